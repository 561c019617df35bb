"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Each document draws the exponential key -ln(u) / w from a hash of its doc_id and its quality weight w. A source that is
to give T of its S words gives floor(T / S) whole epochs, then the documents of the smallest keys until the rest of its
budget is used up. The order by key within a source is cut into buckets of a few thousand rows, whose sums are
prefix-summed; only the one bucket in which the budget ends is sorted. No source ever lies in one task.

Defined cases: a null text has 0 words; a null source is a source, ordered last; a null doc_id draws its key as the
string "null"; rows of equal keys (repeated rows) at the end of the budget share what is left by size; a source without
words has target 0; a row without words has no copies; an empty table gives an empty table; columns other than doc_id, source and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_prefix, small, written

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Quality weights lie between this and 1, which bounds how uneven the buckets of keys are.
LEAST_WEIGHT = 0.25
#: Expected rows of a source in one bucket of keys.
BUCKET_ROWS = 4096


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: str = "text") -> Column:
    """From LEAST_WEIGHT for text without letters to 1 for letters alone."""
    letters = F.length(F.regexp_replace(F.col(text), r"\P{L}+", "")) / F.greatest(F.length(text), F.lit(1))
    return F.lit(LEAST_WEIGHT) + F.lit(1 - LEAST_WEIGHT) * F.coalesce(letters, F.lit(0.0))


def exponential_key(doc_id: str, weight: Column) -> Column:
    """-ln(u) / w, u from 52 bits of a digest of doc_id: the same on every run."""
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    return -F.log(u) / weight


def keyed(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """doc_id, source, size and key of each row."""
    return docs.select("doc_id", "source", words().alias("size"), exponential_key("doc_id", quality() if weight is None else weight).alias("key"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n, target: weighted shares of share * all words, filled up to most * the source's words.

    With sources in ascending order of size / weight, the common level is the largest of (words to share less the limits
    of all sources before) / (weights from here on). The windows run over one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rising = Window.orderBy("ratio", "no")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    ranked = sources.withColumn("no", F.row_number().over(by_name)).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("no") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    levels = (
        ranked.withColumn("ratio", F.col("source_size") / F.col("w"))
        .withColumn("before", F.sum("source_size").over(rising.rowsBetween(Window.unboundedPreceding, 0)) - F.col("source_size"))
        .withColumn("rest", F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("level", (F.lit(share) * F.col("total") - F.lit(most) * F.col("before")) / F.col("rest"))
    )
    level = F.max("level").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.select("source", "no", "source_size", "n", F.least(F.lit(most) * F.col("source_size"), F.col("w") * level).alias("target"))


def budgets(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with epochs, and the key at which each source's fractional epoch ends: end_key, end_left words for the rows of that key, which have end_size."""
    size = F.col("source_size")
    budget = F.floor("target").cast("long")
    epochs = F.when(size > 0, F.floor(budget / size).cast("long")).otherwise(0)
    goals = goals.withColumn("epochs", epochs).withColumn("left", budget - F.col("epochs") * size).withColumn("buckets", F.floor(F.col("n") / BUCKET_ROWS) + 1)
    goals = written(goals, "mix-goals")
    uniform = F.lit(1.0) - F.exp(F.lit(-LEAST_WEIGHT) * F.col("key"))
    bucketed = rows.join(small(goals).alias("g"), F.col("g.source").eqNullSafe(rows["source"])).select("no", "buckets", "left", "key", "size", F.least(F.floor(uniform * F.col("buckets")), F.col("buckets") - 1).alias("bucket"))
    sums = bucketed.groupBy("no", "left", "bucket").agg(F.sum("size").alias("sum"))
    up = Window.partitionBy("no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = written(sums.withColumn("start", F.sum("sum").over(up) - F.col("sum")).filter("start <= left and left < start + sum").select(F.col("no").alias("end_no"), F.col("bucket").alias("end_bucket"), "start"), "mix-ends")
    last = bucketed.join(small(ends), (F.col("no") == F.col("end_no")) & (F.col("bucket") == F.col("end_bucket")))
    ties = last.groupBy("no", "left", "start", "key").agg(F.sum("size").alias("sum"))
    up = Window.partitionBy("no").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    cut = ties.withColumn("before", F.col("start") + F.sum("sum").over(up) - F.col("sum")).filter("before <= left and left < before + sum")
    cut = cut.select("no", F.col("key").alias("end_key"), (F.col("left") - F.col("before")).alias("end_left"), F.col("sum").alias("end_size"))
    return written(goals.join(cut, "no", "left"), "mix-budgets")


def taken(rows: DataFrame, plan: DataFrame, columns: list[str]) -> DataFrame:
    """columns of rows with source_size, target, epochs, taken and copies (epochs, and one more for a row of the fractional epoch)."""
    plan = small(plan).alias("p")
    part = F.when(F.col("key") < F.col("end_key"), F.col("size")).when(F.col("key") == F.col("end_key"), F.floor(F.col("end_left") * F.col("size") / F.greatest(F.col("end_size"), F.lit(1))).cast("long")).otherwise(F.lit(0).cast("long"))
    joined = rows.join(plan, F.col("p.source").eqNullSafe(rows["source"]))
    return joined.select(*[rows[c] for c in columns], F.col("source_size"), F.col("target"), F.col("epochs"), (F.col("epochs") * F.col("size") + part).alias("taken"), F.when(F.col("size") > 0, F.col("epochs") + (part > 0).cast("long")).otherwise(0).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken, epochs, copies for each row of docs."""
    rows = written(keyed(docs), "mix-rows")
    plan = budgets(rows, targets(rows, weights, share, most))
    return taken(rows, plan, ["doc_id", "size"])


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it, the row at which a budget ends taken whole.

    The texts are not shuffled: a row's copies follow from its key and its source's budget.
    """
    rows = written(keyed(docs), "mix-rows")
    plan = budgets(rows, targets(rows, weights, share, most)).select("source", "epochs", "end_key", "end_left", "end_size")
    own = free_prefix(docs)
    mine = lambda name: F.col(own + name)
    plan = small(plan).select(*[F.col(c).alias(own + c) for c in plan.columns])
    each = docs.withColumns({own + "key": exponential_key("doc_id", quality()), own + "size": words()})
    joined = each.join(plan, mine("source").eqNullSafe(each["source"]))
    tied = F.floor(mine("end_left") * mine("size") / F.greatest(mine("end_size"), F.lit(1))) > 0
    more = F.when((mine("key") < mine("end_key")) | (mine("key") == mine("end_key")) & tied, 1).otherwise(0)
    copies = F.when(mine("size") > 0, mine("epochs") + more).otherwise(0)
    repeats = F.explode(F.sequence(F.lit(1), copies.cast("int")))
    return joined.filter(copies > 0).select(*[F.col(f"`{c}`") for c in docs.columns], repeats.alias(own + "copy")).drop(own + "copy")


def op2_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / (0.25 + 0.75 * coalesce(length(regexp_replace(text, '\P{L}+', '', 'g'))::DOUBLE / greatest(length(text), 1), 0.0)) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM s),
w AS (SELECT *, [5, 2, 1][((no - 1) % 3 + 1)::INT]::BIGINT AS w FROM r),
l AS (SELECT *, sum(source_size) OVER (ORDER BY source_size / w, no) - source_size AS before,
    sum(w) OVER (ORDER BY source_size / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () AS total FROM w),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size::DOUBLE,
    w::DOUBLE * max((1.5::DOUBLE * total::DOUBLE - 2.0::DOUBLE * before::DOUBLE) / rest::DOUBLE) OVER ()) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
k AS (SELECT source, key, sum(size)::BIGINT AS tied FROM d GROUP BY source, key),
c AS (SELECT source, key, tied, sum(tied) OVER (PARTITION BY source ORDER BY key) - tied AS before FROM k),
p AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, c.tied,
    floor(b.target)::BIGINT - b.epochs * b.source_size - c.before AS room
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.key = d.key),
q AS (SELECT *, CASE WHEN room >= tied THEN size WHEN room > 0 THEN floor(room::DOUBLE * size / greatest(tied, 1))::BIGINT ELSE 0 END AS part FROM p)
SELECT doc_id, size, source_size, target, epochs::BIGINT AS epochs, (epochs * size + part)::BIGINT AS taken, (CASE WHEN size > 0 THEN epochs + CASE WHEN part > 0 THEN 1 ELSE 0 END ELSE 0 END)::BIGINT AS copies FROM q
"""
