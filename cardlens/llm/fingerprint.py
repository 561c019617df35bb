"""Document fingerprints: 64-bit SimHash and search in permuted block tables, with DataFrame functions only.

A text's terms are its lower-cased words. Each occurrence votes with the square of the word's length (16 at most) for
the set bits of the word's 64-bit hash and against the others, so rare long words outweigh frequent short ones. Votes
are counted two bits to a long; a text of more than CHUNK words is counted in chunks, whose counts are then added.

Defined cases: a null text is the empty text, whose fingerprint is zero, as is that of any text without words; a null
doc_id is ordered last; rows equal in doc_id and text give equal rows, and the next document is the next different one;
a table of one document is its own next; copies of a document's fingerprint are not its neighbours; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

CHUNK = 2**22
#: Rows of a range of documents when each is to find the next one.
RANGE_ROWS = 20_000
#: Differing bits up to which fingerprints are neighbours, and blocks of their search.
RADIUS, BLOCKS = 3, 6
SPACE = r"[\x20\x09-\x0D]+"


def _votes(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys and fp from keys, pos, word."""
    size = F.least(F.length("word"), F.lit(16)).cast("long")
    hashed = words.select(*keys, F.floor(F.col("pos") / CHUNK).alias("chunk"), F.xxhash64("word").alias("x"), (size * size).alias("w"))
    pairs = [F.sum(F.shiftrightunsigned("x", j).bitwiseAND(F.lit(0x100000001)) * F.col("w")).alias(f"s{j}") for j in range(32)]
    counted = hashed.groupBy(*keys, "chunk").agg(F.sum("w").alias("w"), *pairs)
    low = [F.sum(F.col(f"s{j}").bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"b{j}") for j in range(32)]
    high = [F.sum(F.shiftrightunsigned(f"s{j}", 32)).alias(f"b{j + 32}") for j in range(32)]
    sums = counted.groupBy(*keys).agg(F.sum("w").alias("w"), *low, *high)
    bits = [F.when(F.col(f"b{j}") * 2 > F.col("w"), F.lit(1 << j if j < 63 else -(2**63))).otherwise(F.lit(0)).cast("long") for j in range(64)]
    return sums.select(*keys, reduce(Column.bitwiseOR, bits).alias("fp"))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and fp (long) for each row of texts; keys must be unique or the rows of a key equal."""
    words = texts.select(*keys, F.posexplode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACE)).alias("pos", "word"))
    return _votes(words, keys)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return F.lit(1.0) - distance(a, b) / 64.0


def _block(fp: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))


def _first_table(x: Column, radius: int, blocks: int) -> Column:
    """The first table in which two fingerprints meet whose differing bits are x."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum((1 << edges[i + 1]) - (1 << edges[i]) for i in kept) for kept in combinations(range(blocks), blocks - radius)]
    return F.coalesce(*[F.when(x.bitwiseAND(F.lit(m if m < 2**63 else m - 2**64)) == 0, F.lit(t)) for t, m in enumerate(masks)])


def block_tables(fp: str, radius: int, blocks: int) -> Column:
    """One struct (t, key) for each way to choose the blocks - radius blocks in which a pair within radius must agree.

    The chosen blocks are permuted to the front, as it were: key holds their bits.
    """
    edges = [64 * i // blocks for i in range(blocks + 1)]
    tables = []
    for t, kept in enumerate(combinations(range(blocks), blocks - radius)):
        key, shift = F.lit(0).cast("long"), 0
        for i in kept:
            width = edges[i + 1] - edges[i]
            key = key.bitwiseOR(F.shiftleft(_block(F.col(fp), edges[i], width), shift))
            shift += width
        tables.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    return F.explode(F.array(*tables))


def within(queries: DataFrame, stored: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query_fp, fp, distance): all different fingerprints fp of stored within radius of each different one of queries.

    Copies meet once: both sides are reduced to different fingerprints first, and a pair is kept in its first table only.
    """
    side = lambda df, name: df.select(F.col("fp").alias(name)).distinct().select(name, block_tables(name, radius, blocks).alias("e")).select(name, "e.t", "e.key")
    pairs = side(queries, "query_fp").join(side(stored, "fp"), ["t", "key"])
    near = pairs.withColumn("distance", distance(F.col("query_fp"), F.col("fp"))).filter(F.col("distance") <= radius)
    return near.filter(F.col("t") == _first_table(F.col("query_fp").bitwiseXOR(F.col("fp")), radius, blocks)).select("query_fp", "fp", "distance")


def neighbours(prints: DataFrame) -> DataFrame:
    """near_fp, near_fingerprints: for each different fp that has any, the number of other different ones within RADIUS."""
    fps = written(prints.select("fp").distinct(), "different-fingerprints")
    pairs = within(fps, fps).filter("query_fp <> fp")
    return written(pairs.groupBy(F.col("query_fp").alias("near_fp")).agg(F.count("*").alias("near_fingerprints")), "neighbours")


def next_documents(docs: DataFrame) -> DataFrame:
    """id, k, h, n, copies, nk, nh for each different document (k, h), (nk, nh) being the next one by id."""
    rows = written(docs.select("id", "k", "h", F.length("text").alias("n")).groupBy("id", "k", "h", "n").agg(F.count("*").alias("copies")), "next-rows")
    parts = max(1, math.ceil(rows.count() / RANGE_ROWS))
    order = [F.col("id").isNull(), F.col("id"), F.col("h")]
    ranged = written(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "next-ranged")
    by_id = Window.partitionBy("part").orderBy(*order)
    here = F.struct(F.col("id").isNull().alias("none"), "id", "h", "k")
    firsts = ranged.groupBy("part").agg(F.min(here).alias("first"))
    along = Window.orderBy("part")  # one row for each range
    firsts = written(firsts.select("part", F.coalesce(F.lead("first").over(along), F.first("first").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after")), "next-firsts")
    found = ranged.withColumn("own", F.lead(here).over(by_id)).join(small(firsts), "part").withColumn("next", F.coalesce("own", "after"))
    return written(found.select("id", "k", "h", "n", "copies", F.col("next.k").alias("nk"), F.col("next.h").alias("nh")), "next")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_fingerprints for each row of docs.

    Whole texts are shuffled once, by document; the passage that a document takes from the next one goes to it by a join.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").alias("id"), text.alias("text"))
    base = base.select("id", F.coalesce("id", F.lit(0)).alias("k"), F.xxhash64("text", F.col("id").isNull()).alias("h"), "text")
    chain = next_documents(base)
    base = base.select("k", "h", "text")
    if chain.filter("copies > 1").limit(1).count():
        base = base.dropDuplicates(["k", "h"])
    quarter = F.floor(F.col("n") / 4).cast("int")
    needs = chain.select(F.col("nk").alias("k"), F.col("nh").alias("h"), F.col("k").alias("pk"), F.col("h").alias("ph"), quarter.alias("q"))
    passages = base.join(needs, ["k", "h"]).select(F.col("pk").alias("k"), F.col("ph").alias("h"), "q", F.substring("text", F.lit(1), F.col("q")).alias("passage"))
    both = base.join(passages, ["k", "h"]).withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - F.col("q")), "passage"))
    digest = F.sha2("edited", 256)
    sha = [F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("long").alias(f"sha{i}") for i in range(4)]
    versions = both.select("k", "h", *sha, F.explode(F.array(F.struct(F.lit(False).alias("edited"), "text"), F.struct(F.lit(True).alias("edited"), F.col("edited").alias("text")))).alias("v"))
    shas = [f"sha{i}" for i in range(4)]
    prints = fingerprints(versions.select("k", "h", *shas, "v.edited", "v.text"), ["k", "h", *shas, "edited"])
    prints = prints.groupBy("k", "h", *shas).agg(F.max(F.when(~F.col("edited"), F.col("fp"))).alias("fp"), F.max(F.when(F.col("edited"), F.col("fp"))).alias("efp"))
    prints = written(prints, "fingerprints")
    following = prints.select(F.col("k").alias("nk"), F.col("h").alias("nh"), F.col("fp").alias("nfp"))
    rows = chain.join(prints, ["k", "h"]).join(following, ["nk", "nh"])
    rows = rows.join(small(neighbours(prints)), F.col("fp") == F.col("near_fp"), "left")
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(
        F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_chars"), F.concat(*[hex16(F.col(s)) for s in shas]).alias("edited_sha256"),
        hex16(F.col("fp")).alias("fingerprint"), hex16(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"),
        F.coalesce("near_fingerprints", F.lit(0)).cast("long").alias("near_fingerprints"),
    )


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
