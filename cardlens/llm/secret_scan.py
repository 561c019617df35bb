"""Secret scans over an incremental ledger of blobs, with DataFrame functions only.

Every version of a document is addressed by the SHA-256 of its text. The ledger, two tables in a folder, holds which
blobs have been scanned with which version of the rules, and what was found. A scan reduces the versions to different
blobs, drops the pairs of blob and rules that the ledger holds, scans the rest, appends to the ledger, and joins the
findings of all blobs back to all paths.

A rule's matches are marked in the text by three private characters, and the marked text is cut at the first of them;
the lengths of the pieces, summed up, are the places of the matches. Where the text holds such characters itself, another
private character of the same length takes their place first; no rule matches either.

Defined cases: a null text is the empty text; rows of equal path and text give a row each; a text without findings has
counts of 0, an empty spans string and the digest of the empty string; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path


@dataclass(frozen=True)
class Rule:
    """Matches of head followed by value, if value (or else the whole match) has at least so many characters.

    apart is a class of characters of which none may stand before a match. A rule is to take time in proportion to any
    text: repeats of single characters only, as Java recurses once for each turn of a repeated group, and no second
    start within what a first start has passed over in vain.
    """

    kind: str
    head: str
    value: str
    least_value: int = 0
    least: int = 0
    apart: str = ""

    @property
    def pattern(self) -> str:
        return (f"(?<![{self.apart}])" if self.apart else "") + f"({self.head})({self.value})"


BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", least_value=8),
    Rule("access", "AKIA", "[A-Z0-9]+", least=16),
    Rule("hex", "", "[0-9a-f]{32,}"),  # the same as all runs of hexadecimal digits, the short ones dropped
)
MORE = (
    Rule("pem", "-----BEGIN ", r"(?:[A-Z0-9 ]* )?PRIVATE KEY-----"),
    Rule("jwt", "eyJ", r"[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", apart="A-Za-z0-9_-"),
)
RULES = BASE + MORE
_OPEN, _MIDDLE, _CLOSE, _OTHER = "\ue000", "\ue001", "\ue002", "\ue003"


def rules_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find_spans(texts: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "blob") -> DataFrame:
    """key, kind, rule, start, end of all matches in texts (key, text), key being unique; places in code points."""
    free = F.when(F.col("text").rlike(f"[{_OPEN}-{_CLOSE}]"), F.translate("text", _OPEN + _MIDDLE + _CLOSE, _OTHER * 3)).otherwise(F.col("text"))
    marked = [F.struct(F.lit(i).alias("rule"), F.regexp_replace("text", r.pattern, f"{_OPEN}$1{_MIDDLE}$2{_CLOSE}").alias("marked")) for i, r in enumerate(rules)]
    hits = texts.select(key, free.alias("text")).select(key, F.explode(F.array(*marked)).alias("m")).filter(F.contains("m.marked", F.lit(_OPEN)))
    pieces = hits.select(key, "m.rule", F.posexplode(F.split("m.marked", _OPEN)).alias("pos", "piece"))
    middle, close = F.instr("piece", _MIDDLE), F.instr("piece", _CLOSE)
    sizes = pieces.select(key, "rule", "pos", F.when(F.col("pos") == 0, F.length("piece")).otherwise(F.length("piece") - 2).alias("size"), (close - middle - 1).alias("value"), (close - 2).alias("match"))
    before = Window.partitionBy(key, "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    kinds = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rule") + 1)
    least_value = F.element_at(F.array(*[F.lit(r.least_value) for r in rules]), F.col("rule") + 1)
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("rule") + 1)
    placed = sizes.withColumn("start", F.sum("size").over(before)).filter((F.col("pos") > 0) & (F.col("value") >= least_value) & (F.col("match") >= least))
    return placed.select(key, kinds.alias("kind"), "rule", "start", (F.col("start") + F.col("match")).alias("end"))


class Ledger:
    """The tables scanned (blob, rules) and findings (blob, kind, rule, start, end, rules) under a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame | None:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else None

    def scanned(self) -> DataFrame | None:
        return self._read("scanned", "blob string, rules string")

    def findings(self) -> DataFrame | None:
        return self._read("findings", "blob string, kind string, rule int, start long, end long, rules string")

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scans what is unseen of versions (path, text); kind, rule, start, end by blob for all of them.

        Findings are written before their blobs count as scanned: a scan that broke off is done again, and findings that
        are there twice are taken once.
        """
        version = rules_version(rules)
        text = F.coalesce(F.col("text"), F.lit(""))
        blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
        if (seen := self.scanned()) is not None:
            blobs = blobs.join(seen.filter(F.col("rules") == version), "blob", "left_anti")
        found = find_spans(blobs, rules).withColumn("rules", F.lit(version))
        found.select("blob", "kind", F.col("rule").cast("int"), F.col("start").cast("long"), F.col("end").cast("long"), "rules").write.mode("append").parquet(f"{self.path}/findings")
        seen_now = versions.select(F.sha2(text, 256).alias("blob")).distinct()
        if seen is not None:
            seen_now = seen_now.join(seen.filter(F.col("rules") == version), "blob", "left_anti")
        seen_now.select("blob", F.lit(version).alias("rules")).write.mode("append").parquet(f"{self.path}/scanned")
        return self.findings().filter(F.col("rules") == version).drop("rules").distinct()


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def digests(findings: DataFrame) -> DataFrame:
    """blob, n_assign, n_access, n_hex, base_sha256 and spans."""
    spans = findings.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "rule", "end", "kind"))).alias("all"))
    base = [r.kind for r in BASE]
    return spans.withColumn("base", F.filter("all", lambda s: s["kind"].isin(base))).select(
        "blob",
        *[_count(k).alias(f"n_{k}") for k in base],
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("all").alias("spans"),
    )


def scan_documents(docs: DataFrame, ledger: Ledger) -> DataFrame:
    """A row for each row of docs (doc_id, text) with the digests of its findings."""
    rows = docs.select("doc_id", "text")
    found = ledger.scan(rows)
    path = f"{ledger.path}/digests-{rules_version(RULES)}"
    digests(found).write.mode("overwrite").parquet(path)  # written, so that a blob of very many paths can be split in the join
    by_blob = docs.sparkSession.read.parquet(path)
    paths = rows.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))
    none = F.sha2(F.lit(""), 256)
    joined = paths.join(by_blob, "blob", "left")
    return joined.select("doc_id", *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in BASE], F.coalesce("base_sha256", none).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), Ledger(spark, fresh_path(spark, "ledger")))


def _sql_marked(i: int, r: Rule) -> str:
    before = f"(^|[^{r.apart}])" if r.apart else "()"  # DuckDB's patterns can't look back; the character before is never part of the match before it
    pattern = f"{before}({r.head})({r.value})".replace("'", "''")
    return f"SELECT id, {i} AS rule, '{r.kind}' AS kind, {r.least_value} AS lv, {r.least} AS lm, string_split(regexp_replace(t, '{pattern}', '\\1' || chr(57344) || '\\2' || chr(57345) || '\\3' || chr(57346), 'g'), chr(57344)) AS parts FROM d"


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, translate(coalesce(text, ''), chr(57344) || chr(57345) || chr(57346), repeat(chr(57347), 3)) AS t FROM documents),
m AS ({" UNION ALL ".join(_sql_marked(i, r) for i, r in enumerate(RULES))}),
p AS (SELECT id, rule, kind, lv, lm, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS piece FROM m WHERE len(parts) > 1),
z AS (SELECT *, CASE WHEN i = 1 THEN length(piece) ELSE length(piece) - 2 END AS size, instr(piece, chr(57346)) - instr(piece, chr(57345)) - 1 AS value, instr(piece, chr(57346)) - 2 AS match FROM p),
s AS (SELECT *, sum(size) OVER (PARTITION BY id, rule ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS start FROM z),
f AS (SELECT id, rule, kind, start, start + match AS stop FROM s WHERE i > 1 AND value >= lv AND match >= lm),
g AS (SELECT id, count(*) FILTER (WHERE kind = 'assign') AS a, count(*) FILTER (WHERE kind = 'access') AS k, count(*) FILTER (WHERE kind = 'hex') AS h,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rule) FILTER (WHERE rule < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rule) AS spans FROM f GROUP BY id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (id)
"""
