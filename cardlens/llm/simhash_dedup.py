"""Near-duplicates by SimHash and a hierarchical index in Gray order.

Fingerprints: bit i of a text's fingerprint is set if it is set in over half of the XXH64 hashes (seed 42) of its 4-word
shingles. Different fingerprints that differ in RADIUS bits or fewer are linked.

Index: with blocks of the 64 bits, a linked pair agrees in some blocks - RADIUS of them; those bits are the topmost
pattern. Under each such pattern, fingerprints are sorted by Gray rank, range-partitioned (so a pattern with very many
of them spans tasks) and cut into leaves of LEAF. A leaf factors out what its fingerprints share: a mask of constant
bits and their values. Pairs within a leaf are compared directly; pairs of leaves under one pattern are pruned as a
whole where the differences accumulated in their shared constant bits exceed RADIUS, and compared otherwise. Only a
spanning forest of what a comparison finds is emitted, never all pairs.

A pattern of more than CROWDED leaves is that of a large group of near copies, whose leaves are too alike to be pruned by
bits. There the links within leaves, of all patterns, are made components first; a leaf that is linked up in itself
belongs to one of them, and leaves of one component need no comparison. All leaves of a pattern but those of its largest
component are paired with the rest, so pairs grow with the leaves, not with their square. Only the work differs, not the result.

Defined cases: a null or empty text, or one without words, has fingerprint zero and is linked to all such; fewer than 4
words make one shingle; repeated rows are copies; a null doc_id is never a component's id unless there is no other (then
component_id is null); an empty table gives an empty table; other columns are ignored, and kept by near_dedup.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, free_prefix, python_batches, row_id, written

RADIUS = 4
SHINGLE = 4
LEAF = 512
#: Leaves of one pattern from which on components are made first.
CROWDED = 32
_LANES = np.uint64(0x0101010101010101)
_BATCH = 255 * 64


def shingle_hashes(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of each n-word shingle, words being ASCII-lower-cased and split at ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)) if len(words) > n else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; counted in bytes, at most 255 to a byte."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _BATCH):
        part = hashes[start : start + _BATCH]
        part = np.concatenate([part, np.zeros(-len(part) % 255, np.uint64)]).reshape(255, -1)
        for j in range(8):
            lanes = ((part >> np.uint64(j)) & _LANES).sum(axis=0)
            ones[j::8] += np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in range(64) if 2 * ones[i] > len(hashes)))


def _fingerprint(texts: pd.Series) -> pd.Series:
    found = np.array([majority_bits(shingle_hashes(t)) for t in texts], np.uint64)
    return pd.Series(found.view(np.int64))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence, where neighbours differ in one bit."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _gray_rank_column(fp):
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp


def masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """The bit patterns in one of which any pair within radius must agree."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in kept) for kept in combinations(range(blocks), blocks - radius)]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges a-b, the smallest node that each reaches."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != label[label]).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _star(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links a-b as a spanning forest: fingerprint and its root, roots left out."""
    used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = _forest(len(used), at[: len(a)], at[len(a) :])
    leaf = label != np.arange(len(used))
    return fps[used[leaf]], fps[used[label[leaf]]]


_INDEXED = pa.schema([("t", pa.int32()), ("pattern", pa.int64()), ("leaf", pa.string()), ("shared", pa.int64()), ("const", pa.int64()), ("rep", pa.int64()), ("fps", pa.binary()), ("u", pa.int64()), ("v", pa.int64())])
_INDEXED_DDL = "t int, pattern long, leaf string, shared long, const long, rep long, fps binary, u long, v long"


def _rows(**columns: list) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _INDEXED], schema=_INDEXED)


def _leaves(t: np.ndarray, p: np.ndarray, x: np.ndarray, name: Iterator[str], size: int) -> Iterator[pa.RecordBatch]:
    """Links within the leaves of sorted rows; the leaves themselves where their pattern may have others."""
    group = np.cumsum(np.r_[True, (t[1:] != t[:-1]) | (p[1:] != p[:-1])]) - 1
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    within = (np.arange(len(x)) - start[group]) // size
    leaf = np.cumsum(np.r_[True, (group[1:] != group[:-1]) | (within[1:] != within[:-1])]) - 1
    a, b, d, at = [], [], 1, np.arange(len(x))
    while len(at := at[at + d < len(x)]) and len(at := at[leaf[at] == leaf[at + d]]):
        near = at[np.bitwise_count(x[at] ^ x[at + d]) <= RADIUS]
        a.append(near)
        b.append(near + d)
        d += 1
    parts = np.bincount(leaf) - 1  # links that a leaf lacks to be one
    if any(map(len, a)):
        a, b = np.concatenate(a), np.concatenate(b)
        label = _forest(len(x), a, b)
        child = np.flatnonzero(label != np.arange(len(x)))
        parts -= np.bincount(leaf[child], minlength=len(parts))
        yield _rows(u=x[child].view(np.int64), v=x[label[child]].view(np.int64))
    begins = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
    ends = np.r_[begins[1:], len(x)]
    several = np.bincount(group[begins])[group[begins]] > 1
    several |= (group[begins] == 0) | (group[begins] == group[-1])  # may go on beyond these rows
    begins, ends = begins[several], ends[several]
    every = np.array([np.bitwise_and.reduce(x[i:j]) for i, j in zip(begins, ends, strict=True)], np.uint64)
    some = np.array([np.bitwise_or.reduce(x[i:j]) for i, j in zip(begins, ends, strict=True)], np.uint64)
    const = ~(every ^ some)
    rep = pa.array(x[begins].view(np.int64), mask=parts[several] > 0)
    yield _rows(rep=rep, t=t[begins], pattern=p[begins], leaf=[next(name) for _ in begins], shared=(every & const).view(np.int64), const=const.view(np.int64), fps=[x[i:j].tobytes() for i, j in zip(begins, ends, strict=True)])


def _index(size: int):
    """Of a partition sorted by t, pattern and Gray rank: links within leaves of that size, and the leaves; a pattern that is cut between two lots of rows has its leaves listed from both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = (f"{part}-{i}" for i in count())
        held: list[tuple] = []
        for batch in batches:
            held.append((batch["t"].to_numpy(), batch["pattern"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)))
            if sum(len(x) for _, _, x in held) >= 64 * size:
                t, p, x = map(np.concatenate, zip(*held, strict=True))
                cut = len(x) // size * size
                yield from _leaves(t[:cut], p[:cut], x[:cut], name, size)
                held = [(t[cut:], p[cut:], x[cut:])]
        if any(len(x) for _, _, x in held):
            yield from _leaves(*map(np.concatenate, zip(*held, strict=True)), name, size)

    return run


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between two leaves."""
    for df in frames:
        for left, right in zip(df.fps, df.other, strict=True):
            x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            a, b = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= RADIUS)
            if len(a):
                u, v = _star(np.concatenate([x, y]), a, b + len(x))
                yield pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})


def leaf_pairs(nodes: DataFrame, within: DataFrame) -> DataFrame:
    """leaf, leaf2: what is to be compared, each pair once for each pattern."""
    key = ["t", "pattern"]
    sizes = nodes.groupBy(*key).agg(F.count("*").alias("leaves"))
    crowded = sizes.filter(F.col("leaves") > CROWDED).select(*key)
    named = nodes.withColumns({"comp": F.lit(None).cast("long"), "main": F.lit(None).cast("long")})
    if crowded.limit(1).count():
        roots = written(connected_components(within), "leaf-roots")
        comp = F.coalesce("root", "rep").alias("comp")
        named = nodes.join(roots, F.col("rep") == F.col("node"), "left").select(*nodes.columns, comp)
        most = named.join(crowded, key, "left_semi").filter("comp IS NOT NULL").groupBy(*key, "comp").agg(F.count("*").alias("k"))
        most = most.groupBy(*key).agg(F.max(F.struct("k", "comp")).alias("best")).select(*key, F.col("best.comp").alias("main"))
        named = written(named.join(most, key, "left"), "named-leaves")
    rest = F.col("comp").isNull() | F.col("main").isNull() | (F.col("comp") != F.col("main"))
    named = named.withColumn("rest", rest)
    others = named.filter("rest").select(*key, *[F.col(c).alias(f"{c}2") for c in ("leaf", "shared", "const", "comp")])
    apart = F.bit_count(F.col("shared").bitwiseXOR(F.col("shared2")).bitwiseAND(F.col("const")).bitwiseAND(F.col("const2")))
    once = (F.col("leaf") < F.col("leaf2")) | (~F.col("rest"))
    linked = F.coalesce(F.col("comp") == F.col("comp2"), F.lit(False))
    return named.join(others, key).filter(once & (apart <= RADIUS) & ~linked).select("leaf", "leaf2")


def links(fps: DataFrame, blocks: int | None = None) -> DataFrame:
    """(u, v): edges that connect just the fingerprints (column fp, all different) that links connect."""
    spark = fps.sparkSession
    n = fps.count()
    blocks = blocks or (5 if n < 2**24 else 6 if n < 2**30 else 7)
    pattern = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m if m < 2**63 else m - 2**64)).alias("pattern")) for t, m in enumerate(masks(blocks))]))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 100_000)
    rows = fps.select("fp", pattern.alias("e")).select("e.t", "e.pattern", "fp", _gray_rank_column(F.col("fp")).alias("rank"))
    order = ["t", "pattern", F.shiftrightunsigned("rank", 1), "rank"]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("t", "pattern", "fp")
    indexed = written(ranged.mapInArrow(_index(LEAF), _INDEXED_DDL), "gray-index")
    within = indexed.filter("u IS NOT NULL").select("u", "v")
    nodes = indexed.filter("leaf IS NOT NULL").select("t", "pattern", "leaf", "shared", "const", "rep")
    pairs = leaf_pairs(nodes, within)
    content = indexed.filter("leaf IS NOT NULL").select("leaf", "fps")
    loaded = pairs.join(content, "leaf").join(content.select(F.col("leaf").alias("leaf2"), F.col("fps").alias("other")), "leaf2").select("fps", "other")
    return within.unionByName(loaded.mapInPandas(_compare, "u long, v long"))


def _rooted(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, fp, component_id, root (one fingerprint for each component) and columns more for each row of docs."""
    python_batches(docs.sparkSession)
    prints = written(docs.select("doc_id", *more, F.pandas_udf(_fingerprint, "long")("text").alias("fp")), "simhash")
    firsts = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-different")
    roots = written(connected_components(links(firsts.select("fp"))), "simhash-roots")
    member = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = member.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = written(member.select("fp", "root").join(ids, "root").select("fp", "root", "component_id"), "simhash-classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id", "root", *more)


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for each row of docs, which has doc_id and text."""
    return _rooted(docs).select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, with the columns of docs: that of the smallest doc_id, of its texts there the longest."""
    ids = docs.select(row_id().alias("doc_id"), "text", F.xxhash64("text").alias("tx"), F.coalesce(-F.length("text"), F.lit(1)).alias("shortness"))
    firsts = _rooted(ids, "tx", "shortness").filter("doc_id = component_id").groupBy("root")
    kept = firsts.agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("shortness", "tx")).alias("best"), F.count("*").alias("copies"))
    kept = written(kept.select("doc_id", F.col("best.tx").alias("tx"), "copies"), "simhash-kept")
    own = free_prefix(docs)
    mine = lambda name: F.col(own + name)
    keys = kept.select(F.col("doc_id").alias(own + "kept_id"), F.col("tx").alias(own + "kept_tx")).hint("shuffle_hash")  # the same plan at every size: the ids grow with the documents
    found = docs.withColumns({own + "id": row_id(), own + "tx": F.xxhash64("text")})
    found = found.join(keys, (mine("id") == mine("kept_id")) & (mine("tx") == mine("kept_tx")), "left_semi")
    if kept.filter("copies > 1").limit(1).count():
        rank = Window.partitionBy(own + "id", own + "tx").orderBy(own + "tx")
        found = found.withColumn(own + "rank", F.row_number().over(rank)).filter(mine("rank") == 1)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
