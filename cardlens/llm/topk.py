"""Exact top-k search by inner product, block at a time.

Components become integers floor(64 x). Vectors are dealt into shards and queries into groups; each pair of the two is a
cell of its own. A cell orders its vectors so that similar ones are neighbours and cuts them into blocks; a block keeps
the maximum and minimum of each component (the term maxima of its positive and negative parts) and its vectors as a
forward index. For each query the blocks are taken in descending order of the summed maxima, an upper bound on all scores
in the block, and scored until the bound falls below the query's k-th score so far. A first pass takes each query through
one shard only; the k-th score found there is a floor that goes with the query into all its cells, which then prune from
their first block and give only what reaches the floor, so what is merged by query grows little with the shards.

Defined cases: vectors that are null or hold null or non-finite components, and rows without a vec_id, take no part; rows
of the query's own vec_id count as its own; a vec_id that is there several times is a query for each row, with a list of
its own, and as often a candidate of others; shorter vectors are filled up with zeros; equal scores go to the smaller
vec_id; an empty table gives an empty table; other columns are ignored. Products beyond 2**53 are summed as exact integers;
a score beyond 64 bits is an error.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import python_batches, written

SCALE = 64
BLOCK = 64
#: Most vectors of a shard, queries of a group, and the least number of shards where rows suffice.
SHARD_ROWS, GROUP_ROWS, SHARDS, LEAST_SHARD = 32_768, 4_096, 32, 512
_NONE = np.iinfo(np.int64).min


def vectors(df: DataFrame) -> DataFrame:
    """vec_id and v (array of long) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = df.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    return ok.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _similar_first(x: np.ndarray) -> np.ndarray:
    """An order in which neighbours tend to share their nearest of a few pivots."""
    pivots = x[:: max(1, len(x) // 32)].astype(np.float32)
    near = x.astype(np.float32) @ pivots.T
    best = near.argmax(axis=1)
    return np.lexsort((-near[np.arange(len(x)), best], best))


def search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row of query, vec_id, score) of the k best of x for each query, its own vec_id left out, and how many blocks were scored.

    floors are scores of which each query has k elsewhere (_NONE where unknown): what falls short of them is left out.
    """
    most = int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else object
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    by_id = _similar_first(x)  # places in ids, block after block
    n = len(ids)
    x, q = x[by_id].astype(kind), q.astype(kind)
    starts = np.arange(0, n, BLOCK)
    high, low = np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts)
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    turn = np.argsort(-bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, turn, axis=1)
    # A candidate is one number, score * n + (n - 1 - place): greater is better, and equal scores go to the smaller id.
    known = np.full(len(q), _NONE) if floors is None else floors
    wide = object if max(most, int(np.abs(known[known != _NONE]).max(initial=0))) * n >= 2**62 else np.int64
    none = _NONE if wide is np.int64 else -(2**200)
    floor = np.array([none if f == _NONE else int(f) * n for f in known], wide)
    best = np.full((len(q), k), none, wide)
    own = np.searchsorted(ids, query_ids), np.searchsorted(ids, query_ids, "right")
    active, scored = np.arange(len(q)), 0
    for r in range(len(starts)):
        worst = np.maximum(best[active].min(axis=1), floor[active])
        reached = (bound[active, r] >= worst // n) | (worst == none)
        active = active[reached.astype(bool)]
        if not len(active):
            break
        scored += len(active)
        blocks = turn[active, r]
        by_block = np.argsort(blocks, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(blocks[by_block]) != 0])
        for group in np.split(by_block, cuts[1:]):
            rows, b = active[group], blocks[group[0]]
            place = by_id[b * BLOCK : (b + 1) * BLOCK]
            score = (q[rows] @ x[b * BLOCK : (b + 1) * BLOCK].T).astype(wide) * n + (n - 1 - place)
            score[(place >= own[0][rows, None]) & (place < own[1][rows, None])] = none
            both = np.concatenate([best[rows], score], axis=1)
            best[rows] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:] if wide is np.int64 else np.sort(both, axis=1)[:, -k:]
    at, column = np.nonzero((best != none) & (best >= floor[:, None]))
    found = best[at, column]
    return at, ids[(n - 1 - found % n).astype(np.int64)], (found // n).astype(np.int64), scored


_FOUND = "query long, query_id long, vec_id long, score long"


def _cell(k: int):
    def run(stored: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if stored.empty or asked.empty:
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query", "query_id", "vec_id", "score")})
        width = max(stored.v.map(len).max(), asked.v.map(len).max(), 1)
        at, ids, scores, _ = search(stored.vec_id.to_numpy(), _matrix(stored.v, width), asked.vec_id.to_numpy(), _matrix(asked.v, width), k, asked.floor.to_numpy())
        return pd.DataFrame({"query": asked["query"].to_numpy()[at], "query_id": asked.vec_id.to_numpy()[at], "vec_id": ids, "score": scores})

    return run


def _up_to(n: int):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def top_k(stored: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries the k best rows of stored; both have vec_id and v."""
    python_batches(stored.sparkSession)
    stored, queries = written(stored, "vectors"), written(queries.withColumn("query", F.monotonically_increasing_id()), "queries")
    n, asked = stored.count(), queries.count()
    shards = max(1, math.ceil(n / SHARD_ROWS), min(SHARDS, n // LEAST_SHARD))
    groups = max(1, math.ceil(asked / GROUP_ROWS))
    dealt = stored.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"))
    grouped = queries.select("query", "vec_id", "v", F.pmod(F.xxhash64("query"), F.lit(groups)).alias("group"))
    cells = lambda left, right: left.groupBy("shard", "group").cogroup(right.groupBy("shard", "group")).applyInPandas(_cell(k), _FOUND)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    floors = F.lit(-(2**63)).cast("long").alias("floor")
    if shards > 1:
        home = dealt.filter(F.col("shard") < 1).select("*", _up_to(groups).alias("group"))
        first = cells(home, grouped.select("*", F.lit(0).cast("long").alias("shard"), floors))
        floor = written(first.groupBy("query").agg(F.min("score").alias("floor"), F.count("*").alias("n")).filter(F.col("n") >= k).select("query", "floor"), "floors")
        grouped, floors = grouped.join(floor, "query", "left"), F.coalesce("floor", floors).alias("floor")
    found = cells(dealt.select("*", _up_to(groups).alias("group")), grouped.select("query", "vec_id", "v", "group", floors, _up_to(shards).alias("shard")))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark, sf_dir: str) -> DataFrame:
    rows = vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows, rows.filter("vec_id % 20 = 0"), 20)


OP10_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.n AS query, a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
