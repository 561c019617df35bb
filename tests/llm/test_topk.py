import math

import numpy as np
import pytest

from cardlens.llm import topk

from .util import rows_of, save, with_clashes


def brute(rows, k, every):
    ok = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ok if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_against_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(map(tuple, topk.op10_topk(spark, sf_dir).collect())) == brute(rows, 20, 20)


def test_defined_cases(spark, tmp_path):
    rows = [(i, [0.5, -0.25, i % 3 / 2]) for i in range(0, 50)] + [(60, None), (61, [1.0, None, 2.0]), (62, [float("nan"), 0.0, 0.0]), (63, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (80, [1.0]), (81, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.op10_topk(spark, save(with_clashes(df), tmp_path, "embeddings")).collect())) == brute(rows, 20, 20)
    few = df.filter("vec_id < 5")
    assert sorted(map(tuple, topk.op10_topk(spark, save(few, tmp_path, "embeddings")).collect())) == brute([r for r in rows if r[0] is not None and r[0] < 5], 20, 20)
    assert rows_of(topk.op10_topk(spark, save(df.limit(0), tmp_path, "embeddings"))) == []


@pytest.mark.parametrize("scale", [1, 2**14, 2**28])
def test_search_with_ties_and_large_numbers(scale):
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (700, 6)) * scale
    ids = rng.permutation(700)
    at, got, score, _ = topk.search(ids, x, ids[:40], x[:40], 7)
    found = {}
    for a, g, s in zip(at, got, score, strict=True):
        found.setdefault(int(a), []).append((-int(s), int(g)))
    for a in range(40):
        want = sorted((-sum(int(p) * int(q) for p, q in zip(x[a], x[j], strict=True)), int(ids[j])) for j in range(700) if j != a)[:7]
        assert sorted(found[a]) == want


def test_repeated_ids_count_as_the_querys_own():
    x = np.array([[2], [3], [1]])
    at, got, score, _ = topk.search(np.array([7, 7, 8]), x, np.array([7]), x[:1], 5)
    assert (list(at), list(got), list(score)) == ([0], [8], [2])


def test_repeated_query_rows_have_lists_of_their_own(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-9, 10, 8) / 8]) for i in range(200)]
    rows += [rows[40], (20, [0.5] * 8), (60, rows[60][1]), (60, [-0.25] * 8), (61, rows[61][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = sorted(map(tuple, topk.op10_topk(spark, save(df, tmp_path, "embeddings")).collect()))
    assert out == brute(rows, 20, 20) and len(out) == 14 * 20


def test_shards_and_floors(spark, monkeypatch):
    """Several shards and groups of queries, where floors come from the first shard, against brute force."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-5, 6, 6) / 8]) for i in range(600)]
    for name, n in (("LEAST_SHARD", 40), ("GROUP_ROWS", 7), ("BLOCK", 8)):
        monkeypatch.setattr(topk, name, n)
    x = topk.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, topk.top_k(x, x.filter("vec_id % 20 = 0"), 20).collect())) == brute(rows, 20, 20)
    few = x.filter("vec_id < 50")  # a shard may hold fewer than k
    assert sorted(map(tuple, topk.top_k(few, few.filter("vec_id % 20 = 0"), 20).collect())) == brute(rows[:50], 20, 20)


def test_blocks_below_the_bound_are_not_scored():
    """On clustered vectors most blocks are pruned, the more so with a floor; the results are those of scoring all."""
    rng = np.random.default_rng(8)
    centres = rng.integers(-60, 61, (40, 16))
    x = (centres[rng.integers(0, 40, 8000)] + rng.integers(-4, 5, (8000, 16))).astype(np.int64)
    ids, q = np.arange(8000), x[::100]
    at, got, score, scored = topk.search(ids, x, ids[::100], q, 20)
    blocks = len(q) * -(-len(x) // topk.BLOCK)
    assert scored < blocks / 4
    exact = q @ x.T
    exact[np.arange(len(q)), ids[::100]] = -(2**40)
    for a in range(len(q)):
        assert sorted(score[at == a]) == sorted(np.sort(exact[a])[-20:])
    floors = np.sort(exact, axis=1)[:, -20]
    again = topk.search(ids, x, ids[::100], q, 20, floors)
    assert again[3] <= scored and sorted(zip(*again[:3], strict=True)) == sorted(zip(at, got, score, strict=True))
