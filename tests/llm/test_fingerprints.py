import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cardlens.llm import fingerprint, simhash_dedup

from .util import empty_documents, odd_documents, rows_of, save, with_clashes


def plain_fingerprint(text):
    votes = [0] * 64
    for w in re.split("[ \t-\r]+", (text or "").lower()):
        h, weight = xxhash.xxh64_intdigest(w.encode(), 42), min(len(w), 16) ** 2
        for i in range(64):
            votes[i] += weight if h >> i & 1 else -weight
    return f"{sum(1 << i for i in range(64) if votes[i] > 0):016x}"


def test_edited_texts_against_brute_force(spark, sf_dir):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r["doc_id"])
    texts = [r["text"] or "" for r in docs]
    out = {r["doc_id"]: r for r in fingerprint.op4_fingerprints(spark, sf_dir).collect()}
    assert len(out) == len(docs)
    for i, (d, t) in enumerate(zip(docs, texts, strict=True)):
        q, r, after = len(t) // 4, out[d["doc_id"]], texts[(i + 1) % len(texts)]
        edited = t[: len(t) - q] + after[:q]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (plain_fingerprint(t), plain_fingerprint(edited))
        assert r["near_next"] == 1 - (int(r["fingerprint"], 16) ^ int(out[docs[(i + 1) % len(docs)]["doc_id"]]["fingerprint"], 16)).bit_count() / 64
    assert np.mean([r["near_edited"] > r["near_next"] for r in out.values()]) > 0.95


def test_defined_cases_of_fingerprints(spark, monkeypatch):
    docs = odd_documents(spark)
    out = fingerprint.edited_fingerprints(docs)
    assert out.count() == docs.count()
    assert rows_of(out) == rows_of(fingerprint.edited_fingerprints(with_clashes(docs)))
    assert fingerprint.edited_fingerprints(empty_documents(spark)).count() == 0
    one = fingerprint.edited_fingerprints(docs.filter("doc_id = 1")).first()
    text = docs.filter("doc_id = 1").first()["text"]
    q = len(text) // 4
    assert one["edited_sha256"] == hashlib.sha256((text[: len(text) - q] + text[:q]).encode()).hexdigest()
    monkeypatch.setattr(fingerprint, "CHUNK", 1000)  # long texts are counted in chunks
    assert rows_of(out) == rows_of(fingerprint.edited_fingerprints(docs))


def test_block_tables_find_all_within_the_radius(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63, 60)
    near = [int(b) ^ int(sum(1 << int(j) for j in rng.choice(63, rng.integers(0, 6), replace=False))) for b in base for _ in range(4)]
    fps = [*map(int, base), *near, near[0]]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {(r["query_fp"], r["fp"], r["distance"]) for r in fingerprint.within(df, df, 3, 6).collect()}
    d = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert got == {(a, b, d(a, b)) for a in set(fps) for b in set(fps) if d(a, b) <= 3}


def plain_simhash(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def plain_components(fps, ids):
    label = list(range(len(fps)))
    near = [[j for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 4] for i in range(len(fps))]
    while True:
        new = [min(label[j] for j in near[i]) for i in range(len(fps))]
        if new == label:
            break
        label = new
    groups = {}
    for x, i in zip(label, ids, strict=True):
        groups.setdefault(x, []).append(i)
    least = {x: min((i for i in g if i is not None), default=None) for x, g in groups.items()}
    return [least[x] for x in label]


def test_simhash_components_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    fps, ids = [plain_simhash(r["text"]) for r in docs], [r["doc_id"] for r in docs]
    want = sorted(zip(ids, [f"{f:016x}" for f in fps], plain_components(fps, ids), strict=True))
    assert sorted(map(tuple, simhash_dedup.op3_simhash_dedup(spark, sf_dir).collect())) == want


def test_defined_cases_of_components(spark, tmp_path):
    docs = odd_documents(spark)
    rows = docs.collect()
    fps, ids = [plain_simhash(r["text"]) for r in rows], [r["doc_id"] for r in rows]
    want = sorted(zip(ids, [f"{f:016x}" for f in fps], plain_components(fps, ids), strict=True), key=repr)
    assert rows_of(simhash_dedup.op3_simhash_dedup(spark, save(with_clashes(docs), tmp_path))) == want
    kept = simhash_dedup.near_dedup(with_clashes(docs))
    assert kept.columns == with_clashes(docs).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 3, None, 5, 7, 8, 9], key=repr)
    assert simhash_dedup.components(empty_documents(spark)).count() == 0
    assert simhash_dedup.near_dedup(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("n,flips", [(1500, 3), (300, 12)])
def test_a_crowd_of_near_copies_spans_many_leaves(spark, monkeypatch, n, flips):
    monkeypatch.setattr(simhash_dedup, "LEAF", 32)
    rng = np.random.default_rng(flips)
    centre = int(rng.integers(0, 2**63))
    fps = list({centre ^ sum(1 << int(j) for j in rng.choice(63, rng.integers(0, flips + 1), replace=False)) for _ in range(n)} | {int(x) for x in rng.integers(0, 2**63, 200)})
    edges = simhash_dedup.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    from cardlens.llm.common import connected_components

    root = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    got = [root.get(f, f) for f in fps]
    want = plain_components(fps, fps)
    assert got == want


def test_gray_rank_is_a_permutation_with_neighbours_one_bit_apart():
    x = np.arange(1024, dtype=np.uint64)
    code = x ^ (x >> np.uint64(1))
    assert (simhash_dedup.gray_rank(code) == x).all()


def test_majority_of_many_hashes():
    h = np.random.default_rng(0).integers(0, 2**64, 50_001, dtype=np.uint64)
    want = sum(1 << i for i in range(64) if 2 * int((h >> np.uint64(i) & np.uint64(1)).sum()) > len(h))
    assert simhash_dedup.majority_bits(h) == want


def test_components_of_long_chains(spark):
    from cardlens.llm.common import connected_components

    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).unionByName(spark.createDataFrame([(1000, 1001), (1001, 1001)], "u long, v long"))
    roots = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert roots == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_a_repeated_doc_id_keeps_the_text_of_each_component(spark):
    text = lambda c: " ".join(f"{c}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(1, text("k")), (1, text("l") + " and more"), (5, text("m")), (6, text("m")), (6, text("n")), (7, text("o")), (7, text("o"))]
    kept = simhash_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(kept) == sorted([rows[0], rows[1], rows[2], rows[4], rows[5]], key=repr)


def test_op4_counts_the_neighbours_of_each_fingerprint(spark, tmp_path):
    text = " ".join(f"word{i}{'abcdefgh'[i % 8]}" for i in range(400))
    rows = [(n, f"{text} {' '.join(f'other{j}' for j in range(4 * n))}") for n in range(10)] + [(10, text), (11, "nothing like the others at all"), (12, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = fingerprint.op4_fingerprints(spark, save(docs, tmp_path)).collect()
    fps = {int(r["fingerprint"], 16) for r in out}
    near = {f: sum(0 < (f ^ g).bit_count() <= 3 for g in fps) for f in fps}
    assert len(out) == 13 and any(near.values())
    assert all(r["near_fingerprints"] == near[int(r["fingerprint"], 16)] for r in out)


def test_leaves_of_one_component_are_not_compared(spark, monkeypatch):
    """A large group of near copies: the links connect the same with and without components first, which save most comparisons."""
    monkeypatch.setattr(simhash_dedup, "LEAF", 16)
    rng = np.random.default_rng(12)
    flip = lambda centre, most: centre ^ sum(1 << int(j) for j in rng.choice(64, rng.integers(0, most + 1), replace=False))
    centre, other = (int(x) for x in rng.integers(0, 2**63, 2))
    fps = sorted({flip(centre, 4) for _ in range(1800)} | {flip(other, 9) for _ in range(200)} | {int(x) for x in rng.integers(0, 2**64, 600, np.uint64)})
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    groups, compared, pairs_of = plain_components(fps, list(range(len(fps)))), [], simhash_dedup.leaf_pairs

    def counted(nodes, within):
        compared.append(pairs_of(nodes, within).count())
        return pairs_of(nodes, within)

    monkeypatch.setattr(simhash_dedup, "leaf_pairs", counted)
    for crowded in (0, 10**6):
        monkeypatch.setattr(simhash_dedup, "CROWDED", crowded)
        found = {r["node"] % 2**64: r["root"] for r in simhash_dedup.connected_components(simhash_dedup.links(df)).collect()}
        got = [found.get(f, ("alone", f)) for f in fps]
        assert len(set(zip(got, groups, strict=True))) == len(set(got)) == len(set(groups))
    print("pairs of leaves compared:", compared)
    assert compared[0] < compared[1] / 4
