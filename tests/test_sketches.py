import datetime
import math
import random
import struct

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cardlens.functions import hashing
from cardlens.operators import bloom, cms, histograms, hll


@pytest.mark.parametrize("seed", [0, 0xC0FFEE, 0xBEEF, 0x1010D017, 0x1010D017 ^ 7, 2**64 - 1])
def test_seeded_hashes_equal_xxhash(spark, seed):
    df = spark.createDataFrame([(1, "a", 0.5), (-(2**63), "é" * 40, -1e300), (7, "", 2.0)], "i long, s string, d double")
    rows = df.select("*", hashing.xxh64(F.col("i"), seed).alias("hi"), hashing.xxh64(F.col("s"), seed).alias("hs"), hashing.xxh64(F.col("d"), seed).alias("hd")).collect()
    for r in rows:
        for value, found in ((struct.pack("<q", r["i"]), r["hi"]), (r["s"].encode(), r["hs"]), (struct.pack("<d", r["d"]), r["hd"])):
            assert found % 2**64 == xxhash.xxh64_intdigest(value, seed)


def test_canonical_bytes_of_each_type(spark):
    df = spark.createDataFrame([(True, 5, -300, 7, datetime.date(2020, 1, 2), b"xy")], "b boolean, t tinyint, s smallint, i int, d date, y binary")
    row = df.select(*[hashing.xxh64(hashing.canonical(df, c), 0).alias(c) for c in df.columns]).first()
    want = {"b": b"\x01", "t": struct.pack("<b", 5), "s": struct.pack("<h", -300), "i": struct.pack("<i", 7), "d": struct.pack("<i", 18263), "y": b"xy"}
    assert {c: row[c] % 2**64 for c in df.columns} == {c: xxhash.xxh64_intdigest(v) for c, v in want.items()}
    with pytest.raises(TypeError):
        hashing.canonical(spark.range(1).select(F.array(F.lit(1)).alias("a")), "a")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_timestamps_in_any_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("SELECT TIMESTAMP_NTZ '2020-07-01 12:00:00' AS n, TIMESTAMP '2020-07-01 12:00:00 UTC' AS t")
        row = df.select(*[hashing.xxh64(hashing.canonical(df, c), 0).alias(c) for c in "nt"], *[histograms.numeric(df, c).alias(f"v{c}") for c in "nt"]).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    nanos = int(datetime.datetime(2020, 7, 1, 12, tzinfo=datetime.UTC).timestamp()) * 10**9
    assert {row[c] % 2**64 for c in "nt"} == {xxhash.xxh64_intdigest(struct.pack("<q", nanos))} and row["vn"] == row["vt"] == nanos


def plain_registers(values, p):
    out = bytearray(1 << p)
    for v in values:
        h = xxhash.xxh64_intdigest(v)
        rest = (h << p) % 2**64
        i = h >> (64 - p)
        out[i] = max(out[i], 65 - p if not rest else 65 - rest.bit_length())
    return bytes(out)


@pytest.mark.parametrize("p", [4, 12, 18])
def test_hll_registers_estimate_and_floor(spark, p):
    values = [f"user-{i % 700}" for i in range(2000)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v string")
    regs = hll.registers(df, "v", p)
    sketch = hll.HllSketch.collect(regs, p)
    assert sketch.registers == plain_registers({v.encode() for v in values}, p)
    row = hll.estimate(regs, p).first()
    assert (row["estimate"], row["floor"]) == (sketch.estimate(), sketch.distinct_floor())
    assert sketch.distinct_floor() <= 700
    if p > 4:
        assert abs(sketch.estimate() - 700) < 700 * 4 * 1.04 / math.sqrt(1 << p) + 2
    assert hll.HllSketch.from_bytes(sketch.to_bytes()) == sketch and len(sketch.to_bytes()) == 9 + (1 << p)


def test_hll_merge_is_the_union(spark):
    a, b = (spark.range(*r).select(F.col("id").alias("v")) for r in ((0, 500), (300, 900)))
    union = hll.HllSketch.collect(hll.registers(a.union(b), "v"), 12)
    parts = [hll.HllSketch.collect(hll.registers(x, "v"), 12) for x in (a, b)]
    assert parts[0].merge(parts[1]) == union == hll.HllSketch.collect(hll.merge(hll.registers(a, "v"), hll.registers(b, "v")), 12)
    with pytest.raises(ValueError):
        parts[0].merge(hll.HllSketch(4, bytes(16)))


def test_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None,)], "v long")
    assert hll.estimate(hll.registers(df, "v"), 12).first().asDict() == {"estimate": 0, "floor": 0}
    assert cms.max_frequency(cms.counters(df, "v")).first().asDict() == {"bound": None, "saturated": False}
    assert bloom.set_bits(df, "v", 64, 3).count() == 0
    assert histograms.equi_depth(df, "v", 4).count() == 0


#: Payloads of the first version of the format, fixed.
HLL_V1 = "04100000000000000000000400000000020000020002000002"
HISTOGRAM_V1 = "0300000000000000000000000000f03f000000000000004000000000000010400200000000000000020000000000000002000000000000000400000000000000"


def test_frozen_payloads():
    sketch = hll.HllSketch.from_bytes(bytes.fromhex(HLL_V1))
    assert sketch.to_bytes().hex() == HLL_V1 and 3 <= sketch.estimate() <= 7
    h = histograms.EquiDepth.from_bytes(bytes.fromhex(HISTOGRAM_V1))
    assert h.to_bytes().hex() == HISTOGRAM_V1 and (h.total, h.boundaries) == (4, [1.0, 2.0, 4.0])


@given(st.binary(max_size=200))
@settings(max_examples=200, deadline=None)
def test_decoders_refuse_noise(data):
    for kind in (hll.HllSketch, bloom.BloomFilter, cms.CountMin, histograms.EquiDepth, histograms.CorrelatedHistogram):
        try:
            assert kind.from_bytes(data).to_bytes() == data or kind is histograms.EquiDepth
        except ValueError:
            pass


def test_payload_sizes():
    assert len(hll.HllSketch(12, bytes(4096)).to_bytes()) == 4105
    assert len(cms.CountMin(5, 1024, [0] * 5120, 0).to_bytes()) == 20504
    assert len(histograms.EquiDepth([float(i) for i in range(65)], [1] * 64).to_bytes()) == 1056
    assert len(histograms.CorrelatedHistogram(16, 16, (0.0, 1.0, 0.0, 1.0), [0] * 256).to_bytes()) == 2104
    bits, hashes = bloom.sizing(10_000, 0.01)
    assert len(bloom.BloomFilter(bytes(-(-bits // 8)), hashes, bits).to_bytes()) == 12002


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    bits, hashes = bloom.sizing(1000, 0.01)
    df = spark.range(1000).select(F.concat(F.lit("k"), F.col("id")).alias("v"))
    rows = bloom.set_bits(df, "v", bits, hashes)
    whole = bloom.BloomFilter.collect(rows, bits, hashes)
    assert all(whole.contains(f"k{i}".encode()) for i in range(1000))
    assert sum(whole.contains(f"other{i}".encode()) for i in range(5000)) < 150
    probe = spark.createDataFrame([("k1",), ("k999",), ("no-such-key",), (None,)], "v string")
    assert {r["v"]: r["maybe"] for r in bloom.contains(probe, "v", rows, bits, hashes).collect()} == {v: whole.contains(v.encode()) for v in ("k1", "k999", "no-such-key")}
    assert bloom.BloomFilter.from_bytes(whole.to_bytes()) == whole
    assert bloom.lossy_sizing(0, 5.0) == bloom.sizing(1, 0.5)
    with pytest.raises(ValueError):
        bloom.sizing(0, 0.01)
    with pytest.raises(ValueError):
        bloom.sizing(10**12, 1e-9)


def test_count_min_never_undercounts(spark):
    rng = random.Random(3)
    values = [f"v{int(rng.paretovariate(1.1))}" for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    counted = cms.counters(df, "v", 4, 64)
    sketch = cms.CountMin.collect(counted, len(values), 4, 64)
    by_join = {r["v"]: r["estimate"] for r in cms.estimates(df, "v", counted, 4, 64).collect()}
    for v in set(values):
        assert by_join[v] == sketch.estimate(v.encode()) >= values.count(v)
    assert cms.max_frequency(counted).first()["bound"] == sketch.max_frequency_bound() >= max(map(values.count, set(values)))
    assert cms.CountMin.from_bytes(sketch.to_bytes()) == sketch
    assert sketch.merge(sketch).counters == cms.CountMin.collect(cms.merge(counted, counted), 0, 4, 64).counters
    assert cms.CountMin(1, 1, [cms.SATURATED], 0).max_frequency_bound() is None
    assert cms.sizing(0.001, 0.01) == (5, 2719)


@pytest.mark.parametrize("values,b", [(list(range(100)), 8), ([5] * 40 + list(range(10)), 7), ([1, 2], 10), ([3, 3, 3], 2), ([-1.5, 0.0, 2.25, 9.0, 9.0], 4)])
def test_equi_depth_equals_a_sort(spark, values, b):
    got = histograms.EquiDepth.collect(histograms.equi_depth(spark.createDataFrame([(float(v),) for v in values], "v double"), "v", b, range_rows=7))
    s, k = sorted(map(float, values)), min(b, len(values))
    counts = [len(s) // k + (i < len(s) % k) for i in range(k)]
    ends = [sum(counts[: i + 1]) for i in range(k)]
    assert (got.counts, got.boundaries) == (counts, [s[0], *(s[e - 1] for e in ends)])
    assert got.estimate_range(s[0], s[-1]) == len(s)
    assert got.estimate_range(2, 1) == 0


def test_equi_depth_range_in_spark_and_driver(spark):
    df = spark.range(1000).select((F.col("id") * 1.5).alias("v"))
    h = histograms.equi_depth(df, "v", 16)
    whole = histograms.EquiDepth.collect(h)
    for lo, hi in ((0, 1500), (100, 333.3), (-5, 10), (700, 700), (5, 1)):
        assert histograms.range_estimate(h, lo, hi).first()["estimate"] == whole.estimate_range(lo, hi)
    for bad in (([1.0, 2.0], [1]), ([1.0, 3.0, 2.0], [1, 1]), ([1.0, math.nan, 2.0], [1, 1])):
        with pytest.raises(ValueError):
            histograms.EquiDepth(*bad)


def test_grid_never_underestimates(spark):
    rng = random.Random(5)
    pairs = [(x := rng.random() * 10, x * 2 + rng.random()) for _ in range(500)] + [(math.nan, 1.0), (math.inf, 1.0), (None, 2.0)]
    df = spark.createDataFrame(pairs, "a double, b double")
    layout = histograms.grid_layout(df, "a", "b")
    cells = histograms.grid(df, "a", "b", 8, 8, layout)
    h = histograms.CorrelatedHistogram.collect(cells, 8, 8, layout)
    assert h.total == 500 and histograms.CorrelatedHistogram.from_bytes(h.to_bytes()) == h
    for _ in range(100):
        a, b = sorted(rng.random() * 12 - 1 for _ in range(2)), sorted(rng.random() * 24 - 1 for _ in range(2))
        true = sum(a[0] <= x <= a[1] and b[0] <= y <= b[1] for x, y in pairs[:500])
        assert h.estimate_range(*a, *b) >= true
    assert h.merge(h).total == 1000
    empty = histograms.CorrelatedHistogram(8, 8, (0.0, 0.0, 0.0, 0.0), [0] * 64)
    assert empty.merge(h) is h
    with pytest.raises(ValueError):
        h.merge(histograms.CorrelatedHistogram(4, 16, layout, [0] * 64))


def test_equi_depth_ranges_hold_about_equally_many_values_whatever_their_spread(spark):
    """One far value does not push all others into one range; ranks are those of one sort."""
    import numpy as np

    from cardlens.operators import ranks

    x = np.r_[np.random.default_rng(3).normal(0, 1, 5000), 1e15, -1e300, [7.0] * 3000].tolist()
    df = spark.createDataFrame([(v,) for v in x] + [(None,)], "v double")
    found = sorted(ranks.ranked(df, F.col("v"), 50).collect(), key=lambda r: r["v"])
    order, counts = np.unique(x, return_counts=True)
    last = np.cumsum(counts)
    assert [(r["v"], r["c"], r["first"], r["last"], r["n"]) for r in found] == [(v, c, e - c + 1, e, len(x)) for v, c, e in zip(order.tolist(), counts.tolist(), last.tolist(), strict=True)]
    bounds = sorted({order[i] for i in range(40, len(order), 50)})
    placed = df.filter("v IS NOT NULL").select(ranks._range(F.col("v"), [float(b) for b in bounds]).alias("p"), "v").collect()
    assert all(r["p"] == int(np.searchsorted(bounds, r["v"])) for r in placed)
    narrow, wide = (histograms.EquiDepth.collect(histograms.equi_depth(df, "v", 16, n)) for n in (40, 10**6))
    assert narrow == wide and narrow.total == len(x)


def test_bloom_positions_in_halves_equal_whole_numbers(spark):
    import struct

    import xxhash

    values = [0, 1, -1, 2**62, -(2**63), 12345678901]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for bits, hashes in ((64, 1), (9586, 7), (2**33, 30), (2**33 - 9, 5)):
        out = {r["v"]: r["p"] for r in df.select("v", bloom.positions(F.col("v"), bits, hashes).alias("p")).collect()}
        for v in values:
            h1, h2 = (xxhash.xxh64_intdigest(struct.pack("<q", v), s) for s in bloom.SEEDS)
            assert out[v] == [(h1 + i * h2) % 2**64 % bits for i in range(hashes)]
    with pytest.raises(ValueError):
        bloom.BloomFilter.collect(spark.createDataFrame([], "bit long"), 2**31, 3)
