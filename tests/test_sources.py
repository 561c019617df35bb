import json
import struct

import pytest
from pyspark.sql import functions as F

from cardlens import cli, sql
from cardlens.operators import histograms, hll
from cardlens.sources import iceberg, portable, puffin, shared, tables


def sidecar(fields=(1,), snapshot=-1, sequence=-1, compress=False):
    writer = puffin.PuffinWriter().with_property(puffin.SCHEMA_VERSION_PROPERTY, "1")
    for f in fields:
        writer.add_blob(puffin.HLL, [f], hll.HllSketch(4, bytes([1] * 16)).to_bytes(), compress, snapshot, sequence)
        writer.add_blob(puffin.EQUI_DEPTH, [f], histograms.EquiDepth([1.0, 2.0, 4.0], [2, 2]).to_bytes(), compress, snapshot, sequence)
    return writer.finish()


@pytest.mark.parametrize("compress", [False, True])
def test_puffin_round_trip(compress):
    data = sidecar((1, 2), 5, 6, compress)
    reader = puffin.PuffinReader(data)
    assert [(b.kind, b.fields, b.snapshot_id, b.sequence_number) for b in reader.blobs] == [(k, [f], 5, 6) for f in (1, 2) for k in (puffin.HLL, puffin.EQUI_DEPTH)]
    assert reader.read(reader.blobs[0]) == hll.HllSketch(4, bytes([1] * 16)).to_bytes()
    assert puffin.verify(data) == 4
    assert puffin.inspect(data)["blobs"][0]["sketch"] == {"precision": 4}


def test_every_cut_and_change_is_refused_or_read():
    data = sidecar()
    for n in range(len(data)):
        with pytest.raises(ValueError):
            puffin.PuffinReader(data[:n])
    for i in range(0, len(data), 3):
        changed = bytearray(data)
        changed[i] ^= 0xFF
        try:
            reader = puffin.PuffinReader(bytes(changed))
            [reader.read(b) for b in reader.blobs]
        except ValueError:
            pass


def test_limits_and_versions():
    data = sidecar()
    with pytest.raises(puffin.PuffinError):
        puffin.PuffinReader(data[:-8] + struct.pack("<I", 1) + data[-4:])
    with pytest.raises(puffin.PuffinError):
        puffin.PuffinReader(puffin.PuffinWriter().with_property(puffin.SCHEMA_VERSION_PROPERTY, "2").finish())
    assert puffin.PuffinReader(puffin.PuffinWriter().finish()).blobs == []
    with pytest.raises(puffin.PuffinError):
        puffin.verify(puffin.PuffinWriter().add_blob("other", [], b"x").finish())
    with pytest.raises(ValueError):
        puffin.pack([(puffin.HLL, b"bad")])


def test_portable_snapshots(tmp_path):
    path = tmp_path / "a.puffin"
    path.write_bytes(sidecar((1, 2), 5, 6))
    assert portable.discover(f"file://{tmp_path}") == [str(path)]
    snapshot = portable.load([f"file://{path}", f"file://{path}"], 5, 6)
    stats = portable.by_schema(snapshot, {1: "id", 2: "name", 3: "more"})
    assert stats["id"].distinct_count == hll.HllSketch(4, bytes([1] * 16)).estimate() and stats["id"].histogram.total == 4
    assert stats["more"] == portable.ColumnStats()
    with pytest.raises(puffin.PuffinError):
        portable.load([str(path)], 5, 7)
    with pytest.raises(ValueError):
        portable.load([str(path)], 5)
    with pytest.raises(puffin.PuffinError):
        portable.by_schema(snapshot, {1: "id"})
    assert portable.by_schema_lenient([str(tmp_path / "none")], {1: "id"}) == {"id": portable.ColumnStats()}
    twice = portable.Snapshot([*snapshot.blobs, snapshot.blobs[0]])
    with pytest.raises(puffin.PuffinError):
        twice.validate()
    portable.Snapshot([portable.Blob("unknown", (1, 2), b"")]).validate()


def test_overrides(spark):
    native, given = portable.ColumnStats(100, 3, 10, 1, 9), portable.ColumnStats(50, None, 20, 0, None)
    assert portable.override(native, given) == portable.ColumnStats(100, 3, 20, 0, 9)
    df = spark.range(5).withColumn("x", F.lit(1))
    blob = portable.Blob(puffin.HLL, (7,), hll.HllSketch(4, bytes([1] * 16)).to_bytes())
    table = portable.StatsTable(df, 5, {}).with_portable(portable.Snapshot([blob]), {7: 1})
    assert table.columns["x"].distinct_count and table.df.count() == 5
    with pytest.raises(ValueError):
        portable.StatsTable(df, 5, {}).with_portable(portable.Snapshot([blob]), {7: 2})


def test_sidecar_of_a_table(spark, sf_dir, tmp_path):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    data = tables.build_sidecar(nation, bloom_columns=("n_nationkey",), bloom_capacity=100, buckets=4)
    (tmp_path / "n.puffin").write_bytes(data)
    assert tables.sidecar_rows(data) == 25
    stats = portable.by_schema(portable.load([str(tmp_path / "n.puffin")]), dict(enumerate(nation.columns, 1)))
    assert stats["n_nationkey"].distinct_count == hll.HllSketch.collect(hll.registers(nation, "n_nationkey"), 12).estimate()
    assert stats["n_regionkey"].distinct_count == 5
    assert portable.load_distributed(spark, str(tmp_path)).count() == len(puffin.PuffinReader(data).blobs)
    sql.install(spark)
    assert spark.sql(f"SELECT count(*) FROM puffin_inspect('{tmp_path}/n.puffin')").first()[0] == len(puffin.PuffinReader(data).blobs)
    assert spark.sql("SELECT hll_count(array(1, 2, 2, NULL, 3)) AS n").first()["n"] == 3


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('1,"a\nb",2.5\n2,"say \\"x\\"",\n')
    df = tables.read_csv(spark, str(tmp_path / "t.csv"), "i int, s string, d double")
    assert [tuple(r) for r in df.collect()] == [(1, "a\nb", 2.5), (2, 'say "x"', None)]
    tables.csv_to_parquet(spark, str(tmp_path), {"t": "i int, s string, d double"})
    assert tables.csv_tables(spark, str(tmp_path), {"t": "i int, s string, d double"})["t"].count() == 2
    (tmp_path / "n.csv").write_text("a, 1.5 \nb,\nc,7\n")
    assert [r["value"] for r in tables.csv_numbers(spark, str(tmp_path / "n.csv"), 1).collect()] == [1.5, 7.0]
    (tmp_path / "bad.csv").write_text("x\n")
    with pytest.raises(Exception, match="not a number"):
        tables.csv_numbers(spark, str(tmp_path / "bad.csv"), 0).collect()
    with pytest.raises(ValueError):
        tables.csv_column(spark, str(tmp_path / "n.csv"), 2)


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "c.csv").write_text("".join(f"{i % 40}\n" for i in range(200)))
    for kind in ("hll", "bloom", "cms", "histogram"):
        assert cli.main(["sketch", kind, str(tmp_path / "c.csv"), str(tmp_path / kind), "--buckets", "5"]) == 0
    assert abs(hll.HllSketch.from_bytes((tmp_path / "hll").read_bytes()).estimate() - 40) <= 1
    names = {"hll": "hll", "bloom": "bloom", "cms": "count-min", "histogram": "equi-depth"}
    cli.main(["puffin", "pack", str(tmp_path / "p.puffin"), *[f"{names[k]}={tmp_path / k}" for k in names]])
    cli.main(["puffin", "verify", str(tmp_path / "p.puffin")])
    cli.main(["inspect", str(tmp_path / "p.puffin")])
    out = capsys.readouterr().out
    assert out.startswith("4 blobs") and len(json.loads(out.split("\n", 1)[1])["blobs"]) == 4
    cli.main(["bench", "list-queries"])
    assert "tpch_q1" in capsys.readouterr().out


def test_synthetic_tables_hold_their_correlation(spark):
    found = tables.synthetic(spark, 0.1)
    assert {n: df.count() for n, df in found.items()} == {"customers": 100, "products": 20, "orders": 1000, "order_items": 3000}
    assert found["orders"].filter("amount > 3000 AND status <> 'delivered' OR amount <= 3000 AND status = 'delivered'").count() == 0
    assert found["order_items"].join(found["orders"], "order_id").count() == 3000


def test_page_cache(sf_dir):
    assert tables.evict_page_cache(sf_dir) >= 14


def test_iceberg_metadata(spark, tmp_path):
    def write(version, hint=None, **known):
        path = f"{place}/metadata/{version}.metadata.json"
        shared.write_text(spark, path, json.dumps({"current-schema-id": 1, "schemas": [{"schema-id": 0, "fields": []}, {"schema-id": 1, "fields": [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}]}]} | known))

    place = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        iceberg.metadata(spark, place)
    write("v1", **{"current-snapshot-id": -1, "snapshots": []})
    assert iceberg.sidecars(iceberg.metadata(spark, place)) == iceberg.Sidecars(None, None, ())
    assert iceberg.column_stats(spark, place) == {"a": portable.ColumnStats(), "b": portable.ColumnStats()}
    for name, data in (("new", sidecar((1,), 7, 2)), ("any", sidecar((2,))), ("old", sidecar((1,), 3, 1)), ("field", sidecar((9,)))):
        shared.write_bytes(spark, f"{place}/{name}.puffin", data)
    snapshots = [{"snapshot-id": 3, "sequence-number": 1}, {"snapshot-id": 7, "sequence-number": 2}]
    files = lambda *names: [{"snapshot-id": 3 if n == "old" else 7, "statistics-path": f"{place}/{n}.puffin"} for n in names]
    write("v2", **{"current-snapshot-id": 7, "snapshots": snapshots, "statistics": files("new", "old", "any", "new")})
    found = iceberg.sidecars(iceberg.metadata(spark, place))
    assert found == iceberg.Sidecars(7, 2, (f"{place}/any.puffin", f"{place}/new.puffin"))
    stats = iceberg.column_stats(spark, place)
    assert stats["a"].distinct_count == stats["b"].distinct_count > 0 and stats["a"].histogram.counts == [2, 2]
    write("00010-abc", **{"current-snapshot-id": 3, "snapshots": snapshots, "statistics": files("old")})
    assert iceberg.column_stats(spark, place)["a"].distinct_count
    shared.write_text(spark, f"{place}/metadata/version-hint.text", "2")
    assert iceberg.sidecars(iceberg.metadata(spark, place)).snapshot_id == 7
    with pytest.raises(puffin.PuffinError):
        iceberg.load(spark, iceberg.Sidecars(7, 2, (f"{place}/old.puffin",)))
    with pytest.raises(puffin.PuffinError):
        portable.by_schema(iceberg.load(spark, iceberg.Sidecars(7, 2, (f"{place}/field.puffin",))), {1: "a"})
