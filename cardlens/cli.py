"""python -m cardlens.cli: inspect, stats, sketch {hll,bloom,cms,histogram}, puffin {pack,verify}, bench."""

from __future__ import annotations

import argparse
import json
from pathlib import Path


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()


def _sketch(a) -> bytes:
    from cardlens.operators import bloom, cms, histograms, hll
    from cardlens.sources import tables

    spark = _spark()
    if a.kind == "histogram":
        return histograms.EquiDepth.collect(histograms.equi_depth(tables.csv_numbers(spark, a.csv, a.column), "value", a.buckets)).to_bytes()
    df = tables.csv_column(spark, a.csv, a.column)
    if a.kind == "hll":
        return hll.HllSketch.collect(hll.registers(df, "value", a.precision), a.precision).to_bytes()
    if a.kind == "bloom":
        bits, hashes = bloom.sizing(a.capacity, a.rate)
        return bloom.BloomFilter.collect(bloom.set_bits(df, "value", bits, hashes), bits, hashes).to_bytes()
    return cms.CountMin.collect(cms.counters(df, "value", a.depth, a.width), df.count(), a.depth, a.width).to_bytes()


def main(argv: list[str] | None = None) -> int:
    from cardlens.sources import puffin

    top = argparse.ArgumentParser(prog="cardlens")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("inspect").add_argument("file")
    sub.add_parser("stats").add_argument("store")
    s = sub.add_parser("sketch")
    s.add_argument("kind", choices=["hll", "bloom", "cms", "histogram"])
    s.add_argument("csv")
    s.add_argument("out")
    for flag, default in (("column", 0), ("precision", 12), ("capacity", 10_000), ("depth", 5), ("width", 1024), ("buckets", 64)):
        s.add_argument(f"--{flag}", type=int, default=default)
    s.add_argument("--rate", type=float, default=0.01)
    p = sub.add_parser("puffin").add_subparsers(dest="action", required=True)
    pack = p.add_parser("pack")
    pack.add_argument("out")
    pack.add_argument("blobs", nargs="+", help="kind=file")
    p.add_parser("verify").add_argument("file")
    b = sub.add_parser("bench").add_subparsers(dest="action", required=True)
    b.add_parser("list-queries")
    r = b.add_parser("run")
    r.add_argument("folder")
    r.add_argument("report")
    r.add_argument("--only", nargs="*")
    r.add_argument("--exclude", nargs="*")
    r.add_argument("--trials", type=int, default=1)
    r.add_argument("--timeout", type=float, default=0)
    r.add_argument("--cold", action="store_true")
    r.add_argument("--feedback")
    r.add_argument("--model")
    t = b.add_parser("train")
    t.add_argument("store")
    t.add_argument("model")
    side = b.add_parser("build-puffin")
    side.add_argument("parquet")
    side.add_argument("out")
    b.add_parser("report").add_argument("store")
    for name in ("compare", "calibrate"):
        two = b.add_parser(name, help="two reports of bench run")
        two.add_argument("before")
        two.add_argument("after")
    c = b.add_parser("convert", help="CSV files without header to Parquet")
    c.add_argument("folder")
    c.add_argument("schemas", help="JSON file: table name to schema in DDL")
    a = top.parse_args(argv)
    if a.command == "inspect":
        print(json.dumps(puffin.inspect(Path(a.file).read_bytes()), indent=1))
    elif a.command == "sketch":
        Path(a.out).write_bytes(_sketch(a))
    elif a.command == "puffin" and a.action == "pack":
        kinds = {k.split(".")[1].removesuffix("-v1"): k for k in puffin.decoders()}
        pairs = [x.split("=", 1) for x in a.blobs]
        Path(a.out).write_bytes(puffin.pack([(kinds[k], Path(f).read_bytes()) for k, f in pairs]))
    elif a.command == "puffin":
        print(puffin.verify(Path(a.file).read_bytes()), "blobs")
    elif a.command == "stats" or a.action == "report":
        from cardlens.plans.feedback import FeedbackStore

        store = FeedbackStore(_spark(), a.store)
        rows = store.templates().collect()
        print(json.dumps({"observations": store.count(), "templates": [r.asDict() for r in rows], "latency": store.latencies().first().asDict()}))
    elif a.action == "list-queries":
        from cardlens.queries import registry

        print("\n".join(registry.QUERIES))
    elif a.action == "build-puffin":
        from cardlens.sources.tables import build_sidecar

        Path(a.out).write_bytes(build_sidecar(_spark().read.parquet(a.parquet)))
    elif a.action in ("compare", "calibrate"):
        from cardlens import runner

        print(json.dumps(getattr(runner, a.action)(*map(runner.load_report, (a.before, a.after)))))
    elif a.action == "convert":
        from cardlens.sources.tables import csv_to_parquet

        csv_to_parquet(_spark(), a.folder, json.loads(Path(a.schemas).read_text()))
    elif a.action == "train":
        from cardlens.plans.correctors import GradientBoosted
        from cardlens.plans.feedback import FeedbackStore

        rows = FeedbackStore(_spark(), a.store).all().filter("predicate_count IS NOT NULL")
        GradientBoosted.fit(rows).save(a.model)
    else:
        from cardlens import runner
        from cardlens.plans.correctors import GradientBoosted
        from cardlens.plans.feedback import FeedbackStore
        from cardlens.queries import registry

        spark = _spark()
        store = FeedbackStore(spark, a.feedback) if a.feedback else None
        model = GradientBoosted.load(a.model) if a.model else None
        out = runner.run(spark, registry.QUERIES, a.folder, a.trials, a.only, a.exclude, a.timeout, a.cold, model, store=store, report=a.report)
        print(json.dumps(runner.q_summary(out)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
