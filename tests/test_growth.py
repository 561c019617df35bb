"""Queries on tables that grew: keys shifted for each copy, as in the driver's larger tables."""

import math

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cardlens.plans import capture
from cardlens.queries import registry, relational, sketch_queries, statistics
from cardlens.sources.tables import TABLES


@pytest.fixture(scope="module")
def many_people(spark, sf_dir, tmp_path_factory):
    """40 copies of customers and suppliers; orders and lineitems stay."""
    out = str(tmp_path_factory.mktemp("many-people"))
    for t in TABLES:
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        if t in ("customer", "supplier"):
            key, n = df.columns[0], df.count()
            df = df.crossJoin(spark.range(40)).withColumn(key, F.col(key) + F.col("id") * n).drop("id")
        df.coalesce(1).write.parquet(f"{out}/{t}.parquet")
    return out


@pytest.mark.parametrize("name", sorted(relational.FROM))
def test_customers_meet_suppliers_by_way_of_orders(spark, many_people, name):
    df = registry.QUERIES[name](spark, many_people)
    rows = df.collect()
    most = max(n.rows or 0 for n in capture.joins(capture.physical(df)))
    assert 0 < most <= spark.read.parquet(f"{many_people}/lineitem.parquet").count()
    oracle = duckdb.connect()
    for t in TABLES:
        oracle.execute(f"CREATE VIEW {t} AS SELECT * FROM '{many_people}/{t}.parquet/*.parquet'")
    assert [tuple(r) for r in rows] == oracle.execute(registry.ORACLE_SQL[name]).fetchall()


@pytest.fixture
def times(monkeypatch):
    """Lets a module measure k times the rows and the distinct values that its tables have, one rows list for each call."""
    def set_up(module, k):
        real, seen = sketch_queries.measured, []

        def more(*args):
            found = [Row(**r.asDict() | {n: r[n] * k for n in ("rows", "distinct", "n")}) for r in real(*args)]
            seen.append([r["n"] for r in found])
            return found

        monkeypatch.setattr(module, "measured", more)
        return seen

    return set_up


def test_chain_ceiling_beyond_64_bits(spark, sf_dir, times):
    plain = registry.QUERIES["join_ceiling_chain3"](spark, sf_dir).first()
    seen = times(sketch_queries, 10**7)
    row = registry.QUERIES["join_ceiling_chain3"](spark, sf_dir).first()
    c, o, _, l = map(float, seen[0])
    assert row["product"] == c * o * l > 2**64
    assert (row["ceiling"], row["truth"], row["sound"]) == (plain["ceiling"] * 10**7, plain["truth"], True)


def test_cycle_beyond_64_bits(spark, sf_dir, times):
    plain = registry.QUERIES["join_ceiling_cycle"](spark, sf_dir).first()
    seen = times(sketch_queries, 10**6)
    assert tuple(registry.QUERIES["join_ceiling_cycle"](spark, sf_dir).first()) == tuple(plain) == (plain["truth"], True, True)
    assert math.prod(seen[0][::2]) > 2**64


def test_chain_bound_beyond_64_bits(spark, sf_dir, times):
    plain = registry.QUERIES["chain_bound"](spark, sf_dir).first()
    assert plain["agm"] < 2**64
    seen = times(statistics, 10**7)
    row = registry.QUERIES["chain_bound"](spark, sf_dir).first()
    c, o, _, l = map(float, seen[0])
    assert row["agm"] == c * o * l > 2**64 and row["clamped"] == l
