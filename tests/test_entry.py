import duckdb
import pytest

import __spark_entry__ as driver
from cardlens.queries import registry


def test_entry(spark):
    row = driver.entry(spark).first()
    assert row["sound"] and row["ceiling_degree"] >= row["truth"] > 0


def norm(rows):
    def value(x):
        return None if x is None or x != x else x.isoformat() if hasattr(x, "isoformat") else repr(float(x)) if isinstance(x, float) else str(x)

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def oracle(sf_dir):
    import os

    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_its_oracle(spark, sf_dir, oracle, name):
    df = registry.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name in registry.ORACLE_SQL:
        found = oracle.execute(registry.ORACLE_SQL[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        at = [columns.index(c) for c in df.columns]
        assert norm(rows) == norm([[r[i] for i in at] for r in found.fetchall()])
    else:
        assert rows


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = registry.QUERIES["tpch_q6"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "l_orderkey" not in plan


def test_distributed_sketches_combine_before_the_shuffle(spark, sf_dir):
    plan = registry.QUERIES["hll_registers_bigint"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "Python" not in plan
