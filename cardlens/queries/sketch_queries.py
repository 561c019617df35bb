"""Sketches, bounds, feedback and filters over the driver's tables, with oracles that hash in SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cardlens.operators import bloom, cms, histograms, hll
from cardlens.plans import feedback
from cardlens.plans.filters import strategy_column
from cardlens.sources.tables import table

_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_W = 18446744073709551616


def _t(spark, sf_dir, name):
    return table(spark, sf_dir, name)


def hash_ctes(values: str, seeds: list[int]) -> str:
    """SQL: CTEs ending in hashed(v, seed, h), the unsigned XXH64 of the bigint column v of (values) under each seed."""
    rotl = lambda x, n: f"(({x} * {2**n}::UHUGEINT) % {_W}::UHUGEINT + {x} // {2 ** (64 - n)}::UHUGEINT)"
    mul = lambda x, p: f"(({x} * {p}::UHUGEINT) % {_W}::UHUGEINT)"
    seed_rows = ", ".join(f"({s % 2**64}::UHUGEINT)" for s in seeds)
    return f"""vals AS ({values}), seeds(seed) AS (VALUES {seed_rows}),
h0 AS (SELECT v, seed, (seed + {_P5}::UHUGEINT + 8) % {_W}::UHUGEINT AS a, {mul(f"(CASE WHEN v < 0 THEN (v::HUGEINT + {_W}::HUGEINT)::UHUGEINT ELSE v::UHUGEINT END)", _P2)} AS k FROM vals, seeds),
h1 AS (SELECT v, seed, xor(a, {mul(rotl("k", 31), _P1)}) AS a FROM h0),
h2 AS (SELECT v, seed, ({mul(rotl("a", 27), _P1)} + {_P4}::UHUGEINT) % {_W}::UHUGEINT AS a FROM h1),
h3 AS (SELECT v, seed, {mul(f"xor(a, a // {2**33}::UHUGEINT)", _P2)} AS a FROM h2),
h4 AS (SELECT v, seed, {mul(f"xor(a, a // {2**29}::UHUGEINT)", _P3)} AS a FROM h3),
hashed AS (SELECT v, seed, xor(a, a // {2**32}::UHUGEINT) AS h FROM h4)"""


def registers_sql(values: str, p: int) -> str:
    rest = f"((h * {2**p}::UHUGEINT) % {_W}::UHUGEINT)"
    rho = f"CASE WHEN {rest} = 0 THEN {65 - p} ELSE 65 - length(ltrim(bin({rest}::UBIGINT), '0')) END"
    return f"WITH {hash_ctes(values, [0])}, regs AS (SELECT (h // {2 ** (64 - p)}::UHUGEINT)::INT AS idx, max(({rho})::INT) AS rho FROM hashed GROUP BY 1)"


def estimate_sql(p: int) -> str:
    m = 1 << p
    raw = f"{hll.alpha(m) * m * m!r}::DOUBLE / (sum(pow(2.0::DOUBLE, -rho)) + ({m} - count(*)))"
    return f"SELECT floor(CASE WHEN {raw} <= {2.5 * m!r} AND count(*) < {m} THEN {float(m)!r} * ln({float(m)!r} / ({m} - count(*))) ELSE {raw} END)::BIGINT AS estimate, count(*) AS floor FROM regs"


ORDER_KEYS, CUSTOMER_KEYS = "SELECT o_orderkey AS v FROM orders", "SELECT o_custkey AS v FROM orders"
QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("hll_registers_bigint", f"{registers_sql(ORDER_KEYS, 12)} SELECT idx, rho FROM regs")
def _(spark, d):
    return hll.registers(_t(spark, d, "orders"), "o_orderkey", 12)


@query("hll_estimate_bigint", f"{registers_sql(ORDER_KEYS, 12)} {estimate_sql(12)}")
def _(spark, d):
    return hll.estimate(hll.registers(_t(spark, d, "orders"), "o_orderkey", 12), 12)


@query("hll_floor", f"{registers_sql(CUSTOMER_KEYS, 10)} SELECT count(*) AS floor FROM regs")
def _(spark, d):
    return hll.estimate(hll.registers(_t(spark, d, "orders"), "o_custkey", 10), 10).select("floor")


@query("hll_merge", f"{registers_sql('SELECT o_custkey AS v FROM orders UNION ALL SELECT c_custkey FROM customer', 12)} {estimate_sql(12)}")
def _(spark, d):
    return hll.estimate(hll.merge(hll.registers(_t(spark, d, "orders"), "o_custkey"), hll.registers(_t(spark, d, "customer"), "c_custkey")), 12)


@query("hll_estimate_by_group", None)
def _(spark, d):
    return hll.estimate(hll.registers(_t(spark, d, "events"), "props", 12, ["event_type"]), 12, ["event_type"])


_CMS = f"WITH {hash_ctes(CUSTOMER_KEYS, [cms.SEED ^ r for r in range(5)])}, counted AS (SELECT xor(seed::UBIGINT, {cms.SEED}::UBIGINT)::INT AS row, (h % 1024)::BIGINT AS pos, least(count(*), 4294967295)::BIGINT AS cnt, FROM hashed GROUP BY 1, 2)"


@query("cms_counters_bigint", f"{_CMS} SELECT row, pos, cnt FROM counted")
def _(spark, d):
    return cms.counters(_t(spark, d, "orders"), "o_custkey")


@query("cms_point_estimate", f"{_CMS} SELECT v AS c_custkey, min(cnt) AS estimate FROM (SELECT DISTINCT v, xor(seed::UBIGINT, {cms.SEED}::UBIGINT)::INT AS row, (h % 1024)::BIGINT AS pos FROM hashed) JOIN counted USING (row, pos) GROUP BY v")
def _(spark, d):
    orders = _t(spark, d, "orders")
    return cms.estimates(orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", cms.counters(orders, "o_custkey"))


@query("cms_max_bound", f"{_CMS} SELECT max(cnt) AS bound, false AS saturated FROM counted")
def _(spark, d):
    return cms.max_frequency(cms.counters(_t(spark, d, "orders"), "o_custkey"))


@query("cms_merge", f"{_CMS} SELECT row, pos, 2 * cnt AS cnt FROM counted")
def _(spark, d):
    one = cms.counters(_t(spark, d, "orders"), "o_custkey")
    return cms.merge(one, one)


_BITS, _HASHES = bloom.sizing(20_000, 0.01)


@query("bloom_bits_bigint", f"WITH {hash_ctes(CUSTOMER_KEYS, [bloom.SEEDS[0]])}, a AS (SELECT DISTINCT v, h AS h1 FROM hashed), {hash_ctes('SELECT DISTINCT v FROM a', [bloom.SEEDS[1]]).replace('vals', 'vals2').replace('seeds', 'seeds2').replace('h0', 'g0').replace('h1 AS (', 'g1 AS (').replace('FROM h1', 'FROM g1').replace('h2', 'g2').replace('h3', 'g3').replace('h4', 'g4').replace('hashed', 'hashed2')} SELECT DISTINCT ((h1 + i::UHUGEINT * h) % {_W}::UHUGEINT % {_BITS}::UHUGEINT)::BIGINT AS bit FROM a JOIN hashed2 USING (v), range({_HASHES}) r(i)")
def _(spark, d):
    return bloom.set_bits(_t(spark, d, "orders"), "o_custkey", _BITS, _HASHES)


@query("bloom_no_false_negatives", "SELECT count(DISTINCT o_custkey) AS keys, count(DISTINCT o_custkey) AS found FROM orders")
def _(spark, d):
    orders = _t(spark, d, "orders")
    found = bloom.contains(orders, "o_custkey", bloom.set_bits(orders, "o_custkey", _BITS, _HASHES), _BITS, _HASHES)
    return found.agg(F.count("*").alias("keys"), F.sum(F.col("maybe").cast("long")).alias("found"))


_TILES = "WITH t AS (SELECT o_totalprice AS v, ntile(64) OVER (ORDER BY o_totalprice) AS bucket FROM orders), b AS (SELECT bucket::INT AS bucket, count(*) AS count, max(v) AS high, min(v) AS least FROM t GROUP BY bucket), h AS (SELECT bucket, count, coalesce(lag(high) OVER (ORDER BY bucket), least) AS low, high FROM b)"


@query("equidepth_buckets", f"{_TILES} SELECT * FROM h")
def _(spark, d):
    return histograms.equi_depth(_t(spark, d, "orders"), "o_totalprice", 64)


@query("equidepth_range", f"{_TILES} SELECT floor(sum(CASE WHEN low >= 50000 AND high <= 150000 THEN count WHEN high < 50000 OR low > 150000 THEN 0 ELSE count * greatest(least(high, 150000.0::DOUBLE) - greatest(low, 50000.0::DOUBLE), 0) / greatest(high - low, 2.220446049250313e-16) END))::BIGINT AS estimate FROM h")
def _(spark, d):
    return histograms.range_estimate(histograms.equi_depth(_t(spark, d, "orders"), "o_totalprice", 64), 50000.0, 150000.0)


_GRID = "WITH m AS (SELECT min(l_quantity) a, max(l_quantity) b, min(l_extendedprice) c, max(l_extendedprice) d FROM lineitem), g AS (SELECT least(greatest(floor((l_quantity - a) / (b - a) * 16), 0), 15)::INT AS i, least(greatest(floor((l_extendedprice - c) / (d - c) * 16), 0), 15)::INT AS j, count(*) AS cnt FROM lineitem, m GROUP BY 1, 2)"


def _grid(spark, d):
    df = _t(spark, d, "lineitem")
    return histograms.grid(df, "l_quantity", "l_extendedprice", 16, 16, histograms.grid_layout(df, "l_quantity", "l_extendedprice"))


@query("corr2d_cells", f"{_GRID} SELECT * FROM g")
def _(spark, d):
    return _grid(spark, d)


@query("corr2d_range", f"{_GRID} SELECT sum(cnt)::BIGINT AS estimate FROM g WHERE i BETWEEN 2 AND 6 AND j BETWEEN 1 AND 8")
def _(spark, d):
    df = _t(spark, d, "lineitem")
    layout = histograms.grid_layout(df, "l_quantity", "l_extendedprice")
    whole = histograms.CorrelatedHistogram.collect(histograms.grid(df, "l_quantity", "l_extendedprice", 16, 16, layout), 16, 16, layout)
    within = lambda lo, hi, cell: lo + (hi - lo) * (cell + 0.5) / 16
    return spark.createDataFrame([(whole.estimate_range(within(*layout[:2], 2), within(*layout[:2], 6), within(*layout[2:], 1), within(*layout[2:], 8)),)], "estimate long")


@query("corr2d_merge", f"{_GRID} SELECT i, j, 2 * cnt AS cnt FROM g")
def _(spark, d):
    one = _grid(spark, d)
    return histograms.grid_merge(one, one)


def _degrees(spark, d, table: str, key: str, prefix: str):
    """rows, distinct values and greatest frequency of a key in one row."""
    counts = _t(spark, d, table).filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("c"))
    return counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias(f"rows_{prefix}"), F.count("*").alias(f"distinct_{prefix}"), F.coalesce(F.max("c"), F.lit(0)).alias(f"degree_{prefix}"))


def degrees_sql(table: str, key: str, prefix: str) -> str:
    return f"{prefix} AS (SELECT coalesce(sum(c), 0)::BIGINT AS rows_{prefix}, count(*) AS distinct_{prefix}, coalesce(max(c), 0) AS degree_{prefix} FROM (SELECT count(*) AS c FROM {table} WHERE {key} IS NOT NULL GROUP BY {key}))"


@query("column_stats_orders", "SELECT count(*) AS row_count, count(*) - count(o_custkey) AS null_count, count(DISTINCT o_custkey) AS distinct_count, min(o_totalprice) AS min_price, max(o_totalprice) AS max_price FROM orders")
def _(spark, d):
    return _t(spark, d, "orders").agg(F.count("*").alias("row_count"), (F.count("*") - F.count("o_custkey")).alias("null_count"), F.countDistinct("o_custkey").alias("distinct_count"), F.min("o_totalprice").alias("min_price"), F.max("o_totalprice").alias("max_price"))


@query("max_degree_lineitem", f"WITH {degrees_sql('lineitem', 'l_orderkey', 'l')} SELECT * FROM l")
def _(spark, d):
    return _degrees(spark, d, "lineitem", "l_orderkey", "l")


@query("degree_from_distinct", f"WITH {degrees_sql('orders', 'o_custkey', 'o')} SELECT rows_o - distinct_o + 1 AS degree, rows_o - distinct_o + 1 >= degree_o AS sound FROM o")
def _(spark, d):
    return _degrees(spark, d, "orders", "o_custkey", "o").select((F.col("rows_o") - F.col("distinct_o") + 1).alias("degree"), (F.col("rows_o") - F.col("distinct_o") + 1 >= F.col("degree_o")).alias("sound"))


_FK = f"""WITH {degrees_sql("lineitem", "l_orderkey", "l")}, {degrees_sql("orders", "o_orderkey", "r")}, t AS (SELECT count(*) AS truth FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT rows_l, rows_r, rows_l * rows_r AS product, least(rows_l * rows_r, rows_l * (rows_r - distinct_r + 1), rows_r * (rows_l - distinct_l + 1)) AS ceiling_distinct,
  least(rows_l * rows_r, rows_l * degree_r, rows_r * degree_l) AS ceiling_degree, truth, least(rows_l * rows_r, rows_l * degree_r, rows_r * degree_l) >= truth AS sound FROM l, r, t"""


@query("join_ceiling_fk", _FK)
def join_ceiling_fk(spark, d):
    """Ceilings of lineitem joined with orders, from distinct counts and from degrees, and the join's true size."""
    left, right = _degrees(spark, d, "lineitem", "l_orderkey", "l"), _degrees(spark, d, "orders", "o_orderkey", "r")
    truth = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).agg(F.count("*").alias("truth"))
    product = F.col("rows_l") * F.col("rows_r")
    by_degree = F.least(product, F.col("rows_l") * F.col("degree_r"), F.col("rows_r") * F.col("degree_l"))
    by_distinct = F.least(product, F.col("rows_l") * (F.col("rows_r") - F.col("distinct_r") + 1), F.col("rows_r") * (F.col("rows_l") - F.col("distinct_l") + 1))
    one = left.crossJoin(right).crossJoin(truth)  # three tables of one row
    return one.select("rows_l", "rows_r", product.alias("product"), by_distinct.alias("ceiling_distinct"), by_degree.alias("ceiling_degree"), "truth", (by_degree >= F.col("truth")).alias("sound"))


def measured(spark, d, keys: list[tuple[str, str]]) -> list:
    """rows, distinct values and greatest frequency (nulls left out) and n (all rows) of each table's key, in one job."""
    found = None
    for i, (name, key) in enumerate(keys):
        counts = _t(spark, d, name).groupBy(F.col(key).alias("k")).agg(F.count("*").alias("c"))
        known = F.when(F.col("k").isNotNull(), F.col("c"))
        one = counts.agg(F.lit(i).alias("place"), F.coalesce(F.sum(known), F.lit(0)).alias("rows"), F.count(known).alias("distinct"), F.coalesce(F.max(known), F.lit(0)).alias("degree"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
        found = one if found is None else found.unionByName(one)
    return sorted(found.collect(), key=lambda r: r["place"])


def _graph_ceiling(spark, d, relations: list[str], edges: list[tuple[int, int, str, str]], truth):
    """product, ceiling, truth, sound and tight (the ceiling is not above the product) of a join graph whose degrees are measured.

    Nothing saturates: numbers beyond a long are compared here, and a ceiling beyond it is an error only where it is asked for.
    """
    from cardlens.operators.bounds import JoinGraph, JoinRelation, product_bound

    ends = list(dict.fromkeys((i, k) for a, b, ka, kb in edges for i, k in ((a, ka), (b, kb))))
    found = dict(zip(ends, measured(spark, d, [(relations[i], k) for i, k in ends]), strict=True))
    rows = [next(r["n"] for (j, _), r in found.items() if j == i) for i in range(len(relations))]
    graph = JoinGraph([JoinRelation(r) for r in rows])
    for n, (a, b, ka, kb) in enumerate(edges):
        for i, k in ((a, ka), (b, kb)):
            graph.relations[i] = graph.relations[i].with_degree(n, found[i, k]["degree"])
        graph = graph.with_edge(a, b, n)
    product, ceiling = product_bound([float(r) for r in rows], math.inf), graph.ceiling(math.inf)
    sound = F.lit(min(ceiling, 2**63 - 1)) >= F.col("truth")
    return truth.select(F.lit(product).alias("product"), F.lit(str(ceiling)).cast("long").alias("ceiling"), "truth", sound.alias("sound"), F.lit(ceiling <= product_bound(rows, math.inf)).alias("tight"))


@query("join_ceiling_chain3", f"""WITH {degrees_sql("customer", "c_custkey", "c")}, {degrees_sql("orders", "o_custkey", "oc")}, {degrees_sql("orders", "o_orderkey", "oo")}, {degrees_sql("lineitem", "l_orderkey", "l")},
n AS (SELECT (SELECT count(*) FROM customer) AS nc, (SELECT count(*) FROM orders) AS no, (SELECT count(*) FROM lineitem) AS nl), t AS (SELECT count(*) AS truth FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey),
x AS (SELECT nc::DOUBLE * no * nl AS product, least(nc * degree_oc * degree_l, no * degree_c * degree_l, nl * degree_oo * degree_c) AS ceiling, truth FROM c, oc, oo, l, n, t)
SELECT product, ceiling, truth, ceiling >= truth AS sound FROM x""")
def _(spark, d):
    truth = _t(spark, d, "customer").join(_t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).join(_t(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).agg(F.count("*").alias("truth"))
    return _graph_ceiling(spark, d, ["customer", "orders", "lineitem"], [(0, 1, "c_custkey", "o_custkey"), (1, 2, "o_orderkey", "l_orderkey")], truth).drop("tight")


@query("join_ceiling_star", f"""WITH {degrees_sql("lineitem", "l_partkey", "lp")}, {degrees_sql("lineitem", "l_suppkey", "ls")}, {degrees_sql("part", "p_partkey", "p")}, {degrees_sql("supplier", "s_suppkey", "s")},
n AS (SELECT (SELECT count(*) FROM lineitem) AS nl, (SELECT count(*) FROM part) AS np, (SELECT count(*) FROM supplier) AS ns), t AS (SELECT count(*) AS truth FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
x AS (SELECT nl::DOUBLE * np * ns AS product, least(nl * degree_p * degree_s, np * degree_lp * degree_s, ns * degree_ls * degree_p) AS ceiling, truth FROM lp, ls, p, s, n, t)
SELECT product, ceiling, truth, ceiling >= truth AS sound FROM x""")
def _(spark, d):
    truth = _t(spark, d, "lineitem").join(_t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(_t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).agg(F.count("*").alias("truth"))
    return _graph_ceiling(spark, d, ["lineitem", "part", "supplier"], [(0, 1, "l_partkey", "p_partkey"), (0, 2, "l_suppkey", "s_suppkey")], truth).drop("tight")


@query("join_ceiling_cycle", """SELECT count(*) AS truth, true AS sound, true AS tight FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey""")
def _(spark, d):
    """Four relations in a ring: the ceiling is not below the truth and not above the product."""
    c, o, l, s = (_t(spark, d, n) for n in ("customer", "orders", "lineitem", "supplier"))
    truth = c.join(o, c.c_custkey == o.o_custkey).join(l, l.l_orderkey == o.o_orderkey).join(s, (s.s_suppkey == l.l_suppkey) & (s.s_nationkey == c.c_nationkey)).agg(F.count("*").alias("truth"))
    edges = [(0, 1, "c_custkey", "o_custkey"), (1, 2, "o_orderkey", "l_orderkey"), (2, 3, "l_suppkey", "s_suppkey"), (3, 0, "s_nationkey", "c_nationkey")]
    return _graph_ceiling(spark, d, ["customer", "orders", "lineitem", "supplier"], edges, truth).select("truth", "sound", "tight")


@query("selectivity_estimate", "SELECT round((SELECT count(*) FROM orders)::DOUBLE * (SELECT count(*) FROM customer) * (1.0 / (SELECT count(DISTINCT c_custkey) FROM customer)), 3) AS estimate")
def _(spark, d):
    from cardlens.operators.bounds import selectivity_estimate

    orders, customer = measured(spark, d, [("orders", "o_orderkey"), ("customer", "c_custkey")])
    return spark.createDataFrame([(round(selectivity_estimate([orders["n"], customer["n"]], [1.0 / customer["distinct"]]), 3),)], "estimate double")


#: A store of observations derived from orders: one for each customer, estimated by the average.
_OBSERVED = "SELECT c_custkey AS id, 'template-' || (c_custkey % 7) AS template_hash, 'plan-' || (c_custkey % 40) AS plan_fingerprint, (c_custkey % 12)::BIGINT AS est_rows, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey)::BIGINT AS actual_rows, (c_custkey % 101)::DOUBLE AS latency_ms FROM customer"


def _observed(spark, d):
    counts = _t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("actual_rows"))
    k = F.col("c_custkey")
    return _t(spark, d, "customer").join(counts, k == F.col("o_custkey"), "left").select(k.alias("id"), F.concat(F.lit("template-"), k % 7).alias("template_hash"), F.concat(F.lit("plan-"), k % 40).alias("plan_fingerprint"), (k % 12).cast("long").alias("est_rows"), F.coalesce("actual_rows", F.lit(0)).alias("actual_rows"), (k % 101).cast("double").alias("latency_ms"))


_Q = "CASE WHEN est_rows <> 0 AND actual_rows <> 0 THEN greatest(est_rows::DOUBLE / actual_rows, actual_rows::DOUBLE / est_rows) END"


@query("qerror_feedback", f"WITH o AS ({_OBSERVED}) SELECT id, round({_Q}, 9) AS q FROM o")
def _(spark, d):
    return _observed(spark, d).select("id", F.round(feedback.q_error_column(), 9).alias("q"))


@query("qerror_moerkotte", f"WITH o AS ({_OBSERVED}), g AS (SELECT id, greatest(est_rows, 1)::DOUBLE AS e, greatest(actual_rows, 1)::DOUBLE AS a FROM o) SELECT id, round(greatest(e / a, a / e), 9) AS q FROM g")
def _(spark, d):
    return _observed(spark, d).select("id", F.round(feedback.q_error_floored_column(), 9).alias("q"))


@query("feedback_template_stats", f"WITH o AS ({_OBSERVED}), q AS (SELECT *, {_Q} AS q FROM o) SELECT template_hash, count(*) AS n, round(coalesce(sum(q), 0) / count(*), 6) AS avg_q, round(max(q), 6) AS max_q, (count(*) - count(q))::BIGINT AS n_infinite FROM q GROUP BY template_hash")
def _(spark, d):
    return feedback.template_report(_observed(spark, d)).withColumns({"avg_q": F.round("avg_q", 6), "max_q": F.round("max_q", 6)})


@query("feedback_latency", f"WITH o AS ({_OBSERVED}), r AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS k, count(*) OVER () AS n FROM o) SELECT max(latency_ms) FILTER (WHERE k = floor(0.5 * (n - 1) + 0.5)) AS p50, max(latency_ms) FILTER (WHERE k = floor(0.9 * (n - 1) + 0.5)) AS p90, max(latency_ms) FILTER (WHERE k = floor(0.99 * (n - 1) + 0.5)) AS p99, max(latency_ms) AS p100 FROM r")
def _(spark, d):
    return feedback.latency_percentiles(_observed(spark, d))


@query("feedback_summary", f"WITH o AS ({_OBSERVED}), q AS (SELECT {_Q} AS q FROM o) SELECT round(exp(avg(ln(q))), 6) AS geomean, round(max(q), 6) AS max, (count(*) - count(q))::BIGINT AS n_infinite FROM q")
def _(spark, d):
    out = feedback.summary(_observed(spark, d).withColumn("q", feedback.q_error_column()))
    return out.withColumns({"geomean": F.round("geomean", 6), "max": F.round("max", 6)})


@query("rote_recall", f"WITH o AS ({_OBSERVED}) SELECT plan_fingerprint, arg_max(actual_rows, id) AS recalled FROM o GROUP BY plan_fingerprint")
def _(spark, d):
    return feedback.rote_recall(_observed(spark, d))


_STATUS = "SELECT status, bound, CASE WHEN bound <= 1000 OR bound <= 0.01 * total THEN 'pre_filter' ELSE 'post_filter' END AS strategy FROM (SELECT o_orderstatus AS status, count(*) AS bound, (SELECT count(*) FROM orders) AS total FROM orders GROUP BY o_orderstatus)"


@query("filter_bound_strategy", _STATUS)
def _(spark, d):
    orders = _t(spark, d, "orders")
    bound = cms.estimates(orders.select(F.col("o_orderstatus").alias("status")), "status", cms.counters(orders, "o_orderstatus"))
    total = orders.count()
    return bound.select("status", F.col("estimate").alias("bound"), strategy_column(F.col("estimate"), F.lit(total)).alias("strategy"))


@query("hint_planned_join", "SELECT c.c_mktsegment, count(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment")
def _(spark, d):
    from cardlens.plans.hints import JoinPlanner, Relation

    names = ("lineitem", "orders", "customer")
    relations = [Relation(n, df, df.count()) for n in names for df in [_t(spark, d, n)]]
    joined = JoinPlanner().build(relations, [(0, 1, "l_orderkey", "o_orderkey"), (1, 2, "o_custkey", "c_custkey")])
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("puffin_inspect")
def _(spark, d):
    import json

    from cardlens.sources import puffin, tables

    blobs = puffin.inspect(tables.build_sidecar(_t(spark, d, "orders"), buckets=64))["blobs"]
    return spark.createDataFrame([(i, b["type"], b["length"], json.dumps(b, sort_keys=True)) for i, b in enumerate(blobs)], "blob int, kind string, length long, entry string")


@query("gbt_correction")
def _(spark, d):
    from cardlens.plans.correctors import GradientBoosted

    orders = _t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("c"))
    customers = _t(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    nations = customers.groupBy("c_nationkey").agg(F.count("*").alias("left_rows"), F.coalesce(F.sum("c"), F.lit(0)).alias("right_rows"), F.countDistinct("c_custkey").alias("left_distinct"), F.countDistinct("o_custkey").alias("right_distinct"))
    sides = ["left_rows", "right_rows", "left_distinct", "right_distinct"]
    measured_features = customers.join(F.broadcast(nations), "c_nationkey").select(F.col("c_custkey").alias("id"), *[F.col(n).cast("double").alias(n) for n in sides], F.length("c_mktsegment").cast("double").alias("predicate_count"), (F.col("c_nationkey") % 4).cast("double").alias("join_depth"))
    rows = _observed(spark, d).withColumn("baseline", F.col("est_rows").cast("double")).join(measured_features, "id")
    return GradientBoosted.fit(rows).score(rows).select("id", "est_rows", "actual_rows", "corrected")
