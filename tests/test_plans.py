import json
import math
from http.server import BaseHTTPRequestHandler, HTTPServer
from threading import Thread

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardlens import runner
from cardlens.functions import inference
from cardlens.operators.cms import CountMin, counters
from cardlens.plans import capture, correctors, feedback, filters, hints, prejoin
from cardlens.plans.capture import CorrectionFeatures
from cardlens.sources import shared
from cardlens.sources.portable import ColumnStats, StatsTable


def orders_join(spark, sf_dir):
    l, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    return l.join(o, l.l_orderkey == o.o_orderkey).filter("o_totalprice > 1000 AND l_quantity > 2")


def test_estimates_and_actual_rows(spark, sf_dir):
    df = orders_join(spark, sf_dir)
    plan = capture.logical(df)
    assert capture.join_depth(plan) == 1 and capture.predicate_count(plan) >= 3
    seen = capture.observe(df)
    assert len(seen.joins) == 1 and seen.joins[0][2] == seen.actual and seen.joins[0][1] > 0 and seen.estimate > 0
    assert seen.actual == df.count()
    nested = df.join(spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey")).filter("c_custkey < 50")
    found = [n for _, _, n in capture.observe(nested).joins]
    assert found[0] == nested.count() and len(found) == 2 and all(found)
    ones = df.agg(F.count("*").alias("n"))
    assert (capture.observe(ones).actual, capture.observe(ones).joins[0][2]) == (seen.actual, seen.actual)
    assert capture.actual_rows(spark.range(7).agg(F.count("*").alias("n"))) == 7 and capture.actual_rows(spark.range(5, 6)) == 5
    assert capture.actual_rows(spark.range(7)) == 7 and capture.actual_rows(spark.range(0)) == 0 and capture.actual_rows(spark.range(7).agg(F.count("*"))) == 7
    assert seen.features.to_list()[-1] == 1.0


def test_cached_and_analysed_tables_have_estimates(spark):
    spark.range(50).withColumn("k", F.col("id") % 5).cache().createOrReplaceTempView("analysed")
    spark.sql("ANALYZE TABLE analysed COMPUTE STATISTICS FOR ALL COLUMNS")
    assert capture.root_estimate(spark.table("analysed")) == 50
    spark.catalog.uncacheTable("analysed")


def test_store(spark, tmp_path, sf_dir):
    store = feedback.FeedbackStore(spark, str(tmp_path / "s"))
    assert store.count() == 0 and store.templates().count() == 0
    assert store.record(feedback.Observation("a", "p1", 10, 100, 5.0), feedback.Observation("a", "p2", 0, 7, 1.0)) == sorted(r["id"] for r in store.all().collect())
    store.record(feedback.Observation("b", "p1", 4, 2, 3.0, CorrectionFeatures(4, predicate_count=2)))
    assert [r["est_rows"] for r in store.history("a").collect()] == [10, 0]
    others = [feedback.FeedbackStore(spark, f"file://{tmp_path}/w") for _ in range(2)]  # two writers of one store
    ids = [i for n in range(3) for w in others for i in w.record(feedback.Observation("a", "p", n, n))]
    assert len(set(ids)) == others[0].count() == 6
    assert store.plan_history("a").count() == 0 and store.plan_history("b").first()["predicate_count"] == 2
    report = {r["template_hash"]: r for r in store.templates().collect()}
    assert (report["a"]["n"], report["a"]["avg_q"], report["a"]["max_q"], report["a"]["n_infinite"]) == (2, 5.0, 10.0, 1)
    assert store.latencies().first().asDict() == {"p50": 3.0, "p90": 5.0, "p99": 5.0, "p100": 5.0}
    assert {r["plan_fingerprint"]: r["recalled"] for r in feedback.rote_recall(store.all()).collect()} == {"p1": 2, "p2": 7}
    feedback.capture(orders_join(spark, sf_dir), store, "c")
    assert feedback.run_with_feedback(spark.range(3), store, "d").count() == 3
    assert store.count() == 5 and feedback.FeedbackStore(spark, str(tmp_path / "s")).count() == 5
    shared.write_text(spark, f"{tmp_path}/s/_meta.json", json.dumps({"version": 99}))
    with pytest.raises(ValueError):
        feedback.FeedbackStore(spark, str(tmp_path / "s"))


def test_older_rows_without_features_are_read(spark, tmp_path):
    old = spark.createDataFrame([(0, "t", "p", 1, 2, None, 0.0)], "id long, template_hash string, plan_fingerprint string, est_rows long, actual_rows long, latency_ms double, recorded_at double")
    old.write.parquet(str(tmp_path / "s" / "rows"))
    store = feedback.FeedbackStore(spark, str(tmp_path / "s"))
    store.record(feedback.Observation("t", "p", 3, 4, None, CorrectionFeatures(3)))
    assert store.history("t").count() == 2 and store.plan_history("t").count() == 1


def test_q_errors():
    assert feedback.q_error(0, 5) == math.inf and feedback.q_error(2, 8) == feedback.q_error(8, 2) == 4
    assert feedback.q_error_floored(0, 5) == 5 and feedback.q_error_floored(0, 0) == 1


def test_boosted_trees_learn_from_depth(spark, tmp_path):
    rows = spark.createDataFrame([(1000, 1000 * (i % 4 + 1), float(i % 4)) for i in range(200)], "est_rows long, actual_rows long, join_depth double")
    model = correctors.GradientBoosted.fit(rows, trees=30, rate=0.3)
    ask = lambda m, d: m.correct(CorrectionFeatures(1000, join_depth=d))
    assert [round(ask(model, d) / 1000) for d in range(4)] == [1, 2, 3, 4]
    model.save(str(tmp_path / "m"))
    again = correctors.GradientBoosted.load(str(tmp_path / "m"), ceiling=1500)
    assert again.training_rows == 0 and ask(again, 0) == ask(model, 0) and ask(again, 3) == 1500
    additive = correctors.GradientBoosted.fit(rows, additive=True, trees=30, rate=0.3)
    assert abs(ask(additive, 2) - 3000) < 300
    scored = model.score(rows.withColumn("baseline", F.col("est_rows").cast("double")).withColumns({n: F.lit(0.0) for n in capture.FEATURES[1:-1]}))
    assert scored.agg(F.max(F.abs(F.col("corrected") - F.col("actual_rows")))).first()[0] < 600
    with pytest.raises(ValueError):
        correctors.GradientBoosted.fit(rows.withColumn("actual_rows", F.lit(0)))


def test_http_corrector():
    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            out = json.dumps({"estimate": body["baseline_estimate"] * 2 if body["features"][6] < 5 else "x"}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/infer"
    model = correctors.language_model(url, ceiling=150)
    assert model.correct(CorrectionFeatures(20)) == 40 and model.correct(CorrectionFeatures(100)) == 150
    assert model.correct(CorrectionFeatures(20, join_depth=9)) is None
    server.shutdown()
    server.server_close()
    assert correctors.Http(url).correct(CorrectionFeatures(20)) is None
    assert correctors.Identity().correct(CorrectionFeatures(7)) == 7 and correctors.Disabled().correct(CorrectionFeatures(7)) is None
    with pytest.warns(UserWarning):
        correctors.Http("http://example.invalid/x")


class Fixed:
    name = "fixed"

    def __init__(self, n):
        self.n = n

    def correct(self, features):
        if self.n == "broken":
            raise RuntimeError
        return self.n


@pytest.mark.parametrize(
    "answer,derived,options,expected",
    [
        (500, 1000, {}, 500), (5000, 1000, {}, 1000), (50, 1000, {}, 100), (50, 1000, {"allow_below_native": True}, 50), (None, 1000, {}, 100),
        ("broken", 1000, {}, 100), (2**50, None, {}, 2**40), (5000, 1000, {"derive_ceiling": False}, 5000), (5000, 1000, {"ceiling": 300}, 300),
    ],
)
def test_corrected_inputs(answer, derived, options, expected):
    metrics = hints.Metrics()
    assert hints.correct_input(100, CorrectionFeatures(100), Fixed(answer), derived, hints.Options(**options), metrics) == expected
    assert metrics.attempts == 1 and metrics.errors == (answer == "broken") and metrics.abstained == (answer is None)
    assert hints.scale_bytes(10, 3, 7) == 24 and hints.scale_bytes(10, 0, 7) == 10


def test_planner_changes_plans_and_no_results(spark, sf_dir):
    names = ("lineitem", "orders", "customer")
    relations = [hints.Relation(n, df, df.count()) for n in names for df in [spark.read.parquet(f"{sf_dir}/{n}.parquet")]]
    edges = [(0, 1, "l_orderkey", "o_orderkey"), (1, 2, "o_custkey", "c_custkey")]
    want = orders_join(spark, sf_dir).filter("true")
    planner = hints.JoinPlanner()
    assert planner.order(relations, edges) == [2, 1, 0]
    out = planner.build(relations, edges)
    assert out.filter("o_totalprice > 1000 AND l_quantity > 2").count() == want.count()
    merge = hints.JoinPlanner(broadcast_bytes=0, hash_bytes=0).build(relations, edges)
    plan = merge._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert planner.metrics.attempts == 3


def test_correctors_change_the_hinted_plan(spark, sf_dir):
    names = ("lineitem", "orders", "customer")
    relations = [hints.Relation(n, df, df.count()) for n in names for df in [spark.read.parquet(f"{sf_dir}/{n}.parquet")]]
    edges = [(0, 1, "l_orderkey", "o_orderkey"), (1, 2, "o_custkey", "c_custkey")]
    below = hints.Options(allow_below_native=True)
    small, none = (hints.JoinPlanner(Fixed(n), below, broadcast_bytes=5_000).build(relations, edges) for n in (10, None))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (small, none)]
    assert "BroadcastHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[1]
    assert small.count() == none.count() > 0


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_pre_join_rule_changes_plans_and_no_results(spark, sf_dir):
    l, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    df = orders_join(spark, sf_dir)
    stats = [StatsTable(l, l.count(), {}), StatsTable(o, o.count(), {})]
    below = hints.Options(allow_below_native=True)
    rule = lambda answer, **how: prejoin.PreJoinRule(Fixed(answer), how.pop("options", below), how.pop("stats", stats), broadcast_bytes=20_000, **how)
    few, many = rule(10), rule(10**9)
    plans = [r.apply(df) for r in (few, many)]
    assert "BroadcastHashJoin" in executed(plans[0]) and "BroadcastHashJoin" not in executed(plans[1])
    assert few.metrics.attempts == 2 and few.metrics.applied == 2 and many.metrics.clamped == 2  # under the tables' rows
    want = sorted(map(repr, df.collect()))
    for plan in plans:
        assert plan.columns == df.columns and sorted(map(repr, plan.collect())) == want
    # without proven rows nothing is broadcast, below native only if that is allowed, and a wide ceiling is not proof enough
    assert "BroadcastHashJoin" not in executed(rule(10, stats=[]).apply(df))
    assert "BroadcastHashJoin" not in executed(rule(10, options=hints.Options()).apply(df))
    assert "BroadcastHashJoin" not in executed(rule(10, proven_bytes=1000).apply(df))
    assert "BroadcastHashJoin" in executed(rule(10).apply(df.groupBy("o_custkey").agg(F.count("*"))))
    assert "SortMergeJoin" in executed(rule(10**9, hash_bytes=0).apply(df))
    # the user's hint stays, other joins too, and a corrector that breaks does no harm
    assert "SortMergeJoin" in executed(few.apply(l.join(o.hint("merge"), l.l_orderkey == o.o_orderkey)))
    loop = l.join(o, l.l_quantity > o.o_totalprice)
    assert few.apply(loop) is loop
    broken = rule("broken")
    assert broken.apply(df).count() == len(want) and broken.metrics.errors == 2


def test_a_statistics_bound_reaches_the_join(spark, sf_dir):
    """Outer joins have no ceiling of their product; a bound of a column is the table's; a filter keeps its child's."""
    l, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    bound = StatsTable(o, None, {"o_orderkey": ColumnStats(upper_bound_rows=40, distinct_count=40)})
    rule = prejoin.PreJoinRule(Fixed(10**9), hints.Options(), [bound], broadcast_bytes=20_000)
    plan = rule.apply(l.join(o.filter("o_totalprice > 1"), l.l_orderkey == o.o_orderkey, "left"))
    assert "BroadcastHashJoin" in executed(plan) and rule.metrics.clamped >= 1


def test_installed_rule(spark, sf_dir):
    l, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    l.createOrReplaceTempView("rule_l")
    o.createOrReplaceTempView("rule_o")
    text = "SELECT count(*) AS n FROM rule_l JOIN rule_o ON l_orderkey = o_orderkey"
    want = spark.sql(text).first()["n"]
    with pytest.raises(LookupError):
        prejoin.planned(l)
    try:
        for _ in range(2):
            prejoin.install(spark, prejoin.PreJoinRule(Fixed(10**9), hints.Options(), [], broadcast_bytes=0, hash_bytes=0))
        assert "SortMergeJoin" in executed(spark.sql(text)) and spark.sql(text).first()["n"] == want
        assert prejoin.planned(l.join(o, l.l_orderkey == o.o_orderkey)).count() == want
    finally:
        prejoin.uninstall(spark)
    assert spark.sql(text).first()["n"] == want


def test_filter_bounds_dominate(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 40, "shoes").otherwise(F.concat(F.lit("c"), F.col("id") % 9)).alias("v"))
    stats = filters.PayloadStats(1000, {"v": CountMin.collect(counters(df, "v"), 1000)})
    shoes, c1 = filters.Match("v", b"shoes"), filters.Match("v", b"c1")
    assert 40 <= stats.bound_condition(shoes) < 1000 and stats.bound_condition(filters.Match("other", b"x")) == 1000
    assert stats.bound_matches(filters.Filter()) == 1000 == stats.bound_condition(filters.Unbounded())
    assert stats.bound_matches(filters.Filter(must=(shoes,), must_not=(c1,))) == stats.bound_condition(shoes)
    both = filters.Filter(should=(shoes, c1))
    assert stats.bound_matches(both) == stats.bound_condition(filters.AnyOf("v", (b"shoes", b"c1"))) >= df.filter("v IN ('shoes', 'c1')").count()
    assert [filters.choose_strategy(b, t) for b, t in ((1000, 2000), (5000, 10**6), (5000, 10**5))] == ["pre_filter", "pre_filter", "post_filter"]


def test_runner(spark, sf_dir, tmp_path):
    from cardlens.queries import registry

    some = {n: registry.QUERIES[n] for n in ("synthetic_s1", "synthetic_s3", "e2e_s1")} | {"broken": lambda s, d: s.table("missing")}
    store = feedback.FeedbackStore(spark, str(tmp_path / "s"))
    before = runner.run(spark, some, sf_dir, exclude=["e2e_s1"], store=store, report=str(tmp_path / "r.json"))
    assert [o.query for o in before] == ["synthetic_s1", "synthetic_s3", "broken"] and before[-1].error
    assert json.loads((tmp_path / "r.json").read_text())["n_queries"] == 3 and store.count() == 2
    again = runner.load_report(str(tmp_path / "r.json"))
    assert [(o.query, o.actual, o.q_error) for o in again] == [(o.query, o.actual, o.q_error) for o in before]
    joins = runner.run(spark, {"join": lambda s, d: orders_join(s, d)}, sf_dir)
    assert runner.join_q_summary(joins)["joins"] == 1 and runner.join_q_summary(joins)["geomean"] >= 1 and joins[0].joins[0][2] == joins[0].actual
    after = runner.run(spark, some, sf_dir, only=["synthetic_s1"], corrector=Fixed(before[0].actual), cold=True)
    assert after[0].corrected == after[0].actual and runner.q_summary(after)["geomean"] == 1
    assert runner.calibrate(before, after)["queries"] == 1 and runner.compare(before, after)["geomean"] > 0
    assert runner.q_summary(before)["failed"] == 1 and "joins" in runner.join_q_summary(before)
    assert runner.ablation(0, None, 50) == {"native": 0, "recall": 0, "ceiling": 50, "multiplicative": 50, "additive": 50}
    assert runner.ablation(10, 20, 50, math.log(2), 7.5) == {"native": 10, "recall": 20, "ceiling": 20, "multiplicative": 40, "additive": 7}
    assert runner.dispatch(0) == "additive" and runner.dispatch(3) == "multiplicative"


def test_statistics():
    x = np.random.default_rng(0).normal(5, 1, 80)
    for bca in (True, False):
        lo, hi = inference.bootstrap_interval(x, bca=bca)
        assert lo < x.mean() < hi and hi - lo < 1
    w, p = inference.wilcoxon_signed_rank([1, 2, 3, 4, 5, 6, 7, 8], [0] * 8)
    assert w == 0 and p < 0.02 and inference.wilcoxon_signed_rank([1, 2], [1, 2]) == (0.0, 1.0)
    for n in (6, 9):  # against all signs
        a = np.random.default_rng(n).permutation(np.arange(1, n + 1)) * np.random.default_rng(n + 1).choice([-1, 1], n)
        w, p = inference.wilcoxon_signed_rank(a, [0] * n)
        sums = [sum(r + 1 for r in range(n) if s >> r & 1) for s in range(2**n)]
        assert abs(p - min(1.0, 2 * np.mean([x <= w for x in sums]))) < 1e-12
    assert np.allclose(inference.adjusted_p_values([0.01, 0.04, 0.03, 0.5]), [0.04, 0.16 / 3, 0.16 / 3, 0.5])
    assert inference.benjamini_hochberg([0.001, 0.2, 0.02, 0.9]) == [True, False, True, False]
    assert inference.max_diff_edges([1, 2, 3, 4, 5], [1, 1, 9, 1, 1], 3)[-1] == 5.0
    assert inference.v_optimal_edges([1, 2, 3, 4], [1, 1, 9, 9], 2) == [2.0, 4.0]


def test_streamed_sketches(spark, tmp_path):
    from cardlens.operators import hll
    from cardlens.streaming import maintain

    (tmp_path / "in").mkdir()
    for i in range(3):
        spark.range(i * 100, i * 100 + 150).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    maintain.hll_stream(stream, "id", str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert hll.HllSketch.collect(maintain.latest(spark, str(tmp_path / "out")), 12) == hll.HllSketch.collect(hll.registers(spark.range(350), "id"), 12)
