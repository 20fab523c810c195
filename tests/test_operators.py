"""Boundaries, ties, gaps, and that the future can't move the past."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import numeric
from tideline.operators import asof, evaluate, flow, grid, joins, latency, models, normalize, options, panel, ranks, realized, windows


def rows_of(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_asof_edges_and_ties(spark):
    rows = spark.createDataFrame([("a", 10, 1, 1.0), ("a", 20, 2, 2.0), ("a", 20, 3, 3.0), ("a", 21, 4, 4.0), ("b", 5, 5, 5.0), ("a", None, 6, 6.0)], "k string, t long, seq long, v double")
    origins = spark.createDataFrame([("a", 9), ("a", 10), ("a", 20), ("b", 100), ("c", 1)], "k string, at long")
    found = asof.latest(origins, rows, ["k"], "at", "t", ["seq"], ["v"])
    assert {(r.k, r.at): r.v for r in found.collect()} == {("a", 9): None, ("a", 10): 1.0, ("a", 20): 3.0, ("b", 100): 5.0, ("c", 1): None}
    strict = asof.latest(origins, rows, ["k"], "at", "t", ["seq"], ["v"], inclusive=False)
    assert {(r.k, r.at): r.v for r in strict.collect()}[("a", 20)] == 1.0
    bounded = asof.latest(origins.withColumn("old", F.col("at") - 50), rows, ["k"], "at", "t", ["seq"], ["v"], oldest="old")
    assert {(r.k, r.at): r.v for r in bounded.collect()}[("b", 100)] is None


@pytest.mark.parametrize("inclusive", [True, False])
def test_asof_in_buckets_is_the_same(spark, inclusive):
    rnd = random.Random(5)
    rows = spark.createDataFrame([(rnd.choice("ab"), rnd.randrange(200), i, float(i)) for i in range(80)], "k string, t long, seq long, v double")
    origins = spark.createDataFrame(sorted({(rnd.choice("abc"), rnd.randrange(260)) for _ in range(60)}), "k string, at long")
    plain = asof.latest(origins, rows, ["k"], "at", "t", ["seq"], ["v"], inclusive)
    parted = asof.latest(origins, rows, ["k"], "at", "t", ["seq"], ["v"], inclusive, bucket=17)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, parted.collect()))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60), st.integers(0, 5)), max_size=25), st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60)), min_size=1, max_size=8, unique=True))
def test_within_is_the_closed_interval(spark, rows, origins):
    r = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "k string, t long, v int, id int")
    o = spark.createDataFrame(origins, "k string, at long")
    got = rows_of(asof.within(o, r, ["k"], "at", "t", 7), "k", "at", "id")
    assert got == sorted((k, at, i) for k, at in origins for i, (k2, t, _) in enumerate(rows) if k == k2 and at - 7 <= t <= at)


def test_two_clock_boundaries(spark):
    rows = spark.createDataFrame([(0, 0, 0), (1, 79, 79), (2, 80, 80), (3, 70, 81), (4, -20, -20), (5, -21, 0)], "id int, e long, c long")
    got = windows.two_clock(rows, "e", "c", 100, 100, 20).where("origin = 100")
    # [-20, 80) by execution, known at 80
    assert rows_of(got, "id") == [(0,), (1,), (4,)]


def test_sliding_assignment_counts(spark):
    rows = spark.range(0, 500, 7).withColumnRenamed("id", "t")
    got = windows.assigned(rows, "t", 10, 30).groupBy("origin").count().collect()
    want = {o: sum(1 for t in range(0, 500, 7) if o - 30 <= t < o) for o in range(10, 540, 10)}
    assert {r.origin: r["count"] for r in got} == {o: n for o, n in want.items() if n}


def test_forward_and_tiles(spark):
    rows = spark.createDataFrame([(0,), (1,), (99,), (100,), (None,)], "t long")
    f = {r.t: (r.window_end, r.eligible) for r in windows.forward(rows, "t", 100, 50).collect()}
    assert f == {0: (100, False), 1: (100, False), 99: (100, True), 100: (200, False), None: (None, False)}
    assert {r.t: r.window_end for r in windows.tiled(rows, "t", 100, F.lit(100)).where("t is not null").collect()} == {0: 100, 1: 100, 99: 100, 100: 100}


def test_future_shock(spark):
    rnd = random.Random(4)
    rows = [("a", i, 100.0 + rnd.random()) for i in range(40)]

    def measured(data):
        g = grid.with_returns(grid.filled(grid.dense(spark.createDataFrame(data, "k string, bar int, close double").withColumns({"high": F.col("close"), "low": F.col("close"), "volume": F.lit(1)}), ["k"], "bar", 0, 39), ["k"], "bar"), ["k"], "bar")
        over = W.partitionBy("k").orderBy("bar")
        out = g.select("bar", realized.backward(F.col("r"), ["k"], "bar", 5).alias("rv"), windows.trailing_mean(F.col("close"), over, 3).alias("m")).where("bar < 30")
        return rows_of(out.na.fill(-1.0), "bar", "rv", "m")

    assert measured(rows) == measured([*rows[:35], ("a", 35, 9_999.0), *rows[36:]])


def test_dense_grid_never_fills_back(spark):
    bars = spark.createDataFrame([("a", 2, 5.0, 6.0, 4.0, 3), ("a", 4, 7.0, 7.0, 7.0, 1)], "k string, bar int, close double, high double, low double, volume int")
    g = grid.filled(grid.dense(bars, ["k"], "bar", 0, 5), ["k"], "bar")
    assert [(r.bar, r.close, r.high, r.volume, r.observed) for r in g.orderBy("bar").collect()] == [(0, None, None, 0, False), (1, None, None, 0, False), (2, 5.0, 6.0, 3, True), (3, 5.0, 5.0, 0, False), (4, 7.0, 7.0, 1, True), (5, 7.0, 7.0, 0, False)]


def test_realized_measures_by_hand(spark):
    r = [None, 0.1, -0.2, 0.3, -0.1, 0.05]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(r)], "k string, bar int, r double")
    got = {x.bar: x for x in realized.forward(df, ["k"], "bar", 3).collect()}
    assert math.isclose(got[0].rv, 0.01 + 0.04 + 0.09) and math.isclose(got[0].bv, math.pi / 2 * (0.02 + 0.06)) and math.isclose(got[0].rq, 0.0001 + 0.0016 + 0.0081)
    assert math.isclose(got[0].rs_pos + got[0].rs_neg, got[0].rv) and math.isclose(got[0].jump + got[0].continuous, got[0].rv)
    assert got[3].rv is None and got[2].rv is not None


def test_prices_of_zero_have_infinite_logs(spark):
    data = [("a", 0, 2.0, 2.0, 1.0), ("a", 1, 0.0, 3.0, 0.0), ("a", 2, 0.0, 0.0, 0.0), ("a", 3, 2.0, 2.0, 1.0), ("a", 4, 4.0, 4.0, 4.0)]
    g = grid.with_returns(spark.createDataFrame(data, "k string, bar int, close double, high double, low double"), ["k"], "bar")
    range_ = realized.parkinson(F.col("high"), F.col("low"), W.partitionBy("k").orderBy("bar"), 1)
    got = g.select("r", range_.alias("p")).orderBy("bar").collect()
    inf = math.inf
    assert [r.r if r.r is None or r.r == r.r else "nan" for r in got] == [None, -inf, "nan", inf, math.log(2)]
    assert [r.p if r.p == r.p else "nan" for r in got[1:]] == [inf, "nan", got[0].p, 0.0] and math.isclose(got[0].p, math.log(2) / 4)


def test_robust_prior_is_strictly_prior(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(d) for d in range(30)]
    values = [float((7 * d) % 11) for d in range(30)]
    df = spark.createDataFrame([("a", d, v) for d, v in zip(days, values, strict=True)], "k string, s date, v double")
    got = {r.s: r for r in normalize.robust_prior(df, ["k"], "s", "v", 10, 5).collect()}
    for i in (4, 5, 20):
        past = np.array(values[max(0, i - 10) : i])
        if len(past) < 5:
            assert got[days[i]].z is None
        else:
            m = np.median(past)
            assert math.isclose(got[days[i]].z, (values[i] - m) / (1.4826 * np.median(abs(past - m))))
    flat = normalize.robust_prior(df.withColumn("v", F.lit(1.0)), ["k"], "s", "v", 10, 5)
    assert flat.where("z is not null").isEmpty()


def test_top_mean(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0), (-1.0, -2.0, 0.0, None), (-1.0, 5.0, 7.0, -1.0)], "a double, b double, c double, d double")
    assert [r[0] for r in df.select(normalize.top_mean(["a", "b", "c", "d"])).collect()] == [3.0, None, 6.0]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(0.001, 1e4), min_size=3, max_size=60))
def test_histogram_quantile_is_within_a_bin(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s double")
    half = len(values) // 2
    parts = [latency.histogram(spark.createDataFrame([(v,) for v in p], "s double"), [], "s") for p in (values[:half], values[half:])]
    assert rows_of(latency.merged(*parts), "bin", "n") == rows_of(latency.histogram(df, [], "s"), "bin", "n")
    got = latency.quantiles(latency.histogram(df, [], "s"), [], [0.5]).first().seconds
    exact = sorted(values)[math.ceil(0.5 * len(values)) - 1]
    assert abs(math.log10(got / exact)) <= 1.01 / latency.BINS_PER_DECADE or exact <= 1e-3


@settings(max_examples=100, deadline=None)
@given(st.floats(1e-6, 1e6), st.floats(1e-6, 1e6))
def test_qlike_is_never_negative(a, f):
    assert a / f - math.log(a / f) - 1 >= -1e-9


@settings(max_examples=12, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=12))
def test_adjusted_p_values(spark, ps):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate(ps)], "f string, i int, p double")
    order = sorted(ps)
    holm = {r.i: r.adjusted for r in evaluate.holm(df, ["f"], "p").collect()}
    bh = {r.i: r.adjusted for r in evaluate.benjamini_hochberg(df, ["f"], "p").collect()}
    n = len(ps)
    for i, p in enumerate(ps):
        at = max(k for k, v in enumerate(order) if v == p)
        first = min(k for k, v in enumerate(order) if v == p)
        assert math.isclose(holm[i], min(1, max((n - k) * order[k] for k in range(first + 1))), abs_tol=1e-12) or holm[i] <= min(1, max((n - k) * order[k] for k in range(at + 1))) + 1e-12
        assert bh[i] >= p - 1e-12 and bh[i] <= 1
    assert [holm[i] for i in sorted(range(n), key=lambda i: ps[i])] == sorted(holm.values())


def test_clustered_mean_by_hand(spark):
    rnd = random.Random(2)
    data = [(c, rnd.random()) for c in range(6) for _ in range(rnd.randint(1, 5))]
    r = evaluate.clustered_mean(spark.createDataFrame(data, "c int, v double").withColumn("by", F.lit(1)), "c", "v", ["by"]).first()
    x = np.array([v for _, v in data])
    sums = np.array([sum(v - x.mean() for c2, v in data if c2 == c) for c in range(6)])
    assert math.isclose(r.mean, x.mean()) and math.isclose(r.se, math.sqrt((sums**2).sum() * 6 / 5) / len(x))


def test_rank_auc_with_ties(spark):
    data = [(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1), (0.8, 1)]
    r = ranks.auc(spark.createDataFrame(data, "s double, y int").withColumn("g", F.lit(1)), ["g"], "s", "y").first()
    wins = [(a > b) + (a == b) / 2 for a, ya in data if ya for b, yb in data if not yb]
    assert math.isclose(r.auc, sum(wins) / len(wins))


def test_flow_measures(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 1.0), ("b", "x", 5.0), ("c", "x", 3.0), ("c", "y", 1.0)], "g string, i string, w double")
    got = {r.g: r for r in flow.concentration(df, ["g"], "i", F.col("w")).collect()}
    assert math.isclose(got["a"].herfindahl, 0.5) and math.isclose(got["a"].entropy_norm, 1.0) and math.isclose(got["a"].herfindahl_norm, 0.0)
    assert got["b"].herfindahl == 1.0 and got["b"].herfindahl_norm is None and math.isclose(got["c"].top_share, 0.75)


def test_option_measures(spark):
    x = spark.range(1)
    cdf = x.select(*[numeric.normal_cdf(F.lit(v)).alias(str(i)) for i, v in enumerate((-3.0, -0.5, 0.0, 1.2, 6.0))]).first()
    assert all(math.isclose(c, 0.5 * (1 + math.erf(v / math.sqrt(2))), abs_tol=1e-7) for c, v in zip(cdf, (-3.0, -0.5, 0.0, 1.2, 6.0), strict=True))
    quotes = spark.createDataFrame([(float(k), max(0.0, 0.95 * (100 - k)) + 2, max(0.0, 0.95 * (k - 100)) + 2) for k in (80, 90, 100, 110)], "k double, c double, p double").withColumn("g", F.lit(1))
    f = options.implied_forward(quotes.withColumnRenamed("c", "price"), quotes.withColumnRenamed("p", "price"), ["g"], "k", "price").first()
    assert math.isclose(f.forward, 100, rel_tol=1e-9) and math.isclose(f.discount, 0.95, rel_tol=1e-9)
    s = options.smile(spark.createDataFrame([(v, 1 + 2 * v + 3 * v * v) for v in (-0.2, -0.1, 0.0, 0.3)], "x double, y double").withColumn("g", F.lit(1)), ["g"], F.col("x"), F.col("y")).first()
    assert np.allclose([s.level, s.slope, s.curvature], [1, 2, 3])
    two = options.smile(spark.createDataFrame([(0.0, 1.0), (1.0, 2.0)], "x double, y double").withColumn("g", F.lit(1)), ["g"], F.col("x"), F.col("y")).first()
    assert two.level is None
    i = options.interpolated(spark.createDataFrame([(10.0, 1.0), (20.0, 3.0)], "x double, y double").withColumn("g", F.lit(1)), ["g"], "x", "y", [5, 10, 15, 30])
    assert rows_of(i, "target", "y") == [(5.0, 1.0), (10.0, 1.0), (15.0, 2.0), (30.0, 3.0)]


def test_implied_volatility_round_trip(spark, sf):
    from tideline.plans import catalogue

    rows = catalogue.queries()["iv_bisection"](spark, sf).where("price > 0.01 and price < 60").collect()
    assert rows and np.mean([r.iv is not None and abs(r.iv - r.true_iv) < 1e-3 for r in rows]) > 0.95


def test_panels(spark):
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, None), (3, float("nan"), 1.0)], "id int, a double, b double")
    n = {r.id: (r.complete_x, r.complete_y, r.reason) for r in panel.nested(p, [("x", ["a"]), ("y", ["b"])]).collect()}
    assert n == {1: (True, True, None), 2: (True, False, "Y_INCOMPLETE"), 3: (False, False, "X_INCOMPLETE")}
    with pytest.raises(ValueError, match="PANEL_COVERAGE_BELOW_FLOOR"):
        panel.assert_coverage(p.withColumn("g", F.lit(1)), ["a", "b"], 0.9, ["g"])
    flagged = p.withColumn("ok", F.col("id") > 1)
    assert panel.mask_digest(flagged, ["id"], "ok") == panel.mask_digest(flagged.orderBy(F.desc("id")), ["id"], "ok") != panel.mask_digest(flagged.withColumn("ok", F.lit(True)), ["id"], "ok")
    f = panel.expanding_folds(spark.range(1, 13).withColumnRenamed("id", "no"), "no", 2, 6, 3, 1, 1).collect()
    assert {(r.fold, r.no) for r in f if r.part == "train"} == {(0, n) for n in range(1, 4)} | {(1, n) for n in range(1, 7)}


def test_checked_joins(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    two = spark.createDataFrame([(1, "x"), (1, "y")], "k int, w string")
    with pytest.raises(ValueError, match="JOIN_RIGHT_KEY_DUPLICATED"):
        joins.checked_join(one, two, ["k"])
    assert joins.checked_join(two, one, ["k"], "left", "m:1").count() == 2
    assert joins.same_keys(one, two, ["k"]) == {"left_only": 1, "right_only": 0}
    with pytest.raises(ValueError, match="TARGET_COLUMN"):
        joins.without_targets(one.withColumn("target_rv", F.lit(1)))
    e = joins.exact_lag(spark.createDataFrame([("a", 0, 1.0), ("a", 2, 3.0), ("a", 3, 4.0)], "k string, t int, v double"), ["k"], "t", 2, ["v"], "_then")
    assert {r.t: r.v_then for r in e.collect()} == {0: None, 2: 1.0, 3: None}


def test_reasons_and_finiteness(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in df.select(numeric.finite(F.col("x"))).collect()] == [True, False, False, None]
    assert [r[0] for r in df.select(numeric.first_reason((F.col("x") > 0, "LOW"), (numeric.finite(F.col("x")), "ODD"))).collect()] == [None, "ODD", "ODD", "LOW"]
    assert [r[0] for r in spark.createDataFrame([(0.0,), (1.0,), (-1.0,)], "x double").select(numeric.log_positive(F.col("x"))).collect()] == [None, 0.0, None]


def test_models(spark):
    rng = np.random.default_rng(3)
    x, d = rng.normal(size=300), rng.normal(size=300)
    rows = [(int(i % 3), int(i // 10), float(a), float(a + b), float(2 * a + 0.5 * (a + b) + 0.01 * rng.normal())) for i, (a, b) in enumerate(zip(x, d, strict=True))]
    df = spark.createDataFrame(rows, "fold int, s int, x double, d double, y double")
    assert np.allclose(models.solve(models.gram(df, ["x"], "d").first().asDict(), 1), np.polyfit(x, x + d, 1)[::-1])
    theta = models.partial_effect(models.cross_fitted(df, ["x"], ["y", "d"], "fold", 1e-6), "y_residual", "d_residual", "s").first()
    assert abs(theta.theta - 0.5) < 0.01 and theta.clusters == 30
    h = models.ewma(spark.createDataFrame([("a", i, 0.1 * i) for i in range(1, 6)], "k string, t int, v double").withColumn("s", F.floor(F.col("t") / 2)), "k", "s", "t", "v", 0.5, 3).orderBy("t").collect()
    state, want = None, []
    for i in range(1, 6):
        state = (0.1 * i) ** 2 if state is None else 0.5 * state + 0.5 * (0.1 * i) ** 2
        want.append(state if i >= 3 else None)
    assert [None if r.h is None else round(r.h, 12) for r in h] == [None if w is None else round(w, 12) for w in want]


def test_plans_push_down_and_do_not_multiply(spark, sf):
    from tideline.plans import catalogue

    plan = catalogue.queries()["scan_project"](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "l_comment" not in plan
    assert "CartesianProduct" not in catalogue.queries()["two_clock_window"](spark, sf)._jdf.queryExecution().toString()


def test_strategy_uses_only_the_past(spark):
    from tideline.operators import selection

    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.1, -0.2, 0.3, 0.4])], "k string, t int, r double")
    rows = selection.strategy(df, ["k"], "t", F.col("r"), F.col("r"), 0.01).orderBy("t").collect()
    assert [r.position for r in rows] == [0.0, 1.0, -1.0, 1.0] and [r.turnover for r in rows] == [0.0, 1.0, 2.0, 2.0]
    assert math.isclose(rows[2].pnl, -0.3 - 0.02)


def test_saved_forecaster_scores_alike(spark, sf, tmp_path):
    from pyspark.ml import PipelineModel

    df = spark.createDataFrame([(float(i), float(2 * i + 1)) for i in range(1, 30)], "x double, y double")
    for kind in ("ols", "gamma"):
        model = models.fitted(df, ["x"], "y", kind)
        model.save(str(tmp_path / kind))
        again = PipelineModel.load(str(tmp_path / kind))
        assert rows_of(model.transform(df), "x", "prediction") == rows_of(again.transform(df), "x", "prediction")
    assert len(df.select(*models.spline_basis("x", [5.0, 10.0])).columns) == 2


def test_exact_quantiles_of_ties_nulls_and_lone_rows(spark):
    import numpy as np

    from tideline.operators import quantiles

    groups = {"a": [3.0, 1.0, 1.0, 1.0, 2.5, -4.0, 9.0], "b": [7.0], None: [2.0, 2.0], "c": [float(i % 13) / 4 for i in range(200)]}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("a", None), ("b", float("nan")), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for cells, small in ((64, 100_000), (4, 5), (2, 1)):
        got = {(r.g, r.q): r.quantile for r in quantiles.exact(df, ["g"], "v", [0.0, 0.25, 0.5, 0.95, 1.0], cells=cells, small=small).collect()}
        want = {(g, q): float(np.quantile(values, q)) for g, values in groups.items() for q in (0.0, 0.25, 0.5, 0.95, 1.0)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert quantiles.exact(df.limit(0), ["g"], "v", [0.5]).collect() == []


def test_exact_quantiles_under_grouping_sets(spark):
    import numpy as np

    from tideline.operators import quantiles

    rnd = random.Random(5)
    data = [(rnd.choice(["a", "b", None]), rnd.choice([1, 2]), rnd.randint(0, 300) / 4, None if rnd.random() < 0.1 else rnd.gauss(0, 1)) for _ in range(900)]
    df = spark.createDataFrame(data, "g string, h int, v double, w double")
    for small in (100_000, 20):
        out = quantiles.wide(df, ["g", "h"], {"m": (F.col("v"), 0.5), "p": (F.col("w"), 0.9)}, sets=[["g", "h"], ["g"], []], count="n", cells=8, small=small).collect()
        got = {(r._set, r.g, r.h): (r.n, r.m, r.p) for r in out}
        want: dict = {}
        for g, h, v, w in data:
            for key in ((0, g, h), (1, g, None), (3, None, None)):
                want.setdefault(key, []).append((v, w))
        assert got.keys() == want.keys()
        for key, held in want.items():
            n, m, p = got[key]
            assert n == len(held) and math.isclose(m, float(np.median([v for v, _ in held])))
            assert math.isclose(p, float(np.quantile([w for _, w in held if w is not None], 0.9)))


def test_distributed_ranks(spark):
    rnd = random.Random(3)
    data = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, 1.0, 2.0, 2.5, rnd.random()]), i) for i in range(700)]
    df = spark.createDataFrame(data, "g string, v double, i int").repartition(5)
    got = {r.i: (r.row, r.rows) for r in ranks.numbered(df, ["g"], ["v", "i"], total="rows", parts=7).collect()}
    all_of = {r.i: r.row for r in ranks.numbered(df, [], [F.col("v").desc(), "i"], parts=7).collect()}
    least = lambda v: (v is not None, v or 0.0)
    for g in {g for g, _, _ in data}:
        own = sorted((x for x in data if x[0] == g), key=lambda x: (least(x[1]), x[2]))
        for at, (_, _, i) in enumerate(own):
            assert got[i] == (at + 1, len(own))
    order = sorted(data, key=lambda x: (x[1] is None, -(x[1] or 0.0), x[2]))
    assert [all_of[i] for _, _, i in order] == list(range(1, 701))
    tied = {r.i: r.a for r in ranks.with_rank(df, ["g"], "v", "a", parts=7).collect()}
    for g, v, i in data:
        own = [x for h, x, _ in data if h == g and x is not None]
        assert tied[i] == (None if v is None else sum(x < v for x in own) + (sum(x == v for x in own) + 1) / 2)
    tiles = spark.range(1, 24).select("id", *[ranks.tile(F.col("id"), F.lit(23), k).alias(f"t{k}") for k in (1, 4, 10, 30)], *[F.expr(f"ntile({k}) over (order by id)").alias(f"n{k}") for k in (1, 4, 10, 30)])
    assert tiles.where("t1 <> n1 or t4 <> n4 or t10 <> n10 or t30 <> n30").count() == 0
    assert ranks.numbered(df.limit(0), ["g"], ["v"]).collect() == [] and ranks.counted(df.limit(0), ["g"], "v").collect() == []


def test_no_rank_sorts_a_key_in_one_task(spark, sf):
    """Windows in these plans run over counts of values and of ranges only, never over the rows of an asset."""
    from tideline.plans import catalogue

    for name in ("row_index", "agg_nearest_quantile", "decile_spread", "rank_auc", "rank_correlation"):
        plan = catalogue.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows and all("_part" in line or "sum(_n" in line for line in windows), name


def test_grouping_sets_multiply_only_cells_of_wanted_ranks(spark):
    from tideline.operators import quantiles

    rnd = random.Random(6)
    rows = [(g, f, rnd.choice([rnd.gauss(0, 1), math.inf, 0.5]), 1) for g in "ab" for f in "xy" for _ in range(2_000)] + [("a", "z", math.inf, 1)]
    df = spark.createDataFrame(rows, "g string, _f string, _v double, _n long")
    counts = df.groupBy("g", "_f", "_v").agg(F.sum("_n").alias("_n"))
    few = quantiles._narrowed(counts, ["g"], [["g"], []], [0.1, 0.3], 64)
    assert few.agg(F.sum("_n")).first()[0] == len(rows) and few.count() * 2 < counts.count()
    got = quantiles.exact(df.where("_f = 'x'"), ["g"], "_v", [0.1, 0.3], sets=[["g"], []], small=10, shared=64).collect()
    want = {(g, q): sorted(r[2] for r in rows if r[1] == "x" and g in (None, r[0])) for g in ("a", "b", None) for q in (0.1, 0.3)}
    assert len(got) == 6
    for r in got:
        at = r.q * (len(want[r.g, r.q]) - 1)
        low, high = want[r.g, r.q][int(at)], want[r.g, r.q][int(at) + 1]
        assert math.isclose(r.quantile, low + (high - low) * (at - int(at)), abs_tol=1e-9)


def test_rows_are_dealt_to_as_many_tasks_as_they_ask_for(spark):
    df = spark.range(1_000).select((F.col("id") % 300).alias("k"), "id")
    parts = joins.dealt(df, ["k"], task_rows=100).withColumn("part", F.spark_partition_id())
    assert parts.rdd.getNumPartitions() == 10 and joins.dealt(df, ["k"], task_rows=10_000).rdd.getNumPartitions() == 1
    assert parts.groupBy("k").agg(F.countDistinct("part").alias("n")).where("n > 1").isEmpty()
    assert joins.dealt(df.limit(0), ["k"]).groupBy("k").count().collect() == []
