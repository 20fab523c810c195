"""Losses, calibration, tests and models over forecasts derived from the tape."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import evaluate, models, ranks
from ..sources.tables import tape
from .registry import GRID, TAPE, query, r6, s6
from .windowed import KEYS, returns

#: Forecasts: actual is the hour's premium; one model repeats the hour before, the other an hourly constant.
_LOSS = f"""{TAPE}, hourly AS (SELECT asset, session_date, hour(executed_at) AS bar, sum(premium) AS actual FROM tape GROUP BY 1, 2, 3), f AS (SELECT *, lag(actual) OVER (PARTITION BY asset, session_date ORDER BY bar) AS persist, 300.0 + bar * 10 AS flat FROM hourly),
  loss AS (SELECT asset, session_date, bar, model, actual, forecast, actual / forecast - ln(actual / forecast) - 1 AS qlike FROM (SELECT asset, session_date, bar, actual, 'persist' AS model, persist AS forecast FROM f UNION ALL SELECT asset, session_date, bar, actual, 'flat', flat FROM f) WHERE forecast IS NOT NULL)"""


def forecasts(spark, sf):
    hourly = tape(spark, sf).groupBy(*KEYS, F.hour("executed_at").alias("bar")).agg(F.sum("premium").alias("actual"))
    return hourly.withColumn("persist", F.lag("actual").over(W.partitionBy(*KEYS).orderBy("bar"))).withColumn("flat", 300.0 + F.col("bar") * 10)


def losses(spark, sf):
    long = forecasts(spark, sf).unpivot([*KEYS, "bar", "actual"], ["persist", "flat"], "model", "forecast").where("forecast is not null")
    return long.withColumn("qlike", evaluate.qlike(F.col("actual"), F.col("forecast")))


@query("qlike_table", f"WITH {_LOSS} SELECT model, asset, count(*) AS n, {s6('avg(qlike)')} AS qlike, {s6('avg(abs(actual - forecast))')} AS mae, {s6('sqrt(avg((actual - forecast) * (actual - forecast)))')} AS rmse FROM loss GROUP BY 1, 2")
def qlike_table(spark, sf):
    gap = F.col("actual") - F.col("forecast")
    return losses(spark, sf).groupBy("model", "asset").agg(F.count("*").alias("n"), r6(F.avg("qlike")).alias("qlike"), r6(F.avg(F.abs(gap))).alias("mae"), r6(F.sqrt(F.avg(gap * gap))).alias("rmse"))


@query("pinball_table", f"WITH {_LOSS} SELECT model, {s6('avg(greatest(0.9 * (actual - forecast), -0.1 * (actual - forecast)))')} AS pinball FROM loss GROUP BY 1")
def pinball_table(spark, sf):
    return losses(spark, sf).groupBy("model").agg(r6(F.avg(evaluate.pinball(F.col("actual"), F.col("forecast"), 0.9))).alias("pinball"))


_PAIRED = f"{_LOSS}, daily AS (SELECT session_date, avg(a.qlike - b.qlike) AS d, count(*) AS n FROM (SELECT * FROM loss WHERE model = 'flat') a JOIN (SELECT * FROM loss WHERE model = 'persist') b USING (asset, session_date, bar) GROUP BY 1)"


def paired(spark, sf):
    return evaluate.paired_daily(losses(spark, sf), "session_date", "model", "qlike", "flat", "persist", ["asset", "bar"])


@query("paired_daily_diff", f"WITH {_PAIRED} SELECT session_date, {s6('d')} AS difference, n AS origins FROM daily", dates=["session_date"])
def paired_daily_diff(spark, sf):
    return paired(spark, sf).select("session_date", r6("difference").alias("difference"), "origins")


@query("mincer_zarnowitz", f"WITH {_LOSS} SELECT model, {s6('regr_slope(actual, forecast)')} AS slope, {s6('regr_intercept(actual, forecast)')} AS intercept, {s6('regr_r2(actual, forecast)')} AS r2, regr_count(actual, forecast)::BIGINT AS n FROM loss GROUP BY 1")
def mincer_zarnowitz(spark, sf):
    m = evaluate.mincer_zarnowitz(losses(spark, sf), ["model"], F.col("actual"), F.col("forecast"))
    return m.select("model", *[r6(c).alias(c) for c in ("slope", "intercept", "r2")], "n")


@query("clark_west", f"WITH {_LOSS} SELECT asset, {s6('avg((actual - flat) ** 2 - ((actual - persist) ** 2 - (flat - persist) ** 2))')} AS term, count(*) AS n FROM f WHERE persist IS NOT NULL GROUP BY 1")
def clark_west(spark, sf):
    t = evaluate.clark_west(F.col("actual"), F.col("flat"), F.col("persist"))
    return forecasts(spark, sf).where("persist is not null").groupBy("asset").agg(r6(F.avg(t)).alias("term"), F.count("*").alias("n"))


@query("clustered_mean", f"""WITH {_PAIRED}, x AS (SELECT a.asset, session_date, a.qlike - b.qlike AS d FROM (SELECT * FROM loss WHERE model = 'flat') a JOIN (SELECT * FROM loss WHERE model = 'persist') b USING (asset, session_date, bar)), c AS (SELECT asset, session_date, sum(d) AS s, count(*) AS n FROM x GROUP BY 1, 2),
  m AS (SELECT asset, sum(s) / sum(n) AS mean, sum(n) AS n, count(*) AS g FROM c GROUP BY 1), e AS (SELECT asset, mean, m.n, g, sum((s - mean * c.n) * (s - mean * c.n)) AS meat FROM c JOIN m USING (asset) GROUP BY 1, 2, 3, 4)
  SELECT asset, g, {s6('mean')} AS mean, {s6('sqrt(meat * g / (g - 1)) / n')} AS se, {s6('mean / (sqrt(meat * g / (g - 1)) / n)')} AS t FROM e""")
def clustered_mean(spark, sf):
    l = losses(spark, sf)  # noqa: E741
    x = l.groupBy(*KEYS, "bar").agg((F.max(F.when(F.col("model") == "flat", F.col("qlike"))) - F.max(F.when(F.col("model") == "persist", F.col("qlike")))).alias("d")).where("d is not null")
    return evaluate.clustered_mean(x, "session_date", "d", ["asset"]).select("asset", "g", *[r6(c).alias(c) for c in ("mean", "se", "t")])


@query("newey_west", f"""WITH {_PAIRED}, c AS (SELECT session_date, d, d - avg(d) OVER () AS e FROM daily), p AS (SELECT e * e AS p0, {', '.join(f'e * lag(e, {k}) OVER (ORDER BY session_date) AS p{k}' for k in (1, 2, 3))}, d FROM c),
  s AS (SELECT count(*) AS n, avg(d) AS mean, sum(p0) + 2 * 0.75 * sum(p1) + 2 * 0.5 * sum(p2) + 2 * 0.25 * sum(p3) AS v FROM p) SELECT n, {s6('mean')} AS mean, {s6('sqrt(greatest(v, 0.0)) / n')} AS se, {s6('mean / (sqrt(greatest(v, 0.0)) / n)')} AS t FROM s""")
def newey_west(spark, sf):
    return evaluate.newey_west(paired(spark, sf), "session_date", "difference", 3).select("n", *[r6(c).alias(c) for c in ("mean", "se", "t")])


@query("autocorrelation", f"""WITH {_PAIRED}, c AS (SELECT session_date, d - avg(d) OVER () AS e FROM daily), p AS (SELECT e, {', '.join(f'lag(e, {k}) OVER (ORDER BY session_date) AS e{k}' for k in (1, 2, 3))} FROM c),
  s AS (SELECT unnest([1, 2, 3]) AS lag, unnest([sum(e * e1), sum(e * e2), sum(e * e3)]) / sum(e * e) AS rho, count(*) AS n FROM p) SELECT lag::INTEGER AS lag, {s6('rho')} AS rho, {s6('n * (n + 2) * sum(rho * rho / (n - lag)) OVER (ORDER BY lag)')} AS ljung_box FROM s""")
def autocorrelation(spark, sf):
    return evaluate.autocorrelation(paired(spark, sf), "session_date", "difference", 3).select("lag", r6("rho").alias("rho"), r6("ljung_box").alias("ljung_box"))


_P = f"{_LOSS}, p AS (SELECT asset, {s6('exp(-avg(qlike) * 6)')} AS p FROM loss WHERE model = 'flat' GROUP BY 1)"


def p_values(spark, sf):
    return losses(spark, sf).where("model = 'flat'").groupBy("asset").agg(r6(F.exp(-F.avg("qlike") * 6)).alias("p")).withColumn("family", F.lit("all"))


@query("holm_adjust", f"WITH {_P}, r AS (SELECT *, row_number() OVER (ORDER BY p, asset) AS i, count(*) OVER () AS n FROM p) SELECT asset, p, {s6('least(1.0, max((n - i + 1) * p) OVER (ORDER BY i))')} AS adjusted FROM r")
def holm_adjust(spark, sf):
    return evaluate.holm(p_values(spark, sf), ["family"], "p").select("asset", "p", r6("adjusted").alias("adjusted"))


@query("bh_adjust", f"WITH {_P}, r AS (SELECT *, row_number() OVER (ORDER BY p, asset) AS i, count(*) OVER () AS n FROM p) SELECT asset, p, {s6('least(1.0, min(p * n / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} AS adjusted FROM r")
def bh_adjust(spark, sf):
    return evaluate.benjamini_hochberg(p_values(spark, sf), ["family"], "p").select("asset", "p", r6("adjusted").alias("adjusted"))


_G = f"{_LOSS}, g AS (SELECT asset, avg(qlike) AS x, var_samp(qlike) / count(*) AS v FROM loss WHERE model = 'persist' GROUP BY 1)"


@query("meta_random_effects", f"""WITH {_G}, s AS (SELECT count(*) AS k, sum(1 / v) AS w, sum(1 / v / v) AS w2, sum(x / v) AS wx, sum(x * x / v) AS wxx FROM g), h AS (SELECT k, w, w2, wxx - wx * wx / w AS q FROM s),
  t AS (SELECT k, q, CASE WHEN q > 0 THEN greatest((q - (k - 1)) / q, 0.0) ELSE 0.0 END AS i2, greatest((q - (k - 1)) / (w - w2 / w), 0.0) AS tau2 FROM h)
  SELECT k, {s6('q')} AS q, {s6('i2')} AS i2, {s6('tau2')} AS tau2, {s6('sum(x / (v + tau2)) / sum(1 / (v + tau2))')} AS mean, {s6('sqrt(1 / sum(1 / (v + tau2)))')} AS se FROM g, t GROUP BY k, q, i2, tau2""")
def meta_random_effects(spark, sf):
    g = losses(spark, sf).where("model = 'persist'").groupBy("asset").agg(F.avg("qlike").alias("x"), (F.var_samp("qlike") / F.count("*")).alias("v"))
    return evaluate.random_effects(g, "x", "v", []).select("k", *[r6(c).alias(c) for c in ("q", "i2", "tau2", "mean", "se")])


@query("rank_auc", f"""WITH {TAPE}, r AS (SELECT asset, is_call, rank() OVER (PARTITION BY asset ORDER BY strike) + (count(*) OVER (PARTITION BY asset, strike) - 1) / 2.0 AS r FROM tape), s AS (SELECT asset, sum(r) FILTER (WHERE is_call) AS r, count(*) FILTER (WHERE is_call) AS p, count(*) FILTER (WHERE NOT is_call) AS q FROM r GROUP BY 1)
  SELECT asset, p, q, {s6('(r - p * (p + 1) / 2.0) / (p * q)')} AS auc FROM s""")
def rank_auc(spark, sf):
    rows = tape(spark, sf).withColumn("label", F.col("is_call").cast("int"))
    return ranks.auc(rows, ["asset"], "strike", "label").withColumn("auc", r6("auc"))


@query("rank_correlation", f"""WITH {TAPE}, r AS (SELECT asset, rank() OVER (PARTITION BY asset ORDER BY strike) + (count(*) OVER (PARTITION BY asset, strike) - 1) / 2.0 AS a, rank() OVER (PARTITION BY asset ORDER BY premium) + (count(*) OVER (PARTITION BY asset, premium) - 1) / 2.0 AS b FROM tape) SELECT asset, {s6('corr(a, b)')} AS spearman FROM r GROUP BY 1""")
def rank_correlation(spark, sf):
    rows = tape(spark, sf).select("asset", "strike", "premium")
    rows = ranks.with_rank(ranks.with_rank(rows, ["asset"], "strike", "a"), ["asset"], "premium", "b")
    return rows.groupBy("asset").agg(r6(F.corr("a", "b")).alias("spearman"))


@query("ols_trend", f"""WITH {TAPE}, d AS (SELECT asset, session_date, sum(premium) AS y, dense_rank() OVER (PARTITION BY asset ORDER BY session_date) AS x FROM tape GROUP BY 1, 2) SELECT asset, {s6('regr_slope(y, x)')} AS slope, {s6('regr_intercept(y, x)')} AS intercept, {s6('regr_r2(y, x)')} AS r2 FROM d GROUP BY 1""")
def ols_trend(spark, sf):
    d = tape(spark, sf).groupBy(*KEYS).agg(F.sum("premium").alias("y")).withColumn("x", F.dense_rank().over(W.partitionBy("asset").orderBy("session_date")))
    return d.groupBy("asset").agg(r6(F.regr_slope("y", "x")).alias("slope"), r6(F.regr_intercept("y", "x")).alias("intercept"), r6(F.regr_r2("y", "x")).alias("r2"))


@query("hourly_contrast", f"WITH {_PAIRED} SELECT bar::INTEGER AS bar, count(*) AS n, {s6('avg(a.qlike - b.qlike)')} AS difference FROM (SELECT * FROM loss WHERE model = 'flat') a JOIN (SELECT * FROM loss WHERE model = 'persist') b USING (asset, session_date, bar) GROUP BY 1")
def hourly_contrast(spark, sf):
    value = lambda m: F.max(F.when(F.col("model") == m, F.col("qlike")))
    x = losses(spark, sf).groupBy(*KEYS, "bar").agg((value("flat") - value("persist")).alias("d")).where("d is not null")
    return x.groupBy("bar").agg(F.count("*").alias("n"), r6(F.avg("d")).alias("difference"))


@query("martingale", f"""WITH {_PAIRED}, w AS (SELECT session_date, exp(sum(ln(greatest(1 + 0.2 * d, 0.01))) OVER (ORDER BY session_date)) AS wealth FROM daily) SELECT session_date, {s6('wealth')} AS wealth, {s6('least(1.0, 1.0 / max(wealth) OVER (ORDER BY session_date))')} AS p FROM w""", dates=["session_date"])
def martingale(spark, sf):
    return evaluate.always_valid(paired(spark, sf), "session_date", "difference", 0.2).select("session_date", r6("wealth").alias("wealth"), r6("p").alias("p"))


@query("gram_ols", f"""WITH {_LOSS} SELECT asset, {s6('regr_slope(actual, persist)')} AS slope, {s6('regr_intercept(actual, persist)')} AS intercept FROM f WHERE persist IS NOT NULL GROUP BY 1""")
def gram_ols(spark, sf):
    g = models.gram(forecasts(spark, sf), ["persist"], "actual", ["asset"])
    det = F.col("x0_0") * F.col("x1_1") - F.col("x0_1") * F.col("x0_1")
    return g.select("asset", r6((F.col("x0_0") * F.col("y1") - F.col("x0_1") * F.col("y0")) / det).alias("slope"), r6((F.col("x1_1") * F.col("y0") - F.col("x0_1") * F.col("y1")) / det).alias("intercept"))


@query("partial_pooling", f"""WITH {_G}, t AS (SELECT greatest(var_samp(x) - avg(v), 0.0) AS tau2, avg(x) AS m FROM g) SELECT asset, {s6('CASE WHEN tau2 + v > 0 THEN (tau2 * x + v * m) / (tau2 + v) ELSE m END')} AS pooled FROM g, t""")
def partial_pooling(spark, sf):
    g = losses(spark, sf).where("model = 'persist'").groupBy("asset").agg(F.avg("qlike").alias("x"), (F.var_samp("qlike") / F.count("*")).alias("v"))
    t = g.agg(F.greatest(F.var_samp("x") - F.avg("v"), F.lit(0.0)).alias("tau2"), F.avg("x").alias("m"))
    share = F.col("tau2") + F.col("v")
    return g.crossJoin(F.broadcast(t)).select("asset", r6(F.when(share > 0, (F.col("tau2") * F.col("x") + F.col("v") * F.col("m")) / share).otherwise(F.col("m"))).alias("pooled"))


# ---- without a SQL counterpart -----------------------------------------------------------------------------


@query("ewma_state", f"""WITH RECURSIVE {GRID}, o AS (SELECT asset, session_date, bar, r, row_number() OVER (PARTITION BY asset ORDER BY session_date, bar) AS i FROM returns WHERE r IS NOT NULL),
  e AS (SELECT asset, session_date, bar, i, r * r AS h FROM o WHERE i = 1 UNION ALL SELECT o.asset, o.session_date, o.bar, o.i, 0.94 * h + 0.06 * o.r * o.r FROM e JOIN o ON o.asset = e.asset AND o.i = e.i + 1)
  SELECT asset, session_date, bar::INTEGER AS bar, {s6('h')} AS h FROM e WHERE i >= 20""", dates=["session_date"])
def ewma_state(spark, sf):
    h = models.ewma(returns(spark, sf), "asset", "session_date", "bar", "r")
    return h.where("h is not null and r is not null").select(*KEYS, "bar", r6("h").alias("h"))


@query("garch_state", f"""WITH RECURSIVE {GRID}, o AS (SELECT asset, session_date, bar, r, row_number() OVER (PARTITION BY asset ORDER BY session_date, bar) AS i FROM returns),
  e AS (SELECT asset, session_date, bar, r, i, 0.05 / (1 - 0.1 - 0.8) AS h FROM o WHERE i = 1 UNION ALL SELECT o.asset, o.session_date, o.bar, o.r, o.i, 0.05 + CASE WHEN e.r IS NULL THEN 0.9 * h ELSE 0.1 * e.r * e.r + 0.8 * h END FROM e JOIN o ON o.asset = e.asset AND o.i = e.i + 1)
  SELECT asset, session_date, bar::INTEGER AS bar, {s6('h')} AS h FROM e""", dates=["session_date"])
def garch_state(spark, sf):
    return models.garch_filter(returns(spark, sf), "asset", "session_date", "bar", "r", 0.05, 0.1, 0.8).select(*KEYS, "bar", r6("h").alias("h"))


@query("ridge_dml")
def ridge_dml(spark, sf):
    rows = forecasts(spark, sf).where("persist is not null").withColumn("fold", F.pmod(F.dayofyear("session_date"), F.lit(3))).withColumn("treat", F.log("persist")).withColumn("y", F.log("actual")).withColumn("hour", F.col("bar").cast("double"))
    fitted = models.cross_fitted(rows, ["hour", "flat"], ["y", "treat"], "fold", 1.0)
    return models.partial_effect(fitted, "y_residual", "treat_residual", "session_date")


@query("glm_gamma")
def glm_gamma(spark, sf):
    rows = forecasts(spark, sf).where("persist is not null and actual > 0").withColumn("x", F.log("persist"))
    return models.fitted(rows, ["x"], "actual", "gamma").transform(rows).select(*KEYS, "bar", "actual", "prediction")
