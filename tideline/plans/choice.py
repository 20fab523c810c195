"""Choice among five forecasts, models and economics.

Queries without SQL are tested against plain loops in ``tests/test_choice.py``.
"""

from __future__ import annotations

from math import e
from statistics import NormalDist

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import normal_cdf, normal_cdf_sql
from ..operators import evaluate, models, selection
from ..sources.tables import tape
from .evaluation import _LOSS, _PAIRED, forecasts, paired
from .registry import GRID, TAPE, query, r6, s6
from .windowed import KEYS, returns

MODELS = ["flat", "persist", "mixed", "so_far", "yesterday"]


def candidates(spark, sf):
    """Five forecasts of every hour: a flat line, the hour before, their mean, the session so far, the same hour of
    the session before."""
    f = forecasts(spark, sf)
    before = W.partitionBy(*KEYS).orderBy("bar").rowsBetween(W.unboundedPreceding, -1)
    f = f.withColumn("mixed", (F.col("flat") + F.col("persist")) / 2).withColumn("so_far", F.avg("actual").over(before))
    return f.withColumn("yesterday", F.lag("actual").over(W.partitionBy("asset", "bar").orderBy("session_date")))


def table_of(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


# ---- association and ranking -------------------------------------------------------------------------------


@query("kendall_tau", f"""WITH {TAPE}, d AS (SELECT asset, session_date, sum(premium) AS x, sum(strike)::BIGINT AS y FROM tape GROUP BY 1, 2),
  p AS (SELECT a.asset, sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM d a JOIN d b ON a.asset = b.asset AND a.session_date < b.session_date)
  SELECT asset, count(*) AS pairs, {s6('sum(sx * sy) / sqrt(sum(sx * sx)::DOUBLE * sum(sy * sy)::DOUBLE)')} AS tau FROM p GROUP BY 1""")
def kendall_tau(spark, sf):
    """Kendall's tau-b over the sessions of an asset: pairs of sessions, some hundred squared at most."""
    d = tape(spark, sf).groupBy(*KEYS).agg(F.sum("premium").alias("x"), F.sum("strike").alias("y"))
    return evaluate.kendall(d, ["asset"], "session_date", "x", "y").withColumn("tau", r6("tau"))


@query("session_pair_auc", f"""WITH {TAPE}, c AS (SELECT asset, session_date, strike, count(*) FILTER (WHERE is_call) AS p, count(*) FILTER (WHERE NOT is_call) AS q FROM tape GROUP BY 1, 2, 3)
  SELECT a.asset, a.session_date AS positive_session, b.session_date AS negative_session, {s6('sum(a.p * b.q * (CASE WHEN a.strike > b.strike THEN 1.0 WHEN a.strike = b.strike THEN 0.5 ELSE 0.0 END))::DOUBLE')} AS wins,
    sum(a.p * b.q)::BIGINT AS pairs FROM c a JOIN c b ON a.asset = b.asset GROUP BY 1, 2, 3 HAVING sum(a.p * b.q) > 0""", dates=["positive_session", "negative_session"])
def session_pair_auc(spark, sf):
    """Exact counts of won pairs for every pair of sessions, so that any resample of sessions has its area at once."""
    return evaluate.session_pair_auc(tape(spark, sf), ["asset"], "session_date", "strike", "is_call").withColumn("wins", r6("wins"))


# ---- models ------------------------------------------------------------------------------------------------


@query("ridge_forecast", f"""WITH {_LOSS} SELECT asset, {s6('regr_sxy(actual, persist) / (regr_sxx(actual, persist) + 1000.0)')} AS slope,
  {s6('avg(actual) - avg(persist) * regr_sxy(actual, persist) / (regr_sxx(actual, persist) + 1000.0)')} AS intercept FROM f WHERE persist IS NOT NULL GROUP BY 1""")
def ridge_forecast(spark, sf):
    """Ridge on one feature per asset from Gram sums, the intercept not penalised."""
    g = models.gram(forecasts(spark, sf), ["persist"], "actual", ["asset"])
    n, sx, sxx, sy, sxy = (F.col(c) for c in ("x0_0", "x0_1", "x1_1", "y0", "y1"))
    slope = (sxy - sx * sy / n) / (sxx - sx * sx / n + 1000.0)
    return g.select("asset", r6(slope).alias("slope"), r6(sy / n - sx / n * slope).alias("intercept"))


@query("one_hot_pipeline", f"""WITH {_LOSS}, t AS (SELECT asset, actual, persist FROM f WHERE persist IS NOT NULL), m AS (SELECT asset, avg(actual) AS my, avg(persist) AS mx FROM t GROUP BY 1),
  b AS (SELECT sum((actual - my) * (persist - mx)) / sum((persist - mx) * (persist - mx)) AS b FROM t JOIN m USING (asset))
  SELECT asset, count(*) AS n, round(avg(my + b * (persist - mx)), 3) + 0.0 AS forecast, round(sqrt(avg((actual - my - b * (persist - mx)) ** 2)), 3) + 0.0 AS rmse FROM t JOIN m USING (asset), b GROUP BY 1""")
def one_hot_pipeline(spark, sf):
    """A pipeline of indexing, one-hot coding, scaling and least squares: assets get an intercept each."""
    rows = forecasts(spark, sf).where("persist is not null")
    done = models.one_hot_pipeline(["asset"], ["persist"], "actual").fit(rows).transform(rows)
    gap = F.col("actual") - F.col("prediction")
    r3 = lambda x: F.round(x, 3) + 0.0
    return done.groupBy("asset").agg(F.count("*").alias("n"), r3(F.avg("prediction")).alias("forecast"), r3(F.sqrt(F.avg(gap * gap))).alias("rmse"))


@query("tweedie_forecast")
def tweedie_forecast(spark, sf):
    rows = forecasts(spark, sf).where("persist is not null and actual > 0").withColumn("x", F.log("persist"))
    return models.fitted(rows, ["x"], "actual", "tweedie").transform(rows).select(*KEYS, "bar", "actual", "x", "prediction")


@query("spline_forecast")
def spline_forecast(spark, sf):
    """Least squares on a cubic spline of the hour: Gram sums in Spark, a small solve."""
    rows = forecasts(spark, sf).withColumn("h", F.col("bar") / 24.0)
    knots = [0.25, 0.5, 0.75]
    rows = rows.withColumns({"h2": F.col("h") ** 2, "h3": F.col("h") ** 3}).select("*", *models.spline_basis("h", knots))
    features = ["h", "h2", "h3", *[f"h_k{i}" for i in range(len(knots))]]
    b = models.solve(models.gram(rows, features, "actual").first().asDict(), len(features))
    line = F.lit(float(b[0]))
    for f, w in zip(features, b[1:], strict=True):
        line = line + F.lit(float(w)) * F.col(f)
    return rows.select("bar", line.alias("forecast")).distinct()


@query("ranked_ridge")
def ranked_ridge(spark, sf):
    """A ridge whose design keeps only the features that add rank on the training rows; a copy of one is left out."""
    rows = forecasts(spark, sf).where("persist is not null").withColumn("copy", F.col("persist") * 2 + 1).withColumn("hour", F.col("bar").cast("double"))
    train = rows.where("session_date < date'2024-01-19'")
    kept, b = models.ranked_ridge(train, ["persist", "copy", "hour"], "actual", ridge=1.0)
    return table_of(spark, [(name, float(w)) for name, w in zip(["intercept", *kept], b, strict=True)], "feature string, weight double")


@query("stopped_boosting")
def stopped_boosting(spark, sf):
    """Boosted trees that stop when held-out sessions no longer gain."""
    rows = forecasts(spark, sf).where("persist is not null").withColumn("held_out", F.dayofmonth("session_date") % 5 == 0)
    model = models.fitted(rows, ["persist", "flat"], "actual", "boosted", held_out="held_out")
    trees = model.stages[-1].getNumTrees
    done = model.transform(rows).withColumn("e", F.abs(F.col("actual") - F.col("prediction")))
    return done.groupBy("held_out").agg(F.count("*").alias("n"), F.avg("e").alias("mae")).withColumn("trees", F.lit(trees))


@query("residual_learner", f"""WITH {_LOSS}, t AS (SELECT ln(actual / flat) AS r, ln(persist / flat) AS x, actual, flat, session_date < DATE '2024-01-19' AS train FROM f WHERE persist > 0 AND actual > 0),
  l AS (SELECT regr_slope(r, x) AS b, regr_intercept(r, x) AS a FROM t WHERE train), p AS (SELECT actual, flat, flat * exp(a + b * x) AS forecast FROM t, l WHERE NOT train)
  SELECT count(*) AS n, {s6('avg(actual / flat - ln(actual / flat) - 1)')} AS base, {s6('avg(actual / forecast - ln(actual / forecast) - 1)')} AS corrected FROM p""")
def residual_learner(spark, sf):
    """A base forecast times what a second learner, fitted to its residuals on earlier sessions, makes of them."""
    t = forecasts(spark, sf).where("persist > 0 and actual > 0").withColumns({"r": F.log(F.col("actual") / F.col("flat")), "x": F.log(F.col("persist") / F.col("flat"))})
    line = t.where("session_date < date'2024-01-19'").agg(F.regr_slope("r", "x").alias("b"), F.regr_intercept("r", "x").alias("a"))
    p = t.where("session_date >= date'2024-01-19'").crossJoin(F.broadcast(line)).withColumn("forecast", F.col("flat") * F.exp(F.col("a") + F.col("b") * F.col("x")))
    loss = lambda f: r6(F.avg(evaluate.qlike(F.col("actual"), F.col(f))))
    return p.agg(F.count("*").alias("n"), loss("flat").alias("base"), loss("forecast").alias("corrected"))


@query("session_lag_placebo", f"""WITH {_LOSS}, s AS (SELECT *, lag(persist) OVER (PARTITION BY asset, bar ORDER BY session_date) AS shifted FROM f)
  SELECT asset, count(*) AS n, {s6('corr(actual, persist)')} AS own, {s6('corr(actual, shifted)')} AS placebo FROM s WHERE persist IS NOT NULL AND shifted IS NOT NULL GROUP BY 1""")
def session_lag_placebo(spark, sf):
    """A predictor taken from one session too early, beside the true one."""
    s = forecasts(spark, sf).withColumn("shifted", F.lag("persist").over(W.partitionBy("asset", "bar").orderBy("session_date")))
    return s.where("persist is not null and shifted is not null").groupBy("asset").agg(F.count("*").alias("n"), r6(F.corr("actual", "persist")).alias("own"), r6(F.corr("actual", "shifted")).alias("placebo"))


@query("calibrated_levels", f"""WITH {_LOSS}, t AS (SELECT asset, ln(actual) AS y, ln(persist) AS x, actual, persist, session_date < DATE '2024-01-19' AS train FROM f WHERE persist > 0 AND actual > 0),
  l AS (SELECT asset, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, (regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / count(*) AS v FROM t WHERE train GROUP BY 1),
  p AS (SELECT asset, a, b, v, actual, persist, exp(a + b * x + v / 2) AS level FROM t JOIN l USING (asset) WHERE NOT train)
  SELECT asset, {s6('max(b)')} AS slope, {s6('max(a)')} AS intercept, {s6('max(exp(v / 2))')} AS smearing, {s6('avg(actual / persist - ln(actual / persist) - 1)')} AS raw, {s6('avg(actual / level - ln(actual / level) - 1)')} AS recalibrated FROM p GROUP BY 1""")
def calibrated_levels(spark, sf):
    """Log regression of outcome on forecast over earlier sessions, brought back to levels with half the residual
    variance, and what it gains on later ones."""
    t = forecasts(spark, sf).where("persist > 0 and actual > 0").withColumns({"y": F.log("actual"), "x": F.log("persist")})
    line = evaluate.log_calibration(t.where("session_date < date'2024-01-19'"), ["asset"], "y", "x")
    level = F.exp(F.col("intercept") + F.col("slope") * F.col("x") + F.col("variance") / 2)
    p = t.where("session_date >= date'2024-01-19'").join(F.broadcast(line), "asset").withColumn("level", level)
    loss = lambda f: r6(F.avg(evaluate.qlike(F.col("actual"), F.col(f))))
    return p.groupBy("asset").agg(r6(F.max("slope")).alias("slope"), r6(F.max("intercept")).alias("intercept"), r6(F.max(F.exp(F.col("variance") / 2))).alias("smearing"), loss("persist").alias("raw"), loss("level").alias("recalibrated"))


@query("floored_persistence", f"""WITH {_LOSS} SELECT asset, count(*) AS n, count(*) FILTER (WHERE persist < 50) AS floored, {s6('avg(actual / greatest(persist, 50.0) - ln(actual / greatest(persist, 50.0)) - 1)')} AS qlike
  FROM f WHERE persist IS NOT NULL GROUP BY 1""")
def floored_persistence(spark, sf):
    f = forecasts(spark, sf).where("persist is not null").withColumn("forecast", F.greatest("persist", F.lit(50.0)))
    return f.groupBy("asset").agg(F.count("*").alias("n"), F.count_if(F.col("persist") < 50).alias("floored"), r6(F.avg(evaluate.qlike(F.col("actual"), F.col("forecast")))).alias("qlike"))


# ---- economics ---------------------------------------------------------------------------------------------

_PNL = f"""{GRID}, s AS (SELECT asset, session_date, bar, r, coalesce(sign(lag(r) OVER w), 0)::DOUBLE AS position FROM returns WHERE r IS NOT NULL WINDOW w AS (PARTITION BY asset, session_date ORDER BY bar)),
  p AS (SELECT asset, session_date, bar, position * r AS pnl FROM s)"""


def pnl(spark, sf):
    return selection.strategy(returns(spark, sf).where("r is not null"), KEYS, "bar", F.col("r"), F.col("r"), 0.0)


#: Trials that a strategy was chosen from, and the greatest of so many standard normal numbers that is to be expected: an average
#: of two quantiles, weighted by Euler's constant (a fixed value).
_TRIALS, _EULER = 5, 0.5772156649015329
_BEST = sum(w * NormalDist().inv_cdf(1 - 1 / k) for w, k in ((1 - _EULER, _TRIALS), (_EULER, _TRIALS * e)))
#: The variance of an estimated Sharpe ratio of returns that are not normal, times the returns less one.
_VARIANCE = "(1 - skew * sharpe + (kurt - 1) * sharpe * sharpe / 4)"
_SCORE = f"CASE WHEN {_VARIANCE} > 0 THEN (sharpe - {_BEST}) / sqrt({_VARIANCE} / (n - 1)) END"


@query("deflated_sharpe", f"""WITH {_PNL}, m AS (SELECT asset, avg(pnl) AS m FROM p GROUP BY 1), c AS (SELECT asset, count(*) AS n, m, avg((pnl - m) ** 2) AS m2, avg((pnl - m) ** 3) AS m3, avg((pnl - m) ** 4) AS m4 FROM p JOIN m USING (asset) GROUP BY asset, m),
  k AS (SELECT asset, n, m / sqrt(m2 * n / (n - 1)) AS sharpe, m3 / m2 ** 1.5 AS skew, m4 / (m2 * m2) AS kurt FROM c), z AS (SELECT asset, sharpe, {_SCORE} AS z FROM k)
  SELECT asset, {s6('sharpe')} AS sharpe, {s6(normal_cdf_sql('z'))} AS deflated FROM z""")
def deflated_sharpe(spark, sf):
    """Chance that a Sharpe ratio per bar is above what the best of five trials shows by luck; one aggregation."""
    x = F.col("pnl")
    k = pnl(spark, sf).groupBy("asset").agg(F.count(x).alias("n"), (F.avg(x) / F.stddev_samp(x)).alias("sharpe"), F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurt"))
    return k.select("asset", r6("sharpe").alias("sharpe"), r6(normal_cdf(F.expr(_SCORE))).alias("deflated"))


@query("risk_utility", f"""WITH {_PNL}, d AS (SELECT asset, session_date, sum(pnl) AS x FROM p GROUP BY 1, 2), q AS (SELECT asset, session_date, x, avg(x) OVER w - 1.645 * stddev_samp(x) OVER w AS bound, count(x) OVER w AS n FROM d WINDOW w AS (PARTITION BY asset ORDER BY session_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
  SELECT asset, {s6('avg(x) - 1.5 * var_samp(x)')} AS certainty_equivalent, count(*) FILTER (WHERE n = 10) AS judged, count(*) FILTER (WHERE n = 10 AND x < bound) AS breaches FROM q GROUP BY 1""")
def risk_utility(spark, sf):
    """Certainty equivalent of a mean-variance investor, and how often a loss falls below its bound from the ten
    sessions before."""
    d = pnl(spark, sf).groupBy(*KEYS).agg(F.sum("pnl").alias("x"))
    w = W.partitionBy("asset").orderBy("session_date").rowsBetween(-10, -1)
    q = d.withColumns({"bound": F.avg("x").over(w) - 1.645 * F.stddev_samp("x").over(w), "n": F.count("x").over(w)})
    return q.groupBy("asset").agg(r6(F.avg("x") - 1.5 * F.var_samp("x")).alias("certainty_equivalent"), F.count_if(F.col("n") == 10).alias("judged"), F.count_if((F.col("n") == 10) & (F.col("x") < F.col("bound"))).alias("breaches"))


@query("hedged_pnl", f"""WITH {GRID}, d AS (SELECT *, 5 * close ** 0.5 AS price, 2.5 / close ** 0.5 AS delta FROM grid WHERE close > 0), c AS (SELECT asset, session_date, lead(price) OVER w - price AS option_move, delta * (lead(close) OVER w - close) AS hedge_move FROM d WINDOW w AS (PARTITION BY asset, session_date ORDER BY bar))
  SELECT asset, session_date, count(option_move) AS steps, {s6('sum(option_move)')} AS bare, {s6('sum(option_move - hedge_move)')} AS hedged FROM c GROUP BY 1, 2""", dates=["session_date"])
def hedged_pnl(spark, sf):
    """A claim priced as a root of the close, held bare and against its delta, step by step."""
    from .state import dense

    d = dense(spark, sf).where("close > 0").withColumns({"price": 5 * F.sqrt("close"), "delta": 2.5 / F.sqrt("close")})
    c = selection.hedged(d, KEYS, "bar", "price", "close", "delta")
    return c.groupBy(*KEYS).agg(F.count("option_move").alias("steps"), r6(F.sum("option_move")).alias("bare"), r6(F.sum(F.col("option_move") - F.col("hedge_move"))).alias("hedged"))


@query("constrained_positions", f"""WITH {GRID}, s AS (SELECT asset, session_date, bar, greatest(-1.0, least(1.0, r * 2)) AS wanted FROM returns WHERE r IS NOT NULL), t AS (SELECT *, sum(abs(wanted)) OVER (PARTITION BY session_date, bar) AS gross FROM s)
  SELECT asset, session_date, bar::INTEGER AS bar, {s6('CASE WHEN gross > 2 THEN wanted * 2 / gross ELSE wanted END')} AS position FROM t""", dates=["session_date"])
def constrained_positions(spark, sf):
    """Positions within one unit each and two units in all at every bar."""
    s = returns(spark, sf).where("r is not null").select(*KEYS, "bar", (F.col("r") * 2).alias("wanted"))
    return selection.constrained(s, ["session_date", "bar"], "wanted", each=1.0, all_=2.0).select(*KEYS, "bar", r6("position").alias("position"))


@query("detectable_effects", f"""WITH {_PAIRED} SELECT count(*) AS n, {s6('2.8015852181 * stddev_samp(d) / sqrt(count(*))')} AS mde, {s6('sign(avg(d)) * greatest(abs(avg(d)) - sqrt(2 * ln(4)) * stddev_samp(d) / sqrt(count(*)), 0)')} AS shrunk FROM daily""")
def detectable_effects(spark, sf):
    d = paired(spark, sf)
    se, mean = F.stddev_samp("difference") / F.sqrt(F.count("*")), F.avg("difference")
    lead = F.greatest(F.abs(mean) - F.sqrt(2 * F.log(F.lit(4.0))) * se, F.lit(0.0))
    return d.agg(F.count("*").alias("n"), r6(F.lit(2.8015852181) * se).alias("mde"), r6(F.signum(mean) * lead).alias("shrunk"))
