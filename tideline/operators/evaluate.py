"""Forecast losses, calibration, and tests over session series.

Losses and series are Spark aggregations; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def qlike(actual: Column, forecast: Column) -> Column:
    """actual / forecast - ln(actual / forecast) - 1; null where either is not positive."""
    ratio = actual / forecast
    return F.when((actual > 0) & (forecast > 0), ratio - F.log(ratio) - 1)


def pinball(actual: Column, forecast: Column, q: float) -> Column:
    gap = actual - forecast
    return F.greatest(F.lit(q) * gap, F.lit(q - 1) * gap)


def session_equal_mean(rows: DataFrame, session: str, value: str, by: list[str]) -> DataFrame:
    """Mean of the sessions' means, so that each session counts once."""
    return rows.groupBy(*by, session).agg(F.avg(value).alias("m")).groupBy(*by).agg(F.avg("m").alias(value), F.count("*").alias("sessions"))


def paired_daily(rows: DataFrame, session: str, model: str, loss: str, base: str, other: str, pair: list[str]) -> DataFrame:
    """Mean loss difference base - other per session over the origins that both forecast: one aggregation by
    origin instead of a self-join."""
    value = lambda m: F.max(F.when(F.col(model) == m, F.col(loss)))
    both = rows.where(F.col(model).isin(base, other)).groupBy(session, *pair).agg(value(base).alias("a"), value(other).alias("b")).where("a is not null and b is not null")
    return both.groupBy(session).agg(F.avg(F.col("a") - F.col("b")).alias("difference"), F.count("*").alias("origins"))


def mincer_zarnowitz(rows: DataFrame, by: list[str], actual: Column, forecast: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.regr_slope(actual, forecast).alias("slope"), F.regr_intercept(actual, forecast).alias("intercept"), F.regr_r2(actual, forecast).alias("r2"), F.regr_count(actual, forecast).alias("n"))


def holm(rows: DataFrame, family: list[str], p: str) -> DataFrame:
    """Step-down adjusted p-values."""
    over = W.partitionBy(*family).orderBy(p)
    ranked = rows.withColumn("_i", F.row_number().over(over)).withColumn("_n", F.count("*").over(W.partitionBy(*family)))
    step = (F.col("_n") - F.col("_i") + 1) * F.col(p)
    return ranked.withColumn("_s", step).withColumn("adjusted", F.least(F.lit(1.0), F.max("_s").over(over.rowsBetween(W.unboundedPreceding, 0)))).drop("_i", "_n", "_s")


def benjamini_hochberg(rows: DataFrame, family: list[str], p: str) -> DataFrame:
    over = W.partitionBy(*family).orderBy(p)
    ranked = rows.withColumn("_i", F.row_number().over(over)).withColumn("_n", F.count("*").over(W.partitionBy(*family)))
    return ranked.withColumn("_s", F.col(p) * F.col("_n") / F.col("_i")).withColumn("adjusted", F.least(F.lit(1.0), F.min("_s").over(over.rowsBetween(0, W.unboundedFollowing)))).drop("_i", "_n", "_s")


def clustered_mean(rows: DataFrame, cluster: str, value: str, by: list[str]) -> DataFrame:
    """Mean over rows with its cluster-robust standard error and t."""
    sums = rows.groupBy(*by, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    # residual sums of clusters expand into sums of s^2, s*n and n^2, so two levels of sums suffice
    t = sums.groupBy(*by).agg(F.sum("s").alias("S"), F.sum("n").alias("N"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("s") * F.col("n")).alias("sn"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("g"))
    mean = F.col("S") / F.col("N")
    meat = F.greatest(F.col("ss") - 2 * mean * F.col("sn") + mean * mean * F.col("nn"), F.lit(0.0))
    se = F.sqrt(meat * F.col("g") / (F.col("g") - 1)) / F.col("N")
    return t.where("g > 1").select(*by, "g", mean.alias("mean"), se.alias("se"), F.when(se > 0, mean / se).alias("t"))


def newey_west(series: DataFrame, order: str, value: str, lags: int) -> DataFrame:
    """Mean of a session series, its Newey-West standard error and t."""
    over = W.orderBy(order)
    centred = series.withColumn("_d", F.col(value) - F.avg(value).over(W.partitionBy()))
    terms = [F.sum(F.col("_d") * F.col("_d")).alias("c0")]
    for k in range(1, lags + 1):
        centred = centred.withColumn(f"_p{k}", F.col("_d") * F.lag("_d", k).over(over))
        terms.append(F.sum(f"_p{k}").alias(f"c{k}"))
    sums = centred.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), *terms)
    long = F.col("c0")
    for k in range(1, lags + 1):
        long = long + 2 * (1 - k / (lags + 1)) * F.coalesce(F.col(f"c{k}"), F.lit(0.0))
    se = F.sqrt(F.greatest(long, F.lit(0.0))) / F.col("n")
    return sums.select("n", "mean", se.alias("se"), F.when(se > 0, F.col("mean") / se).alias("t"))


def autocorrelation(series: DataFrame, order: str, value: str, lags: int) -> DataFrame:
    """Autocorrelations and the Ljung-Box statistic up to each lag."""
    centred = series.withColumn("_d", F.col(value) - F.avg(value).over(W.partitionBy()))
    over = W.orderBy(order)
    lagged = centred.withColumns({f"_p{k}": F.col("_d") * (F.lag("_d", k).over(over) if k else F.col("_d")) for k in range(lags + 1)})
    pairs = lagged.select(F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_p{k}").alias("p")) for k in range(lags + 1)])).alias("x")).select("x.*")
    sums = pairs.groupBy("lag").agg(F.sum("p").alias("s"), F.count("p").alias("m"))
    base = sums.where("lag = 0").select(F.col("s").alias("s0"), F.col("m").alias("n"))
    rho = sums.where("lag > 0").crossJoin(F.broadcast(base)).select("lag", "n", (F.col("s") / F.col("s0")).alias("rho"))
    term = F.col("rho") * F.col("rho") / (F.col("n") - F.col("lag"))
    return rho.withColumn("ljung_box", F.col("n") * (F.col("n") + 2) * F.sum(term).over(W.orderBy("lag").rowsBetween(W.unboundedPreceding, 0)))


def random_effects(groups: DataFrame, effect: str, variance: str, by: list[str]) -> DataFrame:
    """Random-effects mean with Cochran's Q, I2 and tau2."""
    w, x = F.lit(1.0) / F.col(variance), F.col(effect)
    s = groups.withColumn("_w", w).groupBy(*by).agg(F.count("*").alias("k"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_w")).alias("w2"), F.sum(F.col("_w") * x).alias("wx"), F.sum(F.col("_w") * x * x).alias("wxx"))
    q = F.col("wxx") - F.col("wx") * F.col("wx") / F.col("w")
    df = F.col("k") - 1
    s = s.select(*by, "k", q.alias("q"), F.when(q > 0, F.greatest((q - df) / q, F.lit(0.0))).otherwise(0.0).alias("i2"), F.greatest((q - df) / (F.col("w") - F.col("w2") / F.col("w")), F.lit(0.0)).alias("tau2"))
    back = groups.join(F.broadcast(s), by) if by else groups.crossJoin(F.broadcast(s))
    v = F.lit(1.0) / (F.col(variance) + F.col("tau2"))
    return back.withColumn("_v", v).groupBy(*by, "k", "q", "i2", "tau2").agg((F.sum(F.col("_v") * x) / F.sum("_v")).alias("mean"), F.sqrt(F.lit(1.0) / F.sum("_v")).alias("se"))


def clark_west(actual: Column, small: Column, large: Column) -> Column:
    return (actual - small) * (actual - small) - ((actual - large) * (actual - large) - (small - large) * (small - large))


def population_stability(train: DataFrame, test: DataFrame, bin_: str) -> DataFrame:
    """Sum over bins of the difference of shares times the logarithm of their ratio, empty shares as 1e-6."""
    share = lambda f, n: f.groupBy(bin_).agg(F.count("*").alias(n))
    both = share(train, "a").join(share(test, "b"), bin_, "full").na.fill(0, ["a", "b"])
    total = both.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    p, q = F.greatest(F.col("a") / F.col("ta"), F.lit(1e-6)), F.greatest(F.col("b") / F.col("tb"), F.lit(1e-6))
    return both.crossJoin(F.broadcast(total)).agg(F.sum((p - q) * F.log(p / q)).alias("psi"))


def kendall(rows: DataFrame, by: list[str], order: str, x: str, y: str) -> DataFrame:
    """Kendall's tau-b of two session series per group. Pairs of a group's sessions meet, so groups hold one row per
    session (some hundreds), never raw rows."""
    a, b = rows.alias("a"), rows.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in by] + [F.col(f"a.{order}") < F.col(f"b.{order}")]
    sign = lambda c: F.signum(F.col(f"a.{c}").cast("double") - F.col(f"b.{c}"))
    pairs = a.join(b, same).select(*[F.col(f"a.{k}") for k in by], sign(x).alias("sx"), sign(y).alias("sy"))
    total = lambda c, d: F.sum(F.col(c) * F.col(d))
    tau = total("sx", "sy") / F.sqrt(total("sx", "sx") * total("sy", "sy"))
    return pairs.groupBy(*by).agg(F.count("*").alias("pairs"), tau.alias("tau"))


def session_pair_auc(rows: DataFrame, by: list[str], session: str, score: str, label: str) -> DataFrame:
    """For every pair of sessions of a group the won pairs of a positive of one against a negative of the other, ties half.

    Rows are first counted by session and score. Negatives at or below each score are a running sum per session over
    the distinct scores; positives join it on group and score alone. So scores should be few or binned."""
    c = rows.groupBy(*by, session, score).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("q"))
    negative = F.col(session).alias("negative_session")
    grid = c.select(*by, score).distinct().join(c.select(*by, negative).distinct(), by).join(c.select(*by, negative, score, "q"), [*by, "negative_session", score], "left")
    q = F.coalesce("q", F.lit(0))
    up_to = F.sum(q).over(W.partitionBy(*by, "negative_session").orderBy(score).rowsBetween(W.unboundedPreceding, 0))
    below = grid.select(*by, "negative_session", score, (up_to - q / 2).alias("below"))
    positive = F.col(session).alias("positive_session")
    wins = c.where("p > 0").join(below, [*by, score]).groupBy(*by, positive, "negative_session").agg(F.sum(F.col("p") * F.col("below")).alias("wins"))
    size = lambda name, n: c.groupBy(*by, F.col(session).alias(name)).agg(F.sum(n).alias(n))
    both = wins.join(size("positive_session", "p"), [*by, "positive_session"]).join(size("negative_session", "q"), [*by, "negative_session"])
    return both.where("p > 0 and q > 0").select(*by, "positive_session", "negative_session", "wins", (F.col("p") * F.col("q")).alias("pairs"))


def log_calibration(train: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """Line of log outcome on log forecast per group, with the variance of what it leaves."""
    line = train.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"), F.regr_count(y, x).alias("_n"))
    return line.select(*by, "slope", "intercept", ((F.col("_syy") - F.col("slope") * F.col("_sxy")) / F.col("_n")).alias("variance"))


# ---- over a session series on the driver -----------------------------------------------------------------


def spending(share: Column, alpha: float) -> Column:
    """Error spent by the time a share of all information is in, by the logarithmic spending function."""
    return alpha * F.log(1 + (F.exp(F.lit(1.0)) - 1) * F.least(share, F.lit(1.0)))


def conditional_wald(rows: DataFrame, difference: str, conditioner: str) -> DataFrame:
    """``wald, p, sessions``: whether a difference has zero mean given a constant and one conditioner. With s the sums of the difference
    and of its product with the conditioner, and m those of squared residuals times the outer product of the regressors, the
    robust statistic of both coefficients is s' m^-1 s."""
    d, h = F.col(difference), F.col(conditioner)
    line = rows.agg(F.regr_slope(d, h).alias("_b"), F.regr_intercept(d, h).alias("_a"))
    e = F.pow(d - F.col("_a") - F.col("_b") * h, 2)
    s = rows.crossJoin(F.broadcast(line)).agg(F.count("*").alias("sessions"), F.sum(d).alias("s0"), F.sum(d * h).alias("s1"), F.sum(e).alias("m0"), F.sum(e * h).alias("m1"), F.sum(e * h * h).alias("m2"))
    s0, s1, m0, m1, m2 = (F.col(c) for c in ("s0", "s1", "m0", "m1", "m2"))
    wald = F.try_divide(s0 * s0 * m2 - 2 * s0 * s1 * m1 + s1 * s1 * m0, m0 * m2 - m1 * m1)
    return s.select(wald.alias("wald"), F.exp(-wald / 2).alias("p"), "sessions")


def sign_evidence(series_: DataFrame, order: str, value: str, bets: list[float], alpha: float) -> DataFrame:
    """``order, e_value, p, rejected``: the mean wealth of bets of several stakes on the sign of a series; 1 over its running maximum
    is a p-value at any time. One row a session is walked in one task."""
    over = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    wealth = [F.exp(F.sum(F.log(1 + b * F.signum(value))).over(over)) for b in bets]
    walked = series_.select(order, (sum(wealth[1:], wealth[0]) / len(bets)).alias("e_value"))
    top = F.max("e_value").over(over)
    return walked.select(order, "e_value", F.least(F.lit(1.0), 1 / top).alias("p"), (top >= 1 / alpha).alias("rejected"))


def always_valid(series_: DataFrame, order: str, value: str, bet: float) -> DataFrame:
    """A betting martingale 1 + bet * x (a factor never below 0.01) multiplied along the order, and 1 over its
    running maximum."""
    over = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    wealth = series_.withColumn("wealth", F.exp(F.sum(F.log(F.greatest(F.lit(1.0) + bet * F.col(value), F.lit(0.01)))).over(over)))
    return wealth.withColumn("p", F.least(F.lit(1.0), F.lit(1.0) / F.max("wealth").over(over)))
