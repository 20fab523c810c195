"""Domain operators: grids, realized measures, option state, flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import normal_cdf_sql
from ..operators import asof, flow, grid, normalize, options, quantiles, realized, windows
from ..sources.tables import tape
from .registry import BARS, GRID, TAPE, query, r6, s6
from .windowed import KEYS, bars, daily, over, returns

HOUR = 3_600_000_000
_W = "PARTITION BY asset, session_date ORDER BY bar"


@query("dense_grid", f"""WITH {GRID} SELECT asset, session_date, bar::INTEGER AS bar, observed, close, coalesce(high, close) AS high, coalesce(low, close) AS low, volume FROM grid""", dates=["session_date"])
def dense_grid(spark, sf):
    return grid.filled(grid.dense(bars(spark, sf), KEYS, "bar", 0, 23), KEYS, "bar").select(*KEYS, "bar", "observed", "close", "high", "low", "volume")


@query("bars", f"WITH {BARS} SELECT asset, session_date, bar::INTEGER AS bar, open, high, low, close, volume FROM bars", dates=["session_date"])
def bars_query(spark, sf):
    return bars(spark, sf).select(*KEYS, "bar", "open", "high", "low", "close", "volume")


@query("origin_grid", f"""WITH {TAPE} SELECT asset, session_date, h::INTEGER AS bar, CASE WHEN h < 8 THEN 'early' WHEN h < 16 THEN 'middle' ELSE 'late' END AS tercile FROM (SELECT DISTINCT asset, session_date FROM tape), range(1, 24 - CASE WHEN isodow(session_date) = 5 THEN 4 ELSE 2 END, 2) r(h)""", dates=["session_date"])
def origin_grid(spark, sf):
    sessions = tape(spark, sf).select(*KEYS).distinct()
    last = F.lit(23) - F.when(F.weekday("session_date") == 4, 4).otherwise(2)
    o = grid.origins(sessions, "bar", 1, last, 2)
    return o.withColumn("tercile", F.when(F.col("bar") < 8, "early").when(F.col("bar") < 16, "middle").otherwise("late"))


@query("origin_presence", f"""WITH {TAPE}, o AS (SELECT DISTINCT asset, epoch_us(session_date::TIMESTAMP) + h * {HOUR} AS origin FROM tape, range(1, 24) r(h)) SELECT asset, origin, EXISTS (SELECT 1 FROM tape t WHERE t.asset = o.asset AND t.executed_us > origin - 600000000 AND t.executed_us <= origin) AS active FROM o""")
def origin_presence(spark, sf):
    rows = tape(spark, sf)
    o = rows.select("asset", "session_date").distinct().withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(23)))).select("asset", (F.unix_micros(F.col("session_date").cast("timestamp")) + F.col("h") * HOUR).alias("origin"))
    hit = asof.within(o, rows.select("asset", "executed_us"), ["asset"], "origin", "executed_us", 600_000_000 - 1).select("asset", "origin").distinct().withColumn("a", F.lit(True))
    return o.join(hit, ["asset", "origin"], "left").select("asset", "origin", F.coalesce("a", F.lit(False)).alias("active"))


_FWD = f"""{GRID}, p AS (SELECT *, abs(r) * abs(lag(r) OVER ({_W})) AS pair FROM returns), f AS (SELECT asset, session_date, bar, count(r) OVER w AS n, sum(r * r) OVER w AS rv, sum(r * r * r * r) OVER w AS r4, sum(CASE WHEN r > 0 THEN r * r ELSE 0 END) OVER w AS pos,
  sum(CASE WHEN r < 0 THEN r * r ELSE 0 END) OVER w AS neg, sum(pair) OVER v AS pairs, count(pair) OVER v AS m FROM p WINDOW w AS ({_W} ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), v AS ({_W} ROWS BETWEEN 2 FOLLOWING AND 4 FOLLOWING)),
  g AS (SELECT asset, session_date, bar, rv, r4 * 4 / 3.0 AS rq, pos, neg, CASE WHEN m = 3 THEN pi() / 2 * pairs END AS bv FROM f WHERE n = 4)"""


@query("realized_measures", f"""WITH {_FWD} SELECT asset, session_date, bar::INTEGER AS bar, {s6('rv')} AS rv, {s6('bv')} AS bv, {s6('rq')} AS rq, {s6('pos')} AS rs_pos, {s6('neg')} AS rs_neg, {s6('greatest(rv - bv, 0.0)')} AS jump,
  {s6('rv - greatest(rv - bv, 0.0)')} AS continuous, {s6('CASE WHEN rv > 0 THEN sqrt(2 * rq / 4) / rv END')} AS noise FROM g""", dates=["session_date"])
def realized_measures(spark, sf):
    f = realized.forward(returns(spark, sf), KEYS, "bar", 4).where("rv is not null").withColumn("noise", realized.relative_noise(F.col("rv"), F.col("rq"), 4))
    return f.select(*KEYS, "bar", *[r6(c).alias(c) for c in ("rv", "bv", "rq", "rs_pos", "rs_neg", "jump", "continuous", "noise")])


@query("target_with_status", f"""WITH {GRID}, t AS (SELECT asset, session_date, bar, sum(r * r) OVER w AS rv, count(*) OVER w AS n, count(*) FILTER (WHERE observed) OVER w AS seen, observed, r FROM returns WINDOW w AS ({_W} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
  SELECT asset, session_date, bar::INTEGER AS bar, CASE WHEN n < 3 THEN 'HORIZON_CUT' WHEN NOT observed THEN 'ANCHOR_MISSING' WHEN seen < 3 THEN 'FUTURE_MISSING' ELSE 'OK' END AS status, CASE WHEN n = 3 AND observed AND seen = 3 THEN {s6('rv')} END AS target FROM t""", dates=["session_date"])
def target_with_status(spark, sf):
    frame = over().rowsBetween(1, 3)
    t = returns(spark, sf).withColumns({"rv": F.sum(F.col("r") * F.col("r")).over(frame), "n": F.count("*").over(frame), "seen": F.count_if("observed").over(frame)})
    status = F.when(F.col("n") < 3, "HORIZON_CUT").when(~F.col("observed"), "ANCHOR_MISSING").when(F.col("seen") < 3, "FUTURE_MISSING").otherwise("OK")
    return t.select(*KEYS, "bar", status.alias("status"), F.when((F.col("n") == 3) & F.col("observed") & (F.col("seen") == 3), r6("rv")).alias("target"))


@query("parkinson", f"""WITH {GRID}, l AS (SELECT *, ln(coalesce(high, close) / coalesce(low, close)) AS x FROM grid) SELECT asset, session_date, bar::INTEGER AS bar, CASE WHEN count(x) OVER w = 4 THEN {s6('sum(x * x) OVER w / (4 * ln(2) * 4)')} END AS parkinson FROM l WINDOW w AS ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""", dates=["session_date"])
def parkinson(spark, sf):
    g = grid.filled(grid.dense(bars(spark, sf), KEYS, "bar", 0, 23), KEYS, "bar")
    return g.select(*KEYS, "bar", r6(realized.parkinson(F.col("high"), F.col("low"), over(), 4)).alias("parkinson"))


@query("noise_corrected_rv", f"""WITH {GRID}, x AS (SELECT *, r * lag(r) OVER ({_W}) AS pr FROM returns) SELECT asset, session_date, bar::INTEGER AS bar, CASE WHEN count(r) OVER w = 4 AND count(pr) OVER v = 3 THEN {s6('greatest(sum(r * r) OVER w + 2 * sum(pr) OVER v, 0.0)')} END AS rv
  FROM x WINDOW w AS ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), v AS ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""", dates=["session_date"])
def noise_corrected_rv(spark, sf):
    x = returns(spark, sf).withColumn("pr", F.col("r") * F.lag("r").over(over()))
    rv = F.greatest(windows.gap_aware_sum(F.col("r") * F.col("r"), over(), -3, 0) + 2 * windows.gap_aware_sum(F.col("pr"), over(), -2, 0), F.lit(0.0))
    both = windows.gap_aware_sum(F.col("r") * F.col("r"), over(), -3, 0).isNotNull() & windows.gap_aware_sum(F.col("pr"), over(), -2, 0).isNotNull()
    return x.select(*KEYS, "bar", F.when(both, r6(rv)).alias("rv"))


@query("har_features", f"""WITH {GRID}, s AS (SELECT asset, session_date, sum(r * r) AS rv FROM returns GROUP BY 1, 2) SELECT asset, session_date, {s6('rv')} AS rv, {s6('lag(rv) OVER (PARTITION BY asset ORDER BY session_date)')} AS rv_day,
  CASE WHEN count(rv) OVER w = 5 THEN {s6('avg(rv) OVER w')} END AS rv_week FROM s WINDOW w AS (PARTITION BY asset ORDER BY session_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""", dates=["session_date"])
def har_features(spark, sf):
    s = returns(spark, sf).groupBy(*KEYS).agg(F.sum(F.col("r") * F.col("r")).alias("rv"))
    return realized.har(s, "asset", "session_date", "rv").select(*KEYS, *[r6(c).alias(c) for c in ("rv", "rv_day", "rv_week")])


@query("seasonality_index", f"""WITH {GRID}, m AS (SELECT bar, avg(r * r) AS m FROM returns WHERE session_date < DATE '2024-01-19' AND r IS NOT NULL GROUP BY 1) SELECT bar::INTEGER AS bar, {s6('m - avg(m) OVER ()')} AS seasonal FROM m""")
def seasonality_index(spark, sf):
    train = returns(spark, sf).where("session_date < date'2024-01-19' and r is not null").withColumn("r2", F.col("r") * F.col("r"))
    return realized.seasonality(train, "bar", "r2").withColumn("seasonal", r6("seasonal"))


@query("market_controls", f"""WITH {GRID}, c AS (SELECT session_date, bar, r FROM returns WHERE asset = 'view' AND bar > 2), d AS (SELECT session_date, bar, r FROM returns WHERE asset = 'click' AND bar < 22)
  SELECT session_date, bar::INTEGER AS bar, {s6('c.r')} AS view_r, {s6('d.r')} AS click_r FROM c FULL JOIN d USING (session_date, bar)""", dates=["session_date"])
def market_controls(spark, sf):
    r = returns(spark, sf)
    a = r.where("asset = 'view' and bar > 2").select("session_date", "bar", r6("r").alias("view_r"))
    b = r.where("asset = 'click' and bar < 22").select("session_date", "bar", r6("r").alias("click_r"))
    return a.join(b, ["session_date", "bar"], "full")


@query("two_clock_window", f"""WITH {TAPE}, o AS (SELECT DISTINCT asset, session_date, epoch_us(session_date::TIMESTAMP) + h * {HOUR} AS origin FROM tape, range(1, 24) r(h)),
  w AS (SELECT o.asset, o.origin, count(*) AS n, sum(premium) AS premium, sum(direction * premium) AS signed FROM o JOIN tape t ON t.asset = o.asset AND t.executed_us >= o.origin - 120000000 - {HOUR} AND t.executed_us < o.origin - 120000000 AND t.created_us <= o.origin - 120000000 GROUP BY 1, 2)
  SELECT o.asset, o.session_date, o.origin, coalesce(n, 0) AS n, {s6('coalesce(premium, 0.0)')} AS premium, {s6('coalesce(signed, 0.0)')} AS signed, n IS NULL AS is_empty FROM o LEFT JOIN w USING (asset, origin)""", dates=["session_date"])
def two_clock_window(spark, sf):
    """Hourly windows by execution, of what was known two minutes before each origin; every origin has a row."""
    rows = tape(spark, sf)
    sums = windows.two_clock(rows, "executed_us", "created_us", HOUR, HOUR, 120_000_000).groupBy("asset", "origin").agg(F.count("*").alias("n"), F.sum("premium").alias("premium"), F.sum(F.col("direction") * F.col("premium")).alias("signed"))
    o = rows.select("asset", "session_date").distinct().withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(23)))).select("asset", "session_date", (F.unix_micros(F.col("session_date").cast("timestamp")) + F.col("h") * HOUR).alias("origin"))
    out = o.join(sums, ["asset", "origin"], "left")
    return out.select("asset", "session_date", "origin", F.coalesce("n", F.lit(0)).alias("n"), r6(F.coalesce("premium", F.lit(0.0))).alias("premium"), r6(F.coalesce("signed", F.lit(0.0))).alias("signed"), F.col("n").isNull().alias("is_empty"))


@query("counting_window", f"""WITH {TAPE}, f AS (SELECT *, greatest(ceil(created_us / {HOUR}.0)::BIGINT * {HOUR}, epoch_us(session_date::TIMESTAMP) + 6 * {HOUR}) AS window_end FROM tape) SELECT asset, window_end, count(*) AS n FROM f GROUP BY 1, 2""")
def counting_window(spark, sf):
    first = F.unix_micros(F.col("session_date").cast("timestamp")) + 6 * HOUR
    return windows.tiled(tape(spark, sf), "created_us", HOUR, first).groupBy("asset", "window_end").agg(F.count("*").alias("n"))


@query("window_quantile", f"""WITH {TAPE}, w AS (SELECT asset, (executed_us // {HOUR} + 1) * {HOUR} AS origin, (created_us - executed_us) / 1e6 AS lag FROM tape) SELECT asset, origin, {s6('quantile_cont(lag, 0.95)')} AS p95 FROM w GROUP BY 1, 2""")
def window_quantile(spark, sf):
    w = windows.forward(tape(spark, sf), "executed_us", HOUR, HOUR)
    lag = (F.col("created_us") - F.col("executed_us")) / 1e6
    found = quantiles.wide(w.withColumnRenamed("window_end", "origin"), ["asset", "origin"], {"p95": (lag, 0.95)})
    return found.withColumn("p95", r6("p95"))


@query("activity_compact", f"""WITH {TAPE}, k AS (SELECT asset, session_date, strike, count(*) AS c, sum(premium) AS w FROM tape GROUP BY 1, 2, 3), t AS (SELECT asset, session_date, sum(c) AS n, sum(w) AS w, max(c) AS top FROM k GROUP BY 1, 2),
  d AS (SELECT asset, session_date, sum(direction * premium) AS s, count(DISTINCT contract) AS contracts FROM tape GROUP BY 1, 2)
  SELECT asset, session_date, {s6('ln(1 + n)')} AS log_n, {s6('ln(1 + w)')} AS log_premium, {s6('s / w')} AS imbalance, {s6('top / n')} AS top_share, contracts FROM t JOIN d USING (asset, session_date)""", dates=["session_date"])
def activity_compact(spark, sf):
    rows = tape(spark, sf)
    t = rows.groupBy(*KEYS, "strike").agg(F.count("*").alias("c"), F.sum("premium").alias("w")).groupBy(*KEYS).agg(F.sum("c").alias("n"), F.sum("w").alias("w"), F.max("c").alias("top"))
    d = rows.groupBy(*KEYS).agg(F.sum(F.col("direction") * F.col("premium")).alias("s"), F.countDistinct("contract").alias("contracts"))
    return t.join(d, KEYS).select(*KEYS, r6(F.log1p("n")).alias("log_n"), r6(F.log1p("w")).alias("log_premium"), r6(F.col("s") / F.col("w")).alias("imbalance"), r6(F.col("top") / F.col("n")).alias("top_share"), "contracts")


@query("decayed_activity", f"""WITH {TAPE}, o AS (SELECT DISTINCT asset, epoch_us(session_date::TIMESTAMP) + 12 * {HOUR} AS cutoff FROM tape) SELECT o.asset, o.cutoff, {s6('sum(exp((t.created_us - o.cutoff) / 6e8))')} AS activity FROM o JOIN tape t ON t.asset = o.asset AND t.created_us BETWEEN o.cutoff - {2 * HOUR} AND o.cutoff GROUP BY 1, 2""")
def decayed_activity(spark, sf):
    rows = tape(spark, sf)
    o = rows.select("asset", (F.unix_micros(F.col("session_date").cast("timestamp")) + 12 * HOUR).alias("cutoff")).distinct()
    return flow.decayed(o, rows.select("asset", "created_us"), ["asset"], "cutoff", "created_us", 600_000_000, 2 * HOUR).withColumn("activity", r6("activity"))


@query("signed_exposure", f"""WITH {TAPE}, e AS (SELECT asset, session_date, strike, sum(direction * premium) AS e FROM tape GROUP BY 1, 2, 3) SELECT asset, session_date, {s6('sum(e)')} AS total, min_by(strike, (-abs({s6('e')}), abs(strike - 50), strike)) AS peak_strike FROM e GROUP BY 1, 2""", dates=["session_date"])
def signed_exposure(spark, sf):
    e = tape(spark, sf).groupBy(*KEYS, "strike").agg(r6(F.sum(F.col("direction") * F.col("premium"))).alias("e"))
    total = tape(spark, sf).groupBy(*KEYS).agg(r6(F.sum(F.col("direction") * F.col("premium"))).alias("total"))
    return options.exposure(e, KEYS, "strike", "e", F.lit(50)).drop("total").join(total, KEYS).select(*KEYS, "total", "peak_strike")


@query("trade_direction", f"""WITH {TAPE} SELECT asset, direction::INTEGER AS direction, is_call, count(*) AS n FROM tape GROUP BY 1, 2, 3""")
def trade_direction(spark, sf):
    return tape(spark, sf).groupBy("asset", "direction", "is_call").agg(F.count("*").alias("n"))


@query("availability_status", f"""WITH {TAPE}, c AS (SELECT asset, session_date, count(*) AS n, count(*) FILTER (WHERE created_us - executed_us <= 120000000) AS seen FROM tape GROUP BY 1, 2) SELECT asset, session_date, CASE WHEN n < 20 THEN 'sparse' WHEN seen * 2 < n THEN 'late' ELSE 'available' END AS status, n, seen FROM c""", dates=["session_date"])
def availability_status(spark, sf):
    c = tape(spark, sf).groupBy(*KEYS).agg(F.count("*").alias("n"), F.count_if(F.col("created_us") - F.col("executed_us") <= 120_000_000).alias("seen"))
    return c.select(*KEYS, F.when(F.col("n") < 20, "sparse").when(F.col("seen") * 2 < F.col("n"), "late").otherwise("available").alias("status"), "n", "seen")


_PRIOR = """h AS (SELECT a.asset, a.session_no, b.total AS past FROM d a JOIN d b ON a.asset = b.asset AND b.session_no BETWEEN a.session_no - 15 AND a.session_no - 1),
  m AS (SELECT asset, session_no, count(*) AS n, median(past) AS m, quantile_cont(past, 0.75) - quantile_cont(past, 0.25) AS iqr FROM h GROUP BY 1, 2),
  s AS (SELECT m.asset, m.session_no, n, m, iqr, median(abs(past - m)) AS mad FROM m JOIN h USING (asset, session_no) GROUP BY 1, 2, 3, 4, 5)"""


@query("robust_prior_z", f"""WITH {TAPE}, t AS (SELECT asset, session_date, sum(premium) AS total FROM tape GROUP BY 1, 2), d AS (SELECT *, dense_rank() OVER (ORDER BY session_date) AS session_no FROM t), {_PRIOR}
  SELECT d.asset, d.session_date, {s6('(total - m) / CASE WHEN mad > 0 THEN 1.4826 * mad WHEN iqr > 0 THEN iqr / 1.349 END')} AS z FROM d LEFT JOIN (SELECT * FROM s WHERE n >= 8) s USING (asset, session_no)""", dates=["session_date"])
def robust_prior_z(spark, sf):
    return normalize.robust_prior(daily(spark, sf), ["asset"], "session_date", "total", 15, 8).select(*KEYS, r6("z").alias("z"))


@query("strata_tertiles", f"""WITH {TAPE}, t AS (SELECT asset, session_date, sum(premium) AS total FROM tape GROUP BY 1, 2), q AS (SELECT quantile_cont(total, 1 / 3.0) AS a, quantile_cont(total, 2 / 3.0) AS b FROM t WHERE session_date < DATE '2024-01-19')
  SELECT asset, session_date, CASE WHEN total <= a THEN 0 WHEN total <= b THEN 1 ELSE 2 END AS stratum FROM t, q""", dates=["session_date"])
def strata_tertiles(spark, sf):
    d = daily(spark, sf)
    return d.select(*KEYS, normalize.stratum("total", normalize.cutpoints(d.where("session_date < date'2024-01-19'"), "total")).alias("stratum"))


# ---- option state on derived quotes: strike from the tape, price falling in strike for calls, rising for puts ----

_QUOTES = f"""{TAPE}, q AS (SELECT asset, session_date, strike + 50 AS k, avg(CASE WHEN is_call THEN premium END) / 100 + (100 - strike) * 0.9 AS c, avg(CASE WHEN NOT is_call THEN premium END) / 100 AS p FROM tape GROUP BY 1, 2, strike)"""


def quotes(spark, sf):
    q = tape(spark, sf).groupBy(*KEYS, "strike").agg(F.avg(F.when(F.col("is_call"), F.col("premium"))).alias("c"), F.avg(F.when(~F.col("is_call"), F.col("premium"))).alias("p"))
    return q.select(*KEYS, (F.col("strike") + 50).alias("k"), (F.col("c") / 100 + (100 - F.col("strike")) * 0.9).alias("c"), (F.col("p") / 100).alias("p"))


@query("co_strike_forward", f"""WITH {_QUOTES}, l AS (SELECT asset, session_date, count(*) AS strikes, regr_slope(c - p, k::DOUBLE) AS slope, regr_intercept(c - p, k::DOUBLE) AS intercept FROM q WHERE c IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2)
  SELECT asset, session_date, strikes, {s6('-intercept / slope')} AS forward, {s6('-slope')} AS discount FROM l WHERE strikes >= 3 AND slope <> 0""", dates=["session_date"])
def co_strike_forward(spark, sf):
    q = quotes(spark, sf)
    f = options.implied_forward(q.where("c is not null").withColumnRenamed("c", "price"), q.where("p is not null").withColumnRenamed("p", "price"), KEYS, "k", "price")
    return f.where("slope <> 0").select(*KEYS, "strikes", r6("forward").alias("forward"), r6("discount").alias("discount"))


_DELTA = normal_cdf_sql("d1")


@query("bs_delta", f"""WITH {TAPE}, d AS (SELECT seq, is_call, (ln(100.0 / (strike + 50)) + 0.04 * 0.25 / 2) / (0.2 * sqrt(0.25)) AS d1 FROM tape) SELECT seq, {s6(f'CASE WHEN is_call THEN {_DELTA} ELSE {_DELTA} - 1 END')} AS delta, {s6('exp(-d1 * d1 / 2) / sqrt(2 * pi()) / (100.0 * 0.2 * sqrt(0.25))')} AS gamma FROM d""")
def bs_delta(spark, sf):
    k, iv, t, f = (F.col("strike") + 50).cast("double"), F.lit(0.2), F.lit(0.25), F.lit(100.0)
    return tape(spark, sf).select("seq", r6(options.black_delta(f, k, iv, t, F.col("is_call"))).alias("delta"), r6(options.black_gamma(f, k, iv, t)).alias("gamma"))


_SUMS = ", ".join([*(f"sum(pow(x, {k})) AS s{k}" for k in (1, 2, 3, 4)), *(f"sum(pow(x, {k}) * y) AS t{k}" for k in (0, 1, 2))])


@query("smile_fit", f"""WITH {TAPE}, v AS (SELECT asset, session_date, strike / 50.0 - 1 AS x, avg(premium) / 100 AS y FROM tape GROUP BY asset, session_date, strike), s AS (SELECT asset, session_date, count(*) AS n, {_SUMS} FROM v GROUP BY 1, 2),
  d AS (SELECT *, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM s)
  SELECT asset, session_date, n AS points, {s6('(t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / det')} AS level,
  {s6('(n * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / det')} AS slope, {s6('(n * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)) / det')} AS curvature FROM d WHERE n >= 3 AND abs(det) > 1e-9""", dates=["session_date"])
def smile_fit(spark, sf):
    v = tape(spark, sf).groupBy(*KEYS, "strike").agg((F.avg("premium") / 100).alias("y"))
    s = options.smile(v, KEYS, F.col("strike") / 50.0 - 1, F.col("y")).where("level is not null")
    return s.select(*KEYS, "points", *[r6(c).alias(c) for c in ("level", "slope", "curvature")])


@query("total_variance_interp", f"""WITH {TAPE}, v AS (SELECT asset, session_date, strike AS x, avg(premium) AS y FROM tape WHERE strike % 7 = 0 GROUP BY 1, 2, 3), t AS (SELECT unnest([7.0, 14.0, 30.0, 60.0, 90.0]) AS target),
  e AS (SELECT asset, session_date, target, max(CASE WHEN x <= target THEN x END) AS lx, max_by(y, x) FILTER (WHERE x <= target) AS ly, min(CASE WHEN x >= target THEN x END) AS hx, min_by(y, x) FILTER (WHERE x >= target) AS hy FROM v, t GROUP BY 1, 2, 3)
  SELECT asset, session_date, target::DOUBLE AS target, {s6('CASE WHEN lx IS NULL THEN hy WHEN hx IS NULL OR hx = lx THEN ly ELSE ly + (target - lx) / (hx - lx) * (hy - ly) END')} AS y FROM e""", dates=["session_date"])
def total_variance_interp(spark, sf):
    v = tape(spark, sf).where("strike % 7 = 0").groupBy(*KEYS, F.col("strike").alias("x")).agg(F.avg("premium").alias("y"))
    return options.interpolated(v, KEYS, "x", "y", [7, 14, 30, 60, 90]).withColumn("y", r6("y"))


@query("butterfly_count", f"""WITH {_QUOTES}, b AS (SELECT asset, session_date, (lead(c) OVER w - c) / (lead(k) OVER w - k) - (c - lag(c) OVER w) / (k - lag(k) OVER w) AS bent FROM q WHERE c IS NOT NULL WINDOW w AS (PARTITION BY asset, session_date ORDER BY k))
  SELECT asset, session_date, count(bent) AS triples, count(*) FILTER (WHERE bent < -1e-12) AS violations FROM b GROUP BY 1, 2""", dates=["session_date"])
def butterfly_count(spark, sf):
    return options.butterflies(quotes(spark, sf).where("c is not null"), KEYS, "k", "c")


@query("calendar_count", f"""WITH {TAPE}, v AS (SELECT asset, session_date, strike // 10 AS tenor, avg(premium) AS w FROM tape GROUP BY 1, 2, 3), f AS (SELECT asset, session_date, w < lag(w) OVER (PARTITION BY asset, session_date ORDER BY tenor) AS fall FROM v) SELECT asset, session_date, count(fall) AS pairs, count(*) FILTER (WHERE fall) AS violations FROM f GROUP BY 1, 2""", dates=["session_date"])
def calendar_count(spark, sf):
    v = tape(spark, sf).groupBy(*KEYS, F.floor(F.col("strike") / 10).alias("tenor")).agg(F.avg("premium").alias("w"))
    return options.calendar_violations(v, KEYS, "tenor", "w")


@query("model_free_variance", f"""WITH {_QUOTES}, w AS (SELECT asset, session_date, k, p, (coalesce(lead(k) OVER w, k) - coalesce(lag(k) OVER w, k)) / CASE WHEN lead(k) OVER w IS NOT NULL AND lag(k) OVER w IS NOT NULL THEN 2.0 ELSE 1.0 END AS d FROM q WHERE p IS NOT NULL WINDOW w AS (PARTITION BY asset, session_date ORDER BY k))
  SELECT asset, session_date, {s6('2.0 / 0.25 * sum(d / (k * k) * p)')} AS variance FROM w GROUP BY 1, 2""", dates=["session_date"])
def model_free_variance(spark, sf):
    q = quotes(spark, sf).where("p is not null").withColumn("years", F.lit(0.25))
    return options.model_free_variance(q, KEYS, "k", "p", "years").withColumn("variance", r6("variance"))


@query("parity_residual", f"""WITH {_QUOTES} SELECT asset, session_date, {s6('median(abs(c - p - 0.9 * (150 - k)))')} AS residual FROM q WHERE c IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2""", dates=["session_date"])
def parity_residual(spark, sf):
    return quotes(spark, sf).where("c is not null and p is not null").groupBy(*KEYS).agg(r6(F.median(F.abs(F.col("c") - F.col("p") - 0.9 * (150 - F.col("k"))))).alias("residual"))


@query("contract_grid_top1", f"""WITH {TAPE}, t AS (SELECT unnest([0.9, 1.0, 1.1]) AS target), c AS (SELECT asset, session_date, is_call, target, seq, premium, abs((strike + 50) / 100.0 - target) AS distance FROM tape, t)
  SELECT asset, session_date, is_call, target::DOUBLE AS target, seq FROM c WHERE distance <= 0.04 QUALIFY row_number() OVER (PARTITION BY asset, session_date, is_call, target ORDER BY distance, premium DESC, seq) = 1""", dates=["session_date"])
def contract_grid_top1(spark, sf):
    rows = tape(spark, sf).withColumn("m", (F.col("strike") + 50) / 100.0).withColumn("p", -F.col("premium"))
    return options.contract_grid(rows, [*KEYS, "is_call"], "m", [0.9, 1.0, 1.1], 0.04, ["p", "seq"]).select(*KEYS, "is_call", "target", "seq")


@query("iv_bisection")
def iv_bisection(spark, sf):
    k, t, f = (F.col("strike") + 50).cast("double"), F.lit(0.25), F.lit(100.0)
    iv = F.lit(0.1) + (F.col("seq") % 40) / 100.0
    rows = tape(spark, sf).select("seq", iv.alias("true_iv"), k.alias("k"), t.alias("t"), f.alias("f"), "is_call")
    rows = rows.withColumn("price", options.black_price(F.col("f"), F.col("k"), F.col("true_iv"), F.col("t"), F.col("is_call")))
    return rows.select("seq", "true_iv", "price", options.implied_volatility(F.col("price"), F.col("f"), F.col("k"), F.col("t"), F.col("is_call")).alias("iv"))
