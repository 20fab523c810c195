"""Option state, flow records, session features and multi-horizon targets."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import log_quotient, normal_cdf_sql
from ..operators import flow, grid, latency, options, realized, windows
from ..sources.tables import tape, widened
from ..sources.tables import table as read
from .domain import _QUOTES, quotes
from .registry import BARS, GRID, TAPE, query, r6, s6
from .windowed import KEYS, bars, over, returns

HOUR = 3_600_000_000
_W = "PARTITION BY asset, session_date ORDER BY bar"
_DAYS = ["session_date"]


def dense(spark, sf):
    return grid.filled(grid.dense(bars(spark, sf), KEYS, "bar", 0, 23), KEYS, "bar")


def rounded(*names):
    return [r6(n).alias(n) for n in names]


# ---- bars and lags -----------------------------------------------------------------------------------------


@query("fixed_bar_lag", f"""WITH {GRID} SELECT c.asset, c.session_date, c.bar::INTEGER AS bar, b.close AS spot
  FROM cells c LEFT JOIN bars b ON b.asset = c.asset AND b.session_date = c.session_date AND b.bar = c.bar - 3""", dates=_DAYS)
def fixed_bar_lag(spark, sf):
    """The close that stood three bars before each origin: an equi-join on the shifted bar."""
    b = bars(spark, sf).select(*KEYS, (F.col("bar") + 3).alias("bar"), F.col("close").alias("spot"))
    return grid.dense(bars(spark, sf), KEYS, "bar", 0, 23).select(*KEYS, "bar").join(b, [*KEYS, "bar"], "left")


@query("lag_rates_by_scope", f"""WITH {TAPE}, l AS (
    SELECT asset, is_call, CASE WHEN created_us - executed_us <= 200000000 THEN created_us - executed_us END AS lag FROM tape)
  SELECT coalesce(asset, 'ALL') AS scope_asset, coalesce(is_call::VARCHAR, 'ALL') AS scope_side, count(*) AS n,
    count(lag) AS seen, {s6('count(lag) / count(*)')} AS rate FROM l GROUP BY CUBE (asset, is_call)""")
def lag_rates_by_scope(spark, sf):
    lag = F.col("created_us") - F.col("executed_us")
    rows = tape(spark, sf).select("asset", F.col("is_call").cast("string").alias("side"), F.when(lag <= 200_000_000, lag).alias("lag"))
    c = rows.cube("asset", "side").agg(F.count("*").alias("n"), F.count("lag").alias("seen"))
    scope = [F.coalesce("asset", F.lit("ALL")).alias("scope_asset"), F.coalesce("side", F.lit("ALL")).alias("scope_side")]
    return c.select(*scope, "n", "seen", r6(F.col("seen") / F.col("n")).alias("rate"))


@query("group_geometry", f"""WITH {TAPE} SELECT asset, (strike // 25)::INTEGER AS bucket, is_call, count(*) AS n,
    count(DISTINCT contract) AS contracts, count(DISTINCT strike) AS strikes, min(strike) AS low, max(strike) AS high,
    max(strike) - min(strike) AS width, {s6('avg(premium)')} AS premium, {s6('avg(abs(strike - 50))')} AS distance
  FROM tape GROUP BY ALL""")
def group_geometry(spark, sf):
    rows = tape(spark, sf).withColumn("bucket", F.floor(F.col("strike") / 25).cast("int"))
    return rows.groupBy("asset", "bucket", "is_call").agg(
        F.count("*").alias("n"), F.countDistinct("contract").alias("contracts"), F.countDistinct("strike").alias("strikes"),
        F.min("strike").alias("low"), F.max("strike").alias("high"), (F.max("strike") - F.min("strike")).alias("width"),
        r6(F.avg("premium")).alias("premium"), r6(F.avg(F.abs(F.col("strike") - 50))).alias("distance"),
    )


_BINS = f"""{TAPE}, b AS (SELECT asset, floor((created_us - executed_us) / 20e6)::BIGINT AS bin, count(*) AS c FROM tape GROUP BY 1, 2),
  u AS (SELECT asset, bin, sum(c) OVER (PARTITION BY asset ORDER BY bin) AS up_to, sum(c) OVER (PARTITION BY asset) AS n FROM b)"""


def edges(spark, sf):
    rows = tape(spark, sf).withColumn("lag_s", (F.col("created_us") - F.col("executed_us")) / 1e6)
    return latency.lower_edges(latency.fixed_bins(rows, ["asset"], "lag_s", 20.0), ["asset"], [0.5, 0.95], 20.0)


@query("lower_edge_quantiles", f"""WITH {_BINS}, q AS (SELECT unnest([0.5, 0.95])::DOUBLE AS q)
  SELECT asset, q, min(bin) * 20.0::DOUBLE AS seconds, max(n)::BIGINT AS n FROM u, q WHERE up_to >= q * n GROUP BY 1, 2""")
def lower_edge_quantiles(spark, sf):
    return edges(spark, sf).select("asset", "q", "seconds", "n")


@query("cutoff_rule", f"""WITH {_BINS} SELECT asset, greatest(60, ceil(1.5 * min(bin) * 20.0))::BIGINT AS cutoff_s
  FROM u WHERE up_to >= 0.95 * n GROUP BY 1""")
def cutoff_rule(spark, sf):
    """The availability lag that the 95th percentile of each asset calls for."""
    return edges(spark, sf).where("q = 0.95").select("asset", latency.cutoff_column(F.col("seconds"), 60, 1.5).alias("cutoff_s"))


@query("union_supertype", """SELECT n_nationkey::DOUBLE AS key, n_regionkey::VARCHAR AS tag, n_name AS name FROM nation
  UNION ALL SELECT s_acctbal AS key, s_name AS tag, s_suppkey::VARCHAR AS name FROM supplier""")
def union_supertype(spark, sf):
    a = read(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("tag"), F.col("n_name").alias("name"))
    b = read(spark, sf, "supplier").select(F.col("s_acctbal").alias("key"), F.col("s_name").alias("tag"), F.col("s_suppkey").alias("name"))
    return widened(a, b)


# ---- targets and session features --------------------------------------------------------------------------

_HORIZONS = (1, 2, 3, 6, 12)


@query("multi_horizon_targets", f"WITH {GRID} " + " UNION ALL ".join(f"""SELECT asset, session_date, bar::INTEGER AS bar, {h} AS horizon,
    CASE WHEN count(*) OVER w < {h} THEN 'HORIZON_CUT' WHEN NOT observed THEN 'ANCHOR_MISSING'
      WHEN count(*) FILTER (WHERE observed) OVER w < {h} THEN 'FUTURE_MISSING' ELSE 'OK' END AS status,
    CASE WHEN count(*) FILTER (WHERE observed) OVER w = {h} AND observed THEN {s6('sum(r * r) OVER w')} END AS target
  FROM returns WINDOW w AS ({_W} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)""" for h in _HORIZONS), dates=_DAYS)
def multi_horizon_targets(spark, sf):
    """Targets of several horizons in one pass over the grid: all h + 1 closes must have been observed."""
    return realized.targets(returns(spark, sf), KEYS, "bar", _HORIZONS).withColumn("target", r6("target"))


@query("activity_windows", f"""WITH {GRID}, v AS (SELECT *, CASE WHEN observed THEN volume END AS v, CASE WHEN observed THEN volume * close END AS d FROM grid)
  SELECT asset, session_date, bar::INTEGER AS bar, CASE WHEN count(v) OVER w = 4 THEN sum(v) OVER w END::DOUBLE AS volume,
    CASE WHEN count(d) OVER w = 4 THEN {s6('sum(d) OVER w')} END AS dollar_volume
  FROM v WINDOW w AS ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""", dates=_DAYS)
def activity_windows(spark, sf):
    g = dense(spark, sf)
    seen = lambda x: windows.gap_aware_sum(F.when(F.col("observed"), x), over(), -3, 0)
    return g.select(*KEYS, "bar", seen(F.col("volume")).cast("double").alias("volume"), r6(seen(F.col("volume") * F.col("close"))).alias("dollar_volume"))


@query("harq_features", f"""WITH {GRID}, s AS (SELECT asset, session_date, count(r) AS n, sum(r * r) AS rv, count(r) / 3.0 * sum(r * r * r * r) AS rq FROM returns GROUP BY 1, 2),
  k AS (SELECT asset, session_date, CASE WHEN n >= 12 THEN rv END AS rv, CASE WHEN n >= 12 THEN rq END AS rq FROM s),
  l AS (SELECT asset, session_date, rv, lag(rv) OVER d AS rv_day, lag(rq) OVER d AS rq_day,
    CASE WHEN count(rv) OVER w = 5 THEN avg(rv) OVER w END AS rv_week, CASE WHEN count(rv) OVER m = 20 THEN avg(rv) OVER m END AS rv_month
    FROM k WINDOW d AS (PARTITION BY asset ORDER BY session_date), w AS (PARTITION BY asset ORDER BY session_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
      m AS (PARTITION BY asset ORDER BY session_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
  SELECT asset, session_date, {', '.join(f'{s6(c)} AS {c}' for c in ('rv', 'rv_day', 'rv_week', 'rv_month'))}, {s6('sqrt(rq_day) * rv_day')} AS rv_day_attenuated,
    CASE WHEN rv_day IS NULL THEN 'DAY_MISSING' WHEN rv_week IS NULL THEN 'WEEK_MISSING' WHEN rv_month IS NULL THEN 'MONTH_MISSING' END AS reason FROM l""", dates=_DAYS)
def harq_features(spark, sf):
    """Variance of the day, week and month before, and the day's attenuated by its quarticity; a session counts from
    12 returns on."""
    h = realized.harq(returns(spark, sf), "asset", "session_date", "r", least=12, week=5, month=20)
    return h.select(*KEYS, *rounded("rv", "rv_day", "rv_week", "rv_month", "rv_day_attenuated"), "reason")


@query("intraday_har", f"""WITH {GRID} SELECT asset, session_date, bar::INTEGER AS bar, CASE WHEN count(r) OVER w = 6 THEN {s6('sum(r * r) OVER w')} END AS rv_recent,
    {s6('sum(r * r) OVER s')} AS rv_session, {s6('bar / 24.0')} AS phase, {s6('bar * bar / 576.0')} AS phase_squared
  FROM returns WINDOW w AS ({_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), s AS ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", dates=_DAYS)
def intraday_har(spark, sf):
    r2, phase = F.col("r") * F.col("r"), F.col("bar") / 24.0
    so_far = F.sum(r2).over(over().rowsBetween(W.unboundedPreceding, 0))
    return returns(spark, sf).select(*KEYS, "bar", r6(windows.gap_aware_sum(r2, over(), -5, 0)).alias("rv_recent"), r6(so_far).alias("rv_session"), r6(phase).alias("phase"), r6(phase * phase).alias("phase_squared"))


@query("strict_window_features", f"""WITH {GRID}, x AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (WHERE observed) OVER w AS seen, first_value(close) OVER w AS start FROM returns
    WINDOW w AS ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
  y AS (SELECT *, CASE WHEN n < 4 THEN 'WINDOW_CUT' WHEN NOT observed THEN 'ANCHOR_MISSING' WHEN seen < 4 THEN 'GAP_INSIDE' ELSE 'OK' END AS status FROM x)
  SELECT asset, session_date, bar::INTEGER AS bar, status, CASE WHEN status = 'OK' THEN {s6('ln(close / start)')} END AS momentum,
    CASE WHEN status = 'OK' THEN {s6('sum(r * r) OVER v')} END AS rv, CASE WHEN status = 'OK' THEN {s6('max(high) OVER w - min(low) OVER w')} END AS span
  FROM y WINDOW v AS ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w AS ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""", dates=_DAYS)
def strict_window_features(spark, sf):
    """Features of four consecutive observed bars, and which gap stands in their way."""
    frame, inner = over().rowsBetween(-3, 0), over().rowsBetween(-2, 0)
    g = returns(spark, sf)
    g = g.withColumns({"n": F.count("*").over(frame), "seen": F.count_if("observed").over(frame), "start": F.first("close").over(frame)})
    status = F.when(F.col("n") < 4, "WINDOW_CUT").when(~F.col("observed"), "ANCHOR_MISSING").when(F.col("seen") < 4, "GAP_INSIDE").otherwise("OK")
    g = g.withColumn("status", status)
    when = lambda x: F.when(F.col("status") == "OK", r6(x))
    return g.select(
        *KEYS, "bar", "status", when(log_quotient(F.col("close"), F.col("start"))).alias("momentum"),
        when(F.sum(F.col("r") * F.col("r")).over(inner)).alias("rv"), when(F.max("high").over(frame) - F.min("low").over(frame)).alias("span"),
    )


# ---- option state ------------------------------------------------------------------------------------------


@query("exact_tenor", f"""WITH {TAPE}, e AS (SELECT seq, executed_us, epoch_us(session_date::TIMESTAMP) + (strike % 5 * 7 - 7) * {24 * HOUR} + 20 * {HOUR} AS expiry_us FROM tape)
  SELECT seq, CASE WHEN expiry_us > executed_us THEN {s6('(expiry_us - executed_us) / (365 * 86400 * 1e6)')} END AS years FROM e""")
def exact_tenor(spark, sf):
    """Years to the close on expiry, by microseconds; null from the close on."""
    day = F.unix_micros(F.col("session_date").cast("timestamp"))
    expiry = day + (F.col("strike") % 5 * 7 - 7) * (24 * HOUR) + 20 * HOUR
    return tape(spark, sf).select("seq", r6(options.tenor_years(F.col("executed_us"), expiry)).alias("years"))


_BAND = f"""{_QUOTES}, p AS (SELECT asset, session_date, k::DOUBLE AS k, c - p AS y FROM q WHERE c IS NOT NULL AND p IS NOT NULL),
  l AS (SELECT asset, session_date, count(*) AS strikes, regr_slope(y, k) AS slope, regr_intercept(y, k) AS intercept, regr_syy(y, k) AS syy, regr_sxy(y, k) AS sxy,
    (min_by(y, k) - max_by(y, k)) / nullif(max(k) - min(k), 0) AS endpoint FROM p GROUP BY 1, 2)"""


def lines(spark, sf):
    q = quotes(spark, sf)
    return options.parity_line(q, KEYS, "k", F.col("c") - F.col("p"))


@query("forward_plausibility", f"""WITH {_BAND} SELECT asset, session_date, strikes, {s6('-intercept / slope')} AS forward, {s6('sqrt(greatest(syy - slope * sxy, 0.0) / strikes)')} AS residual_sd,
    CASE WHEN slope < 0 THEN {s6('-ln(-slope)')} END AS rate, coalesce(strikes >= 3 AND slope < 0 AND -ln(-slope) BETWEEN -0.05 AND 0.25, false) AS plausible FROM l WHERE strikes >= 2 AND slope <> 0""", dates=_DAYS)
def forward_plausibility(spark, sf):
    """The implied forward with its residual deviation; a rate outside -5 % to 25 % a year, or fewer than three
    strikes, is not plausible."""
    rate = F.when(F.col("slope") < 0, -F.log(-F.col("slope")))
    plausible = F.coalesce((F.col("strikes") >= 3) & rate.between(-0.05, 0.25), F.lit(False))
    return lines(spark, sf).where("strikes >= 2 and slope <> 0").select(*KEYS, "strikes", r6(-F.col("intercept") / F.col("slope")).alias("forward"), r6("residual_sd").alias("residual_sd"), r6(rate).alias("rate"), plausible.alias("plausible"))


@query("endpoint_discount", f"WITH {_BAND} SELECT asset, session_date, strikes, {s6('endpoint')} AS discount FROM l WHERE strikes >= 2", dates=_DAYS)
def endpoint_discount(spark, sf):
    """Discount from the two outermost strikes alone."""
    return lines(spark, sf).where("strikes >= 2").select(*KEYS, "strikes", r6("endpoint").alias("discount"))


@query("gamma_with_carry", f"""WITH {TAPE}, d AS (SELECT seq, (ln(100.0 / (strike + 50)) + (0.02 + 0.2 * 0.2 / 2) * 0.25) / (0.2 * sqrt(0.25)) AS d1 FROM tape)
  SELECT seq, {s6('exp((0.02 - 0.05) * 0.25) * exp(-d1 * d1 / 2) / sqrt(2 * pi()) / (100.0 * 0.2 * sqrt(0.25))')} AS gamma FROM d""")
def gamma_with_carry(spark, sf):
    k = (F.col("strike") + 50).cast("double")
    gamma = options.carry_gamma(F.lit(100.0), k, F.lit(0.2), F.lit(0.25), rate=F.lit(0.05), carry=F.lit(0.02))
    return tape(spark, sf).select("seq", r6(gamma).alias("gamma"))


@query("surface_coverage", f"""WITH {TAPE}, c AS (SELECT asset, session_date, strike // 10 AS cell, is_call, count(*) AS n, max(executed_us) AS last_us FROM tape GROUP BY 1, 2, 3, 4)
  SELECT asset, session_date, count(*) AS cells, {s6('count(*) / 20')} AS coverage, sum(n)::BIGINT AS quotes,
    {s6(f'avg(CASE WHEN last_us >= epoch_us(session_date::TIMESTAMP) + 18 * {HOUR} THEN 1.0 ELSE 0.0 END)')} AS fresh FROM c GROUP BY 1, 2""", dates=_DAYS)
def surface_coverage(spark, sf):
    """Share of the twenty cells (ten strike bands, two sides) that hold a quote, and of these the fresh ones."""
    c = tape(spark, sf).groupBy(*KEYS, F.floor(F.col("strike") / 10).alias("cell"), "is_call").agg(F.count("*").alias("n"), F.max("executed_us").alias("last_us"))
    fresh = F.when(F.col("last_us") >= F.unix_micros(F.col("session_date").cast("timestamp")) + 18 * HOUR, 1.0).otherwise(0.0)
    return c.groupBy(*KEYS).agg(F.count("*").alias("cells"), r6(F.count("*") / 20).alias("coverage"), F.sum("n").alias("quotes"), r6(F.avg(fresh)).alias("fresh"))


@query("variance_spread", f"""WITH {GRID}, s AS (SELECT asset, session_date, sum(r * r) AS rv FROM returns GROUP BY 1, 2),
  i AS (SELECT asset, session_date, avg(premium) / 10 AS iv FROM tape WHERE is_call GROUP BY 1, 2),
  t AS (SELECT asset, session_date, CASE WHEN count(rv) OVER w = 5 THEN avg(rv) OVER w * 252 END AS past FROM s WINDOW w AS (PARTITION BY asset ORDER BY session_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
  SELECT asset, session_date, {s6('iv * iv')} AS implied, {s6('past')} AS past, {s6('iv * iv - past')} AS spread FROM t JOIN i USING (asset, session_date)""", dates=_DAYS)
def variance_spread(spark, sf):
    """Implied variance less the annualised variance of the five sessions before."""
    s = returns(spark, sf).groupBy(*KEYS).agg(F.sum(F.col("r") * F.col("r")).alias("rv"))
    s = s.select(*KEYS, (windows.trailing_mean(F.col("rv"), W.partitionBy("asset").orderBy("session_date"), 5) * 252).alias("past"))
    i = tape(spark, sf).where("is_call").groupBy(*KEYS).agg((F.avg("premium") / 10).alias("iv"))
    implied = F.col("iv") * F.col("iv")
    return s.join(i, KEYS).select(*KEYS, r6(implied).alias("implied"), r6("past").alias("past"), r6(implied - F.col("past")).alias("spread"))


@query("snapshot_state", f"""WITH {_BAND}, f AS (SELECT asset, session_date, strikes, -intercept / slope AS forward, -slope AS discount FROM l WHERE strikes >= 3 AND slope < 0),
  b AS (SELECT asset, session_date, k, c, (lead(c) OVER v - c) / (lead(k) OVER v - k) - (c - lag(c) OVER v) / (k - lag(k) OVER v) AS bent FROM q WHERE c IS NOT NULL WINDOW v AS (PARTITION BY asset, session_date ORDER BY k)),
  u AS (SELECT asset, session_date, count(bent) AS triples, count(*) FILTER (WHERE bent < -1e-12) AS violations FROM b GROUP BY 1, 2),
  a AS (SELECT q.asset, q.session_date, min_by(k, (round(abs(k - forward), 6), k)) AS atm_strike, {s6('median(abs(q.c - q.p - discount * (forward - k)))')} AS parity FROM q JOIN f USING (asset, session_date) WHERE c IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2)
  SELECT asset, session_date, strikes, {s6('forward')} AS forward, {s6('discount')} AS discount, atm_strike::INTEGER AS atm_strike, parity, coalesce(triples, 0) AS triples, coalesce(violations, 0) AS violations,
    CASE WHEN forward IS NULL THEN 'NO_FORWARD' ELSE 'OK' END AS status FROM u LEFT JOIN f USING (asset, session_date) LEFT JOIN a USING (asset, session_date)""", dates=_DAYS)
def snapshot_state(spark, sf):
    """The whole state of a snapshot in one row: forward, discount, nearest strike, parity residual, butterflies."""
    q = quotes(spark, sf)
    f = lines(spark, sf).where("strikes >= 3 and slope < 0").select(*KEYS, "strikes", (-F.col("intercept") / F.col("slope")).alias("forward"), (-F.col("slope")).alias("discount"))
    u = options.butterflies(q.where("c is not null").select(*KEYS, "k", "c"), KEYS, "k", "c")
    residual = F.abs(F.col("c") - F.col("p") - F.col("discount") * (F.col("forward") - F.col("k")))
    near = F.min_by("k", F.struct(F.round(F.abs(F.col("k") - F.col("forward")), 6), "k"))
    a = q.where("c is not null and p is not null").join(f, KEYS).groupBy(*KEYS).agg(near.alias("atm_strike"), r6(F.median(residual)).alias("parity"))
    out = u.join(f, KEYS, "left").join(a, KEYS, "left")
    return out.select(*KEYS, "strikes", *rounded("forward", "discount"), "atm_strike", "parity", "triples", "violations", F.when(F.col("forward").isNull(), "NO_FORWARD").otherwise("OK").alias("status"))


@query("coverage_gates", f"""WITH {GRID}, o AS (SELECT asset, bar // 8 AS tercile, CASE WHEN observed THEN 1.0 ELSE 0.0 END AS x FROM grid),
  g AS (SELECT avg(x) AS global FROM o), a AS (SELECT min(m) AS least_asset FROM (SELECT avg(x) AS m FROM o GROUP BY asset)), t AS (SELECT min(m) AS least_tercile FROM (SELECT avg(x) AS m FROM o GROUP BY tercile))
  SELECT {s6('global')} AS coverage, {s6('least_asset')} AS least_asset, {s6('least_tercile')} AS least_tercile, global >= 0.5 AND least_asset >= 0.3 AND least_tercile >= 0.4 AS passed FROM g, a, t""")
def coverage_gates(spark, sf):
    """Global, least asset's and least tercile's coverage from one aggregation by asset and tercile."""
    o = dense(spark, sf).groupBy("asset", F.floor(F.col("bar") / 8).alias("tercile")).agg(F.count_if("observed").alias("x"), F.count("*").alias("n"))
    share = lambda by: o.groupBy(*by).agg((F.sum("x") / F.sum("n")).alias("m")).agg(F.min("m").alias("m"))
    out = share([]).toDF("g").crossJoin(F.broadcast(share(["asset"]).toDF("a"))).crossJoin(F.broadcast(share(["tercile"]).toDF("t")))
    return out.select(r6("g").alias("coverage"), r6("a").alias("least_asset"), r6("t").alias("least_tercile"), ((F.col("g") >= 0.5) & (F.col("a") >= 0.3) & (F.col("t") >= 0.4)).alias("passed"))


_SQL_DELTA = normal_cdf_sql("d1")


@query("delayed_spot", f"""WITH {BARS}, t AS (SELECT asset, session_date, hour(executed_at) AS bar, strike FROM tape WHERE is_call),
  j AS (SELECT t.asset, t.session_date, b.close AS spot, c.close AS late, t.strike * 10.0 + 1 AS k FROM t JOIN bars b ON b.asset = t.asset AND b.session_date = t.session_date AND b.bar = t.bar - 1
    JOIN bars c ON c.asset = t.asset AND c.session_date = t.session_date AND c.bar = t.bar - 2),
  d AS (SELECT asset, session_date, unnest(['prompt', 'delayed']) AS variant, (ln(unnest([spot, late]) / k) + 0.3 * 0.3 * 0.1 / 2) / (0.3 * sqrt(0.1)) AS d1 FROM j)
  SELECT asset, session_date, variant, count(*) AS n, {s6(f'avg({_SQL_DELTA})')} AS delta FROM d GROUP BY 1, 2, 3""", dates=_DAYS)
def delayed_spot(spark, sf):
    """Contracts repriced with the spot of one and of two bars before: two equi-joins on shifted bars."""
    b = bars(spark, sf)
    shifted = lambda n, name: b.select(*KEYS, (F.col("bar") + n).alias("bar"), F.col("close").alias(name))
    t = tape(spark, sf).where("is_call").select(*KEYS, F.hour("executed_at").alias("bar"), (F.col("strike") * 10.0 + 1).alias("k"))
    j = t.join(shifted(1, "prompt"), [*KEYS, "bar"]).join(shifted(2, "delayed"), [*KEYS, "bar"])
    long = j.unpivot([*KEYS, "k"], ["prompt", "delayed"], "variant", "spot")
    delta = options.black_delta(F.col("spot"), F.col("k"), F.lit(0.3), F.lit(0.1), F.lit(True))
    return long.groupBy(*KEYS, "variant").agg(F.count("*").alias("n"), r6(F.avg(delta)).alias("delta"))


# ---- flow --------------------------------------------------------------------------------------------------

@query("in_session_marks", f"""WITH {BARS}, t AS (SELECT seq, asset, session_date, hour(executed_at) AS bar, premium FROM tape WHERE hour(executed_at) BETWEEN 8 AND 19)
  SELECT seq, coalesce(b.close, o.open) AS mark, b.close IS NULL AS opening, {s6('premium / coalesce(b.close, o.open) - 1')} AS edge
  FROM t LEFT JOIN bars b ON b.asset = t.asset AND b.session_date = t.session_date AND b.bar = t.bar - 1 AND b.bar >= 8 JOIN bars o ON o.asset = t.asset AND o.session_date = t.session_date AND o.bar = t.bar
  WHERE coalesce(b.close, o.open) > 0""")
def in_session_marks(spark, sf):
    """Trades inside the session marked at the close of the bar before, or the opening print where there is none."""
    b = bars(spark, sf).where("bar between 8 and 19")
    t = tape(spark, sf).withColumn("bar", F.hour("executed_at")).where("bar between 8 and 19").select("seq", *KEYS, "bar", "premium")
    before = b.select(*KEYS, (F.col("bar") + 1).alias("bar"), F.col("close").alias("before"))
    marked = t.join(before, [*KEYS, "bar"], "left").join(b.select(*KEYS, "bar", "open"), [*KEYS, "bar"]).withColumn("mark", F.coalesce("before", "open"))
    return marked.where("mark > 0").select("seq", "mark", F.col("before").isNull().alias("opening"), r6(F.col("premium") / F.col("mark") - 1).alias("edge"))


_TAGS = """concat(asset, CASE WHEN strike % 7 = 0 THEN ',multi_leg' ELSE '' END, CASE WHEN strike % 3 = 0 THEN ',ask_side' WHEN strike % 3 = 1 THEN ',bid_side' ELSE '' END)"""


@query("direction_from_tags", f"""WITH {TAPE}, g AS (SELECT session_date, premium, {_TAGS} AS tags FROM tape),
  d AS (SELECT *, CASE WHEN contains(tags, 'multi_leg') THEN 0 WHEN contains(tags, 'ask_side') THEN 1 WHEN contains(tags, 'bid_side') THEN -1 ELSE 0 END AS side FROM g)
  SELECT session_date, side::INTEGER AS side, count(*) AS n, {s6('sum(side * premium)')} AS signed FROM d GROUP BY 1, 2""", dates=_DAYS)
def direction_from_tags(spark, sf):
    """Direction from a trade's tags; legs of a combined trade are unsigned."""
    g = tape(spark, sf).withColumn("side", flow.direction(F.expr(_TAGS)))
    return g.groupBy("session_date", "side").agg(F.count("*").alias("n"), r6(F.sum(F.col("side") * F.col("premium"))).alias("signed"))


@query("activity_nine", f"""WITH {TAPE}, k AS (SELECT asset, session_date, strike, count(*) AS c, sum(premium) AS w, sum(CASE WHEN is_call THEN premium ELSE 0 END) AS calls, sum(direction * premium) AS s,
    sum((created_us - executed_us) / 1e6) AS lag, count(*) FILTER (WHERE created_us - executed_us > 120000000) AS late FROM tape GROUP BY 1, 2, 3),
  t AS (SELECT asset, session_date, sum(c) AS n, sum(w) AS w, sum(calls) AS calls, sum(s) AS s, sum(lag) AS lag, sum(late) AS late, max(c) AS top, sum(w * w) AS ww, count(*) AS strikes FROM k GROUP BY 1, 2)
  SELECT asset, session_date, {s6('ln(1 + n)')} AS log_n, {s6('ln(1 + w)')} AS log_premium, {s6('s / w')} AS imbalance, {s6('calls / w')} AS call_share, {s6('top / n')} AS top_share, {s6('ww / (w * w)')} AS concentration,
    {s6('lag / n')} AS mean_lag, {s6('late / n')} AS late_share, strikes FROM t""", dates=_DAYS)
def activity_nine(spark, sf):
    """Nine compact features; all come from one aggregation by strike."""
    k = tape(spark, sf).groupBy(*KEYS, "strike").agg(
        F.count("*").alias("c"), F.sum("premium").alias("w"), F.sum(F.when(F.col("is_call"), F.col("premium")).otherwise(0.0)).alias("calls"), F.sum(F.col("direction") * F.col("premium")).alias("s"),
        F.sum((F.col("created_us") - F.col("executed_us")) / 1e6).alias("lag"), F.count_if(F.col("created_us") - F.col("executed_us") > 120_000_000).alias("late"),
    )
    total = [F.sum(c).alias(c) for c in ("c", "w", "calls", "s", "lag", "late")]
    t = k.groupBy(*KEYS).agg(F.max("c").alias("top"), F.sum(F.col("w") * F.col("w")).alias("ww"), F.count("*").alias("strikes"), *total)
    part = lambda a, b, name: r6(F.col(a) / F.col(b)).alias(name)
    return t.select(
        *KEYS, r6(F.log1p("c")).alias("log_n"), r6(F.log1p("w")).alias("log_premium"), part("s", "w", "imbalance"), part("calls", "w", "call_share"), part("top", "c", "top_share"),
        r6(F.col("ww") / (F.col("w") * F.col("w"))).alias("concentration"), part("lag", "c", "mean_lag"), part("late", "c", "late_share"), "strikes",
    )


@query("prior_only_residual", f"""WITH {TAPE}, d AS (SELECT asset, session_date, sum(premium) AS y, sum(direction * premium) AS x FROM tape GROUP BY 1, 2)
  SELECT asset, session_date, CASE WHEN count(y) OVER w >= 8 THEN {s6('y - (regr_intercept(y, x) OVER w + regr_slope(y, x) OVER w * x)')} END AS residual
  FROM d WINDOW w AS (PARTITION BY asset ORDER BY session_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", dates=_DAYS)
def prior_only_residual(spark, sf):
    """What is left of a session's total after a line fitted to the sessions before it alone."""
    d = tape(spark, sf).groupBy(*KEYS).agg(F.sum("premium").alias("y"), F.sum(F.col("direction") * F.col("premium")).cast("double").alias("x"))
    w = W.partitionBy("asset").orderBy("session_date").rowsBetween(W.unboundedPreceding, -1)
    line = F.regr_intercept("y", "x").over(w) + F.regr_slope("y", "x").over(w) * F.col("x")
    return d.select(*KEYS, F.when(F.count("y").over(w) >= 8, r6(F.col("y") - line)).alias("residual"))
