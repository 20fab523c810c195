"""Further domain queries: calibration, option levels, impact, tensors, placebos, economics, model choice."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import joins, models, normalize, options, quantiles, selection, windows
from ..sources.tables import table, tape
from .evaluation import _LOSS, _PAIRED, forecasts, paired
from .registry import BARS, GRID, TAPE, query, r6, s6
from .windowed import KEYS, bars, returns

HOUR = 3_600_000_000
_TRAIN = "session_date < DATE '2024-01-19'"


@query("calibration_unusual", f"""WITH {TAPE}, f AS (SELECT asset, session_date, ln(1 + count(*)) AS a, ln(1 + sum(premium)) AS b, ln(1 + count(DISTINCT contract)) AS c FROM tape GROUP BY 1, 2),
  m AS (SELECT asset, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(c) AS mc, stddev_pop(c) AS sc FROM f WHERE {_TRAIN} GROUP BY 1),
  z AS (SELECT asset, session_date, list_filter([(a - ma) / sa, (b - mb) / sb, (c - mc) / sc], lambda x: x > 0) AS z FROM f JOIN m USING (asset))
  SELECT asset, session_date, CASE WHEN len(z) > 0 THEN {s6("list_aggregate(z, 'median')")} END AS score FROM z""", dates=["session_date"])
def calibration_unusual(spark, sf):
    f = tape(spark, sf).groupBy(*KEYS).agg(F.log1p(F.count("*")).alias("a"), F.log1p(F.sum("premium")).alias("b"), F.log1p(F.countDistinct("contract")).alias("c"))
    m = f.where("session_date < date'2024-01-19'").groupBy("asset").agg(*[x for c in "abc" for x in (F.avg(c).alias(f"m{c}"), F.stddev_pop(c).alias(f"s{c}"))])
    z = f.join(F.broadcast(m), "asset").select(*KEYS, *[((F.col(c) - F.col(f"m{c}")) / F.col(f"s{c}")).alias(f"z{c}") for c in "abc"])
    return z.select(*KEYS, r6(normalize.top_mean(["za", "zb", "zc"])).alias("score"))


_LEVEL = """v AS (SELECT asset, session_date, is_call, ln((strike + 50) / 100.0) AS x, avg(premium) / 100 AS y FROM tape GROUP BY asset, session_date, is_call, strike),
  e AS (SELECT asset, session_date, is_call, target, max(CASE WHEN x <= target THEN x END) AS lx, max_by(y, x) FILTER (WHERE x <= target) AS ly, min(CASE WHEN x >= target THEN x END) AS hx, min_by(y, x) FILTER (WHERE x >= target) AS hy FROM v, t GROUP BY 1, 2, 3, 4),
  i AS (SELECT asset, session_date, is_call, target, CASE WHEN lx IS NULL THEN hy WHEN hx IS NULL OR hx = lx THEN ly ELSE ly + (target - lx) / (hx - lx) * (hy - ly) END AS y FROM e)"""


def levels(spark, sf, targets):
    v = tape(spark, sf).groupBy(*KEYS, "is_call", F.log((F.col("strike") + 50) / 100.0).alias("x")).agg((F.avg("premium") / 100).alias("y"))
    return options.interpolated(v, [*KEYS, "is_call"], "x", "y", targets)


@query("atm_interpolation", f"WITH {TAPE}, t AS (SELECT 0.0::DOUBLE AS target), {_LEVEL} SELECT asset, session_date, is_call, {s6('y')} AS atm FROM i", dates=["session_date"])
def atm_interpolation(spark, sf):
    return levels(spark, sf, [0.0]).select(*KEYS, "is_call", r6("y").alias("atm"))


@query("call_put_consensus", f"WITH {TAPE}, t AS (SELECT 0.0::DOUBLE AS target), {_LEVEL} SELECT asset, session_date, count(y) AS sides, {s6('avg(y)')} AS consensus FROM i GROUP BY 1, 2", dates=["session_date"])
def call_put_consensus(spark, sf):
    return levels(spark, sf, [0.0]).groupBy(*KEYS).agg(F.count("y").alias("sides"), r6(F.avg("y")).alias("consensus"))


@query("symmetric_skew", f"WITH {TAPE}, t AS (SELECT unnest([-0.025, 0.025])::DOUBLE AS target), {_LEVEL}, s AS (SELECT asset, session_date, max(y) FILTER (WHERE NOT is_call AND target < 0) AS p, max(y) FILTER (WHERE is_call AND target > 0) AS c FROM i GROUP BY 1, 2) SELECT asset, session_date, CASE WHEN p > 0 AND c > 0 THEN {s6('ln(p / c)')} END AS skew FROM s", dates=["session_date"])
def symmetric_skew(spark, sf):
    side = lambda test: F.max(F.when(test, F.col("y")))
    s = levels(spark, sf, [-0.025, 0.025]).groupBy(*KEYS).agg(side(~F.col("is_call") & (F.col("target") < 0)).alias("p"), side(F.col("is_call") & (F.col("target") > 0)).alias("c"))
    return s.select(*KEYS, F.when((F.col("p") > 0) & (F.col("c") > 0), r6(F.log(F.col("p") / F.col("c")))).alias("skew"))


@query("forward_variance", f"""WITH {TAPE}, w AS (SELECT asset, session_date, avg(premium) FILTER (WHERE strike < 30) * 7 AS w1, avg(premium) FILTER (WHERE strike >= 30) * 30 AS w2 FROM tape GROUP BY 1, 2)
  SELECT asset, session_date, CASE WHEN w2 > w1 THEN {s6('(w2 - w1) / 23')} END AS forward_variance FROM w""", dates=["session_date"])
def forward_variance(spark, sf):
    part = lambda test, days: F.avg(F.when(test, F.col("premium"))) * days
    w = tape(spark, sf).groupBy(*KEYS).agg(part(F.col("strike") < 30, 7).alias("w1"), part(F.col("strike") >= 30, 30).alias("w2"))
    return w.select(*KEYS, F.when(F.col("w2") > F.col("w1"), r6((F.col("w2") - F.col("w1")) / 23)).alias("forward_variance"))


@query("wing_quotes", f"""WITH {TAPE}, v AS (SELECT asset, session_date, (150 - strike) / 200.0 AS x, avg(premium) AS y FROM tape WHERE is_call GROUP BY asset, session_date, strike), t AS (SELECT 0.25::DOUBLE AS target UNION ALL SELECT 0.75),
  e AS (SELECT asset, session_date, target, max(CASE WHEN x <= target THEN x END) AS lx, max_by(y, x) FILTER (WHERE x <= target) AS ly, min(CASE WHEN x >= target THEN x END) AS hx, min_by(y, x) FILTER (WHERE x >= target) AS hy FROM v, t GROUP BY 1, 2, 3)
  SELECT asset, session_date, target, {s6('CASE WHEN lx IS NULL THEN hy WHEN hx IS NULL OR hx = lx THEN ly ELSE ly + (target - lx) / (hx - lx) * (hy - ly) END')} AS y FROM e""", dates=["session_date"])
def wing_quotes(spark, sf):
    v = tape(spark, sf).where("is_call").groupBy(*KEYS, ((150 - F.col("strike")) / 200.0).alias("x")).agg(F.avg("premium").alias("y"))
    return options.interpolated(v, KEYS, "x", "y", [0.25, 0.75]).withColumn("y", r6("y"))


@query("level_change_panel", f"""WITH {BARS}, j AS (SELECT a.asset, a.session_date, a.bar, a.close, b.close AS c1, c.close AS c6 FROM bars a LEFT JOIN bars b ON a.asset = b.asset AND a.session_date = b.session_date AND b.bar = a.bar - 1 LEFT JOIN bars c ON a.asset = c.asset AND a.session_date = c.session_date AND c.bar = a.bar - 6)
  SELECT asset, session_date, bar::INTEGER AS bar, {s6('close - c1')} AS change_1, {s6('close - c6')} AS change_6, CASE WHEN c1 IS NULL THEN 'LAG1_MISSING' WHEN c6 IS NULL THEN 'LAG6_MISSING' END AS reason FROM j""", dates=["session_date"])
def level_change_panel(spark, sf):
    b = bars(spark, sf).select(*KEYS, "bar", "close")
    j = joins.exact_lag(joins.exact_lag(b, KEYS, "bar", 1, ["close"], "_1"), KEYS, "bar", 6, ["close"], "_6")
    reason = F.when(F.col("close_1").isNull(), "LAG1_MISSING").when(F.col("close_6").isNull(), "LAG6_MISSING")
    return j.select(*KEYS, "bar", r6(F.col("close") - F.col("close_1")).alias("change_1"), r6(F.col("close") - F.col("close_6")).alias("change_6"), reason.alias("reason"))


@query("quote_impact", f"""WITH {TAPE}, p AS (SELECT asset, session_date, direction, premium, lag(premium) OVER (PARTITION BY contract ORDER BY seq) AS before FROM tape) SELECT asset, session_date, count(*) AS n, {s6('avg(direction * (premium / before - 1))')} AS impact FROM p WHERE before > 0 AND direction <> 0 GROUP BY 1, 2""", dates=["session_date"])
def quote_impact(spark, sf):
    p = tape(spark, sf).withColumn("before", F.lag("premium").over(W.partitionBy("contract").orderBy("seq"))).where("before > 0 and direction <> 0")
    return p.groupBy(*KEYS).agg(F.count("*").alias("n"), r6(F.avg(F.col("direction") * (F.col("premium") / F.col("before") - 1))).alias("impact"))


@query("tensor_cells", f"""WITH {TAPE}, c AS (SELECT asset, session_date, (strike // 25) * 4 + contract % 4 AS cell, count(*) AS n FROM tape GROUP BY 1, 2, 3), g AS (SELECT asset, session_date, cell, coalesce(n, 0) AS n FROM (SELECT asset, session_date, cell FROM (SELECT DISTINCT asset, session_date FROM tape), range(16) r(cell)) LEFT JOIN c USING (asset, session_date, cell))
  SELECT asset, session_date, string_agg(n::VARCHAR, ',' ORDER BY cell) AS tensor FROM g GROUP BY 1, 2""", dates=["session_date"])
def tensor_cells(spark, sf):
    rows = tape(spark, sf).withColumn("cell", (F.floor(F.col("strike") / 25) * 4 + F.col("contract") % 4).cast("int"))
    counts = rows.groupBy(*KEYS, "cell").agg(F.count("*").alias("n")).groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0)).cast("string"))
    return counts.select(*KEYS, F.array_join(dense, ",").alias("tensor"))


@query("timing_variants", f"""WITH {TAPE}, v AS (SELECT unnest([60, 120, 300]) AS delay_s), o AS (SELECT DISTINCT asset, epoch_us(session_date::TIMESTAMP) + h * {HOUR} AS origin FROM tape, range(1, 24) r(h))
  SELECT delay_s::INTEGER AS delay_s, o.asset, o.origin, count(*) AS n FROM o, v, tape t WHERE t.asset = o.asset AND t.executed_us >= origin - delay_s * 1000000 - {HOUR} AND t.executed_us < origin - delay_s * 1000000 AND t.created_us <= origin - delay_s * 1000000 GROUP BY 1, 2, 3""")
def timing_variants(spark, sf):
    rows = tape(spark, sf)
    origins = rows.select("asset", "session_date").distinct().withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(23)))).select("asset", (F.unix_micros(F.col("session_date").cast("timestamp")) + F.col("h") * HOUR).alias("origin"))
    out = None
    for delay in (60, 120, 300):
        part = windows.two_clock(rows, "executed_us", "created_us", HOUR, HOUR, delay * 1_000_000).groupBy("asset", "origin").agg(F.count("*").alias("n")).withColumn("delay_s", F.lit(delay))
        out = part if out is None else out.unionByName(part)
    return out.join(origins, ["asset", "origin"], "left_semi").select("delay_s", "asset", "origin", "n")


@query("seasonal_look_back", f"""WITH {_LOSS} SELECT asset, session_date, bar::INTEGER AS bar, CASE WHEN count(actual) OVER w = 5 THEN {s6('avg(actual) OVER w')} END AS seasonal FROM hourly WINDOW w AS (PARTITION BY asset, bar ORDER BY session_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""", dates=["session_date"])
def seasonal_look_back(spark, sf):
    w = W.partitionBy("asset", "bar").orderBy("session_date")
    return forecasts(spark, sf).select(*KEYS, "bar", r6(windows.trailing_mean(F.col("actual"), w, 5)).alias("seasonal"))


@query("giacomini_white", f"""WITH {_PAIRED}, l AS (SELECT d, lag(d) OVER (ORDER BY session_date) AS before FROM daily) SELECT {s6('regr_slope(d, before)')} AS slope, {s6('regr_intercept(d, before)')} AS intercept, regr_count(d, before)::BIGINT AS n FROM l""")
def giacomini_white(spark, sf):
    l = paired(spark, sf).withColumn("before", F.lag("difference").over(W.orderBy("session_date")))  # noqa: E741
    return l.agg(r6(F.regr_slope("difference", "before")).alias("slope"), r6(F.regr_intercept("difference", "before")).alias("intercept"), F.regr_count("difference", "before").alias("n"))


@query("permutation_placebo", f"""WITH {TAPE}, a AS (SELECT session_date, seq, premium, row_number() OVER (PARTITION BY session_date ORDER BY seq) AS i FROM tape), b AS (SELECT session_date, strike AS shuffled, row_number() OVER (PARTITION BY session_date ORDER BY md5(seq::VARCHAR), seq) AS i FROM tape)
  SELECT session_date, count(*) AS n, {s6('corr(premium, shuffled)')} AS placebo FROM a JOIN b USING (session_date, i) GROUP BY 1""", dates=["session_date"])
def permutation_placebo(spark, sf):
    day = W.partitionBy("session_date")
    rows = tape(spark, sf).select("session_date", "seq", "premium", "strike")
    a = rows.select("session_date", "premium", F.row_number().over(day.orderBy("seq")).alias("i"))
    b = rows.select("session_date", F.col("strike").alias("shuffled"), F.row_number().over(day.orderBy(F.md5(F.col("seq").cast("string").cast("binary")), "seq")).alias("i"))
    return a.join(b, ["session_date", "i"]).groupBy("session_date").agg(F.count("*").alias("n"), r6(F.corr("premium", "shuffled")).alias("placebo"))


@query("first_receipt", f"""WITH {TAPE} SELECT contract, asset, min(created_us) AS received_us, min_by(seq, (created_us, seq)) AS seq FROM tape GROUP BY 1, 2""")
def first_receipt(spark, sf):
    return tape(spark, sf).groupBy("contract", "asset").agg(F.min("created_us").alias("received_us"), F.min_by("seq", F.struct("created_us", "seq")).alias("seq"))


@query("comonotone_latency", f"""WITH {TAPE} SELECT asset, {s6('quantile_cont((created_us - executed_us) / 1e6, 0.95) + quantile_cont(strike / 10.0, 0.95)')} AS p95 FROM tape GROUP BY 1""")
def comonotone_latency(spark, sf):
    parts = {"lag": ((F.col("created_us") - F.col("executed_us")) / 1e6, 0.95), "wait": (F.col("strike") / 10.0, 0.95)}
    return quantiles.wide(tape(spark, sf), ["asset"], parts).select("asset", r6(F.col("lag") + F.col("wait")).alias("p95"))


@query("regime_subsets", f"""WITH {GRID}, d AS (SELECT asset, session_date, sum(r * r) AS rv FROM returns GROUP BY 1, 2), p AS (SELECT *, lag(rv) OVER (PARTITION BY asset ORDER BY session_date) AS before FROM d),
  l AS (SELECT rv, unnest(['ALL', CASE WHEN before IS NULL THEN 'UNKNOWN' WHEN before > 20 THEN 'HIGH' ELSE 'LOW' END]) AS regime FROM p) SELECT regime, count(*) AS n, {s6('avg(rv)')} AS rv FROM l GROUP BY 1""")
def regime_subsets(spark, sf):
    d = returns(spark, sf).groupBy(*KEYS).agg(F.sum(F.col("r") * F.col("r")).alias("rv")).withColumn("before", F.lag("rv").over(W.partitionBy("asset").orderBy("session_date")))
    regime = F.when(F.col("before").isNull(), "UNKNOWN").when(F.col("before") > 20, "HIGH").otherwise("LOW")
    return d.select("rv", F.explode(F.array(F.lit("ALL"), regime)).alias("regime")).groupBy("regime").agg(F.count("*").alias("n"), r6(F.avg("rv")).alias("rv"))


@query("strategy_economics", f"""WITH {GRID}, s AS (SELECT asset, session_date, bar, r, coalesce(sign(lag(r) OVER w), 0)::DOUBLE AS position FROM returns WHERE r IS NOT NULL WINDOW w AS (PARTITION BY asset, session_date ORDER BY bar)),
  t AS (SELECT *, abs(position - coalesce(lag(position) OVER (PARTITION BY asset, session_date ORDER BY bar), 0.0)) AS turnover FROM s), p AS (SELECT asset, turnover, position * r - 0.001 * turnover AS pnl FROM t)
  SELECT asset, count(pnl) AS n, {s6('avg(pnl)')} AS mean, {s6('avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END)')} AS hit_rate, {s6('sum(turnover)')} AS turnover, {s6('avg(pnl) / stddev_samp(pnl) * sqrt(252)')} AS sharpe FROM p GROUP BY 1""")
def strategy_economics(spark, sf):
    p = selection.strategy(returns(spark, sf).where("r is not null"), KEYS, "bar", F.col("r"), F.col("r"), 0.001)
    return selection.performance(p, ["asset"], "bar").select("asset", "n", *[r6(c).alias(c) for c in ("mean", "hit_rate", "turnover", "sharpe")])


@query("minimum_detectable", f"""WITH {_PAIRED} SELECT count(*) AS n, {s6('2.8015852181 * stddev_samp(d) / sqrt(count(*))')} AS mde FROM daily""")
def minimum_detectable(spark, sf):
    d = paired(spark, sf)
    return d.agg(F.count("*").alias("n"), r6(F.lit(2.8015852181) * F.stddev_samp("difference") / F.sqrt(F.count("*"))).alias("mde"))


@query("bar_validity", f"WITH {BARS} SELECT asset, count(*) AS n, count(*) FILTER (WHERE high < greatest(open, close) OR low > least(open, close)) AS invalid, count(*) FILTER (WHERE high = low) AS flat FROM bars GROUP BY 1")
def bar_validity(spark, sf):
    bad = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))
    return bars(spark, sf).groupBy("asset").agg(F.count("*").alias("n"), F.count_if(bad).alias("invalid"), F.count_if(F.col("high") == F.col("low")).alias("flat"))


@query("inclusion_grid", f"""WITH {TAPE}, g AS (SELECT a.asset, s.session_date FROM (SELECT DISTINCT asset FROM tape) a, (SELECT DISTINCT session_date FROM tape) s), k AS (SELECT asset, session_date, count(*) FILTER (WHERE created_us - executed_us <= 60000000) AS n FROM tape GROUP BY 1, 2)
  SELECT session_date, count(*) AS cells, count(*) FILTER (WHERE coalesce(n, 0) >= 8) AS included FROM g LEFT JOIN k USING (asset, session_date) GROUP BY 1""", dates=["session_date"])
def inclusion_grid(spark, sf):
    rows = tape(spark, sf)
    cells = rows.select("session_date").distinct().crossJoin(F.broadcast(rows.select("asset").distinct()))
    k = rows.groupBy(*KEYS).agg(F.count_if(F.col("created_us") - F.col("executed_us") <= 60_000_000).alias("n"))
    return cells.join(k, KEYS, "left").groupBy("session_date").agg(F.count("*").alias("cells"), F.count_if(F.coalesce("n", F.lit(0)) >= 8).alias("included"))


@query("volume_overlay", f"""WITH {BARS}, o AS (SELECT asset, session_date, bar, CASE WHEN bar % 5 = 0 THEN 0 ELSE volume END AS volume, high, low FROM bars), s AS (SELECT asset, session_date, bar, volume AS other FROM bars WHERE bar % 10 = 0)
  SELECT asset, session_date, bar::INTEGER AS bar, CASE WHEN o.volume = 0 AND high > low THEN other ELSE o.volume END AS volume FROM o LEFT JOIN s USING (asset, session_date, bar)""", dates=["session_date"])
def volume_overlay(spark, sf):
    b = bars(spark, sf)
    o = b.withColumn("volume", F.when(F.col("bar") % 5 == 0, 0).otherwise(F.col("volume")))
    s = b.where("bar % 10 = 0").select(*KEYS, "bar", F.col("volume").alias("other"))
    return o.join(s, [*KEYS, "bar"], "left").select(*KEYS, "bar", F.when((F.col("volume") == 0) & (F.col("high") > F.col("low")), F.col("other")).otherwise(F.col("volume")).alias("volume"))


@query("corporate_event_gate", f"""WITH {TAPE}, o AS (SELECT DISTINCT asset, epoch_us(session_date::TIMESTAMP) + 12 * {HOUR} AS origin FROM tape) SELECT o.asset, o.origin, count(t.seq) AS visible FROM o LEFT JOIN (SELECT * FROM tape WHERE strike >= 95) t ON t.asset = o.asset AND t.executed_us <= o.origin AND t.created_us <= o.origin - 120000000 AND t.executed_us > o.origin - {24 * HOUR} GROUP BY 1, 2""")
def corporate_event_gate(spark, sf):
    from ..operators import asof

    rows = tape(spark, sf)
    o = rows.select("asset", (F.unix_micros(F.col("session_date").cast("timestamp")) + 12 * HOUR).alias("origin")).distinct()
    seen = asof.within(o, rows.where("strike >= 95").select("asset", "executed_us", "created_us"), ["asset"], "origin", "executed_us", 24 * HOUR - 1).where(F.col("created_us") <= F.col("origin") - 120_000_000)
    n = seen.groupBy("asset", "origin").agg(F.count("*").alias("visible"))
    return o.join(n, ["asset", "origin"], "left").select("asset", "origin", F.coalesce("visible", F.lit(0)).alias("visible"))


# ---- Spark-native extras: set and grouping operators beside those of the domain ----------------------------


@query("extra_intersect", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def extra_intersect(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf, "supplier").where("s_acctbal > 0").select("s_nationkey"))


@query("extra_rollup", f"SELECT coalesce(l_returnflag, 'ALL') AS flag, coalesce(l_linestatus, 'ALL') AS status, count(*) AS n, {s6('sum(l_quantity)')} AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def extra_rollup(spark, sf):
    r = table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), r6(F.sum("l_quantity")).alias("quantity"))
    return r.select(F.coalesce("l_returnflag", F.lit("ALL")).alias("flag"), F.coalesce("l_linestatus", F.lit("ALL")).alias("status"), "n", "quantity")


@query("extra_session_gaps", f"""WITH {TAPE}, g AS (SELECT contract, executed_us, CASE WHEN executed_us - lag(executed_us) OVER w <= 6 * {HOUR} THEN 0 ELSE 1 END AS fresh FROM tape WINDOW w AS (PARTITION BY contract ORDER BY executed_us)), s AS (SELECT contract, executed_us, sum(fresh) OVER (PARTITION BY contract ORDER BY executed_us) AS i FROM g)
  SELECT contract, i::BIGINT AS visit, count(*) AS n, min(executed_us) AS first_us FROM s GROUP BY 1, 2""")
def extra_session_gaps(spark, sf):
    w = W.partitionBy("contract").orderBy("executed_us")
    g = tape(spark, sf).withColumn("fresh", F.when(F.col("executed_us") - F.lag("executed_us").over(w) <= 6 * HOUR, 0).otherwise(1))
    return g.withColumn("visit", F.sum("fresh").over(w)).groupBy("contract", "visit").agg(F.count("*").alias("n"), F.min("executed_us").alias("first_us"))


# ---- without a SQL counterpart -----------------------------------------------------------------------------

@query("collinearity")
def collinearity(spark, sf):
    import numpy as np

    rows = forecasts(spark, sf).where("persist is not null").withColumn("bar2", F.col("bar") * F.col("bar"))
    g = models.gram(rows, ["persist", "bar", "bar2"], "actual").first().asDict()
    m = np.array([[g[f"x{min(i, j)}_{max(i, j)}"] for j in range(4)] for i in range(4)], float)
    return spark.createDataFrame([(selection.condition_number(m),)], "condition double")


@query("inclusion_propensity")
def inclusion_propensity(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = forecasts(spark, sf).withColumn("included", (F.col("actual") > 500).cast("double")).withColumn("hour", F.col("bar").cast("double"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["hour", "flat"], outputCol="features"), LogisticRegression(labelCol="included", regParam=0.01)]).fit(rows)
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("probability")[1]
    return model.transform(rows).select(*KEYS, "bar", "included", p.alias("propensity"), F.when(F.col("included") == 1, 1 / F.greatest(p, F.lit(0.01))).alias("weight"))


@query("elastic_net_forecast")
def elastic_net_forecast(spark, sf):
    rows = forecasts(spark, sf).where("persist is not null")
    return models.fitted(rows, ["persist", "flat"], "actual", "elastic").transform(rows).select(*KEYS, "bar", "actual", "prediction")


@query("boosted_forecast")
def boosted_forecast(spark, sf):
    rows = forecasts(spark, sf).where("persist is not null")
    return models.fitted(rows.where("session_date < date'2024-01-19'"), ["persist", "flat"], "actual", "boosted").transform(rows.where("session_date >= date'2024-01-19'")).select(*KEYS, "bar", "actual", "prediction")
