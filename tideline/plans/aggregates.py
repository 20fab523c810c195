"""Aggregations: hash, filtered, distinct, quantiles, two-level, cubes, pivots, weights, histograms."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import evaluate, flow, latency, panel, quantiles, ranks
from ..sources.tables import table, tape
from .registry import TAPE, query, r6, s6


@query("agg_hash", f"""SELECT l_returnflag, l_linestatus, count(*) AS n, {s6('sum(l_quantity)')} AS quantity, {s6('sum(l_extendedprice * (1 - l_discount) * (1 + l_tax))')} AS charge,
  {s6('avg(l_discount)')} AS discount, {s6('min(l_extendedprice)')} AS low, {s6('max(l_extendedprice)')} AS high FROM lineitem GROUP BY 1, 2""")
def agg_hash(spark, sf):
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), r6(F.sum("l_quantity")).alias("quantity"), r6(F.sum(charge)).alias("charge"), r6(F.avg("l_discount")).alias("discount"), r6(F.min("l_extendedprice")).alias("low"), r6(F.max("l_extendedprice")).alias("high"))


@query("agg_filtered", f"""WITH {TAPE} SELECT contract, {s6('coalesce(sum(premium) FILTER (WHERE is_call), 0.0)')} AS call_premium, {s6('sum(premium)')} AS premium,
  {s6("avg(CASE WHEN asset = 'purchase' THEN 1.0 ELSE 0.0 END)")} AS purchase_share FROM tape GROUP BY 1""")
def agg_filtered(spark, sf):
    rows = tape(spark, sf)
    return rows.groupBy("contract").agg(r6(F.sum(F.when(F.col("is_call"), F.col("premium")).otherwise(0.0))).alias("call_premium"), r6(F.sum("premium")).alias("premium"), r6(F.avg(F.when(F.col("asset") == "purchase", 1.0).otherwise(0.0))).alias("purchase_share"))


@query("agg_median_quantile", f"""WITH {TAPE} SELECT asset, {s6('median(premium)')} AS median, {s6('quantile_cont(premium, 0.95)')} AS p95, {s6('quantile_cont(premium, 0.05)')} AS p05, {s6('max(premium) - min(premium)')} AS width FROM tape GROUP BY 1""")
def agg_median_quantile(spark, sf):
    premium = F.col("premium")
    wanted = {"median": 0.5, "p95": 0.95, "p05": 0.05, "least": 0.0, "most": 1.0}
    found = quantiles.wide(tape(spark, sf), ["asset"], {name: (premium, q) for name, q in wanted.items()}, count="n")
    return found.select("asset", *[r6(q).alias(q) for q in ("median", "p95", "p05")], r6(F.col("most") - F.col("least")).alias("width"))


@query("agg_nearest_quantile", f"""WITH {TAPE}, r AS (SELECT asset, premium, row_number() OVER (PARTITION BY asset ORDER BY premium, seq) - 1 AS i, count(*) OVER (PARTITION BY asset) AS n FROM tape)
  SELECT asset, premium AS tercile FROM r WHERE i = round((n - 1) / 3.0)""")
def agg_nearest_quantile(spark, sf):
    found = ranks.counted(tape(spark, sf), ["asset"], "premium")
    at = F.round((F.col("total") - 1) / 3.0)
    return found.where((at >= F.col("before")) & (at < F.col("before") + F.col("n"))).select("asset", F.col("premium").alias("tercile"))


@query("agg_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT (o_custkey, o_orderpriority)) AS pairs, count(DISTINCT p) + max(CASE WHEN p IS NULL THEN 1 ELSE 0 END) AS with_null FROM (SELECT *, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderpriority END AS p FROM orders) GROUP BY 1")
def agg_count_distinct(spark, sf):
    p = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority"))
    rows = table(spark, sf, "orders").withColumn("p", p)
    return rows.groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_custkey", "o_orderpriority").alias("pairs"), (F.countDistinct("p") + F.max(F.col("p").isNull().cast("int"))).alias("with_null"))


@query("agg_concentration", f"""WITH {TAPE}, k AS (SELECT asset, session_date, strike, count(*) AS n FROM tape GROUP BY 1, 2, 3) SELECT asset, session_date, max(n) AS top, sum(n)::BIGINT AS n, {s6('max(n) / sum(n)')} AS share FROM k GROUP BY 1, 2""", dates=["session_date"])
def agg_concentration(spark, sf):
    k = tape(spark, sf).groupBy("asset", "session_date", "strike").agg(F.count("*").alias("c"))
    return k.groupBy("asset", "session_date").agg(F.max("c").alias("top"), F.sum("c").alias("n"), r6(F.max("c") / F.sum("c")).alias("share"))


@query("agg_repeats", f"""WITH {TAPE}, k AS (SELECT asset, session_date, contract, count(*) AS n, sum(premium) AS w FROM tape GROUP BY 1, 2, 3 HAVING count(*) > 1) SELECT asset, session_date, count(*) AS repeated, {s6('sum(w)')} AS repeated_weight FROM k GROUP BY 1, 2""", dates=["session_date"])
def agg_repeats(spark, sf):
    return flow.repeats(tape(spark, sf), ["asset", "session_date"], "contract", "premium").withColumn("repeated_weight", r6("repeated_weight"))


@query("agg_min_of_group_means", f"""WITH {TAPE}, m AS (SELECT asset, session_date, avg(CASE WHEN created_us - executed_us <= 120000000 THEN 1.0 ELSE 0.0 END) AS c FROM tape GROUP BY 1, 2) SELECT asset, {s6('min(c)')} AS worst FROM m GROUP BY 1""")
def agg_min_of_group_means(spark, sf):
    seen = F.when(F.col("created_us") - F.col("executed_us") <= 120_000_000, 1.0).otherwise(0.0)
    return tape(spark, sf).groupBy("asset", "session_date").agg(F.avg(seen).alias("c")).groupBy("asset").agg(r6(F.min("c")).alias("worst"))


@query("agg_session_equal_mean", f"""WITH {TAPE}, m AS (SELECT asset, session_date, avg(premium) AS m FROM tape GROUP BY 1, 2) SELECT asset, {s6('avg(m)')} AS premium, count(*) AS sessions FROM m GROUP BY 1""")
def agg_session_equal_mean(spark, sf):
    return evaluate.session_equal_mean(tape(spark, sf), "session_date", "premium", ["asset"]).withColumn("premium", r6("premium"))


@query("agg_three_stage_mean", f"""WITH {TAPE}, m AS (SELECT session_date, asset, avg(premium) AS m FROM tape GROUP BY 1, 2), d AS (SELECT session_date, avg(m) AS m FROM m GROUP BY 1) SELECT {s6('avg(m)')} AS mean, count(*) AS sessions FROM d""")
def agg_three_stage_mean(spark, sf):
    m = tape(spark, sf).groupBy("session_date", "asset").agg(F.avg("premium").alias("m")).groupBy("session_date").agg(F.avg("m").alias("m"))
    return m.agg(r6(F.avg("m")).alias("mean"), F.count("*").alias("sessions"))


@query("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("scope_cube", f"""SELECT coalesce(l_returnflag, 'ALL') AS flag, coalesce(l_linestatus, 'ALL') AS status, count(*) AS n, {s6('median(l_quantity)')} AS median, {s6('quantile_cont(l_extendedprice, 0.95)')} AS p95 FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def scope_cube(spark, sf):
    keys = ["l_returnflag", "l_linestatus"]
    wanted = {"median": (F.col("l_quantity"), 0.5), "p95": (F.col("l_extendedprice"), 0.95)}
    cubed = quantiles.wide(table(spark, sf, "lineitem"), keys, wanted, sets=[keys, keys[:1], keys[1:], []], count="n")
    return cubed.select(F.coalesce("l_returnflag", F.lit("ALL")).alias("flag"), F.coalesce("l_linestatus", F.lit("ALL")).alias("status"), "n", r6("median").alias("median"), r6("p95").alias("p95"))


@query("pivot_session_cells", f"""WITH {TAPE} SELECT session_date, {', '.join(f"{s6(f"avg(premium) FILTER (WHERE asset = '{a}')")} AS {a}" for a in ('click', 'error', 'purchase', 'signup', 'view'))} FROM tape GROUP BY 1""", dates=["session_date"])
def pivot_session_cells(spark, sf):
    names = ["click", "error", "purchase", "signup", "view"]
    wide = tape(spark, sf).groupBy("session_date").pivot("asset", names).agg(F.avg("premium"))
    return wide.select("session_date", *[r6(n).alias(n) for n in names])


@query("feature_summary", f"""WITH u AS (SELECT 'quantity' AS feature, l_quantity AS v FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem UNION ALL SELECT 'tax', l_tax FROM lineitem)
  SELECT feature, count(v) AS n, {s6('avg(v)')} AS mean, {s6('stddev_samp(v)')} AS sd, {s6('quantile_cont(v, 0.25)')} AS q25, {s6('quantile_cont(v, 0.75)')} AS q75, {s6('skewness(v)')} AS skew FROM u GROUP BY 1""")
def feature_summary(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    n = F.count("v")
    adjusted = F.skewness("v") * F.sqrt(n * (n - 1)) / (n - 2)
    long = rows.unpivot([], ["quantity", "discount", "tax"], "feature", "v")
    moments = long.groupBy("feature").agg(n.alias("n"), r6(F.avg("v")).alias("mean"), r6(F.stddev_samp("v")).alias("sd"), r6(adjusted).alias("skew"))
    found = quantiles.wide(long, ["feature"], {"q25": (F.col("v"), 0.25), "q75": (F.col("v"), 0.75)})
    return moments.join(found, "feature", "left").select("feature", "n", "mean", "sd", r6("q25").alias("q25"), r6("q75").alias("q75"), "skew")


@query("weighted_share", f"""SELECT l_returnflag, {s6('sum(l_discount * l_extendedprice) / sum(l_extendedprice)')} AS discount FROM lineitem GROUP BY 1""")
def weighted_share(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(r6(F.sum(F.col("l_discount") * F.col("l_extendedprice")) / F.sum("l_extendedprice")).alias("discount"))


@query("weighted_median", f"""WITH w AS (SELECT l_returnflag, l_quantity AS v, sum(l_linenumber) AS w FROM lineitem GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS up, sum(w) OVER (PARTITION BY l_returnflag) AS t FROM w)
  SELECT l_returnflag, min(v) AS median FROM c WHERE up * 2 >= t GROUP BY 1""")
def weighted_median(spark, sf):
    w = table(spark, sf, "lineitem").groupBy("l_returnflag", F.col("l_quantity").alias("v")).agg(F.sum("l_linenumber").alias("w"))
    c = w.withColumn("up", F.sum("w").over(W.partitionBy("l_returnflag").orderBy("v"))).withColumn("t", F.sum("w").over(W.partitionBy("l_returnflag")))
    return c.where("up * 2 >= t").groupBy("l_returnflag").agg(F.min("v").alias("median"))


@query("weighted_grid_median", f"""WITH {TAPE}, g AS (SELECT strike // 20 AS row_cell, (contract % 5) AS col_cell, premium AS v, sum(direction * direction + 1) AS w FROM tape GROUP BY 1, 2, 3),
  c AS (SELECT *, sum(w) OVER (PARTITION BY row_cell, col_cell ORDER BY v) AS up, sum(w) OVER (PARTITION BY row_cell, col_cell) AS t FROM g) SELECT row_cell::BIGINT AS row_cell, col_cell, min(v) AS median FROM c WHERE up * 2 >= t GROUP BY 1, 2""")
def weighted_grid_median(spark, sf):
    g = tape(spark, sf).groupBy(F.floor(F.col("strike") / 20).alias("row_cell"), (F.col("contract") % 5).alias("col_cell"), F.col("premium").alias("v")).agg(F.sum(F.col("direction") * F.col("direction") + 1).alias("w"))
    cell = W.partitionBy("row_cell", "col_cell")
    c = g.withColumn("up", F.sum("w").over(cell.orderBy("v"))).withColumn("t", F.sum("w").over(cell))
    return c.where("up * 2 >= t").groupBy("row_cell", "col_cell").agg(F.min("v").alias("median"))


@query("concentration_measures", f"""WITH {TAPE}, k AS (SELECT asset, contract, sum(premium) AS w FROM tape GROUP BY 1, 2), t AS (SELECT asset, sum(w) AS t, count(*) AS n FROM k GROUP BY 1),
  s AS (SELECT asset, n, sum((w / t) * (w / t)) AS h, -sum((w / t) * ln(w / t)) AS e, max(w / t) AS m FROM k JOIN t USING (asset) GROUP BY 1, 2)
  SELECT asset, n AS items, {s6('h')} AS herfindahl, {s6('(h - 1.0 / n) / (1 - 1.0 / n)')} AS herfindahl_norm, {s6('e / ln(n)')} AS entropy_norm, {s6('m')} AS top_share FROM s""")
def concentration_measures(spark, sf):
    c = flow.concentration(tape(spark, sf), ["asset"], "contract", F.col("premium"))
    return c.select("asset", "items", *[r6(x).alias(x) for x in ("herfindahl", "herfindahl_norm", "entropy_norm", "top_share")])


@query("burstiness", f"""WITH {TAPE}, g AS (SELECT asset, session_date, (executed_us - lag(executed_us) OVER (PARTITION BY asset, session_date ORDER BY executed_us, seq)) / 1e6 AS gap FROM tape)
  SELECT asset, session_date, count(*) AS n, {s6('stddev_pop(gap) / avg(gap)')} AS gap_cv, {s6('median(gap)')} AS median_gap FROM g GROUP BY 1, 2""", dates=["session_date"])
def burstiness(spark, sf):
    b = flow.burstiness(tape(spark, sf), ["asset", "session_date"], "executed_us", "seq")
    return b.select("asset", "session_date", "n", r6("gap_cv").alias("gap_cv"), r6("median_gap").alias("median_gap"))


_LAG = f"{TAPE}, lags AS (SELECT asset, (created_us - executed_us) / 1e6 AS lag FROM tape), hist AS (SELECT asset, CASE WHEN lag <= 0.001 THEN 0 ELSE floor(log10(lag / 0.001) * 20)::BIGINT + 1 END AS bin, count(*) AS n FROM lags GROUP BY 1, 2)"


def _lags(spark, sf):
    return tape(spark, sf).select("asset", ((F.col("created_us") - F.col("executed_us")) / 1e6).alias("lag"))


@query("hist_log_bins", f"WITH {_LAG} SELECT asset, bin, n FROM hist")
def hist_log_bins(spark, sf):
    return latency.histogram(_lags(spark, sf), ["asset"], "lag", bins=20)


@query("hist_merge", f"WITH {_LAG} SELECT bin, sum(n)::BIGINT AS n FROM hist GROUP BY 1")
def hist_merge(spark, sf):
    by = latency.histogram(_lags(spark, sf), ["asset"], "lag", bins=20)
    return latency.merged(by.where("asset < 'm'").select("bin", "n"), by.where("asset >= 'm'").select("bin", "n"))


@query("hist_quantile", f"""WITH {_LAG}, c AS (SELECT *, sum(n) OVER (PARTITION BY asset ORDER BY bin) AS up, sum(n) OVER (PARTITION BY asset) AS t FROM hist), q AS (SELECT unnest([0.5, 0.9, 0.99]) AS q)
  SELECT asset, q::DOUBLE AS q, {s6('CASE WHEN bin = 0 THEN 0.001 ELSE 0.001 * pow(10.0, (bin - 1 + (q * t - (up - n)) / n) / 20) END')} AS seconds FROM c, q WHERE up >= q * t AND up - n < q * t""")
def hist_quantile(spark, sf):
    h = latency.histogram(_lags(spark, sf), ["asset"], "lag", bins=20)
    return latency.quantiles(h, ["asset"], [0.5, 0.9, 0.99], bins=20).withColumn("seconds", r6("seconds"))


@query("lag_cdf", f"""WITH {_LAG} SELECT asset, count(lag) AS n, count(*) FILTER (WHERE lag <= 60) AS le_60, count(*) FILTER (WHERE lag <= 120) AS le_120, count(*) FILTER (WHERE lag <= 300) AS le_300 FROM lags GROUP BY 1""")
def lag_cdf(spark, sf):
    return latency.at_thresholds(_lags(spark, sf), ["asset"], "lag", [60, 120, 300])


@query("hourly_support", f"""WITH {TAPE}, h AS (SELECT hour(executed_at)::INTEGER AS hour, asset, count(*) AS n, count(DISTINCT session_date) AS sessions, median((created_us - executed_us) / 1e6) AS m FROM tape GROUP BY 1, 2)
  SELECT hour, asset, n, sessions, CASE WHEN n >= 30 AND sessions >= 3 THEN {s6('m')} END AS median_lag, CASE WHEN n >= 30 AND sessions >= 3 THEN 'ok' ELSE 'insufficient' END AS status FROM h""")
def hourly_support(spark, sf):
    lag = (F.col("created_us") - F.col("executed_us")) / 1e6
    rows = tape(spark, sf).select(F.hour("executed_at").alias("hour"), "asset", "session_date", lag.alias("lag"))
    h = rows.groupBy("hour", "asset").agg(F.count("*").alias("n"), F.countDistinct("session_date").alias("sessions"))
    h = h.join(quantiles.wide(rows, ["hour", "asset"], {"m": (F.col("lag"), 0.5)}), ["hour", "asset"], "left").withColumn("m", r6("m"))
    ok = (F.col("n") >= 30) & (F.col("sessions") >= 3)
    return h.select("hour", "asset", "n", "sessions", F.when(ok, F.col("m")).alias("median_lag"), F.when(ok, "ok").otherwise("insufficient").alias("status"))


@query("session_verdicts", f"""WITH {TAPE}, s AS (SELECT session_date, quantile_cont((created_us - executed_us) / 1e6, 0.95) AS p95, avg(CASE WHEN created_us - executed_us > 120000000 THEN 1.0 ELSE 0.0 END) AS late FROM tape GROUP BY 1)
  SELECT session_date, {s6('p95')} AS p95, {s6('late')} AS late, greatest(120, ceil(1.5 * {s6('p95')}))::BIGINT AS cutoff_s, late <= 0.75 AS admissible FROM s""", dates=["session_date"])
def session_verdicts(spark, sf):
    lag = (F.col("created_us") - F.col("executed_us")) / 1e6
    rows = tape(spark, sf).select("session_date", lag.alias("lag"))
    s = rows.groupBy("session_date").agg(F.avg(F.when(F.col("lag") > 120, 1.0).otherwise(0.0)).alias("l"))
    s = s.join(quantiles.wide(rows, ["session_date"], {"p95": (F.col("lag"), 0.95)}), "session_date", "left").withColumn("p95", r6("p95"))
    return s.select("session_date", "p95", r6("l").alias("late"), F.greatest(F.lit(120), F.ceil(1.5 * F.col("p95"))).cast("long").alias("cutoff_s"), (F.col("l") <= 0.75).alias("admissible"))


@query("quality_accounting", """SELECT count(*) AS n, count(*) FILTER (WHERE l_extendedprice IS NULL OR l_quantity IS NULL) AS null_critical, count(*) FILTER (WHERE l_quantity <= 0 OR l_extendedprice < 0) AS invalid,
  count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS surplus, min(l_shipdate)::DATE AS first_day, max(l_shipdate)::DATE AS last_day FROM lineitem""", dates=["first_day", "last_day"])
def quality_accounting(spark, sf):
    rows = table(spark, sf, "lineitem")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.expr("l_extendedprice is null or l_quantity is null")).alias("null_critical"), F.count_if(F.expr("l_quantity <= 0 or l_extendedprice < 0")).alias("invalid"), (F.count("*") - F.countDistinct("l_orderkey", "l_linenumber")).alias("surplus"), F.to_date(F.min("l_shipdate")).alias("first_day"), F.to_date(F.max("l_shipdate")).alias("last_day"))


@query("coverage_by_group", f"""WITH {TAPE} SELECT asset, feature, {s6('avg(c)')} AS coverage FROM (SELECT asset, 'premium' AS feature, CASE WHEN premium IS NOT NULL THEN 1.0 ELSE 0.0 END AS c FROM tape
  UNION ALL SELECT asset, 'signed', CASE WHEN direction <> 0 THEN 1.0 ELSE 0.0 END FROM tape) GROUP BY 1, 2""")
def coverage_by_group(spark, sf):
    rows = tape(spark, sf).select("asset", "premium", F.when(F.col("direction") != 0, F.col("direction")).alias("signed"))
    return panel.coverage(rows, ["premium", "signed"], ["asset"]).withColumn("coverage", r6("coverage"))


@query("population_stability", f"""WITH {TAPE}, b AS (SELECT least(floor(premium / 25), 10)::BIGINT AS bin, session_date < DATE '2024-01-19' AS train FROM tape),
  c AS (SELECT bin, count(*) FILTER (WHERE train) AS a, count(*) FILTER (WHERE NOT train) AS b FROM b GROUP BY 1), p AS (SELECT greatest(a / sum(a) OVER (), 1e-6) AS p, greatest(b / sum(b) OVER (), 1e-6) AS q FROM c) SELECT {s6('sum((p - q) * ln(p / q))')} AS psi FROM p""")
def population_stability(spark, sf):
    rows = tape(spark, sf).withColumn("bin", F.least(F.floor(F.col("premium") / 25), F.lit(10)))
    return evaluate.population_stability(rows.where("session_date < date'2024-01-19'"), rows.where("session_date >= date'2024-01-19'"), "bin").select(r6("psi").alias("psi"))


@query("json_reason_counts", f"""WITH {TAPE}, c AS (SELECT session_date, asset, count(*) AS n FROM tape GROUP BY 1, 2) SELECT session_date, '{{' || string_agg('"' || asset || '":' || n, ',' ORDER BY asset) || '}}' AS counts FROM c GROUP BY 1""", dates=["session_date"])
def json_reason_counts(spark, sf):
    c = tape(spark, sf).groupBy("session_date", "asset").agg(F.count("*").alias("n"))
    return c.groupBy("session_date").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("asset", "n"))))).alias("counts"))
