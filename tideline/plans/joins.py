"""Joins: equi, semi, anti, full, cross grids, bands, exact lags, and as-of snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import log_quotient
from ..operators import asof, grid, quantiles, windows
from ..operators.joins import checked_join, exact_lag, join_new_columns
from ..sources.tables import table, tape
from .registry import BARS, TAPE, query, r6, s6

HOUR, DAY = 3_600_000_000, 86_400_000_000


@query("join_inner", f"""SELECT o_orderpriority, count(*) AS n, {s6('sum(l_extendedprice)')} AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def join_inner(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.count("*").alias("n"), r6(F.sum("l_extendedprice")).alias("total"))


@query("join_left_counts", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def join_left_counts(spark, sf):
    # counted before the join: the shuffle carries one row per customer
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    return table(spark, sf, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("join_full_coalesce", """SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 20 GROUP BY 1) a
  FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 3 GROUP BY 1) b ON a.k = b.k""")
def join_full_coalesce(spark, sf):
    a = table(spark, sf, "customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = table(spark, sf, "supplier").where("s_nationkey > 3").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, ["k"], "full")


@query("join_semi", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def join_semi(spark, sf):
    f = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    return table(spark, sf, "customer").join(f, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("join_anti", "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_anti(spark, sf):
    f = table(spark, sf, "orders").where("o_totalprice > 200000")
    return table(spark, sf, "customer").join(f, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("join_validated", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_validated(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    return checked_join(table(spark, sf, "customer").withColumnRenamed("c_nationkey", "key"), nations, ["key"], "inner", "m:1").select("c_custkey", "n_name")


@query("join_new_columns", "SELECT n_nationkey, n_name, n_regionkey, c.n AS customers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey")
def join_added(spark, sf):
    more = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.first(F.lit("ignored")).alias("n_name"))
    return join_new_columns(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), more, ["n_nationkey"])


@query("join_cross_grid", f"""WITH {BARS} SELECT s.session_date, a.asset, h.bar::INTEGER AS bar FROM (SELECT DISTINCT session_date FROM tape) s CROSS JOIN (SELECT DISTINCT asset FROM tape) a CROSS JOIN (SELECT unnest(range(24)) AS bar) h
  WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.asset = a.asset AND b.session_date = s.session_date AND b.bar = h.bar)""", dates=["session_date"])
def join_cross_grid(spark, sf):
    rows = tape(spark, sf)
    cells = rows.select("session_date").distinct().withColumn("bar", F.explode(F.sequence(F.lit(0), F.lit(23)))).crossJoin(F.broadcast(rows.select("asset").distinct()))
    seen = rows.select("asset", "session_date", F.hour("executed_at").alias("bar"))
    return cells.join(seen, ["asset", "session_date", "bar"], "left_anti").select("session_date", "asset", "bar")


@query("join_bucket_window", f"""WITH {TAPE}, o AS (SELECT DISTINCT session_date, asset, epoch_us(session_date::TIMESTAMP) + h * {HOUR} AS origin FROM tape, range(1, 24) r(h))
  SELECT o.asset, o.origin, count(*) AS n, {s6('sum(premium)')} AS premium FROM o JOIN tape t ON t.asset = o.asset AND t.executed_us >= o.origin - 120000000 - {HOUR} AND t.executed_us < o.origin - 120000000 GROUP BY 1, 2""")
def join_bucket_window(spark, sf):
    rows = windows.assigned(tape(spark, sf), "executed_us", HOUR, HOUR, 120_000_000)
    sums = rows.groupBy("asset", "origin").agg(F.count("*").alias("n"), F.sum("premium").alias("premium"))
    day = tape(spark, sf).select("asset", "session_date").distinct().withColumn("origin", F.explode(F.transform(F.sequence(F.lit(1), F.lit(23)), lambda h: F.unix_micros(F.col("session_date").cast("timestamp")) + h * HOUR)))
    return day.join(sums, ["asset", "origin"]).select("asset", "origin", "n", r6("premium").alias("premium"))


@query("join_band_backward", f"""WITH {TAPE} SELECT p.seq, count(v.seq) AS views FROM tape p LEFT JOIN tape v ON v.contract = p.contract AND v.asset = 'view' AND v.executed_us < p.executed_us AND v.executed_us >= p.executed_us - {DAY}
  WHERE p.asset = 'purchase' GROUP BY 1""")
def join_band_backward(spark, sf):
    rows = tape(spark, sf)
    origins = rows.where("asset = 'purchase'").select("contract", F.col("seq").alias("origin_seq"), (F.col("executed_us") - 1).alias("cutoff"))
    views = rows.where("asset = 'view'").select("contract", "executed_us", "seq")
    near = asof.within(origins, views, ["contract"], "cutoff", "executed_us", DAY - 1).groupBy("origin_seq").agg(F.count("*").alias("views"))
    return origins.join(near, "origin_seq", "left").select(F.col("origin_seq").alias("seq"), F.coalesce("views", F.lit(0)).alias("views"))


@query("join_band_forward", f"""WITH {TAPE} SELECT p.seq, count(*) AS n, {s6('max(v.premium)')} AS top FROM tape p JOIN tape v ON v.contract = p.contract AND v.session_date = p.session_date AND v.executed_us > p.executed_us
  AND v.executed_us <= p.executed_us + {6 * HOUR} WHERE p.asset = 'signup' GROUP BY 1""")
def join_band_forward(spark, sf):
    rows = tape(spark, sf)
    ends = rows.where("asset = 'signup'").select("contract", "session_date", "seq", (F.col("executed_us") + 6 * HOUR).alias("until"))
    later = rows.select("contract", "session_date", "executed_us", "premium")
    near = asof.within(ends, later, ["contract", "session_date"], "until", "executed_us", 6 * HOUR - 1)
    return near.groupBy("seq").agg(F.count("*").alias("n"), r6(F.max("premium")).alias("top"))


@query("exact_lag_change", f"""WITH {BARS} SELECT a.asset, a.session_date, a.bar::INTEGER AS bar, {s6('ln(a.close / b.close)')} AS change FROM bars a LEFT JOIN bars b ON a.asset = b.asset AND a.session_date = b.session_date AND b.bar = a.bar - 2""", dates=["session_date"])
def exact_lag_change(spark, sf):
    bars = grid.bars(tape(spark, sf).withColumn("bar", F.hour("executed_at")), ["asset", "session_date", "bar"], "premium", "executed_us").select("asset", "session_date", "bar", "close")
    return exact_lag(bars, ["asset", "session_date"], "bar", 2, ["close"], "_then").select("asset", "session_date", "bar", r6(log_quotient(F.col("close"), F.col("close_then"))).alias("change"))


@query("asof_latest_per_key", f"""WITH {TAPE}, p AS (SELECT seq, contract, executed_us FROM tape WHERE asset = 'purchase'), v AS (SELECT seq AS v_seq, contract, executed_us, premium FROM tape WHERE asset = 'view')
  SELECT p.seq, v.v_seq AS view_seq, v.premium AS view_premium FROM p ASOF LEFT JOIN v ON p.contract = v.contract AND p.executed_us >= v.executed_us""")
def asof_latest_per_key(spark, sf):
    rows = tape(spark, sf)
    origins = rows.where("asset = 'purchase'").select("seq", "contract", "executed_us")
    views = rows.where("asset = 'view'").select("contract", F.col("seq").alias("view_seq"), F.col("premium").alias("view_premium"), "executed_us")
    return asof.latest(origins, views, ["contract"], "executed_us", "executed_us", ["view_seq"], ["view_seq", "view_premium"], bucket=7 * DAY).select("seq", "view_seq", "view_premium")


@query("asof_tie_sequence", f"""WITH {TAPE}, t AS (SELECT seq, asset, premium, executed_us // {HOUR} AS tick FROM tape), o AS (SELECT DISTINCT asset, tick FROM t)
  SELECT o.asset, o.tick, max_by(t.seq, (t.tick, t.seq)) AS seq FROM o JOIN t ON t.asset = o.asset AND t.tick <= o.tick AND t.tick >= o.tick - 24 GROUP BY 1, 2""")
def asof_tie_sequence(spark, sf):
    rows = tape(spark, sf).select("seq", "asset", F.floor(F.col("executed_us") / HOUR).alias("tick"))
    origins = rows.select("asset", "tick").distinct()
    return asof.latest(origins, rows.withColumn("s", F.col("seq")), ["asset"], "tick", "tick", ["seq"], ["s"], bucket=24).select("asset", "tick", F.col("s").alias("seq"))


@query("asof_staleness_bound", f"""WITH {TAPE}, p AS (SELECT seq, contract, executed_us FROM tape WHERE asset = 'purchase'), v AS (SELECT seq AS v_seq, contract, created_us FROM tape WHERE asset = 'view'),
  j AS (SELECT p.seq, p.executed_us, v.v_seq, v.created_us, row_number() OVER (PARTITION BY p.seq ORDER BY v.created_us DESC, v.v_seq DESC) AS rn FROM p LEFT JOIN v ON p.contract = v.contract AND v.created_us <= p.executed_us - 120000000)
  SELECT seq, CASE WHEN created_us >= executed_us - 120000000 - {DAY} THEN v_seq END AS view_seq FROM j WHERE rn = 1""")
def asof_staleness_bound(spark, sf):
    rows = tape(spark, sf)
    origins = rows.where("asset = 'purchase'").select("seq", "contract", (F.col("executed_us") - 120_000_000).alias("cutoff"), (F.col("executed_us") - 120_000_000 - DAY).alias("oldest"))
    views = rows.where("asset = 'view'").select("contract", "created_us", F.col("seq").alias("view_seq"))
    return asof.latest(origins, views, ["contract"], "cutoff", "created_us", ["view_seq"], ["view_seq"], oldest="oldest", bucket=7 * DAY).select("seq", "view_seq")


@query("asof_snapshot_contracts", f"""WITH {TAPE}, o AS (SELECT DISTINCT epoch_us(session_date::TIMESTAMP) + 16 * {HOUR} AS cutoff FROM tape),
  s AS (SELECT cutoff, contract, seq, premium FROM o JOIN tape ON created_us BETWEEN cutoff - {2 * HOUR} AND cutoff QUALIFY row_number() OVER (PARTITION BY cutoff, contract ORDER BY created_us DESC, seq DESC) = 1)
  SELECT cutoff, contract, seq, premium FROM s""")
def asof_snapshot_contracts(spark, sf):
    rows = tape(spark, sf)
    origins = rows.select((F.unix_micros(F.col("session_date").cast("timestamp")) + 16 * HOUR).alias("cutoff")).distinct()
    return asof.latest_within(origins, rows.select("contract", "seq", "premium", "created_us"), ["contract"], [], "cutoff", "created_us", ["seq"], 2 * HOUR).select("cutoff", "contract", "seq", "premium")


@query("asof_multi_cutoff", f"""WITH {TAPE}, o AS (SELECT DISTINCT asset, epoch_us(session_date::TIMESTAMP) + 12 * {HOUR} AS origin, d FROM tape, (SELECT unnest([0, 60, 300]) AS d)),
  j AS (SELECT o.asset, o.origin, o.d, t.seq, row_number() OVER (PARTITION BY o.asset, o.origin, o.d ORDER BY t.created_us DESC, t.seq DESC) AS rn FROM o LEFT JOIN tape t ON t.asset = o.asset AND t.created_us <= o.origin - o.d * 1000000)
  SELECT asset, origin, d::INTEGER AS delay_s, seq FROM j WHERE rn = 1""")
def asof_multi_cutoff(spark, sf):
    rows = tape(spark, sf)
    origins = rows.select("asset", (F.unix_micros(F.col("session_date").cast("timestamp")) + 12 * HOUR).alias("origin")).distinct().withColumn("delay_s", F.explode(F.array(F.lit(0), F.lit(60), F.lit(300)))).withColumn("cutoff", F.col("origin") - F.col("delay_s") * 1_000_000)
    return asof.latest(origins, rows, ["asset"], "cutoff", "created_us", ["seq"], ["seq"], bucket=DAY).select("asset", "origin", "delay_s", "seq")


@query("availability_gate", f"""WITH {TAPE} SELECT seq, CASE WHEN created_us <= executed_us + 120000000 THEN premium ELSE -1.0 END AS visible FROM tape""")
def availability_gate(spark, sf):
    return tape(spark, sf).select("seq", asof.gated(F.col("premium"), F.col("created_us"), F.col("executed_us") + 120_000_000, F.lit(-1.0)).alias("visible"))


@query("forward_assignment", f"""WITH {TAPE}, w AS (SELECT *, (created_us // 300000000 + 1) * 300000000 AS window_end FROM tape)
  SELECT asset, count(*) AS candidates, count(*) FILTER (WHERE window_end - created_us <= 120000000) AS eligible, count(*) FILTER (WHERE window_end - created_us > 120000000) AS late FROM w GROUP BY 1""")
def forward_assignment(spark, sf):
    rows = windows.forward(tape(spark, sf), "created_us", 300_000_000, 120_000_000)
    return rows.groupBy("asset").agg(F.count("*").alias("candidates"), F.count_if("eligible").alias("eligible"), F.count_if(~F.col("eligible")).alias("late"))


@query("strict_prior_session", f"""WITH {TAPE}, d AS (SELECT asset, session_date, sum(premium) AS p FROM tape WHERE session_date::VARCHAR NOT LIKE '%-05' GROUP BY 1, 2)
  SELECT asset, session_date, {s6('lag(p) OVER (PARTITION BY asset ORDER BY session_date)')} AS prior FROM d""", dates=["session_date"])
def strict_prior_session(spark, sf):
    from pyspark.sql import Window as W

    d = tape(spark, sf).where(F.dayofmonth("session_date") != 5).groupBy("asset", "session_date").agg(F.sum("premium").alias("p"))
    return d.select("asset", "session_date", r6(F.lag("p").over(W.partitionBy("asset").orderBy("session_date"))).alias("prior"))


@query("provider_reconciliation", f"""WITH {BARS}, s AS (SELECT asset, session_date, bar + 1 AS bar, open AS close FROM bars)
  SELECT b.asset, count(*) AS matched, {s6('median(abs(b.close / s.close - 1))')} AS median_gap, {s6('max(abs(b.close / s.close - 1))')} AS max_gap FROM bars b JOIN s USING (asset, session_date, bar) GROUP BY 1""")
def provider_reconciliation(spark, sf):
    bars = grid.bars(tape(spark, sf).withColumn("bar", F.hour("executed_at")), ["asset", "session_date", "bar"], "premium", "executed_us")
    other = bars.select("asset", "session_date", (F.col("bar") + 1).alias("bar"), F.col("open").alias("other"))
    gap = F.abs(F.col("close") / F.col("other") - 1)
    matched = bars.join(other, ["asset", "session_date", "bar"])
    found = quantiles.wide(matched, ["asset"], {"median_gap": (gap, 0.5), "max_gap": (gap, 1.0)}, count="matched")
    return found.select("asset", "matched", r6("median_gap").alias("median_gap"), r6("max_gap").alias("max_gap"))
