"""Window functions: lags, leads, trailing means, fills, prefix sums, drawdowns, ranks, tails."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import flow, grid, ranks, windows
from ..sources.tables import tape
from .registry import BARS, GRID, TAPE, query, r6, s6

KEYS = ["asset", "session_date"]


def bars(spark, sf):
    return grid.bars(tape(spark, sf).withColumn("bar", F.hour("executed_at")), [*KEYS, "bar"], "premium", "executed_us")


def returns(spark, sf):
    return grid.with_returns(grid.filled(grid.dense(bars(spark, sf), KEYS, "bar", 0, 23), KEYS, "bar"), KEYS, "bar")


def over():
    return W.partitionBy(*KEYS).orderBy("bar")


@query("lag_return", f"WITH {GRID} SELECT asset, session_date, bar::INTEGER AS bar, {s6('r')} AS r FROM returns", dates=["session_date"])
def lag_return(spark, sf):
    return returns(spark, sf).select(*KEYS, "bar", r6("r").alias("r"))


@query("lead_product", f"WITH {GRID} SELECT asset, session_date, bar::INTEGER AS bar, {s6('r * lead(r) OVER (PARTITION BY asset, session_date ORDER BY bar)')} AS product FROM returns", dates=["session_date"])
def lead_product(spark, sf):
    return returns(spark, sf).select(*KEYS, "bar", r6(F.col("r") * F.lead("r").over(over())).alias("product"))


_DAILY = f"{TAPE}, daily AS (SELECT asset, session_date, sum(premium) AS total FROM tape GROUP BY 1, 2)"


def daily(spark, sf):
    return tape(spark, sf).groupBy(*KEYS).agg(F.sum("premium").alias("total"))


@query("shifted_rolling_mean", f"""WITH {_DAILY} SELECT asset, session_date, CASE WHEN count(total) OVER w = 5 THEN {s6('avg(total) OVER w')} END AS trailing FROM daily
  WINDOW w AS (PARTITION BY asset ORDER BY session_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""", dates=["session_date"])
def shifted_rolling_mean(spark, sf):
    return daily(spark, sf).select(*KEYS, r6(windows.trailing_mean(F.col("total"), W.partitionBy("asset").orderBy("session_date"), 5)).alias("trailing"))


@query("lag_same_slot", f"WITH {BARS} SELECT asset, session_date, bar::INTEGER AS bar, lag(close) OVER (PARTITION BY asset, bar ORDER BY session_date) AS before FROM bars", dates=["session_date"])
def lag_same_slot(spark, sf):
    return bars(spark, sf).select(*KEYS, "bar", F.lag("close").over(W.partitionBy("asset", "bar").orderBy("session_date")).alias("before"))


@query("ffill_valid", f"WITH {GRID} SELECT asset, session_date, bar::INTEGER AS bar, observed, close, close IS NOT NULL AS valid FROM grid", dates=["session_date"])
def ffill_valid(spark, sf):
    return grid.filled(grid.dense(bars(spark, sf), KEYS, "bar", 0, 23), KEYS, "bar").select(*KEYS, "bar", "observed", "close", F.col("close").isNotNull().alias("valid"))


@query("prefix_window_sum", f"""WITH {GRID} SELECT asset, session_date, bar::INTEGER AS bar, CASE WHEN count(r) OVER w = 4 THEN {s6('sum(r * r) OVER w')} END AS rv4 FROM returns WINDOW w AS (PARTITION BY asset, session_date ORDER BY bar ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""", dates=["session_date"])
def prefix_window_sum(spark, sf):
    return returns(spark, sf).select(*KEYS, "bar", r6(windows.gap_aware_sum(F.col("r") * F.col("r"), over(), -3, 0)).alias("rv4"))


@query("session_to_date", f"WITH {GRID} SELECT asset, session_date, bar::INTEGER AS bar, {s6('sum(r * r) OVER (PARTITION BY asset, session_date ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)')} AS so_far FROM returns", dates=["session_date"])
def session_to_date(spark, sf):
    return returns(spark, sf).select(*KEYS, "bar", r6(F.sum(F.col("r") * F.col("r")).over(over().rowsBetween(W.unboundedPreceding, -1))).alias("so_far"))


@query("running_drawdown", f"""WITH {TAPE}, d AS (SELECT session_date, sum(direction * premium) AS pnl FROM tape GROUP BY 1), c AS (SELECT session_date, sum(pnl) OVER (ORDER BY session_date) AS running FROM d)
  SELECT session_date, {s6('running')} AS running, {s6('running - max(running) OVER (ORDER BY session_date)')} AS drawdown FROM c""", dates=["session_date"])
def running_drawdown(spark, sf):
    d = tape(spark, sf).groupBy("session_date").agg(F.sum(F.col("direction") * F.col("premium")).alias("pnl"))
    total, down = windows.drawdown(F.col("pnl"), W.orderBy("session_date"))
    return d.withColumn("running", total).withColumn("drawdown", down).select("session_date", r6("running").alias("running"), r6("drawdown").alias("drawdown"))


@query("dense_rank_session", f"WITH {TAPE}, s AS (SELECT DISTINCT session_date FROM tape) SELECT session_date, dense_rank() OVER (ORDER BY session_date) AS session_no FROM s", dates=["session_date"])
def dense_rank_session(spark, sf):
    s = tape(spark, sf).select("session_date").distinct()
    return s.withColumn("session_no", F.dense_rank().over(W.orderBy("session_date")).cast("long"))


@query("previous_trade_delta", f"""WITH {TAPE}, p AS (SELECT seq, premium, lag(premium) OVER (PARTITION BY contract, asset ORDER BY seq) AS before FROM tape) SELECT seq, before IS NOT NULL AS has_previous, CASE WHEN before <> 0 THEN {s6('premium / before - 1')} END AS relative_change FROM p""")
def previous_trade_delta(spark, sf):
    return flow.previous_in_contract(tape(spark, sf), ["contract", "asset"], "seq", "premium").select("seq", "has_previous", r6("relative_change").alias("relative_change"))


@query("clipped_increments", f"""WITH {TAPE}, t AS (SELECT seq, contract, session_date, strike AS size, max(strike * 2) OVER (PARTITION BY contract, session_date ORDER BY seq) AS running FROM tape)
  SELECT seq, least(greatest(running - coalesce(lag(running) OVER (PARTITION BY contract, session_date ORDER BY seq), 0), 0), size)::INTEGER AS increment FROM t""")
def clipped_increments(spark, sf):
    over = W.partitionBy("contract", "session_date").orderBy("seq")
    rows = tape(spark, sf).select("seq", "contract", "session_date", F.col("strike").alias("size"), F.max(F.col("strike") * 2).over(over).alias("running"))
    return flow.clipped_increments(rows, ["contract", "session_date"], "seq", "running", "size").select("seq", "increment")


@query("topn_per_group", f"WITH {TAPE} SELECT asset, session_date, seq, premium FROM tape QUALIFY row_number() OVER (PARTITION BY asset, session_date ORDER BY premium DESC, seq) <= 3", dates=["session_date"])
def topn_per_group(spark, sf):
    rank = F.row_number().over(W.partitionBy(*KEYS).orderBy(F.desc("premium"), "seq"))
    return tape(spark, sf).withColumn("rn", rank).where("rn <= 3").select(*KEYS, "seq", "premium")


@query("tail_sequence", f"""WITH {TAPE}, t AS (SELECT asset, session_date, seq FROM tape QUALIFY row_number() OVER (PARTITION BY asset, session_date ORDER BY executed_us DESC, seq DESC) <= 8)
  SELECT asset, session_date, string_agg(seq::VARCHAR, ',' ORDER BY seq) AS last_eight FROM t GROUP BY 1, 2""", dates=["session_date"])
def tail_sequence(spark, sf):
    t = flow.tail(tape(spark, sf), KEYS, ["executed_us", "seq"], 8, "seq")
    return t.select(*KEYS, F.array_join(F.transform("seq", lambda x: x.cast("string")), ",").alias("last_eight"))


@query("row_index", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) - 1 AS i FROM lineitem")
def row_index(spark, sf):
    from ..sources.tables import table

    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return ranks.numbered(rows, [], ["l_extendedprice", "l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", (F.col("row") - 1).alias("i"))


@query("decile_spread", f"""WITH {TAPE}, d AS (SELECT asset, premium, direction, ntile(10) OVER (PARTITION BY asset ORDER BY premium, seq) AS decile FROM tape), m AS (SELECT asset, decile, avg(direction) AS m FROM d GROUP BY 1, 2)
  SELECT asset, {s6('max(m) FILTER (WHERE decile = 10) - max(m) FILTER (WHERE decile = 1)')} AS spread FROM m GROUP BY 1""")
def decile_spread(spark, sf):
    d = ranks.numbered(tape(spark, sf).select("asset", "premium", "seq", "direction"), ["asset"], ["premium", "seq"], total="rows")
    d = d.withColumn("decile", ranks.tile(F.col("row"), F.col("rows"), 10))
    m = d.groupBy("asset", "decile").agg(F.avg("direction").alias("m"))
    return m.groupBy("asset").agg(r6(F.max(F.when(F.col("decile") == 10, F.col("m"))) - F.max(F.when(F.col("decile") == 1, F.col("m")))).alias("spread"))
