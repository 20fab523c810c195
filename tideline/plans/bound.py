"""Targets bound to predictors, checked joins, stripped columns, a pilot from bars to targets, and a frozen forecaster."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import any_of, log_quotient, nan_to_null, transformed
from ..operators import joins, models
from ..sources import files
from ..sources.tables import tape
from .evaluation import _LOSS, forecasts
from .panels import _PANEL, merged
from .registry import BARS, TAPE, query, r6, s6
from .windowed import KEYS, bars

_DAYS = ["session_date"]


@query("nan_repair", f"""WITH {TAPE}, v AS (SELECT asset, CASE WHEN premium >= 50 THEN sqrt(premium - 50) END AS root, CASE WHEN strike > 0 THEN ln(strike) END AS size FROM tape)
  SELECT asset, count(*) AS n, count(root) AS roots, {s6('avg(root)')} AS mean_root, count(*) FILTER (WHERE root > 10 OR size > 4) AS either, {s6('avg(size)')} AS mean_size FROM v GROUP BY 1""")
def nan_repair(spark, sf):
    """Values that are no number become null before they are averaged; a row counts where any of two tests holds."""
    v = tape(spark, sf).select("asset", nan_to_null(F.sqrt(F.col("premium") - 50)).alias("root"), transformed("strike", "log").alias("size"))
    either = F.count_if(any_of(F.col("root") > 10, F.col("size") > 4))
    return v.groupBy("asset").agg(F.count("*").alias("n"), F.count("root").alias("roots"), r6(F.avg("root")).alias("mean_root"), either.alias("either"), r6(F.avg("size")).alias("mean_size"))


@query("stripped_targets", f"""WITH {_PANEL} SELECT u.feature, count(u.v) AS n, {s6('avg(u.v)')} AS mean FROM (SELECT 'b0' AS feature, b0 AS v FROM panel UNION ALL SELECT 'b1', b1 FROM panel UNION ALL SELECT 'b2', b2 FROM panel) u GROUP BY 1""")
def stripped_targets(spark, sf):
    """A panel with outcomes beside its predictors: these columns are taken off, the guard passes what is left, and each is summed up."""
    panel = merged(spark, sf).withColumns({"target_rv": F.col("b0") * 2, "future_b0": F.lead("b0").over(W.partitionBy("asset").orderBy("session_date")), "qlike_loss": F.lit(0.5), "target_reason": F.lit("ok")})
    kept = joins.without_targets(joins.stripped(panel))
    long = kept.unpivot(KEYS, [c for c in kept.columns if c not in KEYS], "feature", "v")
    return long.groupBy("feature").agg(F.count("v").alias("n"), r6(F.avg("v")).alias("mean"))


@query("join_one_to_one", f"""WITH {BARS}, k AS (SELECT asset, session_date, hour(executed_at) AS bar, count(*) AS n, sum(premium) AS p FROM tape GROUP BY 1, 2, 3)
  SELECT asset, count(*) AS bars, sum(volume)::BIGINT AS volume, sum(n)::BIGINT AS n, {s6('sum(p)')} AS premium FROM bars JOIN k USING (asset, session_date, bar) GROUP BY 1""")
def join_one_to_one(spark, sf):
    """Bars and totals that must meet one to one: repeated keys on either side, or rows left over, are an error."""
    key = [*KEYS, "bar"]
    totals = tape(spark, sf).groupBy(*KEYS, F.hour("executed_at").alias("bar")).agg(F.count("*").alias("n"), F.sum("premium").alias("p"))
    met = joins.one_to_one(bars(spark, sf), totals, key)
    return met.groupBy("asset").agg(F.count("*").alias("bars"), F.sum("volume").alias("volume"), F.sum("n").alias("n"), r6(F.sum("p")).alias("premium"))


@query("near_spot_exposure", f"""WITH {TAPE}, e AS (SELECT asset, session_date, strike + 50 AS k, sum(direction * premium) AS e FROM tape GROUP BY 1, 2, 3),
  s AS (SELECT asset, session_date, avg(strike + 50.0) AS spot FROM tape GROUP BY 1, 2)
  SELECT asset, session_date, {s6('sum(e)')} AS total, {s6('coalesce(sum(e) FILTER (WHERE abs(k / spot - 1) <= 0.05 + 1e-12), 0.0)')} AS near, {s6('min_by(k / spot - 1, (-abs(round(e, 6)), abs(k / spot - 1), k))')} AS peak
  FROM e JOIN s USING (asset, session_date) GROUP BY 1, 2""", dates=_DAYS)
def near_spot_exposure(spark, sf):
    """Exposure by strike: all of it, that within five hundredths of spot, and where the largest stands, as a distance from spot."""
    rows = tape(spark, sf).withColumn("k", F.col("strike") + 50)
    by = rows.groupBy(*KEYS, "k").agg(F.sum(F.col("direction") * F.col("premium")).alias("e"), F.count("*").alias("n"))
    spot = by.groupBy(*KEYS).agg((F.sum(F.col("k") * F.col("n")) / F.sum("n")).alias("spot"))
    away = F.col("k") / F.col("spot") - 1
    near = F.coalesce(F.sum(F.when(F.abs(away) <= 0.05 + 1e-12, F.col("e"))), F.lit(0.0))
    met = by.join(spot, KEYS)
    return met.groupBy(*KEYS).agg(r6(F.sum("e")).alias("total"), r6(near).alias("near"), r6(F.min_by(away, F.struct(-F.abs(F.round("e", 6)), F.abs(away), "k"))).alias("peak"))


@query("bind_targets", f"""WITH {_LOSS}, v AS (SELECT asset, session_date, bar, lag(persist) OVER (PARTITION BY asset, session_date ORDER BY bar) AS delayed FROM f), p AS (SELECT * FROM f WHERE persist IS NOT NULL AND actual > 0),
  b AS (SELECT asset, v.delayed IS NULL AS incomplete, p.actual IS NULL AS unbound, p.actual, v.delayed FROM v LEFT JOIN p USING (asset, session_date, bar))
  SELECT asset, count(*) FILTER (WHERE NOT incomplete AND NOT unbound) AS bound, count(*) FILTER (WHERE incomplete) AS incomplete, count(*) FILTER (WHERE NOT incomplete AND unbound) AS without_target,
    {s6('corr(actual, delayed) FILTER (WHERE NOT incomplete AND NOT unbound)')} AS correlation FROM b GROUP BY 1""")
def bind_targets(spark, sf):
    """A timing variant's predictors, complete cases only, bound to the primary panel's targets on exact origins; what is left out
    is counted, nothing is filled in."""
    rows = forecasts(spark, sf)
    variant = rows.select(*KEYS, "bar", F.lag("persist").over(W.partitionBy(*KEYS).orderBy("bar")).alias("delayed"))
    primary = rows.where("persist is not null and actual > 0").select(*KEYS, "bar", "actual")
    bound = joins.bound(variant, primary, [*KEYS, "bar"], ["delayed"], ["actual"])
    kept = F.col("status") == "bound"
    return bound.groupBy("asset").agg(
        F.count_if(kept).alias("bound"), F.count_if(F.col("status") == "incomplete").alias("incomplete"), F.count_if(F.col("status") == "without_target").alias("without_target"),
        r6(F.corr(F.when(kept, F.col("actual")), F.when(kept, F.col("delayed")))).alias("correlation"),
    )


@query("pilot_trace", f"""WITH {BARS}, c AS (SELECT asset, session_date, bar, close, lead(close, 1) OVER w AS c1, lead(close, 2) OVER w AS c2, lead(bar, 2) OVER w AS last FROM bars WINDOW w AS (PARTITION BY asset, session_date ORDER BY bar)),
  e AS (SELECT asset, session_date, hour(executed_at) AS bar, max(CASE WHEN premium > 100 THEN 1 ELSE 0 END) AS event FROM tape GROUP BY 1, 2, 3),
  o AS (SELECT c.*, coalesce(event, 0) AS event, CASE WHEN last IS NULL THEN 'end_of_session' WHEN last <> bar + 2 THEN 'gap' END AS reason, CASE WHEN last = bar + 2 THEN ln(c1 / close) ** 2 + ln(c2 / c1) ** 2 END AS rv FROM c LEFT JOIN e USING (asset, session_date, bar)),
  a AS (SELECT asset, count(*) AS origins, count(rv) AS targets, count(*) FILTER (WHERE reason = 'end_of_session') AS end_of_session, count(*) FILTER (WHERE reason = 'gap') AS gap, count(rv) FILTER (WHERE event = 1) AS with_event, count(rv) FILTER (WHERE event = 0) AS without_event,
    {s6('count(*) / (24.0 * count(DISTINCT session_date))')} AS completeness, {s6('avg(rv)')} AS mean_target FROM o GROUP BY 1)
  SELECT *, row_number() OVER (ORDER BY completeness DESC, asset) AS place FROM a""")
def pilot_trace(spark, sf):
    """A pilot from bars to targets: each bar is an origin, its target needs the two bars after it without a gap; what is excluded is
    counted by reason, events and none, and assets are ranked by how complete they are."""
    w = W.partitionBy(*KEYS).orderBy("bar")
    c = bars(spark, sf).select(*KEYS, "bar", "close", F.lead("close", 1).over(w).alias("c1"), F.lead("close", 2).over(w).alias("c2"), F.lead("bar", 2).over(w).alias("last"))
    events = tape(spark, sf).groupBy(*KEYS, F.hour("executed_at").alias("bar")).agg(F.max((F.col("premium") > 100).cast("int")).alias("event"))
    square = lambda a, b: F.pow(log_quotient(F.col(b), F.col(a)), 2)
    o = c.join(events, [*KEYS, "bar"], "left").withColumn("reason", F.when(F.col("last").isNull(), "end_of_session").when(F.col("last") != F.col("bar") + 2, "gap"))
    o = o.withColumn("rv", F.when(F.col("reason").isNull(), square("close", "c1") + square("c1", "c2")))
    a = o.groupBy("asset").agg(
        F.count("*").alias("origins"), F.count("rv").alias("targets"), *[F.count_if(F.col("reason") == r).alias(r) for r in ("end_of_session", "gap")],
        F.count(F.when(F.col("event") == 1, F.col("rv"))).alias("with_event"), F.count(F.when(F.col("event") == 0, F.col("rv"))).alias("without_event"),
        r6(F.count("*") / (24.0 * F.countDistinct("session_date"))).alias("completeness"), r6(F.avg("rv")).alias("mean_target"),
    )
    return a.withColumn("place", F.row_number().over(W.orderBy(F.desc("completeness"), "asset")))  # one row an asset


@query("frozen_forecaster", f"""WITH {_LOSS}, t AS (SELECT * FROM f WHERE persist IS NOT NULL), b AS (SELECT asset, regr_slope(actual, persist) AS slope, regr_intercept(actual, persist) AS a FROM t WHERE session_date < DATE '2024-01-19' GROUP BY 1)
  SELECT asset, count(*) AS n, round(avg(a + slope * persist), 4) + 0.0 AS forecast, round(avg(abs(actual - a - slope * persist)), 4) + 0.0 AS mae FROM t JOIN b USING (asset) WHERE session_date >= DATE '2024-01-19' GROUP BY 1""")
def frozen_forecaster(spark, sf):
    """A line an asset, fitted on the sessions before a day and frozen: stored below the key of its content, which is checked when it
    is loaded to score the later ones."""
    rows = forecasts(spark, sf).where("persist is not null")
    g = models.gram(rows.where("session_date < date'2024-01-19'"), ["persist"], "actual", ["asset"])
    n, sx, sxx, sy, sxy = (F.col(c) for c in ("x0_0", "x0_1", "x1_1", "y0", "y1"))
    slope = (sxy - sx * sy / n) / (sxx - sx * sx / n)
    path = files.write_addressed(g.select("asset", slope.alias("slope"), (sy / n - sx / n * slope).alias("intercept")), files.scratch(spark, "frozen"))
    frozen = files.read_addressed(spark, path)
    scored = joins.checked_join(rows.where("session_date >= date'2024-01-19'"), frozen, ["asset"], "inner", "m:1").withColumn("forecast", F.col("intercept") + F.col("slope") * F.col("persist"))
    r4 = lambda x: F.round(x, 4) + 0.0
    return scored.groupBy("asset").agg(F.count("*").alias("n"), r4(F.avg("forecast")).alias("forecast"), r4(F.avg(F.abs(F.col("actual") - F.col("forecast")))).alias("mae"))
