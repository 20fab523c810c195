"""Panels, masks, splits, published versions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import panel
from ..sources.tables import symmetric_difference, table, tape
from .registry import TAPE, query, r6, s6
from .windowed import KEYS

_PANEL = f"""{TAPE}, b0 AS (SELECT asset, session_date, avg(premium) AS b0 FROM tape GROUP BY 1, 2), b1 AS (SELECT asset, session_date, avg(premium) AS b1 FROM tape WHERE is_call AND strike > 60 AND hour(executed_at) < 6 GROUP BY 1, 2),
  b2 AS (SELECT asset, session_date, sum(direction * premium) AS b2 FROM tape WHERE created_us - executed_us < 100000000 AND hour(executed_at) < 3 GROUP BY 1, 2), panel AS (SELECT * FROM b0 LEFT JOIN b1 USING (asset, session_date) LEFT JOIN b2 USING (asset, session_date))"""


def merged(spark, sf):
    rows = tape(spark, sf)
    b0 = rows.groupBy(*KEYS).agg(F.avg("premium").alias("b0"))
    b1 = rows.where("is_call and strike > 60 and hour(executed_at) < 6").groupBy(*KEYS).agg(F.avg("premium").alias("b1"))
    b2 = rows.where("created_us - executed_us < 100000000 and hour(executed_at) < 3").groupBy(*KEYS).agg(F.sum(F.col("direction") * F.col("premium")).alias("b2"))
    return b0.join(b1, KEYS, "left").join(b2, KEYS, "left")


@query("panel_merge", f"WITH {_PANEL} SELECT asset, session_date, {s6('b0')} AS b0, {s6('b1')} AS b1, {s6('b2')} AS b2 FROM panel", dates=["session_date"])
def panel_merge(spark, sf):
    return merged(spark, sf).select(*KEYS, *[r6(c).alias(c) for c in ("b0", "b1", "b2")])


@query("nested_completeness", f"""WITH {_PANEL} SELECT asset, session_date, b0 IS NOT NULL AS complete_b0, b0 IS NOT NULL AND b1 IS NOT NULL AS complete_b1, b0 IS NOT NULL AND b1 IS NOT NULL AND b2 IS NOT NULL AS complete_b2,
  CASE WHEN b0 IS NULL THEN 'B0_INCOMPLETE' WHEN b1 IS NULL THEN 'B1_INCOMPLETE' WHEN b2 IS NULL THEN 'B2_INCOMPLETE' END AS reason FROM panel""", dates=["session_date"])
def nested_completeness(spark, sf):
    return panel.nested(merged(spark, sf), [("b0", ["b0"]), ("b1", ["b1"]), ("b2", ["b2"])]).select(*KEYS, "complete_b0", "complete_b1", "complete_b2", "reason")


@query("common_mask", f"WITH {_PANEL} SELECT session_date, count(*) AS n, count(*) FILTER (WHERE b0 IS NOT NULL AND b1 IS NOT NULL AND b2 IS NOT NULL) AS usable FROM panel GROUP BY 1", dates=["session_date"])
def common_mask(spark, sf):
    flagged = panel.nested(merged(spark, sf), [("b0", ["b0"]), ("b1", ["b1"]), ("b2", ["b2"])])
    return panel.common_mask(flagged, ["complete_b0", "complete_b1", "complete_b2"]).groupBy("session_date").agg(F.count("*").alias("n"), F.count_if("usable").alias("usable"))


@query("availability_sidecar", f"""WITH {_PANEL}, o AS (SELECT asset, session_date, count(*) FILTER (WHERE created_us - executed_us > 300000000) * 4 <= count(*) AS eligible FROM tape GROUP BY 1, 2) SELECT asset, session_date, eligible, CASE WHEN eligible THEN {s6('b2')} END AS b2 FROM panel JOIN o USING (asset, session_date)""", dates=["session_date"])
def availability_sidecar(spark, sf):
    o = tape(spark, sf).groupBy(*KEYS).agg((F.count_if(F.col("created_us") - F.col("executed_us") > 300_000_000) * 4 <= F.count("*")).alias("eligible"))
    return merged(spark, sf).join(o, KEYS).select(*KEYS, "eligible", F.when(F.col("eligible"), r6("b2")).alias("b2"))


@query("chrono_split", f"""WITH {TAPE}, s AS (SELECT session_date, dense_rank() OVER (ORDER BY session_date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT session_date FROM tape)), r AS (SELECT session_date, CASE WHEN i <= floor(n * 0.6) THEN 'D' ELSE 'V' END AS role FROM s)
  SELECT role, count(*) AS n, count(DISTINCT session_date) AS sessions FROM tape JOIN r USING (session_date) GROUP BY 1""")
def chrono_split(spark, sf):
    return panel.chronological(tape(spark, sf), "session_date", 0.6).groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("session_date").alias("sessions"))


@query("purge_embargo", f"""WITH {TAPE}, s AS (SELECT session_date, dense_rank() OVER (ORDER BY session_date) AS no FROM (SELECT DISTINCT session_date FROM tape)), f AS (SELECT unnest(range(3)) AS fold),
  p AS (SELECT fold, session_date, CASE WHEN no >= 13 + fold * 5 AND no < 18 + fold * 5 THEN 'test' WHEN no < 13 + fold * 5 - 3 THEN 'train' END AS part FROM s, f)
  SELECT fold::INTEGER AS fold, part, count(*) AS sessions, min(session_date) AS first_session, max(session_date) AS last_session FROM p WHERE part IS NOT NULL GROUP BY 1, 2""", dates=["first_session", "last_session"])
def purge_embargo(spark, sf):
    s = tape(spark, sf).select("session_date").distinct().withColumn("no", F.dense_rank().over(W.orderBy("session_date")))
    return panel.expanding_folds(s, "no", 3, 13, 5, 2, 1).groupBy("fold", "part").agg(F.count("*").alias("sessions"), F.min("session_date").alias("first_session"), F.max("session_date").alias("last_session"))


@query("role_dates", f"""WITH {TAPE} SELECT CASE WHEN session_date <= DATE '2024-01-15' THEN 'D' WHEN session_date <= DATE '2024-01-25' THEN 'V' ELSE 'BURNED' END AS role, count(*) AS n FROM tape GROUP BY 1""")
def role_dates(spark, sf):
    return tape(spark, sf).groupBy(panel.role_by_date(F.col("session_date"), "2024-01-15", "2024-01-25").alias("role")).agg(F.count("*").alias("n"))


@query("fold_scaling", f"""WITH {_PANEL}, t AS (SELECT median(b1) AS m, avg(b1) AS a, stddev_pop(b1) AS s FROM panel WHERE session_date < DATE '2024-01-19') SELECT asset, session_date, {s6('(coalesce(b1, m) - a) / s')} AS b1, b1 IS NULL AS b1_missing FROM panel, t""", dates=["session_date"])
def fold_scaling(spark, sf):
    return panel.scaled(merged(spark, sf), F.col("session_date") < F.lit("2024-01-19").cast("date"), ["b1"]).select(*KEYS, r6("b1").alias("b1"), "b1_missing")


@query("slice_summary", f"""WITH {TAPE}, l AS (SELECT premium, unnest([asset, CASE WHEN is_call THEN 'calls' ELSE 'puts' END, CASE WHEN strike >= 50 THEN 'high' END]) AS slice FROM tape) SELECT slice, count(*) AS n, {s6('avg(premium)')} AS mean FROM l WHERE slice IS NOT NULL GROUP BY 1""")
def slice_summary(spark, sf):
    labels = F.filter(F.array("asset", F.when(F.col("is_call"), "calls").otherwise("puts"), F.when(F.col("strike") >= 50, "high")), lambda x: x.isNotNull())
    return tape(spark, sf).select("premium", F.explode(labels).alias("slice")).groupBy("slice").agg(F.count("*").alias("n"), r6(F.avg("premium")).alias("mean"))


@query("input_profile", "SELECT count(*) AS n, count(DISTINCT user_id) AS users, min(ts)::DATE AS first_day, max(ts)::DATE AS last_day, sum(event_id)::BIGINT AS id_sum FROM events", dates=["first_day", "last_day"])
def input_profile(spark, sf):
    return table(spark, sf, "events").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"), F.sum("event_id").alias("id_sum"))


@query("explicit_gaps", f"""WITH {TAPE}, g AS (SELECT session_date, h FROM (SELECT DISTINCT session_date FROM tape), range(24) r(h)), k AS (SELECT session_date, hour(executed_at) AS h, count(*) AS n FROM tape WHERE asset = 'error' GROUP BY 1, 2)
  SELECT session_date, h::INTEGER AS hour, n, CASE WHEN n IS NULL THEN 'PROVIDER_GAP' ELSE 'OBSERVED' END AS status FROM g LEFT JOIN k USING (session_date, h)""", dates=["session_date"])
def explicit_gaps(spark, sf):
    rows = tape(spark, sf)
    cells = rows.select("session_date").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    k = rows.where("asset = 'error'").groupBy("session_date", F.hour("executed_at").alias("hour")).agg(F.count("*").alias("n"))
    return cells.join(k, ["session_date", "hour"], "left").withColumn("status", F.when(F.col("n").isNull(), "PROVIDER_GAP").otherwise("OBSERVED"))


_RUNS = "runs AS (SELECT o_orderstatus AS dataset, o_orderpriority AS run_id, max(o_orderkey) AS published, sum(o_custkey)::BIGINT AS payload FROM orders GROUP BY 1, 2)"


def runs(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("run_id")).agg(F.max("o_orderkey").alias("published"), F.sum("o_custkey").alias("payload"))


@query("current_version_view", f"WITH {_RUNS} SELECT dataset, run_id, payload FROM runs QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY published DESC, run_id DESC) = 1")
def current_version_view(spark, sf):
    rank = F.row_number().over(W.partitionBy("dataset").orderBy(F.desc("published"), F.desc("run_id")))
    return runs(spark, sf).withColumn("rn", rank).where("rn = 1").select("dataset", "run_id", "payload")


@query("publish_set_diff", f"""WITH {_RUNS}, a AS (SELECT dataset, payload % 10 AS v FROM runs WHERE run_id < '3'), b AS (SELECT dataset, payload % 10 AS v FROM runs WHERE run_id >= '3')
  SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def publish_set_diff(spark, sf):
    r = runs(spark, sf).select("dataset", (F.col("payload") % 10).alias("v"), "run_id")
    return symmetric_difference(r.where("run_id < '3'").drop("run_id"), r.where("run_id >= '3'").drop("run_id")).select("side", "dataset", "v")


@query("catalogue_reconciliation", """WITH a AS (SELECT n_nationkey AS key, n_name AS name FROM nation WHERE n_nationkey < 20), b AS (SELECT n_nationkey AS key, CASE WHEN n_nationkey % 4 = 0 THEN lower(n_name) ELSE n_name END AS name FROM nation WHERE n_nationkey >= 5)
  SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'insert' WHEN b.key IS NULL THEN 'delete' WHEN a.name <> b.name THEN 'update' ELSE 'keep' END AS action FROM a FULL JOIN b ON a.key = b.key""")
def catalogue_reconciliation(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    a = n.where("key < 20").withColumnRenamed("name", "a")
    b = n.where("key >= 5").select("key", F.when(F.col("key") % 4 == 0, F.lower("name")).otherwise(F.col("name")).alias("b"))
    return a.join(b, ["key"], "full").select("key", F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "delete").when(F.col("a") != F.col("b"), "update").otherwise("keep").alias("action"))
