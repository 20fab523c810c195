"""Scans, projections, predicates, scalar functions and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import joins
from ..sources.tables import symmetric_difference, table, tape, union_sources
from .registry import TAPE, query, r6, s6


@query("scan_project", "SELECT l_orderkey, l_quantity, l_shipdate::DATE AS shipped FROM lineitem WHERE l_shipdate < DATE '1996-01-01'", dates=["shipped"])
def scan_project(spark, sf):
    return table(spark, sf, "lineitem").where("l_shipdate < timestamp_ntz'1996-01-01'").select("l_orderkey", "l_quantity", F.to_date("l_shipdate").alias("shipped"))


@query("filter_conjunct", f"""SELECT l_orderkey, l_linenumber, {s6('l_extendedprice * (1 - l_discount)')} AS net FROM lineitem
  WHERE l_discount BETWEEN 0.03 AND 0.07 AND l_quantity > 20 AND l_returnflag IN ('A', 'R') AND l_tax IS NOT NULL""")
def filter_conjunct(spark, sf):
    rows = table(spark, sf, "lineitem").where(F.col("l_discount").between(0.03, 0.07) & (F.col("l_quantity") > 20) & F.col("l_returnflag").isin("A", "R") & F.col("l_tax").isNotNull())
    return rows.select("l_orderkey", "l_linenumber", r6(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@query("case_reason_chain", f"""WITH {TAPE} SELECT coalesce(CASE WHEN premium <= 5 THEN 'PREMIUM_TOO_SMALL' WHEN created_us - executed_us > 120000000 THEN 'LATE'
  WHEN direction = 0 THEN 'UNSIGNED' END, 'KEPT') AS reason, count(*) AS n FROM tape GROUP BY 1""")
def case_reason_chain(spark, sf):
    reason = numeric.first_reason((F.col("premium") > 5, "PREMIUM_TOO_SMALL"), (F.col("created_us") - F.col("executed_us") <= 120_000_000, "LATE"), (F.col("direction") != 0, "UNSIGNED"))
    return tape(spark, sf).groupBy(F.coalesce(reason, F.lit("KEPT")).alias("reason")).agg(F.count("*").alias("n"))


@query("horizontal_minmax", f"""WITH {TAPE} SELECT seq, greatest(executed_us, created_us) AS known_us, least(strike, contract) AS low, {s6('CASE WHEN premium > 0 THEN ln(premium) END')} AS log_premium,
  {s6('sign(direction * premium) * ln(1 + abs(direction * premium))')} AS signed FROM tape""")
def horizontal_minmax(spark, sf):
    return tape(spark, sf).select("seq", F.greatest("executed_us", "created_us").alias("known_us"), F.least(F.col("strike").cast("long"), F.col("contract")).alias("low"), r6(numeric.log_positive(F.col("premium"))).alias("log_premium"), r6(numeric.signed_log(F.col("direction") * F.col("premium"))).alias("signed"))


@query("json_field", "SELECT (props::JSON ->> 'k')::INTEGER AS k, count(*) AS n FROM events GROUP BY 1")
def json_field(spark, sf):
    parsed = F.from_json("props", "k int")
    return table(spark, sf, "events").groupBy(parsed["k"].alias("k")).agg(F.count("*").alias("n"))


@query("string_predicates", """SELECT p_partkey, lower(p_name) AS name, length(p_name)::INTEGER AS chars, p_type LIKE '%STEEL%' AS has_steel, starts_with(p_brand, 'Brand#1') AS brand_one,
  p_brand || '|' || p_type AS label FROM part""")
def string_predicates(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("name"), F.char_length("p_name").alias("chars"), F.contains("p_type", F.lit("STEEL")).alias("has_steel"), F.startswith("p_brand", F.lit("Brand#1")).alias("brand_one"), F.concat_ws("|", "p_brand", "p_type").alias("label"))


@query("datetime_parts", """SELECT event_id, ts::DATE AS day, isodow(ts)::INTEGER AS weekday, (hour(ts) * 60 + minute(ts))::INTEGER AS minute_of_day,
  epoch_us(time_bucket(INTERVAL 5 MINUTE, ts::TIMESTAMP)) AS bucket_us, epoch_us(ts::TIMESTAMP + INTERVAL 90 SECOND) AS later_us FROM events""", dates=["day"])
def datetime_parts(spark, sf):
    at = F.col("ts").cast("timestamp")
    five = 5 * 60 * 1_000_000
    return table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"), (F.weekday("ts") + 1).alias("weekday"), (F.hour("ts") * 60 + F.minute("ts")).alias("minute_of_day"), (F.floor(F.unix_micros(at) / five) * five).alias("bucket_us"), F.unix_micros(at + F.expr("interval 90 seconds")).alias("later_us"))


@query("zoned_clock", """SELECT event_id, timezone('America/New_York', timezone('UTC', ts::TIMESTAMP))::DATE AS ny_date,
  hour(timezone('America/New_York', timezone('UTC', ts::TIMESTAMP)))::INTEGER AS ny_hour FROM events""", dates=["ny_date"])
def zoned_clock(spark, sf):
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York")
    return table(spark, sf, "events").select("event_id", F.to_date(local).alias("ny_date"), F.hour(local).alias("ny_hour"))


@query("calendar_clock", f"""SELECT event_id, {s6("sin(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440.0)")} AS s, {s6("cos(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440.0)")} AS c FROM events""")
def calendar_clock(spark, sf):
    turn = F.lit(2.0) * F.pi() * (F.hour("ts") * 60 + F.minute("ts")) / 1440.0
    return table(spark, sf, "events").select("event_id", r6(F.sin(turn)).alias("s"), r6(F.cos(turn)).alias("c"))


@query("null_handling", """SELECT l_returnflag, count(*) FILTER (WHERE d IS NULL) AS unknown, sum(coalesce(d, 0))::BIGINT AS total FROM
  (SELECT l_returnflag, CASE WHEN l_discount > 0.05 THEN l_linenumber END AS d FROM lineitem) GROUP BY 1""")
def null_handling(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.when(F.col("l_discount") > 0.05, F.col("l_linenumber")).alias("d"))
    return rows.groupBy("l_returnflag").agg(F.count_if(F.col("d").isNull()).alias("unknown"), F.sum(F.coalesce("d", F.lit(0))).alias("total"))


@query("finite_flags", """SELECT l_returnflag, count(*) FILTER (WHERE q IS NOT NULL AND isfinite(q)) AS finite, count(*) FILTER (WHERE q IS NULL) AS unknown,
  count(*) FILTER (WHERE isinf(q)) AS infinite FROM (SELECT l_returnflag, CASE WHEN l_discount = 0.0 THEN 'inf'::DOUBLE WHEN l_tax > 0.07 THEN NULL ELSE l_tax / l_discount END AS q FROM lineitem) GROUP BY 1""")
def finite_flags(spark, sf):
    q = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).when(F.col("l_tax") > 0.07, None).otherwise(numeric.ratio(F.col("l_tax"), F.col("l_discount")))
    rows = table(spark, sf, "lineitem").select("l_returnflag", q.alias("q"))
    return rows.groupBy("l_returnflag").agg(F.count_if(numeric.finite(F.col("q"))).alias("finite"), F.count_if(F.col("q").isNull()).alias("unknown"), F.count_if(F.abs("q") == float("inf")).alias("infinite"))


@query("row_digest", "SELECT n_nationkey, sha256(n_nationkey::VARCHAR || '|' || n_name) AS digest FROM nation")
def row_digest(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.sha2(F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name"), 256).alias("digest"))


@query("hash_sample", "SELECT event_id, value FROM events WHERE ('0x' || md5(event_id::VARCHAR)[1:8])::BIGINT < 429496729")
def hash_sample(spark, sf):
    code = F.conv(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return table(spark, sf, "events").where(code < 429_496_729).select("event_id", "value")


@query("union_all_missing", """SELECT source, count(*) AS n, count(key) AS keys, count(price) AS prices FROM
  (SELECT 'orders' AS source, o_orderkey AS key, o_totalprice AS price FROM orders UNION ALL SELECT 'events', event_id, NULL FROM events) GROUP BY 1""")
def union_all_missing(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    b = table(spark, sf, "events").select(F.col("event_id").alias("key"))
    return union_sources(("orders", a), ("events", b)).groupBy("source").agg(F.count("*").alias("n"), F.count("key").alias("keys"), F.count("price").alias("prices"))


@query("distinct_first", """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER
  (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) = 1""")
def distinct_first(spark, sf):
    order = W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return table(spark, sf, "lineitem").withColumn("rn", F.row_number().over(order)).where("rn = 1").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return joins.repeated_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("conflicting_duplicates", """SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT l_partkey) AS variants, count(DISTINCT l_partkey) > 1 AS conflict
  FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def conflicting_duplicates(spark, sf):
    keys = ["l_orderkey", "l_linenumber"]
    rows = joins.dealt(table(spark, sf, "lineitem").select(*keys, "l_partkey"), keys).groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("variants"))
    return rows.where("n > 1").withColumn("conflict", F.col("variants") > 1)


@query("symmetric_except", """SELECT side, nation FROM (
  SELECT 'left' AS side, nation FROM (SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 0 EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL
  SELECT 'right', nation FROM (SELECT s_nationkey AS nation FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer WHERE c_acctbal > 0))""")
def symmetric_except(spark, sf):
    a = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("nation"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))
    return symmetric_difference(a, b).select("side", "nation")


@query("source_overlap_check", """WITH k AS (SELECT l_orderkey, l_linenumber, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n FROM lineitem GROUP BY 1, 2)
  SELECT count(*) FILTER (WHERE n > 1) AS overlapping, count(*) FILTER (WHERE n > 1 AND hi - lo > 1e-9) AS disagreeing, count(*) AS keys FROM k""")
def source_overlap_check(spark, sf):
    k = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.max("l_extendedprice") - F.min("l_extendedprice")).alias("gap"), F.count("*").alias("n"))
    return k.agg(F.count_if(F.expr("n > 1")).alias("overlapping"), F.count_if(F.expr("n > 1 and gap > 1e-9")).alias("disagreeing"), F.count("*").alias("keys"))


@query("key_set_difference", """SELECT (SELECT count(*) FROM (SELECT DISTINCT c_custkey FROM customer) WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS left_only,
  (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS right_only""")
def key_set_difference(spark, sf):
    left = table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).distinct().withColumn("l", F.lit(1))
    right = table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("r", F.lit(1))
    return left.join(right, "k", "full").agg(F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))


@query("sort_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def sort_topk(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("asset_selection", f"""SELECT c_nationkey, count(*) AS n, {s6('avg(c_acctbal)')} AS mean FROM customer GROUP BY 1 HAVING count(*) >= 20 ORDER BY n DESC, mean DESC, c_nationkey LIMIT 6""")
def asset_selection(spark, sf):
    rows = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), r6(F.avg("c_acctbal")).alias("mean")).where("n >= 20")
    return rows.orderBy(F.desc("n"), F.desc("mean"), "c_nationkey").limit(6)


@query("argmin_ties", "SELECT p_brand, min_by(p_partkey, {'a': abs(p_size - 25), 'b': p_retailprice, 'c': p_partkey}) AS best FROM part GROUP BY 1")
def argmin_ties(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct(F.abs(F.col("p_size") - 25), "p_retailprice", "p_partkey")).alias("best"))
