"""Files in and out: CSV, JSON lines, payloads, inventories, and sinks that refuse."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import panel
from ..sources import files, tables
from ..sources.tables import table, tape
from .registry import BARS, TAPE, query, r6, s6
from .windowed import KEYS, bars

_DAYS = ["session_date"]


@query("csv_round_trip", "SELECT * FROM supplier")
def csv_round_trip(spark, sf):
    rows = table(spark, sf, "supplier")
    path = files.scratch(spark, "csv")
    files.write_csv(rows, path)
    return files.read_csv(spark, path, rows.schema)


@query("csv_result_table", f"SELECT o_orderstatus AS status, count(*) AS n, {s6('sum(o_totalprice)')} AS total FROM orders GROUP BY 1")
def csv_result_table(spark, sf):
    """A result table read from CSV with a stated schema, files split."""
    path = files.scratch(spark, "csv")
    rows = table(spark, sf, "orders").select("o_orderstatus", "o_totalprice")
    files.write_csv(rows, path)
    read = files.read_csv(spark, path, rows.schema, several_lines=False)
    return read.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), r6(F.sum("o_totalprice")).alias("total"))


def partitioned(spark, sf) -> str:
    """The tape as files below session_date=.../asset=..."""
    path = files.scratch(spark, "tape")
    tape(spark, sf).select("seq", "premium", "session_date", "asset").repartition("session_date", "asset").write.partitionBy("session_date", "asset").parquet(path)
    return path


@query("partition_inventory", f"WITH {TAPE} SELECT session_date, asset, count(*) AS rows, 1::BIGINT AS files FROM tape GROUP BY 1, 2", dates=_DAYS)
def partition_inventory(spark, sf):
    """Files that partition discovery finds, with the rows that their footers state."""
    found = tables.file_inventory(spark, partitioned(spark, sf))
    return found.groupBy("session_date", "asset").agg(F.sum("rows").alias("rows"), F.countDistinct("file").alias("files"))


@query("post_window_sessions", f"WITH {TAPE} SELECT session_date, count(DISTINCT asset) AS assets, count(*) AS rows FROM tape WHERE session_date > DATE '2024-01-20' GROUP BY 1", dates=_DAYS)
def post_window_sessions(spark, sf):
    """Sessions after the development window; earlier partitions are never listed into a task."""
    late = tables.file_inventory(spark, partitioned(spark, sf)).where("session_date > date'2024-01-20'")
    return late.groupBy("session_date").agg(F.countDistinct("asset").alias("assets"), F.sum("rows").alias("rows"))


@query("post_window_bars", f"""WITH {BARS} SELECT CASE WHEN session_date > DATE '2024-01-20' THEN 'evaluation' ELSE 'development' END AS source, asset, count(*) AS bars,
  {s6('avg(close)')} AS close FROM bars GROUP BY 1, 2""")
def post_window_bars(spark, sf):
    """Bars of two windows as one table, each row with its role."""
    b = bars(spark, sf)
    both = tables.union_sources(("development", b.where("session_date <= date'2024-01-20'")), ("evaluation", b.where("session_date > date'2024-01-20'")))
    return both.groupBy("source", "asset").agg(F.count("*").alias("bars"), r6(F.avg("close")).alias("close"))


@query("scope_rejection", f"""WITH {TAPE}, r AS (SELECT CASE WHEN session_date <= DATE '2024-01-15' THEN 'D' WHEN session_date <= DATE '2024-01-25' THEN 'V' ELSE 'BURNED' END AS role FROM tape)
  SELECT role, role IN ('D', 'V') AS in_scope, count(*) AS n FROM r GROUP BY 1, 2""")
def scope_rejection(spark, sf):
    """Rows by role and whether the role is in scope; ``panel.in_scope`` fails on the others."""
    role = panel.role_by_date(F.col("session_date"), "2024-01-15", "2024-01-25")
    rows = tape(spark, sf).withColumn("role", role).withColumn("in_scope", F.col("role").isin("D", "V"))
    kept = panel.in_scope(rows.where("in_scope"), "role", ["D", "V"])
    return kept.unionByName(rows.where("not in_scope")).groupBy("role", "in_scope").agg(F.count("*").alias("n"))


_INVENTORY = T.StructType([T.StructField("session_date", T.StringType()), T.StructField("asset", T.StringType()), T.StructField("paths", T.ArrayType(T.StringType()))])


@query("json_inventory", f"WITH {TAPE} SELECT session_date::VARCHAR AS session_date, asset, count(DISTINCT hour(executed_at)) AS paths FROM tape GROUP BY 1, 2")
def json_inventory(spark, sf):
    """An inventory of paths by session and asset as JSON lines, read back with its schema."""
    name = F.format_string("%s/%02d.parquet", "asset", F.hour("executed_at"))
    listed = tape(spark, sf).groupBy(*KEYS).agg(F.sort_array(F.collect_set(name)).alias("paths"))
    path = files.scratch(spark, "inventory")
    listed.withColumn("session_date", F.col("session_date").cast("string")).write.json(path)
    return files.observations(spark, path, _INVENTORY).select("session_date", "asset", F.size("paths").cast("long").alias("paths"))


@query("torn_observations", """SELECT CASE WHEN event_id % 50 = 0 THEN 'malformed' ELSE 'ok' END AS status, count(*) AS n,
  coalesce(sum(event_id) FILTER (WHERE event_id % 50 <> 0), 0)::BIGINT AS ids FROM events GROUP BY 1 UNION ALL SELECT 'torn', 1, 0""")
def torn_observations(spark, sf):
    """Lines of a log with malformed ones among them and a last one that its writer did not finish."""
    line = F.when(F.col("event_id") % 50 == 0, F.lit("{oops}")).otherwise(F.to_json(F.struct("event_id", "event_type")))
    lines = table(spark, sf, "events").select(line.alias("value"))
    path = files.scratch(spark, "log")
    lines.union(spark.createDataFrame([('{"event_id": 7, "event_',)], "value string")).write.text(path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType())])
    rows = files.json_lines(spark, path, schema)
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("event_id"))), F.lit(0)).alias("ids"))


# ---- payloads ----------------------------------------------------------------------------------------------


def payload(rows, item, *by):
    """One JSON array of rows per asset and session, and whatever else parts them, as a provider sends its pages."""
    return rows.groupBy(*KEYS, *by).agg(F.to_json(F.collect_list(item)).alias("payload"))


@query("bar_payloads", f"""WITH {BARS} SELECT epoch_us(session_date::TIMESTAMP) + bar * 3600000000 AS bar_us, open, high, low, close, volume::DOUBLE AS volume FROM bars WHERE open > 0 AND close > 0""")
def bar_payloads(spark, sf):
    b = bars(spark, sf)
    at = F.concat(F.col("session_date").cast("string"), F.format_string(" %02d:00:00", "bar"))
    sent = payload(b, F.struct(at.alias("date"), "open", "low", "high", "close", "volume"))
    return tables.bar_payload(sent, "payload").select(F.unix_micros("date").alias("bar_us"), "open", "high", "low", "close", "volume")


@query("trade_payloads", f"WITH {TAPE} SELECT executed_us * 1000 + seq % 1000 AS sip_timestamp, {s6('premium - 20')} AS price, strike::BIGINT AS size, asset AS condition FROM tape WHERE premium > 20 AND strike > 0")
def trade_payloads(spark, sf):
    """Trades with clocks in nanoseconds; rows without a price or size go."""
    item = F.struct((F.col("executed_us") * 1000 + F.col("seq") % 1000).alias("sip_timestamp"), (F.col("premium") - 20).alias("price"), F.col("strike").alias("size"), F.array("asset").alias("conditions"))
    found = tables.trade_payload(payload(tape(spark, sf), item, F.hour("executed_at")), "payload")
    return found.select("sip_timestamp", r6("price").alias("price"), "size", F.col("conditions")[0].alias("condition"))


@query("quote_payloads", f"""WITH {TAPE}, q AS (SELECT executed_us * 1000 AS sip_timestamp, premium - 10 AS bid, premium - 10 + strike / 10.0 - 2 AS ask FROM tape)
  SELECT sip_timestamp, {s6('(bid + ask) / 2')} AS mid FROM q WHERE bid > 0 AND ask > bid""")
def quote_payloads(spark, sf):
    """Quotes with their mid price; crossed and one-sided ones go."""
    bid = F.col("premium") - 10
    item = F.struct((F.col("executed_us") * 1000).alias("sip_timestamp"), bid.alias("bid_price"), (bid + F.col("strike") / 10.0 - 2).alias("ask_price"))
    return tables.quote_payload(payload(tape(spark, sf), item, F.hour("executed_at")), "payload").select("sip_timestamp", r6("mid").alias("mid"))


@query("alert_payloads", f"""WITH {TAPE} SELECT seq::VARCHAR AS id, asset AS ticker, (session_date + 7)::DATE AS expiry, executed_us // 1000 AS start_ms, {s6('premium')} AS premium, strike::DOUBLE AS strike, direction = 1 AS has_sweep FROM tape""", dates=["expiry"])
def alert_payloads(spark, sf):
    item = F.struct(
        F.col("seq").cast("string").alias("id"), F.col("asset").alias("ticker"), F.date_add("session_date", 7).cast("string").alias("expiry"), F.floor(F.col("executed_us") / 1000).alias("start_time"),
        F.col("premium").alias("total_premium"), F.col("strike").cast("double").alias("strike"), (F.col("direction") == 1).alias("has_sweep"),
    )
    found = tables.alert_payload(payload(tape(spark, sf), item, F.hour("executed_at")), "payload")
    return found.select("id", "ticker", "expiry", F.unix_millis("start_time").alias("start_ms"), r6("total_premium").alias("premium"), "strike", "has_sweep")


@query("yield_curves", f"SELECT (DATE '2024-01-01' + n_nationkey::INTEGER)::DATE AS day, {s6('n_regionkey + 0.25::DOUBLE')} AS month_1, {s6('n_nationkey / 8.0')} AS year_1 FROM nation", dates=["day"])
def yield_curves(spark, sf):
    """Dates and rates from XML documents, one a region."""
    entry = "<entry><content><properties><NEW_DATE>%sT00:00:00</NEW_DATE><BC_1MONTH>%s</BC_1MONTH><BC_1YEAR>%s</BC_1YEAR></properties></content></entry>"
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_nationkey").cast("int")).cast("string")
    rows = table(spark, sf, "nation").select("n_regionkey", F.format_string(entry, day, (F.col("n_regionkey") + 0.25).cast("string"), (F.col("n_nationkey") / 8.0).cast("string")).alias("e"))
    documents = rows.groupBy("n_regionkey").agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list("e"), ""), F.lit("</feed>")).alias("xml"))
    return tables.yield_curve(documents, "xml").select(F.col("NEW_DATE").alias("day"), r6("BC_1MONTH").alias("month_1"), r6("BC_1YEAR").alias("year_1"))


# ---- sinks -------------------------------------------------------------------------------------------------


@query("write_once", "SELECT count(*) AS rows, true AS refused_again, true AS refused_empty, true AS free_after_refusal FROM nation")
def write_once(spark, sf):
    """A sink that refuses a second write and an empty frame, and leaves nothing behind when it refuses."""
    rows, path, other = table(spark, sf, "nation"), files.scratch(spark, "once"), files.scratch(spark, "empty")
    written = tables.write_new(rows, path)
    again = empty = False
    try:
        tables.write_new(rows, path)
    except AnalysisException:
        again = True
    try:
        tables.write_new(rows.where("false"), other)
    except ValueError:
        empty = True
    free = tables.write_new(rows, other) == written
    return spark.createDataFrame([(written, again, empty, free)], "rows long, refused_again boolean, refused_empty boolean, free_after_refusal boolean")


@query("content_addressed", "SELECT count(*) AS rows, true AS same_place, true AS other_place FROM region")
def content_addressed(spark, sf):
    """Equal content goes to one place, however it is dealt; other content to another."""
    rows, folder = table(spark, sf, "region"), files.scratch(spark, "addressed")
    path = files.write_addressed(rows, folder)
    same = files.write_addressed(rows.repartition(3).orderBy(F.desc("r_regionkey")), folder) == path
    other = files.write_addressed(rows.where("r_regionkey > 0"), folder) != path
    return spark.read.parquet(path).agg(F.count("*").alias("rows")).select("rows", F.lit(same).alias("same_place"), F.lit(other).alias("other_place"))


@query("staged_promotion", "SELECT s_nationkey AS nation, count(*) AS n FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1")
def staged_promotion(spark, sf):
    """The current version after two loads and one that failed."""
    rows, path = table(spark, sf, "supplier"), files.scratch(spark, "staged")
    tables.promote(rows, path, "first")
    tables.promote(rows.where("s_suppkey % 2 = 0"), path, "second")
    try:
        tables.promote(rows.where("false"), path, "third")
    except ValueError:
        pass
    return tables.current(spark, path).groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"))


@query("publish_read_back", "SELECT n_regionkey AS region, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def publish_read_back(spark, sf):
    """A published result, read back and compared both ways before it is given out; publishing it again is nothing new."""
    names = F.array_join(F.sort_array(F.collect_list("n_name")), ",")
    rows = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"), names.alias("names"))
    path = files.scratch(spark, "published")
    tables.publish(rows, path, "r1")
    tables.publish(rows, path, "r1")
    return spark.read.parquet(f"{path}/run_id=r1")


@query("ad_hoc_sql", f"SELECT l_returnflag AS flag, count(*) AS n, {s6('avg(l_discount)')} AS discount FROM lineitem WHERE l_quantity > 25 GROUP BY 1")
def ad_hoc_sql(spark, sf):
    text = "SELECT l_returnflag AS flag, count(*) AS n, round(avg(l_discount), 6) + 0.0D AS discount FROM {data} WHERE l_quantity > 25 GROUP BY 1"
    return tables.query_parquet(spark, f"{sf}/lineitem.parquet", text)


_HASH = "('0x' || md5(concat_ws('|', event_id, event_type, user_id))[1:15])::BIGINT"


@query("content_profile", f"""SELECT count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, bit_xor({_HASH}) AS content, min(ts)::DATE AS first_day, max(ts)::DATE AS last_day,
  sha256('event_id:bigint,ts:timestamp,user_id:bigint,event_type:string,value:double,props:string') AS schema_digest FROM events""", dates=["first_day", "last_day"])
def content_profile(spark, sf):
    """Rows, ends, an order-free digest of the content and one of the schema."""
    rows = table(spark, sf, "events")
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", "event_id", "event_type", "user_id").cast("binary")), 1, 15), 16, 10).cast("long")
    kinds = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in rows.schema).replace("timestamp_ntz", "timestamp")
    return rows.agg(
        F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.bit_xor(digest).alias("content"),
        F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"), F.sha2(F.lit(kinds), 256).alias("schema_digest"),
    )
