"""Readers and writers: tables, the two-clock tape, payloads, versioned and staged results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table; columns and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tape(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as a tape whose rows carry the time of execution and the time of becoming known.

    Times without a zone are UTC. ``seq`` is the stored order that breaks ties.
    """
    events = table(spark, folder, "events")
    executed = F.col("ts").cast("timestamp")
    lag = (F.col("event_id") * 7919) % 400
    executed_us = F.unix_micros(executed)
    created_us = executed_us + lag * 1_000_000
    direction = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return events.select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("asset"), F.col("user_id").alias("contract"), F.col("value").alias("premium"),
        executed.alias("executed_at"), F.timestamp_micros(created_us).alias("created_at"), executed_us.alias("executed_us"), created_us.alias("created_us"),
        F.to_date("ts").alias("session_date"), direction.alias("direction"), F.get_json_object("props", "$.k").cast("int").alias("strike"), (F.col("event_id") % 2 == 0).alias("is_call"),
    )


def bar_payload(frame: DataFrame, column: str) -> DataFrame:
    """Rows of minute-bar payloads: a JSON array of bars in one column to one row per bar."""
    bar = T.ArrayType(T.StructType([T.StructField("date", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "low", "high", "close", "volume"))]))
    parsed = frame.select(F.explode(F.from_json(column, bar)).alias("bar")).select("bar.*")
    return parsed.withColumn("date", F.to_timestamp("date")).where("open > 0 and close > 0 and high >= greatest(open, close) and low <= least(open, close)")


def trade_payload(frame: DataFrame, column: str) -> DataFrame:
    """Rows of trade payloads, clocks in nanoseconds kept as long."""
    trade = T.ArrayType(T.StructType([T.StructField("sip_timestamp", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("size", T.LongType()), T.StructField("conditions", T.ArrayType(T.StringType()))]))
    return frame.select(F.explode(F.from_json(column, trade)).alias("trade")).select("trade.*").where("price > 0 and size > 0")


def quote_payload(frame: DataFrame, column: str) -> DataFrame:
    """Rows of quote payloads with their mid price; crossed and one-sided quotes go."""
    quote = T.ArrayType(T.StructType([T.StructField("sip_timestamp", T.LongType()), T.StructField("bid_price", T.DoubleType()), T.StructField("ask_price", T.DoubleType()), T.StructField("participant_timestamp", T.LongType())]))
    rows = frame.select(F.explode(F.from_json(column, quote)).alias("quote")).select("quote.*").where("bid_price > 0 and ask_price > bid_price")
    return rows.withColumn("mid", (F.col("bid_price") + F.col("ask_price")) / 2)


def alert_payload(frame: DataFrame, column: str) -> DataFrame:
    """Rows of flow alerts; milliseconds become timestamps."""
    fields = [T.StructField(c, T.StringType()) for c in ("id", "ticker", "option_chain", "type", "expiry")]
    fields += [T.StructField(c, T.LongType()) for c in ("start_time", "end_time", "total_size", "volume", "open_interest")]
    fields += [T.StructField(c, T.DoubleType()) for c in ("total_premium", "strike", "underlying_price", "price", "bid", "ask")] + [T.StructField("has_sweep", T.BooleanType()), T.StructField("created_at", T.StringType())]
    rows = frame.select(F.explode(F.from_json(column, T.ArrayType(T.StructType(fields)))).alias("alert")).select("alert.*")
    clock = lambda c: F.timestamp_millis(c).alias(c)
    return rows.select("id", "ticker", "option_chain", "type", F.to_date("expiry").alias("expiry"), clock("start_time"), clock("end_time"), F.to_timestamp("created_at").alias("created_at"), "total_size", "volume", "open_interest", "total_premium", "strike", "underlying_price", "has_sweep")


def yield_curve(frame: DataFrame, column: str) -> DataFrame:
    """Dates and rates from yield-curve XML documents in one column."""
    entry = "struct<content:struct<properties:struct<NEW_DATE:string,BC_1MONTH:double,BC_3MONTH:double,BC_6MONTH:double,BC_1YEAR:double>>>"
    rows = frame.select(F.explode(F.from_xml(column, f"struct<entry:array<{entry}>>")["entry"]).alias("e")).select("e.content.properties.*")
    return rows.withColumn("NEW_DATE", F.to_date(F.substring("NEW_DATE", 1, 10)))


def union_sources(*tagged: tuple[str, DataFrame]) -> DataFrame:
    """Frames of differing columns as one, each row with its source; missing columns are null."""
    frames = [frame.withColumn("source", F.lit(name)) for name, frame in tagged]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def widened(*frames: DataFrame) -> DataFrame:
    """Frames of equal columns as one, each column in the narrowest type that holds all: differing numbers become
    double (whole ones long), anything else that differs becomes text."""
    kinds: dict[str, set[T.DataType]] = {}
    for frame in frames:
        for field in frame.schema:
            kinds.setdefault(field.name, set()).add(field.dataType)

    def common(types: set[T.DataType]) -> T.DataType:
        if len(types) == 1:
            return next(iter(types))
        if all(isinstance(t, T.IntegralType) for t in types):
            return T.LongType()
        return T.DoubleType() if all(isinstance(t, T.NumericType) for t in types) else T.StringType()

    out = None
    for frame in frames:
        cast = frame.select(*[F.col(c).cast(common(types)).alias(c) for c, types in kinds.items()])
        out = cast if out is None else out.unionByName(cast)
    return out


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files below a hive-partitioned path with their sizes and rows; partition columns are discovered."""
    read = spark.read.parquet(path)
    keys = [c for c in ("date", "session_date", "asset", "run_id") if c in read.columns]
    return read.groupBy(*keys, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))


def write_new(frame: DataFrame, path: str) -> int:
    """Write once: an existing path or an empty frame is an error. Returns the rows written."""
    if frame.isEmpty():  # before anything is written, so that the path stays free
        raise ValueError("EMPTY_RESULT_REJECTED")
    frame.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.parquet(path).count()


def publish(frame: DataFrame, path: str, run_id: str) -> None:
    """Add a result under a run id. A run that was published before must have equal rows; another is an error."""
    spark = frame.sparkSession
    target = f"{path}/run_id={run_id}"
    try:
        before = spark.read.parquet(target)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        frame.write.parquet(target)
        before = spark.read.parquet(target)
        if not symmetric_difference(before, frame.select(before.columns)).isEmpty():
            raise ValueError(f"PUBLISHED_RUN_DIFFERS:{run_id}") from None
        return
    if not symmetric_difference(before, frame.select(before.columns)).isEmpty():
        raise ValueError(f"PUBLISHED_RUN_CHANGED:{run_id}")


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either frame that the other lacks, as often as it lacks them."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))


def content_digest(columns: list[Column]) -> Column:
    """SHA-256 of a row's canonical text."""
    return F.sha2(F.to_json(F.array(*[c.cast("string") for c in columns])), 256)


def query_parquet(spark: SparkSession, path: str, sql: str) -> DataFrame:
    """SQL over one Parquet path, which the statement names ``{data}``; nothing is registered in the session."""
    return spark.sql(sql, data=spark.read.parquet(path))


def promote(frame: DataFrame, path: str, load_id: str) -> int:
    """Load under an id of its own, check it, and only then make it the current version. A load that is empty or
    fails leaves the version before it in place. Returns the rows."""
    spark = frame.sparkSession
    rows = write_new(frame, f"{path}/loads/load_id={load_id}")
    past = _pointers(spark, path)
    number = 0 if past is None else past.agg(F.max("number")).first()[0] + 1
    spark.createDataFrame([(number, load_id, rows)], _POINTER).coalesce(1).write.mode("errorifexists").parquet(f"{path}/pointers/{number}")
    return rows


_POINTER = "number long, load_id string, rows long"


def _pointers(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_POINTER).option("recursiveFileLookup", True).parquet(f"{path}/pointers")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def current(spark: SparkSession, path: str) -> DataFrame:
    """The version that was promoted last: pointers are only ever added, and the newest that is whole counts."""
    newest = _pointers(spark, path).orderBy(F.desc("number")).first()
    return spark.read.parquet(f"{path}/loads/load_id={newest.load_id}")


def reconciled(existing: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """What makes one table the other: each key with insert, update, delete or keep. Nulls in values compare equal."""
    values = [c for c in wanted.columns if c not in keys]
    left = existing.select(*keys, F.struct(*values).alias("_old"))
    right = wanted.select(*keys, F.struct(*values).alias("_new"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(~F.col("_old").eqNullSafe(F.col("_new")), "update").otherwise("keep")
    return left.join(right, keys, "full").select(*keys, action.alias("action"))
