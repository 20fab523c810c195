"""Streaming queries, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import cursor, files
from ..sources.tables import table, tape
from ..streaming import live, stateful
from .registry import TAPE, query


def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    # a stream reads a folder; the glob names the one file of the table
    stream = live.source(spark, f"{sf}/events.parque[t]", schema)
    return stream.select("event_id", F.col("event_type").alias("asset"), "user_id", "value", F.col("ts").cast("timestamp").alias("executed_at"))


def _done(spark, frame, mode):
    path = files.scratch(spark, "live")
    return live.run_to_end(frame, f"{path}/out", mode, f"{path}/progress")


@query("stream_dedup", "SELECT user_id, event_type AS asset, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, value FROM events) GROUP BY 1, 2")
def stream_dedup(spark, sf):
    stream = _stream(spark, sf)
    twice = stream.union(stream)
    # state is bounded by the watermark; what comes again beyond it falls out of the stored result
    kept = _done(spark, live.deduplicated(twice, ["user_id", "asset", "value"], "executed_at", "40 days"), "append")
    kept = kept.select("user_id", "asset", "value").distinct()
    return kept.groupBy("user_id", "asset").agg(F.count("*").alias("n"))


@query("stream_sliding", """SELECT epoch_us(s) AS start_us, event_type AS asset, count(*) AS n, (round(sum(value), 6) + 0.0) AS total FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 12 HOUR, ts::TIMESTAMP), time_bucket(INTERVAL 12 HOUR, ts::TIMESTAMP) - INTERVAL 12 HOUR]) AS s FROM events) GROUP BY 1, 2""")
def stream_sliding(spark, sf):
    sums = _done(spark, live.windowed(_stream(spark, sf), "executed_at", "1 hour", "24 hours", "12 hours", ["asset"], "value"), "complete")
    return sums.select(F.unix_micros("start").alias("start_us"), "asset", "n", (F.round("total", 6) + 0.0).alias("total"))


@query("stream_tumbling", """SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts::TIMESTAMP)) AS start_us, count(*) AS n FROM events GROUP BY 1""")
def stream_tumbling(spark, sf):
    sums = _done(spark, live.windowed(_stream(spark, sf), "executed_at", "1 hour", "6 hours", None, [], "value"), "complete")
    return sums.select(F.unix_micros("start").alias("start_us"), "n")


@query("stream_late_rows", "SELECT event_type AS asset, (event_id * 7919) % 400 > 60 AS late, count(*) AS n FROM events GROUP BY 1, 2")
def stream_late_rows(spark, sf):
    """Late rows are flagged, not dropped."""
    stream = _stream(spark, sf)
    got = F.timestamp_micros(F.unix_micros("executed_at") + (F.col("event_id") * 7919) % 400 * 1_000_000)
    flagged = live.flagged(stream.withColumn("received_at", got), "executed_at", "received_at", 60)
    return _done(spark, flagged.select("asset", "late"), "append").groupBy("asset", "late").agg(F.count("*").alias("n"))


@query("stream_resume", "SELECT event_type AS asset, count(*) AS n FROM events GROUP BY 1")
def stream_resume(spark, sf):
    """A stream that stops halfway and goes on from its checkpoint over a log in which rows come again: each is
    counted once."""
    path = files.scratch(spark, "resume")
    rows = table(spark, sf, "events").select("event_id", F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("executed_at"))
    for part in (rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1 or event_id % 10 = 0")):
        part.write.mode("append").parquet(f"{path}/in")
        stream = live.source(spark, f"{path}/in", rows.schema)
        kept = live.run_to_end(live.deduplicated(stream, ["event_id"], "executed_at", "40 days"), f"{path}/out", "append", f"{path}/progress")
    return kept.groupBy("asset").agg(F.count("*").alias("n"))


#: Session bounds of a polled day, in seconds from midnight.
_OPEN, _CLOSE = 34_200, 57_900


@query("cursor_poll", f"""WITH {TAPE}, p AS (SELECT *, (executed_us - epoch_us(session_date::TIMESTAMP)) // 1000000 AS second FROM tape)
  SELECT asset, count(*) AS n, count(DISTINCT session_date) AS pages, sum(seq)::BIGINT AS seqs, min(second)::BIGINT AS first_second, max(second)::BIGINT AS last_second FROM p WHERE second >= {_OPEN} AND second < {_CLOSE} GROUP BY 1""")
def cursor_poll(spark, sf):
    """Pages polled by a cursor an asset: a run over what is there, one that finds nothing new, and one that goes on
    behind the cursors once more pages have come; each row is read once."""
    path = files.scratch(spark, "polled")
    first = F.unix_micros(F.col("session_date").cast("timestamp"))
    rows = tape(spark, sf).select("asset", "seq", F.floor((F.col("executed_us") - first) / 1_000_000).cast("long").alias("second"), F.datediff("session_date", F.lit("1970-01-01")).alias("day"))
    days = rows.select("asset", "day").distinct()
    numbered = days.withColumn("page", (F.row_number().over(W.partitionBy("asset").orderBy("day")) - 1).cast("int"))
    rows = files.stored(rows.join(numbered, ["asset", "day"]))
    schema = rows.select("asset", "seq", "second", "day").schema
    for part in (rows.where("page < 10"), rows.limit(0), rows.where("page >= 10")):
        if not part.isEmpty():
            cursor.write_pages(part, f"{path}/pages")
        stream = cursor.poll(spark, f"{path}/pages", schema, "second", _OPEN, _CLOSE)
        got = live.run_to_end(stream, f"{path}/out", "append", f"{path}/progress")
    return got.groupBy("asset").agg(F.count("*").alias("n"), F.countDistinct("day").alias("pages"), F.sum("seq").alias("seqs"), F.min("second").alias("first_second"), F.max("second").alias("last_second"))


def _runs(spark, sf, columns, parts=3):
    """Thirds of the tape as files that come one after the other, and the stream over their folder after each."""
    path = files.scratch(spark, "runs")
    rows = tape(spark, sf).select(*columns, (F.col("seq") % parts).alias("part"))
    for part in range(parts):
        rows.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{path}/in")
        yield live.source(spark, f"{path}/in", rows.drop("part").schema), path


@query("stream_first_receipt", f"""WITH {TAPE} SELECT contract, asset, min(created_us) AS received_us, min_by(seq, (created_us, seq)) AS seq FROM tape GROUP BY 1, 2""")
def stream_first_receipt(spark, sf):
    """First receipts held in state with timers, over two restarts; an earlier receipt that comes later corrects the first."""
    keys = ["contract", "asset"]
    for stream, path in _runs(spark, sf, [*keys, "seq", "executed_at", F.col("created_us").alias("received_us")]):
        frame = stateful.first_receipts(stream, keys, "executed_at", "40 days", 60 * 86_400_000)
        stateful.run_updates(frame, f"{path}/out", f"{path}/progress")
    return stateful.latest(spark, f"{path}/out", frame, keys)


_BIN = "CASE WHEN created_us - executed_us <= 1000 THEN 0 ELSE CAST(floor(log10((created_us - executed_us) / 1000e0) * 20) AS BIGINT) + 1 END"


@query("stream_histogram", f"""WITH {TAPE} SELECT asset, {_BIN} AS bin, count(*) AS n FROM tape GROUP BY 1, 2""")
def stream_histogram(spark, sf):
    """Histograms of lags that go on adding over two restarts."""
    for stream, path in _runs(spark, sf, ["asset", F.expr(_BIN).cast("long").alias("bin"), F.lit(1).cast("long").alias("n")]):
        frame = stateful.histograms(stream, ["asset"])
        stateful.run_updates(frame, f"{path}/out", f"{path}/progress")
    return stateful.latest(spark, f"{path}/out", frame, ["asset", "bin"])


@query("stream_progress", f"""WITH {TAPE}, k AS (SELECT asset, min(seq % 3) AS run FROM tape GROUP BY 1) SELECT (seq % 3)::INTEGER AS run, count(*) AS rows, (SELECT count(*) FROM k WHERE run <= any_value(tape.seq % 3)) AS keys FROM tape GROUP BY tape.seq % 3""")
def stream_progress(spark, sf):
    """The heartbeat of three runs of one query as a table: rows read, and keys with state at the end."""
    queries = []
    for stream, path in _runs(spark, sf, ["asset", F.expr(_BIN).cast("long").alias("bin"), F.lit(1).cast("long").alias("n")]):
        counts = stream.groupBy("asset").agg(F.sum("n").alias("n"))
        queries.append(stateful.run_updates(counts, f"{path}/out", f"{path}/progress"))
    return stateful.progress(spark, queries).groupBy("run").agg(F.sum("rows").alias("rows"), F.max("state_rows").alias("keys"))
