"""Payload parsers, sinks that refuse, published versions, and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tideline.sources import files, tables
from tideline.streaming import live


def one(spark, payload):
    return spark.createDataFrame([(payload if isinstance(payload, str) else json.dumps(payload),)], "p string")


def test_payloads(spark):
    bars = [{"date": "2024-01-02 09:30:00", "open": 1, "low": 1, "high": 2, "close": 2, "volume": 5}, {"date": "2024-01-02 09:31:00", "open": 1, "low": 2, "high": 2, "close": 2, "volume": 5}]
    assert tables.bar_payload(one(spark, bars), "p").count() == 1
    ns = 1_700_000_000_123_456_789
    quotes = [{"sip_timestamp": ns, "bid_price": 1.0, "ask_price": 1.2}, {"sip_timestamp": ns, "bid_price": 2.0, "ask_price": 1.0}]
    assert [(r.sip_timestamp, round(r.mid, 6)) for r in tables.quote_payload(one(spark, quotes), "p").collect()] == [(ns, 1.1)]
    assert tables.trade_payload(one(spark, [{"sip_timestamp": ns, "price": 1.5, "size": 2, "conditions": ["x"]}, {"price": 0, "size": 1}]), "p").count() == 1
    alert = tables.alert_payload(one(spark, [{"id": "1", "ticker": "X", "start_time": 1_700_000_000_123, "total_premium": 5.5, "expiry": "2024-01-19", "has_sweep": True}]), "p").first()
    assert alert.start_time.microsecond == 123_000 and str(alert.expiry) == "2024-01-19"
    assert tables.bar_payload(one(spark, "not json"), "p").count() == 0
    xml = "<feed><entry><content><properties><NEW_DATE>2024-01-02T00:00:00</NEW_DATE><BC_1MONTH>5.5</BC_1MONTH></properties></content></entry></feed>"
    assert [(str(r.NEW_DATE), r.BC_1MONTH) for r in tables.yield_curve(one(spark, xml), "p").collect()] == [("2024-01-02", 5.5)]


def test_torn_lines_are_dropped_and_bad_ones_reported(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType())])
    (tmp_path / "log.jsonl").write_text('{"id": 1}\n{"id": 2}\n{"id":')
    assert sorted(r.id for r in files.observations(spark, str(tmp_path), schema).collect()) == [1, 2]
    (tmp_path / "other.jsonl").write_text('{"id": 3}\n{oops}\n')
    assert sorted(r.status for r in files.json_lines(spark, str(tmp_path), schema).collect()) == ["malformed", "ok", "ok", "ok", "torn"]
    with pytest.raises(ValueError, match="MALFORMED_LINES"):
        files.observations(spark, str(tmp_path), schema)


def test_csv_keeps_awkward_text(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, 'a "quoted", text'), (4, "two\nlines"), (None, " spaces "), (6, "ünï")]
    frame = spark.createDataFrame(rows, "k long, v string")
    files.write_csv(frame, str(tmp_path / "t"))
    back = files.read_csv(spark, str(tmp_path / "t"), frame.schema)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, frame.collect()))


def test_scratch_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    session = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        files.scratch(session, "x")


def test_sinks_refuse(spark, tmp_path):
    path = str(tmp_path / "out")
    assert tables.write_new(spark.range(3), path) == 3
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        tables.write_new(spark.range(3), path)
    with pytest.raises(ValueError, match="EMPTY_RESULT"):
        tables.write_new(spark.range(0), str(tmp_path / "none"))


def test_published_runs_do_not_change(spark, tmp_path):
    path = str(tmp_path / "runs")
    tables.publish(spark.range(3), path, "r1")
    tables.publish(spark.range(3), path, "r1")
    tables.publish(spark.range(4), path, "r2")
    with pytest.raises(ValueError, match="PUBLISHED_RUN_CHANGED:r1"):
        tables.publish(spark.range(4), path, "r1")
    assert {r.run_id: r.rows for r in tables.file_inventory(spark, path).groupBy("run_id").agg(F.sum("rows").alias("rows")).collect()} == {"r1": 3, "r2": 4}


def test_union_and_difference(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "k int, v string")
    u = tables.union_sources(("a", a), ("b", a.drop("v")))
    assert u.where("source = 'b' and v is null").count() == 2
    assert [(r.side, r.k) for r in tables.symmetric_difference(a, a.limit(1)).collect()] == [("left", 1)]


def test_streams(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:00:01"), (1, "a", "2024-01-01 00:00:02"), (2, "b", "2024-01-01 00:05:00"), (3, "a", "2024-01-01 00:07:30")]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "id int, k string, at string").withColumn("at", F.to_timestamp("at")).withColumn("v", F.lit(1.0)).write.parquet(source)
    stream = live.source(spark, source, spark.read.parquet(source).schema)
    kept = live.run_to_end(live.deduplicated(stream, ["id"], "at", "1 hour"), str(tmp_path / "kept"), "append", str(tmp_path / "c1"))
    assert sorted(r.id for r in kept.collect()) == [1, 2, 3]
    sums = live.run_to_end(live.windowed(stream, "at", "1 hour", "5 minutes", None, [], "v"), str(tmp_path / "summed"), "complete", str(tmp_path / "c2"))
    assert sorted((r.start.minute, r.n) for r in sums.collect()) == [(0, 2), (5, 2)]
    live.append_to(live.flagged(stream.withColumn("got", F.col("at") + F.expr("interval 2 minutes")), "at", "got", 60), str(tmp_path / "out"), str(tmp_path / "c3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("late").count() == 4


def test_promotion_and_queries(spark, tmp_path):
    path = str(tmp_path / "set")
    assert tables.promote(spark.range(3), path, "a") == 3
    assert tables.promote(spark.range(5), path, "b") == 5
    with pytest.raises(ValueError, match="EMPTY_RESULT"):
        tables.promote(spark.range(0), path, "c")
    assert tables.current(spark, path).count() == 5
    assert tables.query_parquet(spark, f"{path}/loads/load_id=a", "SELECT sum(id) AS s FROM {data} WHERE id > 0").first().s == 3


def test_reconciliation(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "a", None), (2, "x", 1), (4, "d", 1)], "k int, v string, n int")
    assert {r.k: r.action for r in tables.reconciled(old, new, ["k"]).collect()} == {1: "keep", 2: "update", 3: "delete", 4: "insert"}


def test_stream_resumes_and_beats(spark, tmp_path):
    import time

    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = lambda ids: spark.createDataFrame([(i, "2024-01-01 00:00:0%d" % (i % 10)) for i in ids], "id int, at string").withColumn("at", F.to_timestamp("at"))
    rows([1, 2]).write.parquet(source)
    beat = live.Heartbeat()
    spark.streams.addListener(beat)
    for more in (None, [2, 3], [3, 4]):
        if more:
            rows(more).write.mode("append").parquet(source)
        stream = live.source(spark, source, spark.read.parquet(source).schema)
        live.append_to(live.deduplicated(stream, ["id"], "at", "1 hour"), out, check).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]
    for _ in range(50):
        if beat.last:
            break
        time.sleep(0.1)
    spark.streams.removeListener(beat)
    assert beat.last and beat.stale(3600) == []
