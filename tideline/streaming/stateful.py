"""Operators with state of their own that outlives restarts: first receipts, accumulators, and progress as rows.

They emit changes in update mode; each row carries the batch that made it, so that the last word on a key is the one
of its latest batch, however often a batch was written.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Buckets of keys that hold first receipts.
BUCKETS = 1_024


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """State with timers needs this store; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class FirstReceipts(StatefulProcessor):
    """The earliest (receipt, sequence) of each key in a bucket of keys; a key is given out whenever that falls, and forgotten
    once the watermark is ``hold_ms`` beyond the latest row of the batch that saw it last. A bucket has one value in
    state, an Arrow table with a row a key, and one timer, that of the key to be forgotten first."""

    def __init__(self, keys: list[str], hold_ms: int):
        self.keys = keys
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "firsts binary, timer_ms long")

    def _firsts(self, parts: list[pd.DataFrame]) -> pd.DataFrame:
        """One row a key: its earliest receipt, and its latest time."""
        groups = pd.concat(parts, ignore_index=True).sort_values(["received_us", "seq"]).groupby(self.keys, dropna=False, sort=False)
        return groups.agg(received_us=("received_us", "first"), seq=("seq", "first"), until_ms=("until_ms", "max")).reset_index()

    def _keep(self, firsts: pd.DataFrame, timer_ms: int | None) -> None:
        """Put the bucket into state, and its timer where that changes."""
        until = int(firsts["until_ms"].min()) if len(firsts) else None
        if until != timer_ms:
            if timer_ms is not None:
                self.handle.deleteTimer(timer_ms)
            if until is not None:
                self.handle.registerTimer(until)
        if until is None:
            self.held.clear()
            return
        table, sink = pa.Table.from_pandas(firsts, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.held.update((sink.getvalue().to_pybytes(), until))

    def _known(self) -> tuple[pd.DataFrame | None, int | None]:
        if not self.held.exists():
            return None, None
        firsts, timer_ms = self.held.get()
        return pa.ipc.open_stream(bytes(firsts)).read_pandas(), timer_ms

    def handleInputRows(self, key: Any, rows: Iterable[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        columns = [*self.keys, "received_us", "seq", "until_ms"]
        fresh = self._firsts([self._firsts([part[columns]]) for part in rows])
        fresh["until_ms"] += self.hold_ms
        known, timer_ms = self._known()
        if known is None:
            changed = firsts = fresh
        else:
            met = fresh.merge(known, "left", self.keys, suffixes=("", "_known"), indicator="_in")
            new = met["_in"] == "left_only"
            earlier = new | (met["received_us"] < met["received_us_known"]) | ((met["received_us"] == met["received_us_known"]) & (met["seq"] < met["seq_known"]))
            changed = met.loc[earlier, columns]
            # what is seen again keeps the earlier receipt and takes the later batch's time
            both = self._firsts([fresh, known]).drop(columns="until_ms")
            again = pd.concat([fresh, known], ignore_index=True).drop_duplicates(self.keys)[[*self.keys, "until_ms"]]
            firsts = both.merge(again, "left", self.keys)
        self._keep(firsts, timer_ms)
        if len(changed):
            yield pd.DataFrame({c: changed[c].to_numpy(object) for c in columns[:-1]})  # plain objects: texts may lie in several chunks

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        known, timer_ms = self._known()
        if known is not None:
            past = max(expiredTimerInfo.getExpiryTimeInMs() + 1, timerValues.getCurrentWatermarkInMs())
            fired = expiredTimerInfo.getExpiryTimeInMs() == timer_ms  # the engine takes it away itself
            self._keep(known[known["until_ms"] >= past].reset_index(drop=True), None if fired else timer_ms)
        yield from ()

    def close(self) -> None:
        pass


class Histogram(StatefulProcessor):
    """Counts by bin for each key, added to for as long as the query lives; bins that change are given out with their
    new counts. Counts merge by adding, so batches, restarts and other queries' histograms do."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "bin long", "n long")

    def handleInputRows(self, key: Any, rows: Iterable[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        more: dict[int, int] = {}
        for part in rows:
            for at, n in part.groupby("bin")["n"].sum().items():
                more[int(at)] = more.get(int(at), 0) + int(n)
        out = []
        for at, n in sorted(more.items()):
            total = n + (self.counts.getValue((at,))[0] if self.counts.containsKey((at,)) else 0)
            self.counts.updateValue((at,), (total,))
            out.append((at, total))
        yield pd.DataFrame({**{k: [v] * len(out) for k, v in zip(self.keys, key, strict=True)}, "bin": [a for a, _ in out], "n": [n for _, n in out]})

    def close(self) -> None:
        pass


def first_receipts(stream: DataFrame, keys: list[str], clock: str, delay: str, hold_ms: int, buckets: int = BUCKETS) -> DataFrame:
    """``keys, received_us, seq``: changes of the first receipt of each key. The stream has these columns and ``clock``;
    rows without a receipt or a sequence are none.

    State is held by hashed buckets of keys, whose number a checkpoint fixes: calls from Python to the state store grow
    with the buckets, not with the keys. Keys pass Python as text, where numbers beside nulls would be rounded."""
    types = dict(stream.dtypes)
    ddl = ", ".join(f"{k} string" for k in keys) + ", received_us long, seq long"
    known = stream.withWatermark(clock, delay).where("received_us is not null and seq is not null")
    until, bucket = F.coalesce(F.unix_millis(clock), F.lit(0)).alias("until_ms"), F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket")
    rows = known.select(*[F.col(k).cast("string").alias(k) for k in keys], "received_us", "seq", clock, until, bucket)
    out = rows.groupBy("_bucket").transformWithStateInPandas(FirstReceipts(keys, hold_ms), ddl, "Update", "EventTime")
    return out.select(*[F.col(k).cast(types[k]).alias(k) for k in keys], "received_us", "seq")


def histograms(stream: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, bin, n``: changes of the counts; the stream has ``keys, bin, n``."""
    types = dict(stream.dtypes)
    ddl = ", ".join(f"{k} {types[k]}" for k in keys) + ", bin long, n long"
    return stream.groupBy(*keys).transformWithStateInPandas(Histogram(keys), ddl, "Update", "None")


def run_updates(frame: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Work through what is there; each batch's changes are written once under its number, a repeated batch over itself."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/of={number}")

    with rocks_state(frame.sparkSession):
        query = frame.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    return query


def latest(spark: SparkSession, path: str, frame: DataFrame, keys: list[str]) -> DataFrame:
    """The last change of each key."""
    changes = spark.read.schema(frame.withColumn("batch", F.lit(0).cast("long")).schema).parquet(f"{path}/of=*")
    values = [c for c in frame.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last")).select(*keys, "_last.*")


def progress(spark: SparkSession, queries: list[StreamingQuery], runs: list[int] | None = None) -> DataFrame:
    """The heartbeat as rows: ``run, batch, rows, state_rows, watermark, started`` per batch of queries that ran one after the
    other. A few rows a query, as the engine keeps them."""
    out = []
    for run, query in enumerate(queries):
        for p in query.recentProgress:
            p = json.loads(p.json) if hasattr(p, "json") and isinstance(p.json, str) else dict(p)
            state = p.get("stateOperators") or [{}]
            out.append((run if runs is None else runs[run], p["batchId"], p["numInputRows"], state[0].get("numRowsTotal"), (p.get("eventTime") or {}).get("watermark"), p["timestamp"]))
    return spark.createDataFrame(out, "run int, batch long, rows long, state_rows long, watermark string, started string")
