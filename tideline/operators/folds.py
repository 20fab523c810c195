"""Folds over rows that last for a while: interval purging, masks a session, and an audit of what was trained on.

A row lasts from its origin to the end of its target. Which folds may not train on it is found by a join of buckets of
time, so neither rows nor folds are multiplied by each other; how much lies before a fold's limit is read off counts
that are accumulated by ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ranks

#: Bands that are broadcast, some 50 bytes each.
BROADCAST_BANDS = 100_000


def blocks(sessions: DataFrame, session: str, folds: int) -> DataFrame:
    """``session, fold``: contiguous blocks of nearly equal numbers of sessions, larger ones first. One row a session is
    numbered in one task."""
    numbered = sessions.select(session).distinct().withColumn("_i", F.row_number().over(W.orderBy(session))).withColumn("_n", F.count("*").over(W.partitionBy(F.lit(0))))
    return numbered.select(session, (ranks.tile(F.col("_i"), F.col("_n"), folds) - 1).alias("fold"))


def bands(tests: DataFrame, fold: str, start: str, end: str, before: int, after: int) -> DataFrame:
    """``fold, low, high, test_low, test_high``: the time that each fold's test rows span, and the band about it that training may
    not touch."""
    spans = tests.groupBy(F.col(fold).alias("fold")).agg(F.min(start).alias("test_low"), F.max(end).alias("test_high"))
    return spans.select("fold", (F.col("test_low") - before).alias("low"), (F.col("test_high") + after).alias("high"), "test_low", "test_high")


def purged(rows: DataFrame, bands_: DataFrame, keys: list[str], start: str, end: str, width: int) -> DataFrame:
    """``rows`` with ``purged``, the sorted folds whose band a row overlaps, tests of the fold itself included. A row may train
    every other fold. Rows and bands meet in buckets of ``width``, which should be about as long as a row lasts."""
    first, last = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    spread = rows.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), first.alias("_b"), F.explode(F.sequence(first, last)).alias("_at"))
    low = F.floor(F.col("low") / width)
    laid = bands_.select("fold", "low", "high", low.alias("_low"), F.explode(F.sequence(low, F.floor(F.col("high") / width))).alias("_at"))
    if laid.count() <= BROADCAST_BANDS:
        laid = F.broadcast(laid)
    # in the first bucket that both reach, so that a pair is met once
    met = spread.join(laid, "_at").where((F.col("_s") <= F.col("high")) & (F.col("_e") >= F.col("low")) & (F.col("_at") == F.greatest("_b", "_low")))
    found = met.groupBy(*keys).agg(F.sort_array(F.collect_set("fold")).alias("purged"))
    out = rows.join(found, keys, "left")
    return out.withColumn("purged", F.coalesce("purged", F.array().cast(found.schema["purged"].dataType)))


def known_by(rows: DataFrame, limits: DataFrame, end: str, limit: str) -> DataFrame:
    """``limits`` with ``n``, the rows that have ended at the limit, and ``last``, the latest end among them (null without
    any). A null limit gives none. Rows are counted by their end and accumulated by ranges; limits stand among them as
    ends of no row."""
    marks = limits.where(F.col(limit).isNotNull()).select(F.col(limit).cast("long").alias("_v"), F.lit(0).cast("long").alias("_n"))
    ends = rows.groupBy(F.col(end).cast("long").alias("_v")).agg(F.count("*").alias("_n"))
    up = ranks.counted(ends.unionByName(marks), [], "_v", weight="_n").withColumn("_up", F.col("before") + F.col("n"))
    at = limits.join(up.select(F.col("_v").alias("_mark"), "_up"), F.col(limit) == F.col("_mark"), "left").withColumn("n", F.coalesce("_up", F.lit(0)))
    lasts = up.where("n > 0").select(F.col("_up").alias("_reached"), F.col("_v").alias("last"))
    return at.drop("_mark", "_up").join(lasts, F.col("n") == F.col("_reached"), "left").drop("_reached")


def session_masks(rows: DataFrame, session: str, start: str, end: str, gap: int, valid: int) -> DataFrame:
    """Per session the sizes of its causal masks: ``test_n``; ``train_n``, rows that ended ``gap`` before its first origin;
    ``valid_n``, those of the last ``valid`` sessions among them; ``fit_n``, those that ended ``gap`` before the first of these; and
    ``status``: too few sessions to train on leave no inner masks. One row a session is numbered in one task."""
    days = rows.groupBy(session).agg(F.count("*").alias("test_n"), F.min(start).alias("_first"), F.min(end).alias("_least"))
    order = W.orderBy(session)
    days = days.withColumn("_no", F.row_number().over(order)).withColumn("_before", F.sum("test_n").over(order.rowsBetween(W.unboundedPreceding, -1))).withColumn("_limit", F.col("_first") - gap)
    days = known_by(rows, days, end, "_limit").withColumnsRenamed({"n": "train_n", "last": "train_last"})
    # the sessions that hold a training row are those whose earliest end lies before the limit
    ends = days.select(F.col("_no").alias("_of"), F.col("_least").alias("_ended"))
    had = known_by(ends, days.select(session, "_limit"), "_ended", "_limit").select(session, F.col("n").alias("train_sessions"))
    days = days.join(had, session).withColumn("_from", F.when(F.col("train_sessions") > valid, F.col("train_sessions") - valid + 1))
    inner = days.select(F.col("_no").alias("_from"), (F.col("_first") - gap).alias("_inner"), F.coalesce("_before", F.lit(0)).alias("_held"))
    days = days.join(inner, "_from", "left")
    fits = known_by(rows, days.select(session, "_inner"), end, "_inner").select(session, F.col("n").alias("fit_n"))
    out = days.join(fits, session)
    status = F.when(F.col("_from").isNull(), "too_few_sessions").when(F.col("fit_n") == 0, "nothing_to_fit").otherwise("ok")
    valid_n = F.when(F.col("_from").isNotNull(), F.col("train_n") - F.col("_held")).otherwise(0)
    return out.select(session, "test_n", "train_n", "train_sessions", F.col("train_last"), valid_n.alias("valid_n"), "fit_n", F.col("_first").alias("test_first"), status.alias("status"))


def causal_audit(rows: DataFrame, tests: DataFrame, start: str, end: str, gap: int) -> DataFrame:
    """Per fold of ``tests`` (rows with ``fold``): test rows and their first origin, rows with an earlier origin, those kept for
    training (ended ``gap`` before it), those dropped, the last end kept, and whether it lies ``gap`` before the test."""
    folds = tests.groupBy("fold").agg(F.count("*").alias("test_n"), F.min(start).alias("test_first")).withColumn("_limit", F.col("test_first") - gap).withColumn("_earlier", F.col("test_first") - 1)
    kept = known_by(rows, folds, end, "_limit").withColumnsRenamed({"n": "train_n", "last": "train_last"})
    earlier = known_by(rows, folds.select("fold", "_earlier"), start, "_earlier").select("fold", F.col("n").alias("earlier_n"))
    out = kept.join(earlier, "fold")
    passed = (F.col("train_n") > 0) & (F.col("train_last") + gap <= F.col("test_first"))
    return out.select("fold", "test_n", "test_first", "earlier_n", "train_n", (F.col("earlier_n") - F.col("train_n")).alias("dropped_n"), "train_last", F.coalesce(passed, F.lit(False)).alias("causal"))
