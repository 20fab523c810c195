"""Joins with checked cardinality, exact-lag joins, and assertions that need one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of one task that groups by keys which few rows share: some 100 MB in hash maps.
TASK_ROWS = 250_000


def dealt(frame: DataFrame, keys: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """The rows dealt out by their keys to as many tasks as their number asks for, so that what a task holds does not grow with
    the input. Counting the rows of Parquet reads its footers only."""
    return frame.repartition(max(1, -(-frame.count() // task_rows)), *keys)


def repeated_keys(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return frame.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", validate: str = "1:1") -> DataFrame:
    """Equi-join that fails where a side that must be unique is not; ``validate`` is 1:1, m:1 or 1:m."""
    ones = validate.split(":")
    for side, frame, one in (("LEFT", left, ones[0]), ("RIGHT", right, ones[1])):
        if one == "1" and not repeated_keys(frame, keys).isEmpty():
            raise ValueError(f"JOIN_{side}_KEY_DUPLICATED:{','.join(keys)}")
    return left.join(right, keys, how)


def join_new_columns(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join only those columns of the right side that the left lacks."""
    return left.join(right.select(*keys, *[c for c in right.columns if c not in left.columns]), keys, how)


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> dict[str, int]:
    """How many distinct keys only one side has: both 0 where the sets are identical."""
    marked = left.select(*keys).distinct().withColumn("l", F.lit(1)).join(right.select(*keys).distinct().withColumn("r", F.lit(1)), keys, "full")
    row = marked.agg(F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only")).first()
    return row.asDict()


def exact_lag(frame: DataFrame, keys: list[str], time: str, lag: Column | int, values: list[str], suffix: str) -> DataFrame:
    """Values at exactly ``time - lag`` with the same keys, null where no such row exists (not the row before)."""
    then = frame.select(*keys, (F.col(time) + lag).alias(time), *[F.col(v).alias(v + suffix) for v in values])
    return frame.join(then, [*keys, time], "left")


def without_targets(frame: DataFrame, markers: tuple[str, ...] = ("target", "future", "loss")) -> DataFrame:
    """Fail where a predictor frame has a column that looks like an outcome."""
    leaks = [c for c in frame.columns if any(m in c.lower() for m in markers)]
    if leaks:
        raise ValueError(f"TARGET_COLUMN_IN_PREDICTORS:{','.join(leaks)}")
    return frame


def stripped(frame: DataFrame, markers: tuple[str, ...] = ("target", "future", "loss")) -> DataFrame:
    """A frame without the columns that look like outcomes."""
    return frame.drop(*[c for c in frame.columns if any(m in c.lower() for m in markers)])


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of frames whose keys are the same and unique; anything else is an error. Null keys meet nothing, so they are
    one too."""
    joined = checked_join(left, right, keys, "inner", "1:1")
    sizes = {"LEFT": left.count(), "RIGHT": right.count(), "JOINED": joined.count()}
    if len(set(sizes.values())) > 1:
        raise ValueError("JOIN_NOT_ONE_TO_ONE:" + ",".join(f"{k}={v}" for k, v in sizes.items()))
    return joined


def bound(predictors: DataFrame, panel: DataFrame, keys: list[str], needed: list[str], targets: list[str]) -> DataFrame:
    """``keys, needed, targets, status`` per predictor row: ``bound`` to the panel's row of the same keys, ``incomplete`` where a
    needed predictor is unknown, ``without_target`` where the panel has no such row. Repeated keys on either side are an error."""
    known = panel.select(*keys, *targets, F.lit(True).alias("_in"))
    met = checked_join(predictors.select(*keys, *needed), known, keys, "left", "1:1")
    missing = F.lit(False)
    for c in needed:
        missing = missing | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    status = F.when(missing, "incomplete").when(F.col("_in").isNull(), "without_target").otherwise("bound")
    return met.withColumn("status", status).drop("_in")
