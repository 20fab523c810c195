"""Bars, dense grids with causal fill, and origin grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import log_quotient
from . import windows


def bars(rows: DataFrame, keys: list[str], price: str, order: str) -> DataFrame:
    """Open, high, low, close and count per key, first and last by ``order``."""
    return rows.groupBy(*keys).agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").alias("volume"))


def dense(frame: DataFrame, keys: list[str], slot: str, low: int, high: int) -> DataFrame:
    """Every slot from low to high for every key, nulls where the frame has no row, and ``observed``. The
    slots are generated, not joined in, and the keys are the frame's own."""
    cells = frame.select(*keys).distinct().withColumn(slot, F.explode(F.sequence(F.lit(low), F.lit(high))))
    return cells.join(frame.withColumn("observed", F.lit(True)), [*keys, slot], "left").withColumn("observed", F.coalesce("observed", F.lit(False)))


def filled(grid: DataFrame, keys: list[str], slot: str) -> DataFrame:
    """Close carried forward, never back; empty slots have volume 0 and a range of no width."""
    over = W.partitionBy(*keys).orderBy(slot)
    out = grid.withColumn("close", windows.carried(F.col("close"), over)).withColumn("volume", F.coalesce("volume", F.lit(0)))
    return out.withColumn("high", F.coalesce("high", "close")).withColumn("low", F.coalesce("low", "close"))


def with_returns(grid: DataFrame, keys: list[str], slot: str) -> DataFrame:
    over = W.partitionBy(*keys).orderBy(slot)
    return grid.withColumn("r", log_quotient(F.col("close"), F.lag("close").over(over)))


def origins(sessions: DataFrame, slot: str, first: Column | int, last: Column | int, step: int = 1) -> DataFrame:
    """Forecast origins of each session: slots from first to last."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return sessions.withColumn(slot, F.explode(F.sequence(as_col(first), as_col(last), F.lit(step))))
