"""Time windows over two clocks, counting windows, and window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def assigned(rows: DataFrame, clock: str, step: int, width: int, delay: int = 0, origin: str = "origin") -> DataFrame:
    """Each row once for every origin, a multiple of ``step``, whose window ``[origin - delay - width, origin - delay)``
    holds its clock. Rows multiply by width / step, never by the number of origins. Clocks are long."""
    first = (F.floor((F.col(clock) + delay) / step) + 1) * step
    return rows.withColumn(origin, F.explode(F.sequence(first, first + (width - step), F.lit(step).cast("long"))))


def two_clock(rows: DataFrame, executed: str, created: str, step: int, width: int, delay: int, origin: str = "origin") -> DataFrame:
    """``assigned`` by the clock of execution; of these, the rows that were known at ``origin - delay``."""
    return assigned(rows, executed, step, width, delay, origin).where(F.col(created) <= F.col(origin) - delay)


def forward(rows: DataFrame, clock: str, step: int, reach: int) -> DataFrame:
    """Each row with the first multiple of ``step`` strictly after its clock, and whether that lies within reach."""
    end = (F.floor(F.col(clock) / step) + 1) * step
    return rows.withColumn("window_end", end).withColumn("eligible", F.coalesce(end - F.col(clock) <= reach, F.lit(False)))


def tiled(rows: DataFrame, clock: str, step: int, first: Column) -> DataFrame:
    """Each row in the left-open window ``(end - step, end]`` that holds it; those before ``first`` go to it."""
    return rows.withColumn("window_end", F.greatest(F.ceil(F.col(clock) / step) * step, first))


def trailing_mean(value: Column, window: W, rows: int, lag: int = 1) -> Column:
    """Mean of the ``rows`` values that end ``lag`` rows before, null until there are as many."""
    frame = window.rowsBetween(-rows - lag + 1, -lag)
    return F.when(F.count(value).over(frame) == rows, F.avg(value).over(frame))


def carried(value: Column, window: W) -> Column:
    """The last known value so far; a leading gap stays null."""
    return F.last(value, ignorenulls=True).over(window.rowsBetween(W.unboundedPreceding, 0))


def gap_aware_sum(value: Column, window: W, low: int, high: int) -> Column:
    """Sum over a row frame, null where the frame is cut short or holds a gap."""
    frame = window.rowsBetween(low, high)
    return F.when(F.count(value).over(frame) == high - low + 1, F.sum(value).over(frame))


def drawdown(value: Column, window: W, running: str = "running") -> tuple[Column, Column]:
    """Expressions for the running sum, and (over that column) how far it lies below its maximum so far."""
    so_far = window.rowsBetween(W.unboundedPreceding, 0)
    return F.sum(value).over(so_far), F.col(running) - F.max(running).over(so_far)
