"""Sums over two-clock windows as differences of prefixes: no row is multiplied by the windows that hold it.

A row is in the window of an origin if it was known at ``origin - delay`` and happened at ``origin - delay - width`` or
later. So it enters at one origin and leaves at another, both multiples of ``step``. Its values are added where it enters
and taken away where it leaves; these changes are summed by origin first, and their running sum along a key is
the window's. A row that became known later than ``width`` after it happened is in no window.

Values should be whole numbers (millionths, say): then running sums are exact, and an empty window is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def spans(rows: DataFrame, executed: str, created: str, step: int, widths: dict[str, int], delay: int) -> DataFrame:
    """``rows`` with ``spans``: for each width whose windows hold the row, its label, the first origin that holds it and the
    first after it that does not. Clocks are long."""
    enter = F.ceil((F.col(created) + delay) / step) * step

    def of(label: str, width: int) -> Column:
        leave = (F.floor((F.col(executed) + delay + width) / step) + 1) * step
        held = (F.col(created) - F.col(executed) <= width) & (enter < leave)
        return F.when(held, F.struct(F.lit(label).alias("width"), enter.cast("long").alias("enter"), leave.cast("long").alias("leave")))

    return rows.withColumn("spans", F.filter(F.array(*[of(label, width) for label, width in widths.items()]), lambda s: s.isNotNull()))


def _changes(spanned: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Sums of what enters and leaves, by key, width and origin."""
    side = lambda at, sign: F.struct(F.col("_span.width").alias("width"), F.col(f"_span.{at}").alias("at"), F.lit(sign).alias("sign"))
    moves = spanned.withColumn("_span", F.explode("spans")).withColumn("_move", F.explode(F.array(side("enter", 1), side("leave", -1))))
    return moves.groupBy(*keys, F.col("_move.width").alias("width"), F.col("_move.at").alias("origin")).agg(*[F.sum(F.col(v) * F.col("_move.sign")).alias(v) for v in values])


def _running(changes: DataFrame, origins: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The running sum at each of the origins, which have ``keys, width, origin``; one row for each origin and change is
    sorted, whatever the number of rows behind it."""
    asked = origins.select(*keys, "width", "origin", *[F.lit(0).cast("long").alias(v) for v in values], F.lit(True).alias("_asked"))
    both = asked.unionByName(changes.withColumn("_asked", F.lit(False)))
    both = both.groupBy(*keys, "width", "origin").agg(*[F.sum(v).alias(v) for v in values], F.max("_asked").alias("_asked"))
    up = W.partitionBy(*keys, "width").orderBy("origin").rowsBetween(W.unboundedPreceding, 0)
    return both.select(*keys, "width", "origin", "_asked", *[F.sum(v).over(up).alias(v) for v in values]).where("_asked").drop("_asked")


def window_sums(spanned: DataFrame, origins: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``keys, width, origin`` and the sum of every value over that window; 0 where it is empty."""
    return _running(_changes(spanned, keys, values), origins, keys, values)


def window_distinct(spanned: DataFrame, origins: DataFrame, keys: list[str], items: list[str], name: str) -> DataFrame:
    """How many distinct items each window holds: spans of one item that touch are merged, and the merged ones counted in and
    out."""
    cells = spanned.select(*keys, *items, F.explode("spans").alias("s")).select(*keys, *items, "s.*").distinct()
    of_item = W.partitionBy(*keys, *items, "width").orderBy("enter", "leave")
    reach = F.max("leave").over(of_item.rowsBetween(W.unboundedPreceding, -1))
    apart = cells.withColumn("_new", F.coalesce((F.col("enter") > reach).cast("int"), F.lit(1)))
    apart = apart.withColumn("_island", F.sum("_new").over(of_item.rowsBetween(W.unboundedPreceding, 0)))
    merged = apart.groupBy(*keys, *items, "width", "_island").agg(F.min("enter").alias("enter"), F.max("leave").alias("leave"))
    moves = merged.select(*keys, "width", F.explode(F.array(F.struct(F.col("enter").alias("origin"), F.lit(1).alias("n")), F.struct(F.col("leave").alias("origin"), F.lit(-1).alias("n")))).alias("m"))
    changes = moves.groupBy(*keys, "width", "m.origin").agg(F.sum("m.n").alias(name))
    return _running(changes, origins, keys, [name])


def cells(spanned: DataFrame, keys: list[str], by: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates of the rows that enter and leave together (and agree in ``by``), one row for each origin that holds the
    cell. Cells are multiplied by width / step, rows are not; how many there are depends on the steps of a session."""
    one = spanned.withColumn("_span", F.explode("spans")).groupBy(*keys, *by, "_span.width", "_span.enter", "_span.leave").agg(*aggregates)
    return one


def at_origins(cells_: DataFrame, step: int) -> DataFrame:
    return cells_.withColumn("origin", F.explode(F.sequence("enter", F.col("leave") - step, F.lit(step).cast("long")))).drop("enter", "leave")


def weighted_quantile(counts: DataFrame, group: list[str], value: str, n: str, q: float, name: str) -> DataFrame:
    """Linear quantile of values with counts; a group's distinct values are sorted in one task."""
    of = W.partitionBy(*group)
    up = F.sum(n).over(of.orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    ranked = counts.withColumn("_up", up).withColumn("_at", F.lit(q) * (F.sum(n).over(of) - 1))
    low, high = F.floor("_at"), F.ceil("_at")
    holds = lambda rank: F.max(F.when((rank < F.col("_up")) & (rank >= F.col("_up") - F.col(n)), F.col(value)))
    found = ranked.groupBy(*group).agg(holds(low).alias("_low"), holds(high).alias("_high"), F.max(F.col("_at") - low).alias("_share"))
    return found.select(*group, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_share")).alias(name))


def decayed(spanned_rows: DataFrame, origins: DataFrame, keys: list[str], executed: str, created: str, start: str, step: int, delay: int, scale_us: int, name: str) -> DataFrame:
    """At each origin the sum of exp(-(origin - delay - executed) / scale) over all rows known by then: one running sum of
    exp((executed - start) / scale). ``start`` is a clock of the key, near its first row; a key may last some hundred scales."""
    enter = (F.ceil((F.col(created) + delay) / step) * step).cast("long")
    grown = F.exp((F.col(executed) - F.col(start)) / F.lit(float(scale_us)))
    changes = spanned_rows.groupBy(*keys, start, enter.alias("origin")).agg(F.sum(grown).alias("_w"))
    asked = origins.select(*keys, start, "origin", F.lit(0.0).alias("_w"), F.lit(True).alias("_asked"))
    both = asked.unionByName(changes.withColumn("_asked", F.lit(False)))
    both = both.groupBy(*keys, start, "origin").agg(F.sum("_w").alias("_w"), F.max("_asked").alias("_asked"))
    up = F.sum("_w").over(W.partitionBy(*keys).orderBy("origin").rowsBetween(W.unboundedPreceding, 0))
    faded = up * F.exp(-(F.col("origin") - delay - F.col(start)) / F.lit(float(scale_us)))
    return both.select(*keys, "origin", "_asked", faded.alias(name)).where("_asked").drop("_asked")
