"""Exact quantiles of groups of any size, under grouping sets too: no task holds a group's values.

The input is read once: equal values are counted, and these counts are stored. Cells that all groups share are summed first,
and a cell in which no group has a wanted rank stays one sum, so that grouping sets multiply little. A group of few counts is ranked
as it is. A larger one is cut into cells at bounds that a mergeable sketch of its distinct values gives; cells are
summed, and only those that hold a wanted rank are kept and cut again, until they are small.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import files

#: Distinct values that one task ranks, cells that a larger group is cut into, and nodes whose bounds are broadcast (some 10 MB).
SMALL, CELLS, BROADCAST_NODES = 100_000, 64, 20_000

#: Cells of each column that all groups share.
SHARED_CELLS = 1_024


def _met(left: DataFrame, right: DataFrame, names: list[str], few: bool) -> DataFrame:
    """``left`` with the other columns of ``right``, which has one row for each of ``names``; null is a name."""
    right = right.withColumnsRenamed({n: f"_of_{n}" for n in names})
    same = reduce(and_, [left[n].eqNullSafe(right[f"_of_{n}"]) for n in names])
    return left.join(F.broadcast(right) if few else right, same).drop(*[f"_of_{n}" for n in names])


def _targets(qs: list[float], total: Column) -> Column:
    """The ranks, from 0, that each quantile lies between, with their weights."""

    def of(q: float) -> Column:
        at = F.lit(float(q)) * (total - 1)
        low, share = F.floor(at), at - F.floor(at)
        return F.array(F.struct(F.lit(float(q)).alias("q"), low.alias("rank"), (1 - share).alias("weight")), F.struct(F.lit(float(q)).alias("q"), (low + 1).alias("rank"), share.alias("weight")))

    return F.filter(F.flatten(F.array(*map(of, qs))), lambda t: t["weight"] > 0)


def _inside(t: Column, start: Column, held: Column) -> Column:
    return (t["rank"] >= start) & (t["rank"] < start + held)


def _cut(open_: DataFrame, node: list[str], qs: list[float], cells: int) -> DataFrame:
    """The rows of those cells of every node that hold a wanted rank, each cell a node of its own."""
    shares = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    bounds = files.stored(open_.groupBy(*node).agg(F.percentile_approx("_v", shares, F.lit(100 * cells)).alias("_bounds")))
    few = bounds.count() <= BROADCAST_NODES
    cell = F.size(F.filter("_bounds", lambda b: b < F.col("_v")))
    placed = files.stored(_met(open_, bounds, node, few).withColumn("_cell", cell).drop("_bounds"))
    sums = placed.groupBy(*node, "_cell").agg(F.sum("_n").alias("_held"), F.count("*").alias("_rows_in"), F.min("_below").alias("_low"), F.min("_total").alias("_of"))
    before = F.coalesce(F.sum("_held").over(W.partitionBy(*node).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_start", F.col("_low") + before)
    wanted = sums.where(F.exists(_targets(qs, F.col("_of")), lambda t: _inside(t, F.col("_start"), F.col("_held")))).select(*node, "_cell", "_start", "_rows_in")
    kept = _met(placed, wanted, [*node, "_cell"], few)
    kept = kept.withColumns({"_below": F.col("_start"), "_rows": F.col("_rows_in"), "_node": F.xxhash64("_node", "_cell")})
    return files.stored(kept.select(open_.columns))


def _narrowed(counts: DataFrame, group: list[str], sets: list[list[str]], qs: list[float], cells: int) -> DataFrame:
    """The counts of those cells, shared by all groups, that hold a wanted rank of any group of any grouping set, and the sums of
    the other cells, each at its smallest value. Only the cells' bounds reach the driver."""
    shares = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    cell = F.lit(None).cast("int")
    placed = counts
    for i, (f, bounds) in enumerate(counts.groupBy("_f").agg(F.percentile_approx("_v", shares, F.lit(10 * cells))).collect()):
        splits = [float("-inf"), *(sorted({b for b in bounds if abs(b) != float("inf")}) or [0.0]), float("inf")]
        placed = Bucketizer(splits=splits, inputCol="_v", outputCol=f"_cell{i}").transform(placed)
        cell = F.when(F.col("_f") == f, F.col(f"_cell{i}").cast("int")).otherwise(cell)
    placed = placed.withColumn("_cell", cell).select(*group, "_f", "_v", "_n", "_cell")
    sums = files.stored(placed.groupBy(*group, "_f", "_cell").agg(F.min("_v").alias("_v"), F.sum("_n").alias("_n")))
    wholes = [[*map(F.col, s), F.col("_f"), F.col("_cell")] for s in sets]
    cubed = sums.groupingSets(wholes, *group, "_f", "_cell").agg(F.sum("_n").alias("_n"), F.grouping_id().alias("_set"))
    of_group = W.partitionBy(*group, "_set", "_f")
    start = F.sum("_n").over(of_group.orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    ranked = cubed.withColumns({"_start": start, "_total": F.sum("_n").over(of_group)})
    wanted = files.stored(ranked.where(F.exists(_targets(qs, F.col("_total")), lambda t: _inside(t, F.col("_start"), F.col("_n")))).select("_f", "_cell").distinct())
    wanted = F.broadcast(wanted)  # as many as there are cells at most
    columns = [*group, "_f", "_v", "_n"]
    return placed.join(wanted, ["_f", "_cell"], "left_semi").select(columns).unionByName(sums.join(wanted, ["_f", "_cell"], "left_anti").select(columns))


def exact(rows: DataFrame, group: list[str], value: str | dict[str, Column], qs: list[float], sets: list[list[str]] | None = None, cells: int = CELLS, small: int = SMALL, shared: int = SHARED_CELLS) -> DataFrame:
    """``group, q, quantile, n`` by linear interpolation between the two values whose ranks enclose ``q * (n - 1)``.

    ``value`` may name several columns; then ``_f`` tells them apart. With ``sets`` there is a row for each group of each
    grouping set, told apart by ``_set``, Spark's grouping id over ``group``. Nulls and NaN are left out; a group without any
    value has no row. ``n`` counts its values."""
    values = value if isinstance(value, dict) else {value: F.col(value)}
    listed = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), c.cast("double").alias("v")) for n, c in values.items()])).alias("_one")
    known = rows.select(*group, listed).select(*group, F.col("_one.f").alias("_f"), F.col("_one.v").alias("_v")).where("_v is not null and not isnan(_v)")
    counts = known.groupBy(*group, "_f", "_v").agg(F.count("*").alias("_n"))
    counts = files.stored(counts)
    if counts.count() > small:
        counts = files.stored(_narrowed(counts, group, [group] if sets is None else sets, qs, shared))
    if sets is not None:
        wholes = [[*map(F.col, s), F.col("_f"), F.col("_v")] for s in sets]
        cubed = counts.groupingSets(wholes, *group, "_f", "_v").agg(F.sum("_n").alias("_n"), F.shiftright(F.grouping_id(), 2).alias("_set"))
        counts, group = files.stored(cubed), [*group, "_set"]
    of_group = [*group, "_f"]
    sizes = counts.groupBy(*of_group).agg(F.count("*").alias("_rows"), F.sum("_n").alias("_total"))
    large = sizes.where(F.col("_rows") > small).count()
    if not large:
        done = counts.withColumns({"_below": F.lit(0).cast("long"), "_node": F.lit(0).cast("long"), "_total": F.sum("_n").over(W.partitionBy(*of_group))})
    else:
        sizes = files.stored(sizes)
        sized = _met(counts, sizes, of_group, sizes.count() <= BROADCAST_NODES).withColumns({"_below": F.lit(0).cast("long"), "_node": F.lit(0).cast("long")})
        done, open_ = sized.where(F.col("_rows") <= small), sized.where(F.col("_rows") > small)
        while not open_.isEmpty():
            kept = _cut(open_, [*of_group, "_node"], qs, cells)
            done = done.unionByName(kept.where(F.col("_rows") <= small))
            open_ = kept.where(F.col("_rows") > small)
    start = F.col("_below") + F.sum("_n").over(W.partitionBy(*of_group, "_node").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    hits = done.withColumn("_start", start).withColumn("_hit", F.explode(F.filter(_targets(qs, F.col("_total")), lambda t: _inside(t, F.col("_start"), F.col("_n")))))
    name = ["_f"] if isinstance(value, dict) else []
    return hits.groupBy(*of_group, F.col("_hit.q").alias("q")).agg(F.sum(F.col("_v") * F.col("_hit.weight")).alias("quantile"), F.max("_total").alias("n")).select(*group, *name, "q", "quantile", "n")


def wide(rows: DataFrame, group: list[str], names: dict[str, tuple[Column, float]], sets: list[list[str]] | None = None, count: str | None = None, cells: int = CELLS, small: int = SMALL) -> DataFrame:
    """One row per group (and grouping set, then with ``_set``) with a column for each named (value, quantile), null where
    a group has no such value, and the ``count`` of its rows, where named. A group needs a row with a value, or the count."""
    values: dict[str, Column] = {"rows": F.lit(1.0)} if count else {}
    of: dict[str, str] = {}
    for name, (column, _) in names.items():
        of[name] = next((v for v, c in values.items() if c is column), f"v{len(values)}")
        values[of[name]] = column
    long = exact(rows, group, values, sorted({q for _, q in names.values()}), sets, cells, small)
    keys = [*group, *(["_set"] if sets is not None else [])]
    pick = lambda name, q: F.max(F.when((F.col("_f") == of[name]) & (F.col("q") == float(q)), F.col("quantile"))).alias(name)
    rows_of = [F.max(F.when(F.col("_f") == "rows", F.col("n"))).alias(count)] if count else []
    return long.groupBy(*keys).agg(*rows_of, *[pick(name, q) for name, (_, q) in names.items()])
