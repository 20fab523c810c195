"""Concentration, entropy, burstiness and signed flow of a tape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def concentration(rows: DataFrame, group: list[str], item: str, weight: Column) -> DataFrame:
    """Herfindahl index, its normalised form, normalised entropy, top share and count of items per group: two
    aggregations, the first by group and item, so that no hot group meets in one task before it is summed."""
    shares = rows.groupBy(*group, item).agg(F.sum(weight).alias("w"))
    # sum p^2 = sum w^2 / (sum w)^2, and the entropy likewise: no join of the totals back to the items
    sums = shares.where("w > 0").groupBy(*group).agg(F.sum("w").alias("t"), F.sum(F.col("w") * F.col("w")).alias("s"), F.sum(F.col("w") * F.log("w")).alias("l"), F.max("w").alias("m"), F.count("*").alias("items"))
    h = F.col("s") / (F.col("t") * F.col("t"))
    n = F.col("items")
    entropy = F.log("t") - F.col("l") / F.col("t")
    return sums.select(*group, "items", h.alias("herfindahl"), F.when(n > 1, (h - 1 / n) / (1 - 1 / n)).alias("herfindahl_norm"), F.when(n > 1, entropy / F.log(n)).alias("entropy_norm"), (F.col("m") / F.col("t")).alias("top_share"))


def burstiness(rows: DataFrame, group: list[str], clock: str, order: str) -> DataFrame:
    """Count, rate, coefficient of variation and median of the gaps between neighbouring rows."""
    gap = (F.col(clock) - F.lag(clock).over(W.partitionBy(*group).orderBy(clock, order))) / F.lit(1e6)
    gaps = rows.withColumn("gap", gap).groupBy(*group).agg(F.count("*").alias("n"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("sd"), F.median("gap").alias("median_gap"))
    return gaps.select(*group, "n", F.when(F.col("mean_gap") > 0, F.col("sd") / F.col("mean_gap")).alias("gap_cv"), "median_gap")


def repeats(rows: DataFrame, group: list[str], item: str, weight: str) -> DataFrame:
    """Items of a group with more than one row: how many, and their weight."""
    counted = rows.groupBy(*group, item).agg(F.count("*").alias("n"), F.sum(weight).alias("w")).where("n > 1")
    return counted.groupBy(*group).agg(F.count("*").alias("repeated"), F.sum("w").alias("repeated_weight"))


def decayed(origins: DataFrame, rows: DataFrame, on: list[str], cutoff: str, clock: str, half_life_us: int, reach: int) -> DataFrame:
    """Sum of exp(-age / scale) over the rows known at each origin, as far back as ``reach``."""
    from . import asof

    near = asof.within(origins, rows, on, cutoff, clock, reach)
    return near.groupBy(*origins.columns).agg(F.sum(F.exp((F.col(clock) - F.col(cutoff)) / F.lit(float(half_life_us)))).alias("activity"))


def previous_in_contract(rows: DataFrame, contract: list[str], order: str, value: str) -> DataFrame:
    """Relative change from the row before of the same contract, and whether there is one."""
    before = F.lag(value).over(W.partitionBy(*contract).orderBy(order))
    return rows.withColumn("has_previous", before.isNotNull()).withColumn("relative_change", F.when(before != 0, F.col(value) / before - 1))


def clipped_increments(rows: DataFrame, keys: list[str], order: str, running: str, size: str) -> DataFrame:
    """Increments of a running total, between 0 and the row's own size."""
    step = F.col(running) - F.coalesce(F.lag(running).over(W.partitionBy(*keys).orderBy(order)), F.lit(0))
    return rows.withColumn("increment", F.least(F.greatest(step, F.lit(0)), F.col(size)))


def tail(rows: DataFrame, group: list[str], order: list[str], n: int, value: str) -> DataFrame:
    """The last n values of each group in order: a bounded array per group."""
    ranked = rows.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(*[F.desc(o) for o in order]))).where(F.col("_n") <= n)
    return ranked.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("_n"), value))), lambda x: x[value]).alias(value))


def direction(tags: Column) -> Column:
    """Side of a trade from its tags: 1 at the ask, -1 at the bid, 0 otherwise and for legs of a combined trade."""
    side = F.when(F.contains(tags, F.lit("ask_side")), 1).when(F.contains(tags, F.lit("bid_side")), -1).otherwise(0)
    return F.when(F.contains(tags, F.lit("multi_leg")), 0).otherwise(side)
