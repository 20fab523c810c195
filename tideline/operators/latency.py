"""Mergeable latency histograms and their quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bins in a factor of ten.
BINS_PER_DECADE = 200


def histogram(rows: DataFrame, group: list[str], seconds: str, floor: float = 1e-3, bins: int = BINS_PER_DECADE) -> DataFrame:
    """Counts by logarithmic bin; values at or below the floor go to bin 0. Histograms merge by adding counts."""
    bin_ = F.when(F.col(seconds) <= floor, 0).otherwise(F.floor(F.log10(F.col(seconds) / floor) * bins) + 1)
    return rows.where(F.col(seconds).isNotNull()).groupBy(*group, bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def merged(*histograms: DataFrame) -> DataFrame:
    out = histograms[0]
    for h in histograms[1:]:
        out = out.unionByName(h)
    return out.groupBy(*[c for c in out.columns if c != "n"]).agg(F.sum("n").alias("n"))


def quantiles(hist: DataFrame, group: list[str], qs: list[float], floor: float = 1e-3, bins: int = BINS_PER_DECADE) -> DataFrame:
    """Quantiles from bins, on a logarithmic scale within the bin that holds the rank."""
    key = group or [F.lit(1)]
    total = F.sum("n").over(W.partitionBy(*key))
    up_to = F.sum("n").over(W.partitionBy(*key).orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    ranked = hist.withColumn("total", total).withColumn("up_to", up_to).withColumn("q", F.explode(F.array(*map(F.lit, qs))))
    hit = ranked.where((F.col("up_to") >= F.col("q") * F.col("total")) & (F.col("up_to") - F.col("n") < F.col("q") * F.col("total")))
    inside = (F.col("q") * F.col("total") - (F.col("up_to") - F.col("n"))) / F.col("n")
    return hit.select(*group, "q", F.when(F.col("bin") == 0, F.lit(floor)).otherwise(F.lit(floor) * F.pow(F.lit(10.0), (F.col("bin") - 1 + inside) / bins)).alias("seconds"))


def cutoff(p95: float, floor: float, multiple: float) -> int:
    """Availability lag that a p95 calls for."""
    from math import ceil

    return max(int(floor), ceil(multiple * p95))


def at_thresholds(rows: DataFrame, group: list[str], seconds: str, thresholds: list[int]) -> DataFrame:
    """Share of rows at or below each threshold and how many lie above; counts merge by adding."""
    sums = [F.count_if(F.col(seconds) <= t).alias(f"le_{t}") for t in thresholds]
    return rows.groupBy(*group).agg(F.count(seconds).alias("n"), *sums)


def cutoff_column(p95, floor: int, multiple: float):
    """``cutoff`` as an expression over a column."""
    return F.greatest(F.lit(floor).cast("long"), F.ceil(F.lit(multiple) * p95).cast("long"))


def fixed_bins(rows: DataFrame, group: list[str], seconds: str, width: float) -> DataFrame:
    """Counts by bins of one width; they merge by adding."""
    bin_ = F.floor(F.col(seconds) / width)
    return rows.where(F.col(seconds).isNotNull()).groupBy(*group, bin_.alias("bin")).agg(F.count("*").alias("n"))


def lower_edges(hist: DataFrame, group: list[str], qs: list[float], width: float) -> DataFrame:
    """Per group and quantile the lower edge of the first bin at which the counts reach it, and the group's count."""
    part = W.partitionBy(*group)
    up_to = F.sum("n").over(part.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    ranked = hist.select(*group, "bin", up_to.alias("up_to"), F.sum("n").over(part).alias("n"))
    ranked = ranked.withColumn("q", F.explode(F.array(*map(F.lit, qs)))).where(F.col("up_to") >= F.col("q") * F.col("n"))
    return ranked.groupBy(*group, "q").agg((F.min("bin") * F.lit(width)).alias("seconds"), F.max("n").alias("n"))
