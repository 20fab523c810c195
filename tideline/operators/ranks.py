"""Exact ranks of groups of any size: no task sorts a group.

Rows are dealt by ranges of (key, order), with bounds that Spark draws from the data, and sorted within each range.
A row's place in its range is known there; what stands before its range is a sum of counts, one number for each
range that holds rows of the key. Place and sum give the rank.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import files

#: Bits of ``monotonically_increasing_id`` that count rows within a partition.
_ROW_BITS = 33
#: Rows that a range should hold.
RANGE_ROWS = 1_000_000


def _named(order: list[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _ranged(rows: DataFrame, keys: list[str], order: list[Column], parts: int) -> DataFrame:
    """Rows sorted within ranges, stored with ``_part`` and ``_at``, their place in the range."""
    by = [*map(F.col, keys), *order]
    at = F.monotonically_increasing_id()
    laid = files.stored(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_id", at), "ranges")
    return laid.withColumn("_part", F.shiftright("_id", _ROW_BITS)).withColumn("_at", F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1)).drop("_id")


def _same(left: DataFrame, names: list[str], prefix: str) -> Column:
    return reduce(and_, [left[n].eqNullSafe(F.col(f"{prefix}{n}")) for n in names])


def parts_for(rows: DataFrame) -> int:
    """Ranges for a frame: those of the session's shuffles, or more where it is larger than that many should hold."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE_ROWS + 1)


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column], number: str = "row", total: str | None = None, parts: int | None = None) -> DataFrame:
    """``rows`` with ``number``, 1, 2, 3 ... in the stated order within each key (null is a key), and, where named, the
    ``total`` of the key's rows. Rows that the order does not tell apart are numbered in any way. Without keys the
    whole frame is numbered."""
    laid = _ranged(rows, keys, _named(order), parts or parts_for(rows))
    held = laid.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    of_key = W.partitionBy(*(keys or [F.lit(0)]))  # one row for each range that a key reaches into
    before = F.coalesce(F.sum("_n").over(of_key.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumn("_before", before - F.col("_first")).withColumn("_total", F.sum("_n").over(of_key)).drop("_first", "_n")
    held = held.toDF(*[f"_of_{c}" for c in held.columns])
    out = laid.join(held, _same(laid, [*keys, "_part"], "_of_"))
    added = [(F.col("_of__before") + F.col("_at") + 1).cast("long").alias(number)] + ([F.col("_of__total").cast("long").alias(total)] if total else [])
    return out.select(*rows.columns, *added)


def counted(rows: DataFrame, keys: list[str], value: str, weight: str | None = None, parts: int | None = None) -> DataFrame:
    """``keys, value, n, before, total`` per distinct value of a key: how many rows (or how much ``weight``) have that
    value, smaller ones, and any. Null and NaN values are left out. Equal values are counted before they are dealt, so a
    frequent value is one row."""
    known = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = files.stored(known.groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("n")), "counts")
    laid = files.stored(counts.repartitionByRange(parts or parts_for(counts), *keys, value).withColumn("_part", F.spark_partition_id()), "counts")
    held = laid.groupBy(*keys, "_part").agg(F.sum("n").alias("_n"))
    of_key = W.partitionBy(*(keys or [F.lit(0)]))
    before = F.coalesce(F.sum("_n").over(of_key.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumn("_before", before).withColumn("_total", F.sum("_n").over(of_key)).drop("_n")
    held = held.toDF(*[f"_of_{c}" for c in held.columns])
    inside = F.sum("n").over(W.partitionBy(*keys, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    out = laid.withColumn("_inside", inside)
    out = out.join(held, _same(out, [*keys, "_part"], "_of_"))
    return out.select(*keys, value, "n", (F.col("_of__before") + F.col("_inside")).alias("before"), F.col("_of__total").alias("total"))


def average_ranks(rows: DataFrame, keys: list[str], value: str, parts: int | None = None) -> DataFrame:
    """``keys, value, n, rank, total`` per distinct value of a key; equal values share the mean of their ranks."""
    found = counted(rows, keys, value, parts=parts)
    return found.select(*keys, value, "n", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"), "total")


def with_rank(rows: DataFrame, keys: list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """``rows`` with the average rank of a value within its key; null where the value is unknown."""
    ranks = average_ranks(rows, keys, value, parts).select(*[F.col(k).alias(f"_of_{k}") for k in [*keys, value]], F.col("rank").alias(name))
    return rows.join(ranks, _same(rows, [*keys, value], "_of_"), "left").drop(*[f"_of_{k}" for k in [*keys, value]])


def tile(number: Column, total: Column, tiles: int) -> Column:
    """``ntile``: the first ``total % tiles`` tiles hold one row more than the others."""
    small, more = F.floor(total / tiles), total % tiles
    edge = more * (small + 1)
    at = number - 1
    in_large = F.floor(at / (small + 1))
    in_small = more + F.floor((at - edge) / F.greatest(small, F.lit(1)))
    return (F.when(at < edge, in_large).otherwise(in_small) + 1).cast("int")


def auc(rows: DataFrame, keys: list[str], score: str, label: str, parts: int | None = None) -> DataFrame:
    """``keys, p, q, auc``: area under the curve of a score for 0/1 labels, ties by half; only counts by distinct score
    are ranked."""
    known = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    ranks = average_ranks(known, keys, score, parts)
    own = known.groupBy(*keys, score).agg(F.sum(F.col(label)).alias("_p"))
    own = own.toDF(*[f"_of_{c}" for c in own.columns])
    met = ranks.join(own, _same(ranks, [*keys, score], "_of_"))
    sums = met.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("_of__p")).alias("_r"), F.sum("_of__p").alias("p"), (F.sum("n") - F.sum("_of__p")).alias("q"))
    area = F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("_r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q")))
    return sums.select(*keys, "p", "q", area.alias("auc"))
