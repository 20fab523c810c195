"""As-of snapshots: the latest row that was known at a cutoff, with a total order for ties.

Two forms. With many origins and one series per key, origins and rows are merged into one ordered stream and
the last row before each origin is carried down: one shuffle, no row multiplied. With a bounded look-back, rows
are dealt into time buckets and each origin looks at its own and the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Origins that are broadcast, and parts that a time bucket's rows are dealt into where no key parts them.
FEW, SALTS = 100_000, 64


def latest(origins: DataFrame, rows: DataFrame, keys: list[str], cutoff: str, clock: str, order: list[str], values: list[str], inclusive: bool = True, oldest: str | None = None, bucket: int | None = None) -> DataFrame:
    """Each origin with the values of the last row of its keys whose ``clock`` is at or before (``inclusive``) or
    strictly before ``cutoff``; ``order`` breaks ties, last wins. With ``oldest``, a column of the origins, a
    row before it counts as none: the latest is chosen first and then judged, there is no walking back.

    With ``bucket``, a length in units of long clocks, keys of any weight are parted by time: each bucket is ordered
    on its own, and only its last row (one row per key and bucket) is carried on to those after it."""
    kept = F.struct(F.col(clock).alias("asof_clock"), *[F.col(v).alias(v) for v in values])
    right = rows.where(F.col(clock).isNotNull()).select(*keys, F.col(clock).alias("_t"), F.lit(1).alias("_side"), F.struct(*order).alias("_o"), kept.alias("_row"), F.lit(None).cast(origins.schema.simpleString()).alias("_origin"))
    left = origins.select(*keys, F.col(cutoff).alias("_t"), F.lit(2 if inclusive else 0).alias("_side"), F.lit(None).cast(right.schema["_o"].dataType).alias("_o"), F.lit(None).cast(right.schema["_row"].dataType).alias("_row"), F.struct(*origins.columns).alias("_origin"))
    merged = right.unionByName(left)
    part = [*keys]
    if bucket is not None:
        merged = merged.withColumn("_bucket", F.floor(F.col("_t") / bucket))
        part.append("_bucket")
    stream = W.partitionBy(*part).orderBy("_t", "_side", "_o").rowsBetween(W.unboundedPreceding, 0)
    found = merged.withColumn("_last", F.last("_row", ignorenulls=True).over(stream)).where(F.col("_origin").isNotNull())
    if bucket is not None:
        ends = merged.groupBy(*part).agg(F.max_by("_row", F.when(F.col("_row").isNotNull(), F.struct("_t", "_o"))).alias("_end"))
        before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
        carried = ends.select(*part, F.last("_end", ignorenulls=True).over(before).alias("_carried"))
        same = [F.col(f"f.{k}").eqNullSafe(F.col(f"c.{k}")) for k in part]
        found = found.alias("f").join(carried.alias("c"), same, "left").select("f._origin", F.coalesce("f._last", "c._carried").alias("_last"))
    found = found.select("_origin.*", "_last")
    if oldest is not None:
        found = found.withColumn("_last", F.when(F.col("_last.asof_clock") >= F.col(oldest), F.col("_last")))
    return found.select(*origins.columns, "_last.*")


def latest_within(origins: DataFrame, rows: DataFrame, keys: list[str], origin_keys: list[str], cutoff: str, clock: str, order: list[str], look_back: int) -> DataFrame:
    """For each origin, the last row of every value of ``keys`` with ``clock`` in ``[cutoff - look_back, cutoff]``,
    both ends included. Clocks are long numbers; ``origin_keys`` must agree between both sides."""
    near = within(origins, rows, origin_keys, cutoff, clock, look_back)
    of = [*origins.columns, *[k for k in keys if k not in origins.columns]]
    rest = [c for c in near.columns if c not in of]
    last = near.groupBy(*of).agg(F.max_by(F.struct(*rest), F.struct(clock, *order)).alias("_last"))
    return last.select(*of, "_last.*").select(*near.columns)


def within(origins: DataFrame, rows: DataFrame, on: list[str], cutoff: str, clock: str, look_back: int) -> DataFrame:
    """Origins joined with the rows in ``[cutoff - look_back, cutoff]``: an equi-join on time buckets as long as
    the look-back, so that each row meets the origins of two buckets only. Few origins are broadcast; many that share no
    key with the rows would leave the bucket alone to deal by, so these rows are salted."""
    left = origins.withColumn("_b", F.explode(F.array(F.floor(F.col(cutoff) / look_back), F.floor(F.col(cutoff) / look_back) - 1)))
    right = rows.withColumn("_b", F.floor(F.col(clock) / look_back))
    if origins.count() <= FEW:
        met = F.broadcast(left).join(right, [*on, "_b"])
    elif on:
        met = left.join(right, [*on, "_b"])
    else:
        salted = right.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
        met = left.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).join(salted, ["_b", "_salt"]).drop("_salt")
    met = met.where((F.col(clock) <= F.col(cutoff)) & (F.col(clock) >= F.col(cutoff) - look_back)).drop("_b")
    return met.select(*origins.columns, *[c for c in met.columns if c not in origins.columns])


def gated(value: Column, available: Column, origin: Column, fallback: Column) -> Column:
    """A value where it was available at the origin, else the fallback."""
    return F.when(available <= origin, value).otherwise(fallback)
