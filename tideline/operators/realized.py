"""Realized measures of returns on a dense grid, before and after each origin."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import log_quotient
from . import windows


def forward(grid: DataFrame, keys: list[str], slot: str, horizon: int) -> DataFrame:
    """Variance, bipower, jump, continuous part, quarticity and semivariances of the next ``horizon`` returns;
    null where the horizon is cut short."""
    over = W.partitionBy(*keys).orderBy(slot)
    r = F.col("r")
    ahead = lambda x: windows.gap_aware_sum(x, over, 1, horizon)
    pair = F.abs(r) * F.abs(F.lag("r").over(over))
    out = grid.withColumn("_pair", pair)
    # the products inside the horizon: one fewer than its returns
    bipower = F.lit(pi / 2) * (windows.gap_aware_sum(F.col("_pair"), over, 2, horizon) if horizon > 1 else F.lit(0.0))
    out = out.withColumn("rv", ahead(r * r)).withColumn("bv", F.when(F.col("rv").isNotNull(), bipower))
    out = out.withColumn("rq", F.lit(horizon / 3) * ahead(r * r * r * r)).withColumn("rs_pos", ahead(F.when(r > 0, r * r).when(r.isNotNull(), 0.0))).withColumn("rs_neg", ahead(F.when(r < 0, r * r).when(r.isNotNull(), 0.0)))
    return out.withColumn("jump", F.greatest(F.col("rv") - F.col("bv"), F.lit(0.0))).withColumn("continuous", F.col("rv") - F.col("jump")).drop("_pair")


def backward(value: Column, keys: list[str], slot: str, length: int) -> Column:
    """Sum of squares of the ``length`` values that end at the row."""
    return windows.gap_aware_sum(value * value, W.partitionBy(*keys).orderBy(slot), -length + 1, 0)


def parkinson(high: Column, low: Column, over: W, length: int) -> Column:
    """Range variance over the ``length`` bars that end at the row."""
    ratio = log_quotient(high, low)
    return windows.gap_aware_sum(ratio * ratio, over, -length + 1, 0) / F.lit(4 * log(2) * length)


def relative_noise(rv: Column, rq: Column, horizon: int) -> Column:
    return F.when(rv > 0, F.sqrt(F.lit(2.0) * rq / horizon) / rv)


def first_order_corrected(r: Column, over: W, length: int) -> Column:
    """Variance of trailing returns plus twice their neighbouring products, not below zero."""
    return F.greatest(windows.gap_aware_sum(r * r, over, -length + 1, 0) + 2 * windows.gap_aware_sum(r * F.lag(r).over(over), over, -length + 2, 0), F.lit(0.0))


def har(sessions: DataFrame, key: str, session: str, rv: str, week: int = 5) -> DataFrame:
    """Variance of the session before, and its mean over the ``week`` before, null until there are as many."""
    over = W.partitionBy(key).orderBy(session)
    return sessions.withColumn("rv_day", F.lag(rv).over(over)).withColumn("rv_week", windows.trailing_mean(F.col(rv), over, week))


def seasonality(train: DataFrame, bucket: str, value: str) -> DataFrame:
    """Mean by bucket over the training rows, centred on the mean of buckets."""
    means = train.groupBy(bucket).agg(F.avg(value).alias("m"))
    centre = means.agg(F.avg("m").alias("c"))
    return means.crossJoin(F.broadcast(centre)).select(bucket, (F.col("m") - F.col("c")).alias("seasonal"))


def targets(grid: DataFrame, keys: list[str], slot: str, horizons: tuple[int, ...]) -> DataFrame:
    """``horizon, status, target`` per row and horizon: the variance of the next h returns, where the anchor and all h
    closes after it were observed. Rows multiply by the number of horizons, after one sort."""
    over = W.partitionBy(*keys).orderBy(slot)
    cells = []
    for h in horizons:
        ahead = over.rowsBetween(1, h)
        seen, rows = F.count_if("observed").over(ahead), F.count("*").over(ahead)
        status = F.when(rows < h, "HORIZON_CUT").when(~F.col("observed"), "ANCHOR_MISSING").when(seen < h, "FUTURE_MISSING").otherwise("OK")
        value = F.when(F.col("observed") & (seen == h), F.sum(F.col("r") * F.col("r")).over(ahead))
        cells.append((h, status, value))
    wide = grid.select(*keys, slot, *[c for h, status, value in cells for c in (status.alias(f"s{h}"), value.alias(f"t{h}"))])
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"s{h}").alias("status"), F.col(f"t{h}").alias("target")) for h in horizons])
    return wide.select(*keys, slot, F.explode(each).alias("x")).select(*keys, slot, "x.*")


def harq(grid: DataFrame, key: str, session: str, r: str, least: int, week: int = 5, month: int = 22) -> DataFrame:
    """Session variances, their day, week and month before, and the day's times the root of its quarticity; sessions
    of fewer than ``least`` returns count as missing. ``reason`` is the first that is missing."""
    x, n = F.col(r), F.count(r)
    s = grid.groupBy(key, session).agg(n.alias("_n"), F.sum(x * x).alias("rv"), (n / F.lit(3.0) * F.sum(x * x * x * x)).alias("rq"))
    s = s.select(key, session, *[F.when(F.col("_n") >= least, F.col(c)).alias(c) for c in ("rv", "rq")])
    over = W.partitionBy(key).orderBy(session)
    mean = lambda k: windows.trailing_mean(F.col("rv"), over, k)
    out = s.withColumns({"rv_day": F.lag("rv").over(over), "rq_day": F.lag("rq").over(over), "rv_week": mean(week), "rv_month": mean(month)})
    gaps = [(F.col(f"rv_{c}").isNull(), f"{c.upper()}_MISSING") for c in ("day", "week", "month")]
    reason = F.when(*gaps[0]).when(*gaps[1]).when(*gaps[2])
    return out.withColumn("rv_day_attenuated", F.sqrt("rq_day") * F.col("rv_day")).withColumn("reason", reason)
