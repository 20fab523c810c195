"""Robust prior-history normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def session_index(frame: DataFrame, session: str) -> DataFrame:
    """Sessions numbered from 1: ranked on the distinct sessions, then joined, never over all rows."""
    sessions = frame.select(session).distinct()
    return frame.join(sessions.withColumn("session_no", F.dense_rank().over(W.orderBy(session)).cast("long")), session)


def robust_prior(frame: DataFrame, keys: list[str], session: str, value: str, look_back: int = 60, least: int = 20) -> DataFrame:
    """z-score of each value against the values of the ``look_back`` sessions strictly before, same keys: median
    and 1.4826 * MAD, else the interquartile range / 1.349, null where fewer than ``least`` values or no scale.

    Values meet once per key and session; a range window over the sessions of a key then gathers them, so
    nothing is multiplied before the shuffle.
    """
    own = session_index(frame, session)
    daily = own.groupBy(*keys, "session_no").agg(F.collect_list(value).alias("_v"))
    before = W.partitionBy(*keys).orderBy("session_no").rangeBetween(-look_back, -1)
    history = daily.select(*keys, "session_no", F.sort_array(F.flatten(F.collect_list("_v").over(before))).alias("_h")).withColumn("prior_n", F.size("_h").cast("long"))

    def quantile(array, q):
        place = (F.size(array) - 1) * F.lit(q)
        low = F.floor(place).cast("int")
        at = lambda i: F.get(array, i)
        return at(low) + (at(F.ceil(place).cast("int")) - at(low)) * (place - low)

    history = history.where(F.col("prior_n") >= least).withColumn("_m", quantile(F.col("_h"), 0.5))
    history = history.withColumn("_mad", quantile(F.sort_array(F.transform("_h", lambda x: F.abs(x - F.col("_m")))), 0.5)).withColumn("_iqr", quantile(F.col("_h"), 0.75) - quantile(F.col("_h"), 0.25))
    scale = F.when(F.col("_mad") > 0, F.lit(1.4826) * F.col("_mad")).when(F.col("_iqr") > 0, F.col("_iqr") / 1.349)
    history = history.select(*keys, "session_no", "prior_n", F.col("_m").alias("prior_median"), scale.alias("prior_scale"))
    return own.join(history, [*keys, "session_no"], "left").withColumn("z", (F.col(value) - F.col("prior_median")) / F.col("prior_scale"))


def top_mean(scores: list[str], n: int = 3):
    """Median of the n largest positive scores of a row; null where none is positive."""
    positive = F.filter(F.array(*scores), lambda x: x > 0)
    top = F.slice(F.sort_array(positive, asc=False), 1, n)
    size = F.size(top)
    return F.when(size > 0, (F.get(F.sort_array(top), F.floor((size - 1) / 2).cast("int")) + F.get(F.sort_array(top), F.floor(size / 2).cast("int"))) / 2)


def cutpoints(train: DataFrame, value: str, parts: int = 3) -> list[float]:
    """Cut points between equal parts of the training rows: a handful of numbers."""
    row = train.agg(*[F.percentile(value, F.lit(k / parts)).alias(f"q{k}") for k in range(1, parts)]).first()
    return list(row)


def stratum(value: str, points: list[float]):
    """Which part a value falls in, from 0."""
    out = F.lit(len(points))
    for k in range(len(points) - 1, -1, -1):
        out = F.when(F.col(value) <= points[k], k).otherwise(out)
    return F.when(F.col(value).isNotNull(), out)
