"""Condition of a design, and strategy economics."""

from __future__ import annotations

from math import sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def condition_number(gram: np.ndarray) -> float:
    """Of the standardised design, from its Gram matrix."""
    d = np.sqrt(np.diag(gram))
    values = np.linalg.eigvalsh(gram / np.outer(d, d))
    return sqrt(float(values[-1] / max(values[0], 1e-300)))


def strategy(rows: DataFrame, keys: list[str], order: str, signal: Column, outcome: Column, cost: float) -> DataFrame:
    """Positions from the sign of the signal before, their profit less the cost of turning over."""
    over = W.partitionBy(*keys).orderBy(order)
    out = rows.withColumn("position", F.coalesce(F.signum(F.lag(signal).over(over)), F.lit(0.0)))
    turn = F.abs(F.col("position") - F.coalesce(F.lag("position").over(over), F.lit(0.0)))
    return out.withColumn("turnover", turn).withColumn("pnl", F.col("position") * outcome - cost * F.col("turnover"))


def performance(pnl: DataFrame, by: list[str], order: str, periods: int = 252) -> DataFrame:
    """Mean, deviation, annualised Sharpe ratio, hit rate and turnover per group."""
    s = pnl.groupBy(*by).agg(F.count("pnl").alias("n"), F.avg("pnl").alias("mean"), F.stddev_samp("pnl").alias("sd"), F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("hit_rate"), F.sum("turnover").alias("turnover"))
    return s.withColumn("sharpe", F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * sqrt(periods)))


def hedged(rows: DataFrame, keys: list[str], order: str, price: str, spot: str, delta: str) -> DataFrame:
    """Each step's move of a claim, and of the spot times the delta held over it."""
    over = W.partitionBy(*keys).orderBy(order)
    move = lambda c: F.lead(c).over(over) - F.col(c)
    return rows.withColumn("option_move", move(price)).withColumn("hedge_move", F.col(delta) * move(spot))


def constrained(rows: DataFrame, at: list[str], wanted: str, each: float, all_: float) -> DataFrame:
    """Positions cut to a limit each, then scaled down where the sum of their sizes at a time is beyond another."""
    cut = F.greatest(F.lit(-each), F.least(F.lit(each), F.col(wanted)))
    rows = rows.withColumn("_cut", cut).withColumn("_gross", F.sum(F.abs("_cut")).over(W.partitionBy(*at)))
    position = F.when(F.col("_gross") > all_, F.col("_cut") * all_ / F.col("_gross")).otherwise(F.col("_cut"))
    return rows.withColumn("position", position).drop("_cut", "_gross")
