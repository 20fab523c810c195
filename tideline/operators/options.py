"""Option-state measures: tenor, implied forward, Black-76, smiles, term structure, arbitrage counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import normal_cdf, normal_density

YEAR_DAYS = 365


def tenor_years(now_us: Column, expiry_us: Column) -> Column:
    return F.when(expiry_us > now_us, (expiry_us - now_us) / F.lit(YEAR_DAYS * 86_400 * 1e6))


def implied_forward(calls: DataFrame, puts: DataFrame, keys: list[str], strike: str, price: str, least: int = 3) -> DataFrame:
    """Forward and discount from the line of call minus put over the strikes both have: slope -D, intercept D * F."""
    pairs = calls.select(*keys, strike, F.col(price).alias("c")).join(puts.select(*keys, strike, F.col(price).alias("p")), [*keys, strike])
    y, x = F.col("c") - F.col("p"), F.col(strike).cast("double")
    line = pairs.groupBy(*keys).agg(F.count("*").alias("strikes"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    return line.where(F.col("strikes") >= least).select(*keys, "strikes", "slope", "intercept", F.when(F.col("slope") != 0, -F.col("intercept") / F.col("slope")).alias("forward"), (-F.col("slope")).alias("discount"))


def _d1(forward: Column, strike: Column, iv: Column, years: Column) -> Column:
    return (F.log(forward / strike) + iv * iv * years / 2) / (iv * F.sqrt(years))


def black_delta(forward: Column, strike: Column, iv: Column, years: Column, is_call: Column) -> Column:
    """Undiscounted delta, null outside its domain."""
    n = normal_cdf(_d1(forward, strike, iv, years))
    return F.when((forward > 0) & (strike > 0) & (iv > 0) & (years > 0), F.when(is_call, n).otherwise(n - 1))


def black_gamma(forward: Column, strike: Column, iv: Column, years: Column) -> Column:
    return F.when((forward > 0) & (strike > 0) & (iv > 0) & (years > 0), normal_density(_d1(forward, strike, iv, years)) / (forward * iv * F.sqrt(years)))


def black_price(forward: Column, strike: Column, iv: Column, years: Column, is_call: Column) -> Column:
    d1 = _d1(forward, strike, iv, years)
    d2 = d1 - iv * F.sqrt(years)
    call = forward * normal_cdf(d1) - strike * normal_cdf(d2)
    return F.when(is_call, call).otherwise(call - forward + strike)


def implied_volatility(price: Column, forward: Column, strike: Column, years: Column, is_call: Column, rounds: int = 100) -> Column:
    """Volatility by bisection in Arrow batches: a true iteration, which no built-in expression has. Null where
    the price lies outside its no-arbitrage bounds."""

    @F.pandas_udf("double")
    def solve(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        def cdf(x):
            t = 1 / (1 + 0.2316419 * np.abs(x))
            tail = np.exp(-x * x / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
            return np.where(x >= 0, 1 - tail, tail)

        for p, f, k, t, call in batches:
            p, f, k, t = (s.to_numpy(np.float64) for s in (p, f, k, t))
            call = call.to_numpy(bool)
            with np.errstate(all="ignore"):
                p = np.where(call, p, p + f - k)
                ok = (p > np.maximum(f - k, 0)) & (p < f) & (t > 0) & (k > 0)
                low, high = np.full(len(p), 1e-4), np.full(len(p), 5.0)
                for _ in range(rounds):
                    mid = (low + high) / 2
                    d1 = (np.log(f / k) + mid * mid * t / 2) / (mid * np.sqrt(t))
                    over = f * cdf(d1) - k * cdf(d1 - mid * np.sqrt(t)) > p
                    high, low = np.where(over, mid, high), np.where(over, low, mid)
            yield pd.Series(np.where(ok, (low + high) / 2, np.nan)).replace({np.nan: None}).astype("float64")

    return F.nullif(solve(price, forward, strike, years, is_call), F.lit(float("nan")))


def smile(rows: DataFrame, keys: list[str], x: Column, y: Column, least: int = 3) -> DataFrame:
    """Least-squares parabola per key from power sums: level, slope and curvature at x = 0."""
    s = rows.select(*keys, x.alias("x"), y.alias("y")).where("x is not null and y is not null").groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.sum(F.pow("x", F.lit(k))).alias(f"s{k}") for k in (1, 2, 3, 4)], *[F.sum(F.pow("x", F.lit(k)) * F.col("y")).alias(f"t{k}") for k in (0, 1, 2)])
    n, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    det = n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    level = t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)
    slope = n * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)
    curve = n * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)
    usable = (n >= least) & (F.abs(det) > 1e-9)
    return s.select(*keys, n.alias("points"), *[F.when(usable, v / det).alias(name) for v, name in ((level, "level"), (slope, "slope"), (curve, "curvature"))])


def interpolated(rows: DataFrame, keys: list[str], x: str, y: str, targets: list[float]) -> DataFrame:
    """Linear interpolation of y at each target, flat outside the known range."""
    at = rows.where(f"{x} is not null and {y} is not null").withColumn("target", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    below, above = F.when(F.col(x) <= F.col("target"), F.struct(x, y)), F.when(F.col(x) >= F.col("target"), F.struct(x, y))
    ends = at.groupBy(*keys, "target").agg(F.max(below).alias("lo"), F.min(above).alias("hi"))
    share = (F.col("target") - F.col(f"lo.{x}")) / (F.col(f"hi.{x}") - F.col(f"lo.{x}"))
    value = F.when(F.col("lo").isNull(), F.col(f"hi.{y}")).when(F.col("hi").isNull() | (F.col(f"lo.{x}") == F.col(f"hi.{x}")), F.col(f"lo.{y}")).otherwise(F.col(f"lo.{y}") + share * (F.col(f"hi.{y}") - F.col(f"lo.{y}")))
    return ends.select(*keys, "target", value.alias(y))


def butterflies(rows: DataFrame, keys: list[str], strike: str, price: str) -> DataFrame:
    """Neighbouring strike triples, and how many of them are not convex in price."""
    over = W.partitionBy(*keys).orderBy(strike)
    k0, k1, k2 = F.lag(strike).over(over), F.col(strike), F.lead(strike).over(over)
    p0, p1, p2 = F.lag(price).over(over), F.col(price), F.lead(price).over(over)
    bent = (p2 - p1) / (k2 - k1) - (p1 - p0) / (k1 - k0)
    return rows.withColumn("bent", bent).groupBy(*keys).agg(F.count("bent").alias("triples"), F.count_if(F.col("bent") < -1e-12).alias("violations"))


def calendar_violations(rows: DataFrame, keys: list[str], tenor: str, variance: str) -> DataFrame:
    """How often total variance falls with tenor."""
    fall = F.col(variance) < F.lag(variance).over(W.partitionBy(*keys).orderBy(tenor))
    return rows.withColumn("fall", fall).groupBy(*keys).agg(F.count("fall").alias("pairs"), F.count_if("fall").alias("violations"))


def model_free_variance(rows: DataFrame, keys: list[str], strike: str, price: str, years: str) -> DataFrame:
    """Two over the tenor times the sum of strike width / strike^2 * price."""
    over = W.partitionBy(*keys).orderBy(strike)
    width = (F.coalesce(F.lead(strike).over(over), F.col(strike)) - F.coalesce(F.lag(strike).over(over), F.col(strike))) / F.when(F.lead(strike).over(over).isNotNull() & F.lag(strike).over(over).isNotNull(), F.lit(2.0)).otherwise(F.lit(1.0))
    return rows.withColumn("_w", width).groupBy(*keys).agg((F.lit(2.0) / F.max(years) * F.sum(F.col("_w") / (F.col(strike) * F.col(strike)) * F.col(price))).alias("variance"))


def exposure(rows: DataFrame, keys: list[str], strike: str, amount: str, spot: Column) -> DataFrame:
    """Total exposure, and the strike of the largest absolute one: ties go to the nearest to spot, then the lower."""
    by = rows.groupBy(*keys, strike).agg(F.sum(amount).alias("e"), F.max(spot).alias("spot"))
    return by.groupBy(*keys).agg(F.sum("e").alias("total"), F.min_by(strike, F.struct(-F.abs("e"), F.abs(F.col(strike) - F.col("spot")), F.col(strike))).alias("peak_strike"))


def contract_grid(rows: DataFrame, keys: list[str], value: str, targets: list[float], tolerance: float, ties: list[str]) -> DataFrame:
    """Per key and target the nearest row within the tolerance, by distance and then the given ties."""
    near = rows.withColumn("target", F.explode(F.array(*[F.lit(float(t)) for t in targets]))).withColumn("distance", F.abs(F.col(value) - F.col("target"))).where(F.col("distance") <= tolerance)
    best = W.partitionBy(*keys, "target").orderBy("distance", *ties)
    return near.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def parity_line(rows: DataFrame, keys: list[str], strike: str, gap: Column) -> DataFrame:
    """The line of call minus put over the strikes of each key: slope, intercept, residual deviation, and the discount
    that the two outermost strikes imply. One aggregation."""
    pairs = rows.select(*keys, F.col(strike).cast("double").alias("_k"), gap.alias("_y")).where("_y is not null")
    line = pairs.groupBy(*keys).agg(
        F.count("*").alias("strikes"), F.regr_slope("_y", "_k").alias("slope"), F.regr_intercept("_y", "_k").alias("intercept"),
        F.regr_syy("_y", "_k").alias("syy"), F.regr_sxy("_y", "_k").alias("sxy"),
        ((F.min_by("_y", "_k") - F.max_by("_y", "_k")) / F.nullif(F.max("_k") - F.min("_k"), F.lit(0.0))).alias("endpoint"),
    )
    spread = F.sqrt(F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)) / F.col("strikes"))
    return line.select(*keys, "strikes", "slope", "intercept", spread.alias("residual_sd"), "endpoint")


def carry_gamma(spot: Column, strike: Column, iv: Column, years: Column, rate: Column, carry: Column) -> Column:
    """Gamma of an option on a spot with a cost of carry, null outside its domain."""
    d1 = (F.log(spot / strike) + (carry + iv * iv / 2) * years) / (iv * F.sqrt(years))
    gamma = F.exp((carry - rate) * years) * normal_density(d1) / (spot * iv * F.sqrt(years))
    return F.when((spot > 0) & (strike > 0) & (iv > 0) & (years > 0), gamma)
