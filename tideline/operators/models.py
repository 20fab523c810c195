"""Models as Spark jobs: Gram sums with a small solve, MLlib regressions, per-asset recursive filters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import files


def gram(rows: DataFrame, features: list[str], target: str, by: list[str] | None = None) -> DataFrame:
    """Sums of products of the features (with 1) and the target, per group: one aggregation, k * k numbers."""
    columns = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    y = F.col(target).cast("double")
    known = [F.col(c).isNotNull() for c in [*features, target]]
    for test in known:
        rows = rows.where(test)
    return rows.groupBy(*(by or [])).agg(*[F.sum(a * b).alias(f"x{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j], *[F.sum(a * y).alias(f"y{i}") for i, a in enumerate(columns)], F.count("*").alias("n"))


def solve(row: dict, features: int, ridge: float = 0.0) -> np.ndarray:
    """Coefficients, intercept first and not penalised, from one row of ``gram``."""
    k = features + 1
    x = np.array([[row[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    y = np.array([row[f"y{i}"] for i in range(k)], float)
    return np.linalg.solve(x + ridge * np.diag([0.0] + [1.0] * features), y)


def cross_fitted(rows: DataFrame, features: list[str], targets: list[str], fold: str, ridge: float) -> DataFrame:
    """Residuals of each target on the features, each fold predicted by a ridge fit to the others."""
    out = rows
    for target in targets:
        sums = {r[fold]: r.asDict() for r in gram(rows, features, target, [fold]).collect()}
        total = {k: sum(s[k] for s in sums.values()) for k in next(iter(sums.values())) if k != fold}
        predicted = F.lit(None).cast("double")
        for f, own in sums.items():
            b = solve({k: total[k] - own[k] for k in total}, len(features), ridge)
            line = F.lit(float(b[0]))
            for c, w in zip(features, b[1:], strict=True):
                line = line + F.lit(float(w)) * F.col(c)
            predicted = F.when(F.col(fold) == f, line).otherwise(predicted)
        out = out.withColumn(f"{target}_residual", F.col(target) - predicted)
    return out


def partial_effect(rows: DataFrame, y: str, d: str, cluster: str) -> DataFrame:
    """Slope of residual on residual with its cluster-robust error."""
    c = rows.groupBy(cluster).agg(F.sum(F.col(d) * F.col(y)).alias("dy"), F.sum(F.col(d) * F.col(d)).alias("dd"))
    s = c.agg(F.sum("dy").alias("sy"), F.sum("dd").alias("sd"), F.sum(F.col("dy") * F.col("dy")).alias("a"), F.sum(F.col("dy") * F.col("dd")).alias("b"), F.sum(F.col("dd") * F.col("dd")).alias("e"), F.count("*").alias("clusters"))
    theta = F.col("sy") / F.col("sd")
    # one parameter: the scale for n rows and g clusters is g / (g - 1) * (n - 1) / (n - 1)
    scale = F.col("clusters") / F.greatest(F.col("clusters") - 1, F.lit(1))
    se = F.sqrt(scale * F.greatest(F.col("a") - 2 * theta * F.col("b") + theta * theta * F.col("e"), F.lit(0.0))) / F.col("sd")
    return s.select(theta.alias("theta"), se.alias("se"), "clusters")


def fitted(train: DataFrame, features: list[str], target: str, kind: str = "ols", held_out: str | None = None):
    """An MLlib model with its assembler: ols, ridge, elastic, gamma, tweedie or boosted (squared loss; with
    ``held_out``, a column of flags, it stops when the flagged rows no longer gain)."""
    assembled = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    common = {"labelCol": target}
    model = {
        "ols": lambda: LinearRegression(**common), "ridge": lambda: LinearRegression(regParam=0.1, elasticNetParam=0.0, **common), "elastic": lambda: LinearRegression(regParam=0.1, elasticNetParam=0.5, **common),
        "gamma": lambda: GeneralizedLinearRegression(family="gamma", link="log", **common), "tweedie": lambda: GeneralizedLinearRegression(family="tweedie", variancePower=1.5, linkPower=0.0, **common),
        "boosted": lambda: GBTRegressor(maxIter=20, maxDepth=3, seed=1, **common, **({"validationIndicatorCol": held_out} if held_out else {})),
    }[kind]()
    from pyspark.ml import Pipeline

    return Pipeline(stages=[assembled, model]).fit(train)


def recurrence(rows: DataFrame, key: str, segment: str, order: str, factor: Column, term: Column, start: DataFrame, name: str) -> DataFrame:
    """``state = factor * state + term`` along each key's order; the column holds the state before each row, and
    ``<name>_after`` the one after it.

    A linear recurrence over a segment is one factor and one term, so this is a parallel scan: segments are
    reduced on their own, their reductions (a row each) are carried along the key, and each segment is then
    unrolled from its own start. No task holds more than a segment, or one number pair per segment of a key.
    ``start``: key and ``state``.
    """
    marked = rows.withColumn("_a", factor.cast("double")).withColumn("_b", term.cast("double"))
    kinds = {f.name: f.dataType.simpleString() for f in marked.schema}

    def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        a, b = 1.0, 0.0
        for x, y in zip(pdf["_a"].to_numpy(), pdf["_b"].to_numpy(), strict=True):
            a, b = a * x, b * x + y
        return pd.DataFrame({key: [pdf[key].iloc[0]], segment: [pdf[segment].iloc[0]], "_a": [a], "_b": [b]})

    def carried(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(segment)
        state, out = float(pdf["state"].iloc[0]), []
        for x, y in zip(pdf["_a"].to_numpy(), pdf["_b"].to_numpy(), strict=True):
            out.append(state)
            state = x * state + y
        return pdf[[key, segment]].assign(_start=out)

    def unrolled(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        state, out = float(pdf["_start"].iloc[0]), []
        for x, y in zip(pdf["_a"].to_numpy(), pdf["_b"].to_numpy(), strict=True):
            out.append(state)
            state = x * state + y
        return pdf.drop(columns=["_a", "_b", "_start"]).assign(**{name: out, f"{name}_after": [*out[1:], state]})

    parts = marked.select(key, segment, order, "_a", "_b").groupBy(key, segment).applyInPandas(reduced, f"`{key}` {kinds[key]}, `{segment}` {kinds[segment]}, _a double, _b double")
    starts = parts.join(start, key).groupBy(key).applyInPandas(carried, f"`{key}` {kinds[key]}, `{segment}` {kinds[segment]}, _start double")
    schema = T.StructType(list(rows.schema.fields)).add(name, "double").add(f"{name}_after", "double")
    return marked.join(starts, [key, segment]).select(*rows.columns, "_a", "_b", "_start").groupBy(key, segment).applyInPandas(unrolled, schema)


def _known(value: str) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))


def ewma(rows: DataFrame, key: str, segment: str, order: str, value: str, decay: float = 0.94, warm_up: int = 20) -> DataFrame:
    """Exponentially weighted variance ``h`` carried along each key's order, from its first square; rows without
    a value leave it as it is; null until ``warm_up`` values were seen."""
    rows = rows.select(key, segment, order, value)
    square = F.col(value) * F.col(value)
    known = _known(value)
    first = rows.where(known).groupBy(key).agg(F.min_by(square, F.struct(segment, order)).alias("state"))
    out = recurrence(rows, key, segment, order, F.when(known, decay).otherwise(1.0), F.when(known, (1 - decay) * square).otherwise(0.0), first, "h")
    counts = rows.groupBy(key, segment).agg(F.count_if(known).alias("_n"))
    before = counts.select(key, segment, F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy(segment).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    seen = F.col("_before") + F.count_if(known).over(W.partitionBy(key, segment).orderBy(order))
    return out.join(before, [key, segment]).withColumn("_seen", seen).select(key, segment, order, value, F.when(F.col("_seen") >= warm_up, F.col("h_after")).alias("h"))


def garch_filter(rows: DataFrame, key: str, segment: str, order: str, value: str, omega: float, alpha: float, beta: float) -> DataFrame:
    """Conditional variance ``h`` of a GARCH(1,1) with given parameters, before each row, from its long-run level; a
    row without a value counts as its expectation."""
    rows = rows.select(key, segment, order, value)
    known = _known(value)
    start = rows.select(key).distinct().withColumn("state", F.lit(omega / max(1e-12, 1 - alpha - beta)))
    factor = F.when(known, beta).otherwise(alpha + beta)
    term = F.lit(omega) + F.when(known, alpha * F.col(value) * F.col(value)).otherwise(0.0)
    return recurrence(rows, key, segment, order, factor, term, start, "h").drop("h_after")


def spline_basis(x: str, knots: list[float]) -> list[Column]:
    """Truncated cubic basis of a column."""
    return [F.pow(F.greatest(F.col(x) - F.lit(k), F.lit(0.0)), F.lit(3.0)).alias(f"{x}_k{i}") for i, k in enumerate(knots)]


def one_hot_pipeline(categories: list[str], numbers: list[str], target: str):
    """Indexing, one-hot coding and scaling before least squares, as one MLlib pipeline; unknown categories get a
    column of their own."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer

    index = StringIndexer(inputCols=categories, outputCols=[f"{c}_index" for c in categories], handleInvalid="keep")
    coded = OneHotEncoder(inputCols=[f"{c}_index" for c in categories], outputCols=[f"{c}_coded" for c in categories])
    gathered = VectorAssembler(inputCols=numbers, outputCol="numbers", handleInvalid="skip")
    scaled = StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True)
    both = VectorAssembler(inputCols=[*[f"{c}_coded" for c in categories], "scaled"], outputCol="features")
    return Pipeline(stages=[index, coded, gathered, scaled, both, LinearRegression(labelCol=target, solver="normal")])


def ranked_ridge(train: DataFrame, features: list[str], target: str, ridge: float, least: float = 1e-8) -> tuple[list[str], np.ndarray]:
    """Features, in order, that add rank to those before them on the training rows, and the ridge's coefficients
    (intercept first, not penalised). One aggregation gives all sums."""
    row = gram(train, features, target).first().asDict()
    k = len(features) + 1
    x = np.array([[row[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    d = np.sqrt(np.maximum(np.diag(x), 1e-300))
    unit, kept = x / np.outer(d, d), [0]
    for i in range(1, k):
        near = unit[np.ix_(kept, kept)]
        left = unit[i, i] - unit[i, kept] @ np.linalg.pinv(near) @ unit[kept, i]
        if left > least:
            kept.append(i)
    y = np.array([row[f"y{i}"] for i in kept], float)
    b = np.linalg.solve(x[np.ix_(kept, kept)] + ridge * np.diag([0.0] + [1.0] * (len(kept) - 1)), y)
    return [features[i - 1] for i in kept[1:]], b


def trend(rows: DataFrame, key: str, order: str, value: str, draws: int, ahead: int) -> DataFrame:
    """``key, slope, p, step, forecast``: least squares over a series' positions, its p-value under random signs of the centred
    series (a hash of draw and place), and what it says for the next places. Draws are rows; series have one row a session."""
    from . import resample

    of = W.partitionBy(key)
    placed = rows.withColumns({"_i": F.row_number().over(of.orderBy(order)) - 1, "_n": F.count("*").over(of), "_e": F.col(value) - F.avg(value).over(of)})
    placed = placed.withColumn("_x", F.col("_i") - (F.col("_n") - 1) / 2)
    line = placed.groupBy(key).agg(F.avg(value).alias("_level"), F.try_divide(F.sum(F.col("_x") * F.col(value)), F.sum(F.col("_x") * F.col("_x"))).alias("slope"), F.sum(F.col("_x") * F.col("_x")).alias("_xx"), F.max("_n").alias("_n"))
    sign = F.when(resample.number("trend", F.col("draw"), F.col("_i")) % 2 == 0, 1.0).otherwise(-1.0)
    drawn = placed.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).groupBy(key, "draw").agg(F.abs(F.sum(sign * F.col("_e") * F.col("_x"))).alias("_s"))
    p = drawn.join(line, key).groupBy(key).agg(((F.count_if(F.try_divide("_s", "_xx") >= F.abs("slope")) + 1) / F.lit(draws + 1.0)).alias("p"))
    steps = line.join(p, key).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(ahead))))
    at = F.col("_n") - 1 + F.col("step") - (F.col("_n") - 1) / 2
    return steps.select(key, "slope", "p", "step", (F.col("_level") + F.col("slope") * at).alias("forecast"))


def garch_fit(rows: DataFrame, key: str, segment: str, order: str, value: str, closer: int = 6) -> DataFrame:
    """``key, omega, alpha, beta, n``: a GARCH(1,1) by quasi maximum likelihood, over all rows of each key. The long-run variance is
    that of the series, so two parameters are sought: a grid, drawn ``closer`` by half about its best point.

    For each pair the variance is a linear recurrence: segments are reduced for all pairs at once, their reductions carried
    along the key (an array a segment), and each segment's likelihood summed up from its own start. No task holds more than a
    segment, or a key's segments."""
    known = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    mean = known.groupBy(key).agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_level"), F.count("*").alias("n"))
    squares = files.stored(known.join(mean, key).select(key, segment, order, F.pow(F.col(value) - F.col("_m"), 2).alias("_x"), "_level", "n"))
    kinds = {f.name: f.dataType.simpleString() for f in squares.schema}
    grid = {None: np.array([(a, b) for a in np.linspace(0.01, 0.4, 6) for b in np.linspace(0.0, 0.97, 8)])}
    step, best = np.array([0.078, 0.1386]) / 2, {}
    head = f"`{key}` {kinds[key]}"

    def pairs_of(name, grid):
        return grid.get(name, grid.get(None))

    def passes(grid: dict):
        def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b = pairs_of(pdf[key].iloc[0], grid).T
            level, total = pdf["_level"].iloc[0], np.zeros(len(a))
            for x in pdf.sort_values(order)["_x"].to_numpy():
                total = b * total + level * (1 - a - b) + a * x
            return pd.DataFrame({key: [pdf[key].iloc[0]], segment: [pdf[segment].iloc[0]], "_f": [(b ** len(pdf)).tolist()], "_t": [total.tolist()], "_level": [level]})

        def carried(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(segment)
            state, out = np.full(len(pairs_of(pdf[key].iloc[0], grid)), pdf["_level"].iloc[0]), []
            for f, t in zip(pdf["_f"], pdf["_t"], strict=True):
                out.append(state.tolist())
                state = np.asarray(f) * state + np.asarray(t)
            return pdf[[key, segment]].assign(_start=out)

        def judged(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b = pairs_of(pdf[key].iloc[0], grid).T
            level, h, cost = pdf["_level"].iloc[0], np.array(pdf["_start"].iloc[0]), np.zeros(len(a))
            for x in pdf.sort_values(order)["_x"].to_numpy():
                cost += np.log(h) + x / h
                h = np.maximum(level * (1 - a - b) + a * x + b * h, 1e-12)
            return pd.DataFrame({key: pdf[key].iloc[0], "at": np.arange(len(a)), "cost": np.where((a >= 0) & (b >= 0) & (a + b < 0.999), cost, np.inf)})

        return reduced, carried, judged

    for _ in range(closer):
        reduced, carried, judged = passes(grid)
        parts = squares.groupBy(key, segment).applyInPandas(reduced, f"{head}, `{segment}` {kinds[segment]}, _f array<double>, _t array<double>, _level double")
        starts = parts.groupBy(key).applyInPandas(carried, f"{head}, `{segment}` {kinds[segment]}, _start array<double>")
        costs = squares.join(starts, [key, segment]).groupBy(key, segment).applyInPandas(judged, f"{head}, at int, cost double").groupBy(key, "at").agg(F.sum("cost").alias("cost"))
        for r in costs.groupBy(key).agg(F.min_by("at", F.struct("cost", "at")).alias("at")).collect():  # a row a key
            best[r[key]] = pairs_of(r[key], grid)[r["at"]]
        grid = {name: np.clip(point + step * np.array([(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]), 0.0, 0.998) for name, point in best.items()}
        step = step / 2
    found = rows.sparkSession.createDataFrame([(name, float(a), float(b)) for name, (a, b) in best.items()], f"{head}, alpha double, beta double")
    about = squares.groupBy(key).agg(F.max("_level").alias("_level"), F.max("n").alias("n"))
    return about.join(F.broadcast(found), key).select(key, (F.col("_level") * (1 - F.col("alpha") - F.col("beta"))).alias("omega"), "alpha", "beta", "n")
