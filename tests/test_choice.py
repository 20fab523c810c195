"""Tests over session series and models, against plain loops and both directions."""

from __future__ import annotations

from itertools import combinations
from math import isclose

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import models, selection
from tideline.operators import resample as rs
from tideline.plans import catalogue, evaluation


def gains_of(spark, matrix, draws=299):
    """Mean gains by model, and those of every draw of blocks."""
    rows = spark.createDataFrame([(i, f"m{j}", float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row)], "i long, model string, x double").cache()
    drawn = rs.taken(rs.blocks(spark, len(matrix), draws, 5, "t"), rows).groupBy("draw", "model").agg(F.avg("x").alias("x")).cache()
    return rows.groupBy("model").agg(F.avg("x").alias("mean")).cache(), drawn


def test_overfitting_is_the_plain_loop(spark):
    rng = np.random.default_rng(1)
    for losses, parts in ((rng.normal(size=(60, 4)), 6), (rng.normal(size=(60, 4)) + [0, 0, -9, 0], 8)):
        blocks = np.array_split(np.arange(len(losses)), parts)
        bad = total = 0
        for chosen in combinations(range(parts), parts // 2):
            inside = np.concatenate([blocks[i] for i in chosen])
            outside = np.concatenate([blocks[i] for i in range(parts) if i not in chosen])
            best, other = int(losses[inside].mean(0).argmin()), losses[outside].mean(0)
            worse, same = sum(x > other[best] for x in other), sum(x == other[best] for x in other)
            bad += (worse + (same + 1) / 2) / (losses.shape[1] + 1) <= 0.5
            total += 1
        sums = spark.createDataFrame([(p, f"m{j}", float(losses[b, j].sum()), len(b)) for p, b in enumerate(blocks) for j in range(4)], "part int, model string, s double, n long")
        got = rs.overfitting(sums, parts, 4).first()
        assert got.splits == total and isclose(got.pbo, bad / total)


def test_superior_ability_and_confidence_set_in_both_directions(spark):
    noise = np.random.default_rng(2).normal(size=(120, 4))
    noise -= noise.mean(axis=0)
    better, worse = gains_of(spark, noise + [0, 0, 0, 1.0]), gains_of(spark, noise - 1.0)
    for key in ("spa_p", "reality_p"):
        assert rs.superior(*better, 120, 299).first()[key] < 0.01 and rs.superior(*worse, 120, 299).first()[key] > 0.5
    assert rs.superior(*better, 120, 299).first().best == "m3"
    mixed = rs.superior(*gains_of(spark, np.column_stack([noise[:, :2] - 50 * np.arange(1, 3), noise[:, 2:] + 0.12])), 120, 299).first()
    assert mixed.spa_p <= mixed.reality_p
    equal = rs.confidence_set(*gains_of(spark, noise), 4, 299, 0.1).collect()
    assert all(r.kept for r in equal)
    bad = {r.model: (r.p, r.kept) for r in rs.confidence_set(*gains_of(spark, noise + [0, 0, 3.0, 0]), 4, 299, 0.1).collect()}
    assert not bad["m2"][1] and bad["m2"][0] < 0.01 and sum(k for _, k in bad.values()) == 3
    good = {r.model: (r.p, r.kept) for r in rs.confidence_set(*gains_of(spark, noise - [0, 3.0, 0, 0]), 4, 299, 0.1).collect()}
    assert good["m1"] == (1.0, True) and sum(k for _, k in good.values()) == 1


def test_places_of_draws(spark):
    for wraps in (True, False):
        rows = {}
        for r in rs.blocks(spark, 23, 60, 5, "p", wraps=wraps).collect():
            rows.setdefault(r.draw, {})[r.place] = r.i
        assert len(rows) == 60 and all(sorted(v) == list(range(23)) for v in rows.values())
        steps = [(v[p] - v[p - 1]) % 23 for v in rows.values() for p in range(1, 23) if p % 5]
        assert set(steps) == {1}
        assert wraps == any(v[p] < v[p - 1] for v in rows.values() for p in range(1, 23) if p % 5)
    still = {}
    for r in rs.stationary(spark, 200, 80, 5, "s").collect():
        still.setdefault(r.draw, {})[r.place] = r.i
    breaks = np.mean([(v[p] - v[p - 1]) % 200 != 1 for v in still.values() for p in range(1, 200)])
    assert abs(breaks - 0.2) < 0.02
    counts = np.bincount([i for v in still.values() for i in v.values()], minlength=200)
    assert counts.min() > 0 and len(rs.blocks(spark, 7, 3, 5, "l", length=40).collect()) == 120


def test_wild_weights_and_power(spark):
    x = np.random.default_rng(4).normal(size=40)
    df = lambda v: spark.createDataFrame(list(enumerate(map(float, v))), "i long, d double")
    for kind in ("signs", "webb"):
        weights = [r.w for r in spark.range(6_000).select(rs.weight(kind, rs.number("w", F.col("id"))).alias("w")).collect()]
        assert abs(np.mean(weights)) < 0.05 and abs(np.var(weights) - 1) < 0.05 and len(set(weights)) == (2 if kind == "signs" else 6)
        assert rs.wild(spark, df(x + 2), "d", kind, 199, "a").first().p < 0.01 < rs.wild(spark, df(x - x.mean()), "d", kind, 199, "a").first().p
        assert rs.wild(spark, df(np.ones(10)), "d", kind, 99, "a").first().p == 1.0
    centred = spark.createDataFrame([(i, float(v), 0.3) for i, v in enumerate(x - x.mean())], "i long, e double, effect double")
    got = {r.sessions: r for r in rs.power(spark, centred, "effect", 40, [20, 200], 199, 5, "q").collect()}
    assert got[20].power < got[200].power and got[200]["size"] < 0.2


def test_trend_and_chance(spark):
    rng = np.random.default_rng(11)
    rows = [("up", i, 2.0 * i + rng.normal()) for i in range(40)] + [("flat", i, rng.normal()) for i in range(40)]
    got = {(r.key, r.step): r for r in models.trend(spark.createDataFrame(rows, "key string, i int, y double"), "key", "i", "y", 199, 3).collect()}
    assert abs(got["up", 1].slope - 2) < 0.1 and got["up", 1].p < 0.01 < 0.05 < got["flat", 1].p
    assert isclose(got["up", 3].forecast - got["up", 2].forecast, got["up", 2].slope)


def plain_cost(x, level, a, b):
    h, total = level, 0.0
    for v in x:
        total += np.log(h) + v / h
        h = level * (1 - a - b) + a * v + b * h
    return total


def test_garch_parameters_come_back(spark):
    rng = np.random.default_rng(8)
    rows = []
    for name, (omega, alpha, beta) in {"a": (0.1, 0.1, 0.8), "b": (0.4, 0.3, 0.3)}.items():
        h = omega / (1 - alpha - beta)
        for i in range(3_000):
            r = float(np.sqrt(h) * rng.normal())
            rows.append((name, i // 100, i % 100, r))
            h = omega + alpha * r * r + beta * h
    found = {r.k: r for r in models.garch_fit(spark.createDataFrame(rows, "k string, s int, i int, r double"), "k", "s", "i", "r").collect()}
    for name, (alpha, beta) in {"a": (0.1, 0.8), "b": (0.3, 0.3)}.items():
        f = found[name]
        assert abs(f.alpha - alpha) < 0.06 and abs(f.beta - beta) < 0.15 and f.n == 3_000
        r = np.array([x for k, _, _, x in rows if k == name])
        x = (r - r.mean()) ** 2
        near = min(plain_cost(x, x.mean(), f.alpha + i * 0.01, f.beta + j * 0.01) for i in (-1, 0, 1) for j in (-1, 0, 1) if f.alpha + i * 0.01 > 0 and f.alpha + f.beta + 0.01 * (i + j) < 0.999)
        assert plain_cost(x, x.mean(), f.alpha, f.beta) <= near + 1e-6 and isclose(f.omega, x.mean() * (1 - f.alpha - f.beta))


@pytest.fixture(scope="module")
def pdf(spark, sf):
    return evaluation.forecasts(spark, sf).where("persist is not null").toPandas()


def test_ridge_dml_is_the_plain_loop(spark, sf, pdf):
    day = pdf["session_date"].map(lambda d: d.timetuple().tm_yday).to_numpy()
    x = np.column_stack([np.ones(len(pdf)), pdf["bar"].to_numpy(float), pdf["flat"].to_numpy(float)])
    residuals = []
    for target in (np.log(pdf["actual"].to_numpy()), np.log(pdf["persist"].to_numpy())):
        left = np.empty(len(pdf))
        for fold in range(3):
            train = day % 3 != fold
            b = np.linalg.solve(x[train].T @ x[train] + np.diag([0.0, 1.0, 1.0]), x[train].T @ target[train])
            left[~train] = target[~train] - x[~train] @ b
        residuals.append(left)
    y, d = residuals
    theta = d @ y / (d @ d)
    score = d * (y - theta * d)
    meat = sum(score[day == k].sum() ** 2 for k in set(day))
    g = len(set(day))
    row = catalogue.queries()["ridge_dml"](spark, sf).first()
    assert isclose(row.theta, theta, rel_tol=1e-6, abs_tol=1e-8) and isclose(row.se, (g / (g - 1) * meat) ** 0.5 / (d @ d), rel_tol=1e-6)


def test_collinearity_is_the_condition_number(spark, sf, pdf):
    x = np.column_stack([np.ones(len(pdf)), pdf["persist"], pdf["bar"], pdf["bar"] ** 2]).astype(float)
    want = np.linalg.cond(x / np.linalg.norm(x, axis=0))
    assert isclose(catalogue.queries()["collinearity"](spark, sf).first().condition, want, rel_tol=1e-4)
    assert isclose(selection.condition_number(np.eye(3)), 1.0)


@pytest.mark.parametrize(("name", "power"), [("glm_gamma", 2.0), ("tweedie_forecast", 1.5)])
def test_generalised_models_solve_their_equations(spark, sf, name, power):
    rows = catalogue.queries()[name](spark, sf).toPandas()
    lead = evaluation.forecasts(spark, sf).where("persist is not null and actual > 0").toPandas().set_index(["asset", "session_date", "bar"])["persist"]
    x = np.log(lead.loc[list(zip(rows["asset"], rows["session_date"], rows["bar"], strict=True))].to_numpy())
    score = (rows["actual"] - rows["prediction"]) * rows["prediction"] ** (1 - power)
    scale = np.abs(score).sum()
    assert abs(score.sum()) / scale < 1e-4 and abs((score * x).sum()) / (scale * np.abs(x).max()) < 1e-4


def test_elastic_net_is_a_minimum(spark, sf, pdf):
    rows = catalogue.queries()["elastic_net_forecast"](spark, sf).toPandas()
    x, y = pdf[["persist", "flat"]].to_numpy(float), pdf["actual"].to_numpy(float)
    merged = pdf.merge(rows, on=["asset", "session_date", "bar"])
    design = np.column_stack([np.ones(len(merged)), merged[["persist", "flat"]]]).astype(float)
    b = np.linalg.lstsq(design, merged["prediction"].to_numpy(), rcond=None)[0]
    sx = x.std(0, ddof=1)

    def cost(b):
        w = b[1:] * sx / y.std(ddof=1)
        return ((y - b[0] - x @ b[1:]) ** 2).mean() / 2 / y.var(ddof=1) + 0.1 / y.std(ddof=1) * (0.5 * np.abs(w).sum() + 0.25 * w @ w)

    rng = np.random.default_rng(10)
    assert all(cost(b) <= cost(b + rng.normal(size=3) * [1, 0.05, 0.05]) + 1e-9 for _ in range(200))


def test_propensity_is_balanced(spark, sf):
    rows = catalogue.queries()["inclusion_propensity"](spark, sf).toPandas()
    assert abs((rows["included"] - rows["propensity"]).mean()) < 1e-3
    kept = rows[rows["included"] == 1]
    assert np.allclose(kept["weight"], 1 / np.maximum(kept["propensity"], 0.01)) and rows[rows["included"] == 0]["weight"].isna().all()


def test_boosting_learns_and_stops(spark, sf, pdf):
    rows = catalogue.queries()["boosted_forecast"](spark, sf).toPandas()
    assert (rows["session_date"].map(str) >= "2024-01-19").all() and rows["prediction"].std() > 0
    stopped = {r.held_out: r for r in catalogue.queries()["stopped_boosting"](spark, sf).collect()}
    assert stopped[True].n + stopped[False].n == len(pdf) and 1 <= stopped[True].trees <= 20


def test_spline_and_ranked_ridge_are_least_squares(spark, sf):
    f = evaluation.forecasts(spark, sf).toPandas()
    h = f["bar"].to_numpy() / 24.0
    basis = lambda h: np.column_stack([np.ones(len(h)), h, h**2, h**3, *[np.maximum(h - k, 0) ** 3 for k in (0.25, 0.5, 0.75)]])
    b = np.linalg.lstsq(basis(h), f["actual"].to_numpy(), rcond=None)[0]
    for r in catalogue.queries()["spline_forecast"](spark, sf).collect():
        assert isclose(r.forecast, float((basis(np.array([r.bar / 24.0])) @ b)[0]), rel_tol=1e-4)
    found = {r.feature: r.weight for r in catalogue.queries()["ranked_ridge"](spark, sf).collect()}
    assert list(found) == ["intercept", "persist", "hour"]
    t = f[f["persist"].notna() & (f["session_date"].map(str) < "2024-01-19")]
    x = np.column_stack([np.ones(len(t)), t["persist"], t["bar"]]).astype(float)
    want = np.linalg.solve(x.T @ x + np.diag([0.0, 1.0, 1.0]), x.T @ t["actual"].to_numpy())
    assert np.allclose(list(found.values()), want, rtol=1e-6)
