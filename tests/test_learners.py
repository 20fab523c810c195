"""Learners that pass over the rows once a round, against plain loops over the same rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tideline.operators import learners
from tideline.plans import catalogue, learn


@pytest.fixture(scope="module")
def sample(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(900):
        x, z = rnd.random() * 4, rnd.choice([0.0, 1.0, 2.0])
        level = math.exp(0.5 * (x > 2) + 0.8 * (z == 1.0) + 0.2 * x)
        rows.append((x, z, level * rnd.gammavariate(2.0, 0.5), i % 5 == 0))
    rows += [(None, 1.0, 2.0, False), (1.0, 1.0, None, False), (1.0, float("nan"), 2.0, False), (1.0, 1.0, -1.0, False)]
    return rows, spark.createDataFrame([(*r[:3], int(r[3])) for r in rows], "x double, z double, y double, held int").repartition(4).cache()


def plain_boost(rows, edges, loss, rounds, depth, rate, l2, least):
    """Trees by loops over rows: node -> (feature, edge) or score; and the mean held-out loss after each round."""
    kept = [(np.array([sum(v > e for e in edges[i]) for i, v in enumerate(r[:2])]), r[2], r[3]) for r in rows if all(v is not None and math.isfinite(v) for v in r[:3]) and (loss == "squared" or r[2] > 0)]
    scale = {"qlike": 1.0, "gamma": 2.0}.get(loss)
    mean = sum(y for _, y, h in kept if not h) / sum(not h for _, _, h in kept)
    raw = [math.log(mean) if scale else mean] * len(kept)

    def slopes(y, r):
        return (scale - scale * y / math.exp(r), scale * y / math.exp(r)) if scale else (r - y, 1.0)

    trees, history = [], []
    for _ in range(rounds):
        tree, at, open_ = {}, [0] * len(kept), [0]
        for _ in range(depth):
            grown = []
            for node in open_:
                own = [(b, *slopes(y, r)) for (b, y, h), r, a in zip(kept, raw, at, strict=True) if a == node and not h]
                g, h = sum(o[1] for o in own), sum(o[2] for o in own)
                best = None
                for f in range(2):
                    for e in range(len(edges[f])):
                        low = [o for o in own if o[0][f] <= e]
                        if least <= len(low) <= len(own) - least:
                            gl, hl = sum(o[1] for o in low), sum(o[2] for o in low)
                            gain = gl * gl / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g * g / (h + l2)
                            if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                                best = (gain, f, e)
                tree[node] = -g / (h + l2)
                if best:
                    tree[node] = best[1:]
                    for child, side in ((2 * node + 1, True), (2 * node + 2, False)):
                        part = [o for o in own if (o[0][best[1]] <= best[2]) == side]
                        tree[child] = -sum(o[1] for o in part) / (sum(o[2] for o in part) + l2)
                        grown.append(child)
                    at = [(2 * a + 1 if b[best[1]] <= best[2] else 2 * a + 2) if a == node else a for (b, _, _), a in zip(kept, at, strict=True)]
            open_ = grown
        trees.append(tree)
        raw = [r + rate * tree[a] for r, a in zip(raw, at, strict=True)]
        held = [(y, r) for (_, y, h), r in zip(kept, raw, strict=True) if h]
        history.append(sum(scale * (y / math.exp(r) - math.log(y / math.exp(r)) - 1) if scale else (y - r) ** 2 for y, r in held) / len(held))
    return trees, history


@pytest.mark.parametrize("loss", ["squared", "qlike", "gamma"])
def test_boosting_against_plain_loops(spark, sample, loss):
    rows, df = sample
    model = learners.boost(df, ["x", "z"], "y", loss, held_out="held", rounds=4, depth=2, bins=8, rate=0.3, least=20, patience=6, keep=2)
    trees, history = plain_boost(rows, [e.tolist() for e in model.edges], loss, 4, 2, 0.3, 1.0, 20)
    assert np.allclose(model.history, history[: len(model.history)], rtol=1e-9) and len(model.history) == 4
    assert len(model.trees) == int(np.argmin(history)) + 1
    for got, want in zip(model.trees, trees, strict=False):
        assert got.keys() == want.keys()
        assert all(got[n] == want[n] if isinstance(want[n], tuple) else math.isclose(got[n], want[n], rel_tol=1e-9, abs_tol=1e-12) for n in want)
    # the column gives the scores of the trees
    first = df.where("x is not null and y is not null and not isnan(z)").withColumn("f", model.score()).limit(50).collect()
    for r in first:
        raw = model.start
        for tree in model.trees:
            node = 0
            while isinstance(tree[node], tuple):
                f, e = tree[node]
                node = 2 * node + (1 if (r.x, r.z)[f] <= model.edges[f][e] else 2)
            raw += 0.3 * tree[node]
        assert math.isclose(r.f, raw if loss == "squared" else math.exp(raw), rel_tol=1e-9)


def test_boosting_stops_and_takes_odd_tables(spark, sample):
    _, df = sample
    model = learners.boost(df, ["x", "z"], "y", "qlike", held_out="held", rounds=20, patience=1, rate=1.5)
    assert len(model.history) < 20 and model.history[len(model.trees) - 1] == min(model.history)
    flat = learners.boost(df.limit(3), ["x", "z"], "y", "qlike", rounds=3)
    assert flat.trees == []
    assert learners.boost(df.where("x = -1"), ["x"], "y", "squared", rounds=2).trees == []


def test_ratio_losses_beat_squared_error_on_their_own_measure(spark, sf):
    got = {r.loss: r for r in catalogue.queries()["ratio_boosting"](spark, sf).collect()}
    assert set(got) == {"squared", "qlike", "gamma"} and got["qlike"].trees > 0
    assert got["qlike"].qlike < got["squared"].qlike


def pinball_sum(x, y, w, q, l2):
    gap = y - x @ w
    return np.maximum(q * gap, (q - 1) * gap).sum() + l2 * (w[1:] ** 2).sum()


def plain_pinball(x, y, q, l2):
    """Smoothed Newton steps with ever less smoothing: close to the optimum of the loss itself."""
    w = np.r_[np.quantile(y, q), np.zeros(x.shape[1] - 1)]
    for eps in 10.0 ** -np.arange(0, 7, 0.25):
        for _ in range(60):
            gap = y - x @ w
            weight = 0.5 / np.sqrt(gap * gap + eps * eps)
            right = x.T @ (weight * y) + (q - 0.5) * x.sum(axis=0)
            left = (x * weight[:, None]).T @ x + 2 * l2 * np.diag(np.r_[0.0, np.ones(x.shape[1] - 1)])
            w = np.linalg.solve(left, right)
    return w


def test_consensus_reaches_the_quantiles(spark):
    rnd = np.random.default_rng(3)
    x = np.column_stack([rnd.normal(5, 2, 1_200), rnd.random(1_200)])
    y = 3 + 2 * x[:, 0] - 4 * x[:, 1] + (1 + x[:, 1]) * rnd.standard_t(3, 1_200)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, y double").repartition(3)
    found = learners.pinball(df, ["a", "b"], "y", [0.1, 0.5, 0.9], size=300, tolerance=1e-3)
    design = np.column_stack([np.ones(len(x)), x])
    for c in found:
        assert c.converged, c
        best = pinball_sum(design, y, plain_pinball(design, y, c.quantile, 0.0), c.quantile, 0.0)
        assert pinball_sum(design, y, c.weights, c.quantile, 0.0) <= best * 1.002
        below = (y < design @ c.weights).mean()
        assert abs(below - c.quantile) < 0.02
    assert learners.pinball(df.limit(0), ["a"], "y", [0.5])[0].converged is False


def test_the_pinball_query_is_near_the_optimum(spark, sf):
    got = catalogue.queries()["pinball_consensus"](spark, sf).collect()
    rows = [(r.persist, r.flat, r.actual) for r in learn.featured(spark, sf).collect()]
    table = np.array(rows)
    scaled = (table - table.mean(axis=0)) / table.std(axis=0)
    x = np.column_stack([np.ones(len(table)), scaled[:, :2]])
    for q in (0.1, 0.5, 0.9):
        own = {r.feature: r for r in got if r["quantile"] == q}
        assert own["intercept"].converged
        slopes = np.array([own["persist"].weight, own["flat"].weight]) * table[:, :2].std(axis=0) / table[:, 2].std()
        level = (own["intercept"].weight + own["persist"].weight * table[:, 0].mean() + own["flat"].weight * table[:, 1].mean() - table[:, 2].mean()) / table[:, 2].std()
        w = np.r_[level, slopes]
        best = pinball_sum(x, scaled[:, 2], plain_pinball(x, scaled[:, 2], q, 1.0), q, 1.0)
        assert pinball_sum(x, scaled[:, 2], w, q, 1.0) <= best * 1.005


def test_logistic_against_plain_newton(spark, sf):
    got = {r.feature: r.weight for r in catalogue.queries()["jump_logistic"](spark, sf).collect()}
    rows = [(math.log(r.persist), r.bar / 24, float(r.actual > 2 * r.persist)) for r in learn.featured(spark, sf).collect()]
    x = np.column_stack([np.ones(len(rows)), np.array(rows)[:, :2]])
    y = np.array(rows)[:, 2]
    w = np.zeros(3)
    for _ in range(200):
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([0, 2.0, 2.0]), x.T @ (p - y) + np.array([0, 2.0, 2.0]) * w)
    assert np.allclose([got["intercept"], got["size"], got["hour"]], w, atol=1e-6)
    one = spark.createDataFrame([(1.0, 1), (2.0, 1)], "x double, y int")
    weights, rounds = learners.logistic(one, ["x"], "y")
    assert rounds == 0 and weights[1] == 0 and weights[0] > 0


def test_network_against_a_plain_loop(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(0, 1, (300, 2))
    y = np.sin(x[:, 0]) + 0.3 * x[:, 1]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, y double").repartition(3)
    start = rnd.normal(0, 0.5, 2 * 3 + 2 * 3 + 1)
    model = learners.network(df, ["a", "b"], "y", hidden=3, rounds=12, rate=0.05, l2=1e-3, start=start)
    xs, ys = (x - x.mean(axis=0)) / x.std(axis=0), (y - y.mean()) / y.std()
    w, m, v = start.copy(), np.zeros(13), np.zeros(13)

    def loss(w):
        total = 0.0
        for row, t in zip(xs, ys, strict=True):
            hidden = [math.tanh(sum(row[i] * w[i * 3 + j] for i in range(2)) + w[6 + j]) for j in range(3)]
            total += 0.5 * (sum(h * c for h, c in zip(hidden, w[9:12], strict=True)) + w[12] - t) ** 2
        return total / len(ys)

    for turn in range(1, 13):
        slope = np.array([(loss(w + 1e-5 * e) - loss(w - 1e-5 * e)) / 2e-5 for e in np.eye(13)]) + 1e-3 * w
        assert math.isclose(model.history[turn - 1], loss(w), rel_tol=1e-6)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w = w - 0.05 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    assert np.allclose(model.weights, w, atol=1e-4) and model.history[-1] < model.history[0]
    scored = df.withColumn("f", model.score()).limit(5).collect()
    for r in scored:
        row = (np.array([r.a, r.b]) - model.mean[:2]) / model.scale[:2]
        a, b, c, e = learners._parts(model.weights, 2, 3)
        assert math.isclose(r.f, float((np.tanh(row @ a + b) @ c + e) * model.scale[2] + model.mean[2]), rel_tol=1e-9)


def test_the_network_query_learns(spark, sf):
    got = {r.held: r for r in catalogue.queries()["network_forecast"](spark, sf).collect()}
    assert got[0].last_loss < got[0].first_loss and got[1].mse < got[1].variance * 1.05
