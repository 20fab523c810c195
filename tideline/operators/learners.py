"""Learners that pass over the rows once a round: boosted trees on a stated loss, quantile regression by consensus, logistic
regression by Newton steps, and a small network on full-batch gradients.

Rows are stored once as blocks of numbers. In a round every task reduces its blocks to a vector whose length the model's
size fixes; these vectors are summed by position in a shuffle, and the sums alone reach the driver, where the model takes
its step. A lost executor repeats its part of one round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import files

#: Rows of a block.
BLOCK = 1 << 16
_BLOCKS_DDL = "block long, n long, data binary"
_BLOCKS = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
_SUMS = pa.schema([("at", pa.int64()), ("v", pa.float64())])


def blocked(rows: DataFrame, columns: list[str], size: int = BLOCK) -> DataFrame:
    """The rows whose columns are all known and finite, as stored blocks of doubles."""
    parts = rows.select(*[F.col(c).cast("double").alias(c) for c in columns])
    for c in columns:
        parts = parts.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf"))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, n = TaskContext.get().partitionId() << 32, [], 0

        def out(count: int) -> Iterator[pa.RecordBatch]:
            nonlocal at, held, n
            whole = np.concatenate(held)
            yield pa.record_batch([[at], [count], [whole[:count].tobytes()]], schema=_BLOCKS)
            at, held, n = at + 1, [whole[count:]], len(whole) - count

        for batch in batches:
            held.append(np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns))]))
            n += batch.num_rows
            while n >= size:
                yield from out(size)
        if n:
            yield from out(n)

    return files.stored(parts.mapInArrow(run, _BLOCKS_DDL), "blocks")


def _matrices(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for block, n, data in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "data")), strict=True):
        yield block, np.frombuffer(data).reshape(n, width)


def summed(blocks: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray], length: int) -> np.ndarray:
    """The sum over all blocks of a vector made from each: within a task, then by position."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            for _, matrix in _matrices(batch, width):
                total += of(matrix)
        held = np.flatnonzero(total)
        yield pa.record_batch([held, total[held]], schema=_SUMS)

    out = np.zeros(length)
    for at, v in blocks.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v")).collect():
        out[at] = v
    return out


def changed(blocks: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The blocks with their matrices replaced, stored."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, matrix in _matrices(batch, width):
                new = np.ascontiguousarray(of(matrix), np.float64)
                yield pa.record_batch([[block], [len(new)], [new.tobytes()]], schema=_BLOCKS)

    return files.stored(blocks.mapInArrow(run, _BLOCKS_DDL), "blocks")


# ---- boosted trees -----------------------------------------------------------------------------------------


class Loss(NamedTuple):
    """``start`` from the target's mean; gradient and curvature by the raw score; value of a forecast; forecast of a score."""

    start: Callable[[float], float]
    slopes: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    value: Callable[[np.ndarray, np.ndarray], np.ndarray]
    forecast: Callable[[np.ndarray], np.ndarray]
    column: Callable[[Column], Column]


#: Scores of a logarithm are held within this, so that a step too far gives a bad number and no infinite one.
_MOST = 30.0
_exp = lambda raw: np.exp(np.clip(raw, -_MOST, _MOST))
_exp_column = lambda raw: F.exp(F.greatest(F.least(raw, F.lit(_MOST)), F.lit(-_MOST)))


def _ratio(scale: float):
    def slopes(y: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = scale * y / _exp(raw)
        return scale - part, part

    def value(y: np.ndarray, raw: np.ndarray) -> np.ndarray:
        part = y / _exp(raw)
        return scale * (part - np.log(part) - 1)

    return Loss(lambda mean: float(np.log(mean)), slopes, value, _exp, _exp_column)


LOSSES = {
    "squared": Loss(lambda mean: mean, lambda y, raw: (raw - y, np.ones_like(y)), lambda y, raw: (y - raw) ** 2, lambda raw: raw, lambda raw: raw),
    "qlike": _ratio(1.0), "gamma": _ratio(2.0),
}


@dataclass
class Boosted:
    """Trees as lists of splits: node -> (feature, edge) or a leaf's score; children of node i are 2i + 1 (at or below
    the edge) and 2i + 2."""

    features: list[str]
    edges: list[np.ndarray]
    loss: str
    start: float
    rate: float
    trees: list[dict[int, tuple[int, int] | float]] = field(default_factory=list)
    #: Mean loss of the held-out rows after each round.
    history: list[float] = field(default_factory=list)

    def score(self) -> Column:
        """The forecast as one column over the features."""

        def node(tree: dict, at: int) -> Column:
            if isinstance(tree[at], float):
                return F.lit(self.rate * tree[at])
            feature, edge = tree[at]
            return F.when(F.col(self.features[feature]) <= float(self.edges[feature][edge]), node(tree, 2 * at + 1)).otherwise(node(tree, 2 * at + 2))

        raw = F.lit(self.start)
        for tree in self.trees:
            raw = raw + node(tree, 0)
        return LOSSES[self.loss].column(raw)


def _leaves(tree: dict, binned: np.ndarray) -> np.ndarray:
    """The node that each row has come to."""
    at = np.zeros(len(binned), np.int64)
    while True:
        moved = False
        for node, split in tree.items():
            if not isinstance(split, float):
                here = np.flatnonzero(at == node)
                if len(here):
                    feature, edge = split
                    at[here] = np.where(binned[here, feature] <= edge, 2 * node + 1, 2 * node + 2)
                    moved = True
        if not moved:
            return at


def _raw(tree: dict, binned: np.ndarray, rate: float) -> np.ndarray:
    at = _leaves(tree, binned)
    out = np.zeros(len(binned))
    for node, leaf in tree.items():
        if isinstance(leaf, float):
            out[at == node] = rate * leaf
    return out


def best_split(cells: np.ndarray, l2: float, least: float) -> tuple[float, int, int] | None:
    """Gain, feature and edge of the best split of a node from its sums (gradient, curvature, rows) by feature and bin; ties, to
    nine digits, go to the first feature and edge."""
    below = np.cumsum(cells, axis=1)[:, :-1]
    whole = cells.sum(axis=1, keepdims=True)
    above = whole - below
    worth = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
    with np.errstate(invalid="ignore", divide="ignore"):
        gain = worth(below) + worth(above) - worth(whole)
    gain[(below[..., 2] < least) | (above[..., 2] < least) | ~np.isfinite(gain)] = -np.inf
    if not gain.size or gain.max() <= 1e-9:
        return None
    feature, edge = np.unravel_index(np.argmax(gain >= gain.max() * (1 - 1e-9)), gain.shape)
    return float(gain[feature, edge]), int(feature), int(edge)


def boost(
    rows: DataFrame, features: list[str], target: str, loss: str, held_out: str | None = None, rounds: int = 50, depth: int = 2, bins: int = 32, rate: float = 0.2, l2: float = 1.0, least: int = 20, patience: int = 5, keep: int = 16
) -> Boosted:
    """Gradient boosting on histograms. ``held_out``, 0 or 1, marks the rows (of whole sessions) that decide how many rounds are
    kept: it stops once ``patience`` rounds bring no gain. A level of a tree is one pass, whose sums by node, feature and
    bin are all that is collected. Edges are quantiles of a sketch. Rows with an unknown feature or target are left out;
    losses of a ratio need positive targets."""
    stated = LOSSES[loss]
    known = rows.withColumn("_held", F.col(held_out).cast("double") if held_out else F.lit(0.0))
    if loss != "squared":
        known = known.where(F.col(target) > 0)
    shares = [i / bins for i in range(1, bins)]
    cuts = known.where("_held = 0").agg(*[F.percentile_approx(f, shares, 100 * bins).alias(f"e{i}") for i, f in enumerate(features)]).first()
    edges = [np.unique(np.array(c if c is not None else [], np.float64)) for c in cuts]
    k, wide = len(features), len(features) + 3
    raw_blocks = blocked(known, [*features, target, "_held"])
    totals = summed(raw_blocks, k + 2, lambda m: np.array([(m[:, k] * (m[:, k + 1] == 0)).sum(), (m[:, k + 1] == 0).sum(), (m[:, k + 1] == 1).sum()]), 3)
    model = Boosted(features, edges, loss, stated.start(totals[0] / max(1.0, totals[1])), rate)
    start = model.start

    def bin_(m: np.ndarray) -> np.ndarray:
        binned = np.column_stack([np.searchsorted(e, m[:, i], side="left") for i, e in enumerate(edges)])
        return np.column_stack([binned, m[:, k:], np.full(len(m), start)])

    blocks = changed(raw_blocks, k + 2, bin_)
    fresh: list[dict] = []
    most = max([len(e) + 1 for e in edges] + [1])
    best = np.inf
    for turn in range(rounds + 1):
        tree: dict[int, tuple[int, int] | float] = {0: 0.0}
        open_ = [0]
        for level in range(depth):
            place = {node: i for i, node in enumerate(open_)}

            def histogram(m: np.ndarray, fresh=tuple(fresh), tree=dict(tree), place=place) -> np.ndarray:
                binned, y, held, raw = m[:, :k].astype(np.int64), m[:, k], m[:, k + 1], m[:, k + 2].copy()
                for t in fresh:
                    raw += _raw(t, binned, rate)
                out = np.zeros(1 + len(place) * k * most * 3)
                out[0] = stated.value(y[held == 1], raw[held == 1]).sum()
                at = _leaves(tree, binned)
                slot = np.full(2 ** (depth + 1), -1)
                slot[list(place)] = list(place.values())
                use = np.flatnonzero((held == 0) & (slot[at] >= 0))
                g, h = stated.slopes(y[use], raw[use])
                for f in range(k):
                    cell = (slot[at[use]] * k + f) * most + binned[use, f]
                    for j, weight in enumerate((g, h, np.ones(len(use)))):
                        out[1 + j :: 3] += np.bincount(cell, weight, len(place) * k * most)
                return out

            sums = summed(blocks, wide, histogram, 1 + len(open_) * k * most * 3)
            if level == 0 and turn and totals[2]:
                model.history.append(sums[0] / totals[2])
            cells = sums[1:].reshape(len(open_), k, most, 3)
            grown = []
            for i, node in enumerate(open_):
                one = cells[i, 0].sum(axis=0)
                tree[node] = float(-one[0] / (one[1] + l2))
                if found := best_split(cells[i], l2, least):
                    _, feature, edge = found
                    below, all_ = cells[i, feature, : edge + 1].sum(axis=0), cells[i, feature].sum(axis=0)
                    tree[node] = (feature, edge)
                    for child, part in ((2 * node + 1, below), (2 * node + 2, all_ - below)):
                        tree[child] = float(-part[0] / (part[1] + l2))
                        grown.append(child)
            open_ = grown
            if not open_ or (level == 0 and turn == rounds):
                break
        if model.history:
            best = min(best, min(model.history))
            if len(model.history) - int(np.argmin(model.history)) > patience:
                break
        if turn == rounds or isinstance(tree[0], float):
            break
        model.trees.append(tree)
        fresh.append(tree)
        if len(fresh) == keep:  # scores so far are written down, so that a pass walks few trees

            def written(m: np.ndarray, fresh=tuple(fresh)) -> np.ndarray:
                out = m.copy()
                for t in fresh:
                    out[:, k + 2] += _raw(t, m[:, :k].astype(np.int64), rate)
                return out

            blocks, fresh = changed(blocks, wide, written), []
    if model.history:
        model.trees = model.trees[: int(np.argmin(model.history)) + 1]
    return model


# ---- quantile regression by consensus ----------------------------------------------------------------------


def pinball_near(x: np.ndarray, y: np.ndarray, q: float, near: np.ndarray, rho: float, rounds: int = 400, tolerance: float = 1e-7) -> np.ndarray:
    """The coefficients with least pinball loss of one block (a sum) plus rho / 2 times the squared distance to ``near``: residuals
    are split off, and shrunk in closed form."""
    n, d = x.shape
    inner = max(1e-3, 1.0 / max(1e-9, np.abs(y - x @ near).mean()))
    inverse = np.linalg.inv(inner * (x.T @ x) + rho * np.eye(d))
    b = near.copy()
    z = y - x @ b
    u = np.zeros(n)
    for _ in range(rounds):
        new = inverse @ (inner * (x.T @ (y - z - u)) + rho * near)
        gap = y - x @ new
        z = np.maximum(gap - u - q / inner, 0.0) + np.minimum(gap - u + (1 - q) / inner, 0.0)
        u += z - gap
        if np.abs(new - b).max() < tolerance and np.abs(z - gap).max() < 1e3 * tolerance:
            return new
        b = new
    return b


class Consensus(NamedTuple):
    quantile: float
    weights: np.ndarray
    rounds: int
    primal: float
    dual: float
    converged: bool


def pinball(rows: DataFrame, features: list[str], target: str, quantiles: list[float], l2: float = 0.0, rho: float | None = None, tolerance: float = 1e-3, rounds: int = 200, size: int = BLOCK, broadcast_blocks: int = 100_000) -> list[Consensus]:
    """Linear quantile regressions, all levels in the same rounds: summed pinball loss plus ``l2`` times the squared slopes.

    In a round each block finds the coefficients that suit it best near the common ones; their mean, and that of the
    blocks' multipliers, give the next common ones. It stops for a level when the blocks agree, and the common ones rest,
    within ``tolerance`` of their size, and says when it has not. ``rho`` follows the balance of the two. It starts at half the rows of
    a block. Features are scaled by their own mean and deviation first, and weights given back in their own units, the intercept first."""
    d = len(features) + 1
    blocks = blocked(rows, [*features, target], size)
    k = len(features)
    moments = summed(blocks, k + 1, lambda m: np.r_[len(m), m.sum(axis=0), (m * m).sum(axis=0)], 1 + 2 * (k + 1))
    n = max(1.0, moments[0])
    mean = moments[1 : k + 2] / n
    scale = np.sqrt(np.maximum(moments[k + 2 :] / n - mean * mean, 0.0))
    scale[scale == 0] = 1.0
    count = blocks.count()
    levels = np.array(quantiles)
    common = np.zeros((len(levels), d))
    weight = np.full(len(levels), rho or 0.5 * n / max(1, count))
    rescale = np.ones(len(levels))
    spark = rows.sparkSession
    ddl = "block long, b array<double>, u array<double>"
    state = spark.createDataFrame([], ddl)
    done: dict[int, Consensus] = {}
    for turn in range(1, rounds + 1):
        if not count or len(done) == len(levels):
            break
        held = F.broadcast(state) if count <= broadcast_blocks else state
        met = blocks.join(held.withColumnRenamed("block", "of"), F.col("block") == F.col("of"), "left").select("block", "n", "data", "b", "u")

        def step(batches: Iterable[pa.RecordBatch], common=common.copy(), weight=weight.copy(), rescale=rescale.copy(), closed=tuple(done)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                olds = zip(batch.column("b").to_pylist(), batch.column("u").to_pylist(), strict=True)
                for (block, m), (b, u) in zip(_matrices(batch, k + 1), olds, strict=True):
                    x = np.column_stack([np.ones(len(m)), (m[:, :k] - mean[:k]) / scale[:k]])
                    y = (m[:, k] - mean[k]) / scale[k]
                    b = np.zeros_like(common) if b is None else np.array(b).reshape(common.shape)
                    u = np.zeros_like(common) if u is None else (np.array(u).reshape(common.shape) + b - common) * rescale[:, None]
                    for i, q in enumerate(levels):
                        if i not in closed:
                            b[i] = pinball_near(x, y, q, common[i] - u[i], weight[i], rounds=100)
                    yield pa.record_batch([[block], [b.ravel().tolist()], [u.ravel().tolist()]], schema=pa.schema([("block", pa.int64()), ("b", pa.list_(pa.float64())), ("u", pa.list_(pa.float64()))]))

        state = files.stored(met.mapInArrow(step, ddl), "consensus")
        size_ = len(levels) * d
        both = [F.col(c)[i] for i in range(size_) for c in ("b", "u")]
        sums = state.agg(*[F.sum(c) for c in both], *[F.sum(F.col("b")[i] * F.col("b")[i]) for i in range(size_)]).first()
        b_sum = np.array(sums[: 2 * size_ : 2]).reshape(common.shape)
        u_sum = np.array(sums[1 : 2 * size_ : 2]).reshape(common.shape)
        b_square = np.array(sums[2 * size_ :]).reshape(common.shape)
        before = common.copy()
        factor = weight[:, None] * count / (weight[:, None] * count + 2 * l2 * (np.arange(d) > 0))
        common = factor * (b_sum + u_sum) / count
        # sums of squares of what each block is off by
        primal = np.sqrt(np.maximum((b_square - 2 * b_sum * common + count * common**2).sum(axis=1), 0.0) / count)
        dual = np.abs(common - before).max(axis=1)
        size_of = np.maximum(1.0, np.abs(common).max(axis=1))
        for i in range(len(levels)):
            if i not in done and primal[i] <= tolerance * size_of[i] and dual[i] <= tolerance * size_of[i]:
                done[i] = Consensus(quantiles[i], common[i].copy(), turn, float(primal[i]), float(dual[i]), True)
            if i in done:
                common[i] = done[i].weights
        rescale = np.where(primal > 5 * dual, 0.5, np.where(dual > 5 * primal, 2.0, 1.0))
        weight = weight / rescale
    out = []
    for i, q in enumerate(quantiles):
        c = done.get(i) or Consensus(q, common[i], min(rounds, turn) if count else 0, float(primal[i]) if count else 0.0, float(dual[i]) if count else 0.0, False)
        slopes = c.weights[1:] * scale[k] / scale[:k]
        out.append(c._replace(weights=np.r_[mean[k] + c.weights[0] * scale[k] - (slopes * mean[:k]).sum(), slopes]))
    return out


# ---- logistic regression -----------------------------------------------------------------------------------


def logistic(rows: DataFrame, features: list[str], label: str, l2: float = 1.0, tolerance: float = 1e-9, rounds: int = 50) -> tuple[np.ndarray, int]:
    """Weights (the intercept first, not penalised) of a logistic regression: summed loss plus ``l2`` times the squared slopes,
    by Newton steps, each from one sum of gradients and curvatures; and the rounds it took. With one class alone the slopes
    are 0 and the intercept stands for a share of half a row."""
    k = len(features)
    d = k + 1
    blocks = blocked(rows.where(F.col(label).isin(0, 1)), [*features, label])
    n, ones = summed(blocks, d, lambda m: np.array([len(m), m[:, k].sum()]), 2)
    w = np.zeros(d)
    if n == 0 or ones in (0.0, n):
        w[0] = np.log((ones + 0.5) / (n - ones + 0.5))
        return w, 0
    penalty = np.r_[0.0, np.full(k, 2 * l2)]
    w[0] = np.log(ones / (n - ones))

    def passed(m: np.ndarray, w: np.ndarray) -> np.ndarray:
        x = np.column_stack([np.ones(len(m)), m[:, :k]])
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        loss = np.logaddexp(0.0, x @ w).sum() - (x @ w)[m[:, k] == 1].sum()
        return np.r_[loss, x.T @ (p - m[:, k]), ((x * (p * (1 - p))[:, None]).T @ x).ravel()]

    at = summed(blocks, d, lambda m: passed(m, w), 1 + d + d * d)
    for turn in range(1, rounds + 1):
        gradient = at[1 : 1 + d] + penalty * w
        step = np.linalg.solve(at[1 + d :].reshape(d, d) + np.diag(penalty + 1e-12), gradient)
        loss, share = at[0] + 0.5 * (penalty * w * w).sum(), 1.0
        while True:  # a shorter step where the full one does not pay
            new = w - share * step
            at = summed(blocks, d, lambda m, new=new: passed(m, new), 1 + d + d * d)
            if at[0] + 0.5 * (penalty * new * new).sum() <= loss + 1e-12 * abs(loss) or share < 1e-4:
                break
            share /= 2
        w = new
        if np.abs(share * step).max() <= tolerance * max(1.0, np.abs(w).max()):
            return w, turn
    return w, rounds


# ---- a small network ---------------------------------------------------------------------------------------


@dataclass
class Network:
    """One hidden layer of tanh; weights in one vector."""

    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    hidden: int
    weights: np.ndarray
    history: list[float]

    def score(self) -> Column:
        """The forecast as one column over the features."""
        k, h = len(self.features), self.hidden
        a, b, c, e = _parts(self.weights, k, h)
        xs = [(F.col(f) - float(self.mean[i])) / float(self.scale[i]) for i, f in enumerate(self.features)]
        out = F.lit(float(e))
        for j in range(h):
            inner = F.lit(float(b[j]))
            for i, x in enumerate(xs):
                inner = inner + float(a[i, j]) * x
            out = out + float(c[j]) * F.tanh(inner)
        return out * float(self.scale[k]) + float(self.mean[k])


def _parts(w: np.ndarray, k: int, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    return w[: k * h].reshape(k, h), w[k * h : k * h + h], w[k * h + h : k * h + 2 * h], w[-1]


def loss_and_slope(w: np.ndarray, x: np.ndarray, y: np.ndarray, h: int) -> np.ndarray:
    """Summed squared error and its gradient by every weight."""
    a, b, c, e = _parts(w, x.shape[1], h)
    t = np.tanh(x @ a + b)
    gap = t @ c + e - y
    back = (gap[:, None] * c) * (1 - t * t)
    return np.r_[0.5 * gap @ gap, (x.T @ back).ravel(), back.sum(axis=0), t.T @ gap, gap.sum()]


def network(rows: DataFrame, features: list[str], target: str, hidden: int = 4, rounds: int = 40, rate: float = 0.05, l2: float = 1e-4, seed: int = 5, start: np.ndarray | None = None) -> Network:
    """A network fitted by Adam on the mean squared error of all rows: one sum of gradients a round, weights sent to every
    task. Features and target are scaled by their own mean and deviation. The start is drawn by ``seed`` or given."""
    k = len(features)
    blocks = blocked(rows, [*features, target])
    moments = summed(blocks, k + 1, lambda m: np.r_[len(m), m.sum(axis=0), (m * m).sum(axis=0)], 1 + 2 * (k + 1))
    n = max(1.0, moments[0])
    mean = moments[1 : k + 2] / n
    scale = np.sqrt(np.maximum(moments[k + 2 :] / n - mean * mean, 0.0))
    scale[scale == 0] = 1.0
    size = k * hidden + 2 * hidden + 1
    w = np.random.default_rng(seed).normal(0, 0.5, size) if start is None else start.astype(np.float64).copy()
    first, second, history = np.zeros(size), np.zeros(size), []
    for turn in range(1, rounds + 1):

        def passed(m: np.ndarray, w=w.copy()) -> np.ndarray:
            scaled = (m - mean) / scale
            return loss_and_slope(w, scaled[:, :k], scaled[:, k], hidden)

        sums = summed(blocks, k + 1, passed, 1 + size)
        history.append(float(sums[0] / n))
        slope = sums[1:] / n + l2 * w
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        w = w - rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
    return Network(features, mean, scale, hidden, w, history)
