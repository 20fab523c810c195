"""Centroid clustering by Yinyang bounds (operator 12).

Vectors are integers, kept in blocks beside each one's cluster, an upper bound of its distance to that centroid, and one
lower bound for each group of the other centroids; the groups are drawn once. When centroids move, bounds
move with them: a vector whose upper bound is below all lower bounds keeps its cluster unseen, else only groups whose
bound it reaches are scanned, exactly. Bounds are widened by more than rounding can take, and distances are
integers, so clusters are those of a full scan, ties too.

Each round reads the blocks once, and writes them with their new bounds and with the sums of those vectors that changed
cluster; a lost executor repeats its part of one round.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Integers per unit of a component; clusters; rounds.
SCALE, CLUSTERS, ROUNDS = 1024, 8, 10
#: Centroids that share a lower bound, about.
PER_GROUP = 4
#: Vectors of a block.
BLOCK = 4_096
#: Integers beyond this would overflow a long distance.
LARGEST = 1 << 27
#: What bounds are widened by: relative, and at once.
_SLACK, _STEP = 1e-12, 1e-6
_KEY = np.dtype([("key", "<i8"), ("known", "?")])
#: A block: keys, components, cluster, bounds; or what moved between clusters in a task: ``moved`` alone.
_BLOCKS = pa.schema([("keys", pa.binary()), ("parts", pa.binary()), ("cluster", pa.binary()), ("bounds", pa.binary()), ("moved", pa.binary())])
_BLOCKS_DDL = "keys binary, parts binary, cluster binary, bounds binary, moved binary"
_OUT = pa.schema([("vec_key", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])
_OUT_DDL = "vec_key long, cluster int, distance long"


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); components that would overflow are an error."""
    scaled = np.floor(vectors * float(scale))
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST // scale} give distances that no long holds")
    return scaled.astype(np.int64)


def squared(own: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every vector to every centroid."""
    if max(np.abs(own).max(initial=0), np.abs(centroids).max(initial=0)) < 1 << 20 and own.shape[1] < 1 << 10:
        a, b = own.astype(np.float64), centroids.astype(np.float64)  # all sums below 2**53
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((own - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def grouped(centroids: np.ndarray, per_group: int = PER_GROUP) -> np.ndarray:
    """The group of each centroid: seeds far from each other, then a few rounds of means. Run once, on the driver, over
    as many rows as there are clusters."""
    k = len(centroids)
    groups = max(1, -(-k // per_group))
    points = centroids.astype(np.float64)
    seeds = [0]
    while len(seeds) < groups:
        seeds.append(int(np.min([((points - points[s]) ** 2).sum(axis=1) for s in seeds], axis=0).argmax()))
    means = points[seeds]
    for _ in range(5):
        of = np.array([((means - p) ** 2).sum(axis=1).argmin() for p in points])
        means = np.array([points[of == g].mean(axis=0) if (of == g).any() else means[g] for g in range(groups)])
    return np.unique(of, return_inverse=True)[1]


class Round:
    """Centroids of a round, how far each moved since the last, and their groups."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray, groups: np.ndarray):
        self.centroids, self.groups = centroids, groups
        self.drift = np.sqrt(((centroids - before) ** 2).sum(axis=1).astype(np.float64)) * (1 + _SLACK)
        self.group_drift = np.array([self.drift[groups == g].max() for g in range(groups.max() + 1)])
        #: Vectors whose cluster no filter kept, and distances computed.
        self.scanned = self.distances = 0

    def assign(self, own: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Change clusters and bounds in place."""
        upper[:] = (upper + self.drift[cluster]) * (1 + _SLACK)
        lower[:] = np.maximum(0.0, lower - self.group_drift) * (1 - _SLACK)
        open_ = np.flatnonzero(upper + _STEP >= lower.min(axis=1))  # the global filter
        if not len(open_):
            return
        exact = np.empty(len(open_), np.int64)
        for c in np.unique(cluster[open_]).tolist():
            at = cluster[open_] == c
            exact[at] = squared(own[open_[at]], self.centroids[c : c + 1])[:, 0]
        self.distances += len(open_)
        upper[open_] = np.sqrt(exact.astype(np.float64)) * (1 + _SLACK)
        still = upper[open_] + _STEP >= lower[open_].min(axis=1)
        open_, exact = open_[still], exact[still]
        self.scanned += len(open_)
        if not len(open_):
            return
        was, was_exact = cluster[open_].copy(), exact.copy()
        best, best_exact = was.copy(), exact.copy()
        reached = upper[open_][:, None] + _STEP >= lower[open_]  # the groups' filter
        found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for g in range(lower.shape[1]):
            at = np.flatnonzero(reached[:, g])
            if not len(at):
                continue
            members = np.flatnonzero(self.groups == g)
            far = squared(own[open_[at]], self.centroids[members])
            self.distances += far.size
            found[g] = at, members, far
            first = far.argmin(axis=1)  # the smallest number of those nearest
            near, number = far[np.arange(len(at)), first], members[first]
            better = (near < best_exact[at]) | ((near == best_exact[at]) & (number < best[at]))
            best[at[better]], best_exact[at[better]] = number[better], near[better]
        for g, (at, members, far) in found.items():
            far = far.astype(np.float64)
            far[best[at][:, None] == members] = np.inf
            lower[open_[at], g] = np.sqrt(far.min(axis=1)) * (1 - _SLACK)
        # the cluster left behind is one of its group's others now, where that group was not scanned
        left = np.flatnonzero((best != was) & ~reached[np.arange(len(was)), self.groups[was]])
        g = self.groups[was[left]]
        lower[open_[left], g] = np.minimum(lower[open_[left], g], np.sqrt(was_exact[left].astype(np.float64)) * (1 - _SLACK))
        cluster[open_] = best
        upper[open_] = np.sqrt(best_exact.astype(np.float64)) * (1 + _SLACK)


def _narrow(own: np.ndarray) -> np.ndarray:
    most = np.abs(own).max(initial=0)
    return own.astype("<i2" if most < 1 << 15 else "<i4")


def _blocks(size: int, scale: int):
    """Vectors to blocks without a cluster yet."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, BLOCK) for b in batches for at in range(0, b.num_rows, BLOCK)):
            keys = np.zeros(batch.num_rows, _KEY)
            keys["key"] = pa.compute.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False)
            keys["known"] = pa.compute.is_valid(batch.column(0)).to_numpy(zero_copy_only=False)
            own = whole(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size), scale)
            yield from common.rows_out(_BLOCKS, [[keys.tobytes()], [_narrow(own).tobytes()], [None], [None], [None]])

    return run


def _opened(batch: pa.RecordBatch, size: int) -> Iterator[tuple]:
    """Keys, vectors, clusters and bounds of each block."""
    for keys, parts, cluster, bounds, _ in zip(*(batch.column(c).to_pylist() for c in _BLOCKS.names), strict=True):
        if keys is not None:
            n = len(keys) // _KEY.itemsize
            own = np.frombuffer(parts, f"<i{len(parts) // (n * size)}").reshape(n, size)
            yield keys, parts, own.astype(np.int64), cluster, bounds


def _state(n: int, groups: int, cluster: bytes | None, bounds: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if cluster is None:  # all in the first, bounds that hold nothing back
        return np.zeros(n, np.int32), np.full(n, np.inf), np.zeros((n, groups))
    held = np.frombuffer(bounds, "<f8").reshape(n, 1 + groups)
    return np.frombuffer(cluster, "<i4").copy(), held[:, 0].copy(), held[:, 1:].copy()


def _assigned(size: int, centroids: np.ndarray, before: np.ndarray, groups: np.ndarray):
    """Blocks with their new clusters and bounds, and one row a task of the counts and sums that each cluster won."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Round(centroids, before, groups)
        moved = np.zeros((len(centroids), 1 + size), np.int64)
        for batch in batches:
            for keys, parts, own, cluster, bounds in _opened(batch, size):
                new = cluster is None
                cluster, upper, lower = _state(len(own), int(groups.max()) + 1, cluster, bounds)
                old = cluster.copy()
                now.assign(own, cluster, upper, lower)
                changed = np.flatnonzero(new | (old != cluster))
                for sign, of in ((1, cluster), (-1, old)):
                    if sign == 1 or not new:
                        np.add.at(moved[:, 0], of[changed], sign)
                        np.add.at(moved[:, 1:], of[changed], sign * own[changed])
                yield from common.rows_out(_BLOCKS, [[keys], [parts], [cluster.astype("<i4").tobytes()], [np.column_stack([upper, lower]).astype("<f8").tobytes()], [None]])
        yield from common.rows_out(_BLOCKS, [[None], [None], [None], [None], [moved.tobytes()]])

    return run


def _won(blocks: DataFrame, size: int, clusters: int) -> np.ndarray:
    """Sums over tasks of what each cluster won, by cluster and component; as many numbers as the centroids have reach
    the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(clusters * (1 + size), np.int64)
        for batch in batches:
            for moved in batch.column(0).to_pylist():
                total += np.frombuffer(moved, "<i8")
        held = np.flatnonzero(total)
        yield from common.rows_out(pa.schema([("at", pa.int64()), ("n", pa.int64())]), [held, total[held]])

    out = np.zeros(clusters * (1 + size), np.int64)
    for at, n in blocks.where("moved is not null").select("moved").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        out[at] = n
    return out.reshape(clusters, 1 + size)


def _placed(size: int, centroids: np.ndarray):
    """Key, cluster and exact distance of every vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, _, own, cluster, _ in _opened(batch, size):
                keys, cluster = np.frombuffer(keys, _KEY), np.frombuffer(cluster, "<i4")
                distance = ((own - centroids[cluster]) ** 2).sum(axis=1)
                yield from common.rows_out(_OUT, [pa.array(keys["key"].copy(), pa.int64(), mask=~keys["known"]), cluster, distance])

    return run


def cluster(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = 64, scale: int = SCALE, seed: int = 3, id_column: str = "vec_id", vector_column: str = "embedding", per_group: int = PER_GROUP
) -> tuple[DataFrame, np.ndarray]:
    """``vec_key, cluster, distance`` per kept vector, and the final centroids.

    Kept are vectors of ``size`` components, none null or not finite, as floor(``scale`` * x). Centroids start as the kept
    vectors of the smallest hashes of ``seed`` and id (a null id as the empty string; equal hashes by their components).
    With fewer vectors than clusters each starts one. Repeated rows count each. A cluster that is empty stays where
    it is. No kept vector gives no row and no centroid. Components beyond 2**27 / ``scale`` are an error.
    """
    rows = common.own_columns(vectors, vec_key=id_column, vector=vector_column).select(F.col("vec_key").cast("long"), F.col("vector").cast("array<double>"))
    sound = (F.size("vector") == size) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.coalesce(sound, F.lit(False)))
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_key").cast("string"), F.lit(""))).cast("binary"), 256)
    first = rows.select("vector", named.alias("h")).orderBy("h", "vector").limit(clusters).collect()
    centroids = whole(np.array([r.vector for r in first], np.float64).reshape(-1, size), scale)
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], _OUT_DDL), centroids
    groups = grouped(centroids, per_group)
    blocks = common.stored(rows.mapInArrow(_blocks(size, scale), _BLOCKS_DDL))
    before, held = centroids, np.zeros((len(centroids), 1 + size), np.int64)
    for turn in range(rounds + 1):
        step = common.stored(blocks.mapInArrow(_assigned(size, centroids, before, groups), _BLOCKS_DDL))
        common.forget(blocks)
        blocks, before = step, centroids
        if turn < rounds:
            held = held + _won(blocks, size, len(centroids))
            full = held[:, 0] > 0
            centroids = np.where(full[:, None], held[:, 1:] // np.maximum(held[:, :1], 1), centroids)
    placed = common.stored(blocks.where("keys is not null").mapInArrow(_placed(size, centroids), _OUT_DDL))
    common.forget(blocks)
    return placed, centroids
