"""Near-duplicate documents by HyperMinHash (operator 9).

A document's shingles are spread over 128 buckets; of the smallest hash in each, its count of leading zeros
and ten bits of mantissa are kept (two bytes). Bands of five registers give buckets of candidates. Each
document is first compared with the best of its buckets' smallest documents and linked where the full sets
say so; what buckets then still hold of different components is compared in blocks by the estimate, which
is corrected for chance collisions of registers, and confirmed on full sets. So no bucket's pairs are
written out, and no link between components is passed over.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components, shingles

REGISTERS = 128
MANTISSA_BITS = 10
BANDS, ROWS = 25, 5
_EMPTY = 0xFFFF
#: Standard errors by which an estimate may lie below the threshold and still be confirmed on full sets.
ERRORS = 4.0
#: Members of a bucket that one block holds, and about how many shingles, whose texts meet in one task.
BLOCK, BLOCK_SHINGLES = 256, 2_000_000
#: Classes that one copy of their head's sketch and text meets.
HEAD = 4_096
#: Rows and shingles of small buckets, on average, that one task takes together; pairs that it looks at together.
SHELF, SHELF_SHINGLES, _PAIRS = 1_000, 500_000, 20_000
_LONGS = ("row_file", "row_at", "doc_key", "n_shingles", "set_a", "set_b")
_SKETCH = pa.schema([*((c, pa.int64()) for c in _LONGS), ("registers", pa.binary())])
_SKETCH_DDL = ", ".join(f"{c} long" for c in _LONGS) + ", registers binary"


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 16-bit registers per set of ascending hashes: leading zeros and mantissa of each bucket's
    smallest hash, or the mark of an empty bucket."""
    bits = (REGISTERS - 1).bit_length()
    edges = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - bits)
    least = np.zeros((len(sets), REGISTERS), np.uint64)
    filled = np.zeros((len(sets), REGISTERS), bool)
    for i, own in enumerate(sets):
        at = np.searchsorted(own, edges)
        has = np.diff(np.r_[at, len(own)]) > 0
        least[i, has] = own[at[has]]
        filled[i] = has
    least <<= np.uint64(bits)
    zeros = 53 - np.frexp((least >> np.uint64(11)).astype(np.float64))[1]
    mantissa = (least << (zeros.astype(np.uint64) + np.uint64(1))) >> np.uint64(64 - MANTISSA_BITS)
    code = (zeros << MANTISSA_BITS) + mantissa.astype(np.int64)
    return np.where(filled, code, _EMPTY).astype(np.uint16)


def band_keys(codes: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band; an empty register takes the value of the next filled one."""
    n = len(codes)
    at = np.where(codes != _EMPTY, np.arange(REGISTERS), 1 << 20)
    twice = np.concatenate([at, at + REGISTERS], axis=1)
    following = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][:, :REGISTERS] % REGISTERS
    full = np.take_along_axis(codes, following, axis=1).astype(np.uint64)[:, : BANDS * ROWS].reshape(n, BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS)).copy()
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            keys = shingles.mixed(keys * np.uint64(65599) + full[:, :, r] + np.uint64(1))
    return keys


@lru_cache(maxsize=1)
def _chance() -> tuple[np.ndarray, np.ndarray]:
    """Chance that unrelated sets of given sizes agree in a register, on a grid of log2 sizes."""
    zeros = np.arange(40)
    step = np.arange(1 << MANTISSA_BITS) / (1 << MANTISSA_BITS)
    low = (2.0 ** -(zeros + 1.0))[:, None] * (1 + step)
    high = low + (2.0 ** -(zeros + 1.0))[:, None] / (1 << MANTISSA_BITS)
    grid = np.arange(0, 21, 2.0)
    mass = []
    for size in 2.0**grid:
        each = max(1.0, size / REGISTERS)
        mass.append((np.exp(each * np.log1p(-low)) - np.exp(each * np.log1p(-np.minimum(high, 1 - 1e-16)))).ravel())
    mass = np.array(mass)
    return grid, mass @ mass.T


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimate of register rows pair by pair, corrected for chance collisions, and the number of
    registers that it rests on."""
    used = (a != _EMPTY) | (b != _EMPTY)
    same = ((a == b) & used).sum(-1)
    used = np.maximum(used.sum(-1), 1)
    grid, table = _chance()
    i, j = (np.clip(np.rint(np.log2(np.maximum(s, 1)) / 2).astype(int), 0, len(grid) - 1) for s in (size_a, size_b))
    chance = table[i, j]
    return (same / used - chance) / (1 - chance), used


def plausible(a, b, size_a, size_b, least: float) -> np.ndarray:
    """Pairs that may reach the threshold: by size, and by the estimate less its error."""
    jaccard, used = estimate(a, b, size_a, size_b)
    sized = np.minimum(size_a, size_b) >= least * np.maximum(size_a, size_b) - 1e-9
    return sized & (jaccard >= least - ERRORS * np.sqrt(least * (1 - least) / used))


def _sketched(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.turn("near-duplicates")
        for keys, texts in common.chunks(batches, text_at=3, most=2_000_000):
            for at in range(0, len(keys), 2_000):
                sets = list(shingles.shingle_sets(texts[at : at + 2_000], words))
                digests = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
                marks = np.frombuffer(digests, np.int64).reshape(-1, 2)
                names = zip(*keys[at : at + 2_000], strict=True)
                yield from common.rows_out(_SKETCH, [*names, [len(s) for s in sets], marks[:, 0], marks[:, 1], [c.tobytes() for c in registers(sets)]])

    return run


def _banded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("band", pa.int64()), ("doc", pa.int64())])
    for batch in batches:
        codes = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        yield from common.rows_out(schema, [band_keys(codes).view(np.int64).ravel(), np.repeat(batch.column("doc").to_numpy(), BANDS)])


def _chosen(least: float):
    """Pairs that the estimate leaves open."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("rx", "ry"))
            keep = plausible(a, b, batch.column("nx").to_numpy(), batch.column("ny").to_numpy(), least)
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(pa.array(keep)), batch.column("y").filter(pa.array(keep))], schema=schema)

    return run


def _met(band: np.ndarray, block: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of rows that meet, some thousands of pairs at a time: the two blocks of one bucket, or the
    members of each bucket with the ones after them."""
    if low != high:
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        for part in np.array_split(left, max(1, len(left) * len(right) // _PAIRS)):
            yield np.repeat(part, len(right)), np.tile(right, len(part))
        return
    end = np.searchsorted(band, band, "right")
    after = end - np.arange(len(band)) - 1  # members behind each row in its own bucket
    for part in np.array_split(np.arange(len(band)), max(1, int(after.sum()) // _PAIRS)):
        x = np.repeat(part, after[part])
        start = np.cumsum(after[part]) - after[part]
        yield x, x + 1 + np.arange(len(x)) - np.repeat(start, after[part])


def _open_pairs(group: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of a group, sorted by band, that lie in different components, that the estimate leaves
    open, and that meet in no earlier band."""
    band, comp, n, block = (group.column(c).to_numpy() for c in ("band", "component", "n_shingles", "block"))
    codes = np.frombuffer(b"".join(group.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    keys = band_keys(codes).view(np.int64)
    own = (keys == band[:, None]).argmax(axis=1)
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x, y in _met(band, block, group.column("low")[0].as_py(), group.column("high")[0].as_py()):
        likely = (comp[x] != comp[y]) & (np.minimum(n[x], n[y]) >= least * np.maximum(n[x], n[y]) - 1e-9)
        x, y = x[likely], y[likely]
        likely = plausible(codes[x], codes[y], n[x], n[y], least)
        x, y = x[likely], y[likely]
        first = (keys[x] == keys[y]).argmax(axis=1) == own[x]
        xs.append(x[first])
        ys.append(y[first])
    return np.concatenate(xs), np.concatenate(ys)


def _open_members(least: float):
    """Of a group's buckets, the members that have an open pair; never the pairs."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("band")
        x, y = _open_pairs(group, least)
        return group.take(pa.array(np.union1d(x, y)))

    return run


def _joined(words: int, percent: int):
    """Components of a group's buckets that full sets join, each with the smallest that it is joined to."""
    least = percent / 100

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("band")
        x, y = _open_pairs(group, least)
        texts = [zlib.decompress(z).decode() for z in group.column("zipped").to_pylist()]
        sets = [s for at in range(0, len(texts), 64) for s in shingles.shingle_sets(texts[at : at + 64], words)]
        sizes = np.array([len(s) for s in sets])
        names, comp = np.unique(group.column("component").to_numpy(), return_inverse=True)
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.unique(x):
            for part in np.array_split(y[x == i], max(1, int((x == i).sum()) // 64)):
                if len(part):
                    both = np.concatenate([sets[j] for j in part])
                    at = np.minimum(np.searchsorted(sets[i], both), len(sets[i]) - 1)
                    shared = np.add.reduceat(sets[i][at] == both, np.cumsum(np.r_[0, sizes[part][:-1]]), dtype=np.int64)
                    same = part[100 * shared >= percent * (sizes[i] + sizes[part] - shared)]
                    us.append(np.full(len(same), comp[i]))
                    vs.append(comp[same])
        root = components.local_roots(len(names), np.concatenate(us), np.concatenate(vs))
        moved = np.flatnonzero(root != np.arange(len(names)))
        return pa.table({"u": names[moved], "v": names[root[moved]]})

    return run


def _zipped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc", pa.int64()), ("zipped", pa.binary())])
    for batch in batches:
        for part in range(0, batch.num_rows, 500):
            texts = batch.column("text").slice(part, 500).to_pylist()
            yield from common.rows_out(schema, [batch.column("doc").slice(part, 500), [zlib.compress((t or "").encode(), 1) for t in texts]])


def _confirmed(words: int, least: int):
    """Pairs whose full sets have ``100 * intersection >= least * union``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])
        known: dict[int, np.ndarray] = {}

        def own(doc: int, zipped: bytes) -> np.ndarray:
            if doc not in known:
                if len(known) > 64:
                    known.clear()
                known[doc] = next(shingles.shingle_sets([zlib.decompress(zipped).decode()], words))
            return known[doc]

        for batch in batches:
            xs, ys = [], []
            for x, y, zx, zy in zip(*(batch.column(c) for c in ("x", "y", "zx", "zy")), strict=True):
                a, b = own(x.as_py(), zx.as_py()), own(y.as_py(), zy.as_py())
                both = np.concatenate([a, b])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= least * (len(both) - shared):
                    xs.append(x.as_py())
                    ys.append(y.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], schema=schema)

    return run


def _grouped(docs: DataFrame, words: int, percent: int, id_column: str, text_column: str) -> DataFrame:
    """``row_file, row_at, doc_key, n_shingles, component, component_id`` per row of a scanned frame; the component
    is null for rows without a shingle."""
    steps = common.Steps()
    least = percent / 100
    texts = common.named_columns(docs, doc_key=id_column, text=text_column)
    texts = texts.select("row_file", "row_at", F.col("doc_key").cast("long"), "text")
    sketches = steps(texts.mapInArrow(_sketched(words), _SKETCH_DDL))
    # a class of equal sets is one node, whatever ids its rows have; its number is fixed by writing it
    classes = sketches.where("n_shingles > 0").groupBy("set_a", "set_b").agg(
        F.min("doc_key").alias("least_key"), F.min(F.struct("row_file", "row_at")).alias("row"),
        F.max("n_shingles").alias("n_shingles"), F.max("registers").alias("registers"),
    )
    classes = steps(classes.withColumn("doc", F.monotonically_increasing_id()))
    sized = classes.select("doc", "n_shingles", "registers")

    bands = steps(sized.select("doc", "registers").mapInArrow(_banded, "band long, doc long"))
    heads = bands.groupBy("band").agg(F.min("doc").alias("head"), F.max("doc").alias("last")).where("head < last").drop("last")
    shared = steps(bands.join(heads, "band"))
    met = classes.select("row.*", "doc").join(shared.select("doc").distinct(), "doc", "left_semi")
    named = common.by_ids(texts, ["row_file", "row_at"], steps(met.select("row_file", "row_at", "doc")), "inner")
    zipped = steps(named.select("doc", "text").mapInArrow(_zipped, "doc long, zipped binary"))

    first = shared.where("head <> doc").groupBy(F.col("doc").alias("y"), F.col("head").alias("x")).count()
    first = steps(first.groupBy("y").agg(F.max_by("x", F.struct("count", -F.col("x"))).alias("x")))
    # a head that many classes choose meets them in parts, to each of which its sketch and text go once
    hot = steps(first.groupBy("x").count().where(F.col("count") > HEAD).select(F.col("x").alias("of"), F.ceil(F.col("count") / F.lit(HEAD)).cast("int").alias("parts")))
    few = hot.count() <= common.BROADCAST_IDS

    def parted(frame: DataFrame, part) -> DataFrame:
        met = frame.join(F.broadcast(hot) if few else hot, F.col("x") == F.col("of"), "left")
        return met.withColumn("part", part(F.coalesce("parts", F.lit(1)))).drop("of", "parts")

    def dealt(pairs: DataFrame) -> DataFrame:
        return parted(pairs, lambda n: F.pmod(F.xxhash64("y"), n).cast("int"))

    def every(heads: DataFrame) -> DataFrame:
        return parted(heads, lambda n: F.explode(F.sequence(F.lit(0), n - 1)))

    chosen = dealt(first).join(every(sized.toDF("x", "nx", "rx")), ["x", "part"]).drop("part").join(sized.toDF("y", "ny", "ry"), "y")
    chosen = steps(chosen.mapInArrow(_chosen(least), "x long, y long"))
    pairs = dealt(chosen).join(every(zipped.toDF("x", "zx")), ["x", "part"]).drop("part").join(zipped.toDF("y", "zy"), "y")
    links = steps(pairs.mapInArrow(_confirmed(words, percent), "x long, y long"))
    found = components.components(links)

    placed = shared.select("band", "doc").distinct().join(found, F.col("doc") == F.col("node"), "left")
    placed = placed.select("band", "doc", F.coalesce("component", "doc").alias("component")).join(sized, "doc")
    # a bucket's largest component is compared with the rest, never with itself: its members are in one component already
    parts = placed.groupBy("band", "component").agg(F.count("*").alias("k"), F.sum("n_shingles").alias("s")).groupBy("band")
    spread = parts.agg(
        F.max_by(F.struct("component", "k", "s"), F.struct("k", "component")).alias("main"),
        F.sum("k").alias("size"), F.sum("s").alias("load"), F.count("*").alias("n"),
    ).where("n > 1")
    spread = steps(spread)
    rows, load = spread.agg(F.sum("size"), F.sum("load")).first()
    shelves = max(1, (rows or 0) // SHELF, (load or 0) // SHELF_SHINGLES)
    of_main = F.col("component") == F.col("main.component")

    def blocks(members, load):
        """Blocks bounded by their members and by the length of their texts."""
        return F.greatest(F.ceil(members / F.lit(BLOCK)), F.ceil(load / F.lit(BLOCK_SHINGLES))).cast("int")

    mains = blocks(F.col("main.k"), F.col("main.s"))
    rests = blocks(F.col("size") - F.col("main.k"), F.col("load") - F.col("main.s"))
    block = F.when(of_main, rests + F.pmod(F.xxhash64("doc"), mains).cast("int")).otherwise(F.pmod(F.xxhash64("doc"), rests).cast("int"))
    others = F.sequence(F.lit(0), F.when(of_main, rests).otherwise(rests + mains) - 1)
    # a bucket of one block shares its task with others: main and rest are compared in it as one
    small = blocks(F.col("size"), F.col("load")) == 1
    blocked = placed.join(spread, "band").withColumn("small", small)
    blocked = blocked.withColumn("block", F.when(F.col("small"), 0).otherwise(block))
    blocked = blocked.withColumn("other", F.explode(F.when(F.col("small"), F.array(F.lit(0))).otherwise(others)))
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    shelf = F.when(F.col("small"), F.pmod("band", F.lit(shelves))).otherwise(F.col("band")).alias("shelf")
    blocked = blocked.select(shelf, low, high, "band", "block", "doc", "component", "n_shingles", "registers")
    key = ["shelf", "low", "high"]
    members = steps(blocked.groupBy(key).applyInArrow(_open_members(least), blocked.schema))
    last = members.join(zipped, "doc").groupBy(key).applyInArrow(_joined(words, percent), "u long, v long")

    merged = components.components(last)
    final = found.join(merged.toDF("component", "further"), "component", "left").select("node", F.coalesce("further", "component").alias("component"))
    final = final.union(merged.join(found, "node", "left_anti"))
    whole = classes.select("set_a", "set_b", "doc", "least_key").join(final, F.col("doc") == F.col("node"), "left")
    whole = steps(whole.select(F.col("set_a").alias("sa"), F.col("set_b").alias("sb"), F.coalesce("component", "doc").alias("component"), "least_key"))
    names = whole.groupBy("component").agg(F.min("least_key").alias("component_id"))
    whole = whole.drop("least_key").join(names, "component")
    same = (F.col("set_a") == F.col("sa")) & (F.col("set_b") == F.col("sb")) & (F.col("n_shingles") > 0)
    rows = sketches.drop("registers").join(whole, same, "left")
    rows = rows.withColumn("component_id", F.when(F.col("component").isNull(), F.col("doc_key")).otherwise(F.col("component_id")))
    steps.frames += [found, merged]
    return steps.result(rows.select("row_file", "row_at", "doc_key", "n_shingles", "component", "component_id"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_key, n_shingles, component_id, kept`` per row of ``docs``.

    Documents link where their sets of shingles have a Jaccard similarity of ``percent`` or more; component_id
    is the smallest id reachable by links. Null, empty and blank texts have no shingle and link with nothing;
    shorter texts than a shingle are one. A null id names no component: among rows with ids such a row is not
    kept, and a group of null ids alone has a null component. Rows that repeat an id are each their own text.
    Exact copies are one class from the start, however many.
    """
    rows = _grouped(common.scanned(docs), words, percent, id_column, text_column)
    return rows.select("doc_key", "n_shingles", "component_id").withColumn("kept", F.expr("doc_key <=> component_id"))


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, but one row alone of each group of linked ones: that of the smallest id
    (null ids last), of equal ids the first in its file. Rows without a shingle stay. Rows are told apart by their
    place in the files, so neither repeated nor null ids matter."""
    docs = common.scanned(docs)
    rows = _grouped(docs, words, percent, id_column, text_column).where("component is not null")
    order = F.struct(F.col("doc_key").isNull().alias("unnamed"), "doc_key", "row_file", "row_at")
    stay = rows.groupBy("component").agg(F.min(order).alias("first")).select("first.row_file", "first.row_at")
    dropped = common.stored(rows.select("row_file", "row_at").join(stay, ["row_file", "row_at"], "left_anti"))
    file_, at = common.row_name(docs)
    named = docs.select("*", file_.alias("__row_file"), at.alias("__row_at"))
    return common.by_ids(named, ["__row_file", "__row_at"], dropped, "left_anti").select(*[f"`{c}`" for c in docs.columns])
