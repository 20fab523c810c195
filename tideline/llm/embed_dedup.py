"""Near-duplicate vectors by random-hyperplane signs in several tables (operator 1).

Equal vectors are one class from the start. In each table a class falls into the bucket of its label and its signs, whose
number grows with the logarithm of the classes. The members of a bucket are compared block by block, by all their signs first, and where these allow a
link exactly, in double precision; what a block
returns are counts of links and one star per cluster, never its pairs. A pair that meets in several tables
is counted in the first of them.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, log, log1p, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, components

#: Signs of a table at least and at most, and the share of links at the threshold that all tables together may miss.
LEAST_BITS, MOST_BITS, MISSED = 16, 30, 4e-5
#: Standard errors by which signs may differ more than at the threshold: beyond, a pair in a billion is a link.
ERRORS = 6.0
#: Members of a bucket that one block holds, and rows of small buckets that one task takes together.
BLOCK, SHELF = 512, 1_000


def shape(classes: int, least: float) -> tuple[int, int]:
    """Signs of a table, so that a bucket of vectors that are not alike stays small however many there are, and tables, so
    that a link at the threshold is missed no more often than stated: at 0.98 a sign agrees with probability 0.936, which
    takes 24 tables of 16 signs, or 68 of 30."""
    bits = min(MOST_BITS, max(LEAST_BITS, ceil(log2(max(2, classes)))))
    met = (1 - np.arccos(min(1.0, least)) / np.pi) ** bits
    return bits, max(1, ceil(log(MISSED) / log1p(-met))) if met < 1 else 1


def _kind(bits: int) -> str:
    return "<u2" if bits <= 16 else "<u4"


@lru_cache(maxsize=16)
def _planes(size: int, seed: int, signs: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, signs))


def _signed(seed: int, bits_of: int, tables: int):
    """Add each class's signature: a code of its signs for every table."""
    schema = pa.schema([("rep", pa.int64()), ("copies", pa.int64()), ("label_key", pa.int64()), ("vector", pa.binary()), ("signs", pa.binary())])

    def run(batches):
        weights = (1 << np.arange(bits_of)).astype(np.int64)
        for batch in batches:
            vectors = [np.array(v, np.float64) for v in batch.column("vector").to_pylist()]
            units, signs = [None] * len(vectors), [None] * len(vectors)
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                own = np.array([vectors[i] for i in at])
                own /= np.abs(own).max(axis=1, keepdims=True)
                own /= np.sqrt((own * own).sum(axis=1, keepdims=True))
                bits = (own @ _planes(int(size), seed, tables * bits_of) >= 0).reshape(len(at), tables, bits_of)
                codes = (bits @ weights).astype(_kind(bits_of))
                for k, i in enumerate(at):
                    units[i], signs[i] = own[k].tobytes(), codes[k].tobytes()
            yield from common.rows_out(schema, [batch.column("rep"), batch.column("copies"), batch.column("label_key"), pa.array(units, pa.binary()), pa.array(signs, pa.binary())])

    return run


def _tabled(bits: int, tables: int):
    schema = pa.schema([("tab", pa.int32()), ("sign", pa.int32()), ("label_key", pa.int64()), ("rep", pa.int64())])

    def run(batches):
        for batch in batches:
            signs = np.frombuffer(b"".join(batch.column("signs").to_pylist()), _kind(bits)).astype(np.int32)
            n = batch.num_rows
            labels, reps = (np.repeat(batch.column(c).to_numpy(), tables) for c in ("label_key", "rep"))
            yield from common.rows_out(schema, [np.tile(np.arange(tables, dtype=np.int32), n), signs, labels, reps])

    return run


def _edges(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal rows begin and end."""
    turn = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        turn |= c[1:] != c[:-1]
    edge = np.flatnonzero(np.r_[True, turn, True]).tolist()
    return list(zip(edge[:-1], edge[1:], strict=True))


def _open(least: float, bits_of: int, tables: int):
    """Of a group's buckets, the members that by all their signs may have a link, in the first table that holds it."""
    share = np.arccos(min(1.0, least)) / np.pi
    whole = tables * bits_of
    most = whole * share + ERRORS * np.sqrt(whole * share * (1 - share))
    size = 8 * np.dtype(_kind(bits_of)).itemsize

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("label_key", "ascending"), ("tab", "ascending"), ("sign", "ascending")])
        lab, tab, sign, block = (group.column(c).to_numpy() for c in ("label_key", "tab", "sign", "block"))
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        raw = np.frombuffer(b"".join(group.column("signs").to_pylist()), _kind(bits_of)).reshape(-1, tables)
        keep = np.zeros(len(raw), bool)
        for a, b in _edges(lab, tab, sign):
            bits = np.unpackbits(raw[a:b].view(np.uint8), axis=1, bitorder="little").reshape(b - a, tables, size)[:, :, :bits_of]
            bits = bits.reshape(b - a, whole).astype(np.float32) * 2 - 1
            left, right = np.flatnonzero(block[a:b] == low), np.flatnonzero(block[a:b] == high)
            near = bits[left] @ bits[right].T >= whole - 2 * most
            if low == high:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            i, j = left[i], right[j]
            first = (raw[a + i] == raw[a + j]).argmax(axis=1) == tab[a]
            keep[a + i[first]] = keep[a + j[first]] = True
        return group.filter(pa.array(keep)).drop_columns(["signs"])

    return run


def _linked(least: float, bits_of: int, tables: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("label_key", "ascending"), ("tab", "ascending"), ("sign", "ascending"), ("rep", "ascending")])
        lab, tab, sign, rep, copies, block = (group.column(c).to_numpy() for c in ("label_key", "tab", "sign", "rep", "copies", "block"))
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        signs = np.frombuffer(b"".join(group.column("signs").to_pylist()), _kind(bits_of)).reshape(-1, tables)
        vectors = group.column("vector").combine_chunks()
        reps, links, roots = [], [], []
        for a, b in _edges(lab, tab, sign):
            own = np.frombuffer(b"".join(vectors[a:b].to_pylist()), np.float64).reshape(b - a, -1)
            left, right = np.flatnonzero(block[a:b] == low), np.flatnonzero(block[a:b] == high)
            near = own[left] @ own[right].T >= least
            if low == high:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            i, j = left[i], right[j]
            first = (signs[a + i] == signs[a + j]).argmax(axis=1) == tab[a]
            i, j = i[first], j[first]
            if not len(i):
                continue
            count = np.zeros(b - a, np.int64)
            np.add.at(count, i, copies[a + j])
            np.add.at(count, j, copies[a + i])
            at = np.flatnonzero(count)
            reps.append(rep[a + at])
            links.append(count[at])
            roots.append(rep[a + components.local_roots(b - a, i, j)[at]])
        if not reps:
            reps = links = roots = [np.zeros(0, np.int64)]
        return pa.table({"rep": np.concatenate(reps), "links": np.concatenate(links), "root": np.concatenate(roots)})

    return run


def near_vectors(vectors: DataFrame, least: float = 0.98, seed: int = 7, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """``vec_key, n_links, component_id, kept`` per row of ``vectors``.

    Rows of equal, non-null label link where the cosine of their vectors is ``least`` or more. Vectors that
    are null, empty or zero, or that hold null or non-finite parts, link with nothing, as do rows without an
    id or label, and vectors of different lengths; such a row is its own component and is kept. Rows that repeat an id with
    another vector share that id's links.
    """
    rows = common.own_columns(vectors, vec_key=id_column, vector=vector_column, label=label_column).select(F.col("vec_key").cast("long"), "vector", "label")
    sound = F.col("vec_key").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    marked = rows.withColumn("fa", F.when(F.col("sound"), F.xxhash64("label", "vector"))).withColumn("fb", F.when(F.col("sound"), F.xxhash64(F.lit(1), "vector", "label")))
    classes = marked.where("sound").groupBy("fa", "fb").agg(F.min("vec_key").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"), F.first(F.xxhash64("label", F.size("vector"))).alias("label_key"))
    classes = common.stored(classes)
    bits, tables = shape(classes.count(), least)
    units = common.stored(classes.select("rep", "copies", "label_key", "vector").mapInArrow(_signed(seed, bits, tables), "rep long, copies long, label_key long, vector binary, signs binary"))

    bucket = ["label_key", "tab", "sign"]
    tabled = units.select("label_key", "rep", "signs").mapInArrow(_tabled(bits, tables), "tab int, sign int, label_key long, rep long")
    sizes = tabled.groupBy(bucket).agg(F.count("*").alias("size")).where("size > 1")
    members = common.stored(tabled.join(sizes, bucket))
    shelves = max(1, members.count() // SHELF)
    n_blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    spread = members.withColumn("block", F.pmod(F.xxhash64("rep"), n_blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    key = F.xxhash64(*bucket)
    spread = spread.select(*bucket, "rep", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.when(F.col("size") <= BLOCK, F.pmod(key, F.lit(shelves))).otherwise(key).alias("shelf"))
    # signs alone (48 bytes) go to every table and block; the vectors go where a link may be counted
    signs = units.select("rep", "signs")
    signed = spread.join(signs, "rep")
    ddl = T.StructType([f for f in signed.schema if f.name != "signs"])
    open_ = common.stored(signed.groupBy("shelf", "low", "high").applyInArrow(_open(least, bits, tables), ddl))
    found = common.stored(open_.join(units.drop("label_key"), "rep").groupBy("shelf", "low", "high").applyInArrow(_linked(least, bits, tables), "rep long, links long, root long"))

    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components.components(found.select("rep", "root"))
    nodes = classes.select(F.col("fa").alias("ca"), F.col("fb").alias("cb"), "rep", "copies").join(counts, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
    nodes = nodes.select("ca", "cb", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = marked.select("vec_key", "fa", "fb").join(nodes, (F.col("fa") == F.col("ca")) & (F.col("fb") == F.col("cb")), "left")
    out = out.select("vec_key", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_key").alias("component_id"))
    return out.withColumn("kept", F.expr("vec_key <=> component_id"))
