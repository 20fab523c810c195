"""Shards of bounded bytes by extendible hashing (operator 7), in DataFrame functions only.

Each row has 60 hash bits: 40 of its key, then 20 of its place in the files, so that rows of one key can part too, and a
further 60 of its place whenever these are spent. A bucket is a prefix of these bits; one that is over the limit is
split on its next bit, and no other. The directory is computed from byte sums of prefixes, without touching the texts again.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KEY_BITS, ROW_BITS = 40, 20
BITS = KEY_BITS + ROW_BITS
#: Bits by which the directory grows where buckets are still over the limit.
STEP = 8


def coded(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_key, row_file, row_at, code, n_bytes`` per row of a scanned frame; a null id hashes as the empty string,
    a null text has no bytes."""
    rows = common.named_columns(docs, doc_key=id_column, text=text_column)
    of_key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_key").cast("string"), F.lit("")).cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")
    of_row = F.pmod(F.xxhash64("row_file", "row_at"), F.lit(1 << ROW_BITS))
    return rows.select("doc_key", "row_file", "row_at", (F.shiftleft(of_key, ROW_BITS) + of_row).alias("code"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))


def _bits(code: str, depth: str) -> Column:
    """The first ``depth`` of a code's bits as text."""
    return F.expr(f"right(concat(repeat('0', {BITS}), bin({code})), cast({depth} as int))")


def _leaves(cells: DataFrame, above: int, depth: int, limit: int) -> DataFrame:
    """``path, cell, leaf`` per cell of ``depth`` bits that lies in a bucket that fits, the buckets having more than ``above``
    bits; leaf: depth, prefix, shard_bytes, shard_docs.

    A bucket that fits is a leaf unless its parent fits too: each parent meets its two children only. Cells look for their
    leaf among the depths that leaves have, so no key is shared by more cells than lie under one shallowest leaf."""
    at = lambda levels: cells.withColumn("depth", F.explode(levels)).withColumn("prefix", F.expr(f"shiftright(cell, cast({depth} - depth as int))"))
    sums = at(F.sequence(F.lit(above + 1), F.lit(depth))).groupBy("path", "depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
    fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
    parents = fits.select("path", (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("half"))
    leaves = common.stored(fits.withColumn("half", F.shiftright("prefix", 1)).join(parents, ["path", "depth", "half"], "left_anti").drop("half"))
    least = leaves.agg(F.min("depth")).first()[0]
    if least is None:
        return cells.limit(0).select("path", "cell", F.lit(None).cast("struct<depth:int,prefix:long,shard_bytes:long,shard_docs:long>").alias("leaf"))
    found = at(F.sequence(F.lit(least), F.lit(depth))).select("path", "cell", "depth", "prefix").join(leaves, ["path", "depth", "prefix"])
    return found.select("path", "cell", F.struct("depth", "prefix", "shard_bytes", "shard_docs").alias("leaf"))


def shard(docs: DataFrame, limit: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_key, row_file, row_at, n_bytes, shard_id, depth, shard_bytes, shard_docs`` per row of ``docs``.

    Each shard holds at most ``limit`` bytes of text, unless it is a single document above that. A shard is
    the shortest prefix that fits: its parent does not. Rows with equal or null ids are parted by their
    place in the files, however many they are. An empty table gives no row; a limit below one byte is an error.
    """
    if limit < 1:
        raise ValueError("a shard needs room for a byte")
    rows = common.stored(coded(common.scanned(docs), id_column, text_column).withColumn("path", F.lit("")))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    done: DataFrame | None = None
    generation, above, depth = 0, -1, min(BITS, max(1, ceil(log2(max(2, 4 * total / limit)))))
    while True:
        cell = F.shiftright("code", BITS - depth)
        cells = common.stored(rows.groupBy("path", cell.alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs")))
        leaf = common.stored(_leaves(cells, above, depth, limit))
        few = leaf.count() <= common.BROADCAST_IDS
        leaf = leaf.withColumnsRenamed({"path": "_path", "cell": "_cell"})
        laid = rows.withColumn("cell", cell)
        met = laid.join(F.broadcast(leaf) if few else leaf, (laid["path"] == leaf["_path"]) & (laid["cell"] == leaf["_cell"]), "left")
        placed = common.stored(met.drop("cell", "_path", "_cell"))
        name = F.concat(F.lit("shard-"), F.col("path"), _bits("leaf.prefix", "leaf.depth"))
        columns = [name.alias("shard_id"), (F.length("path") + F.col("leaf.depth")).alias("depth"), F.col("leaf.shard_bytes").alias("shard_bytes"), F.col("leaf.shard_docs").alias("shard_docs")]
        here = placed.where("leaf is not null").select("doc_key", "row_file", "row_at", "n_bytes", *columns)
        done = here if done is None else done.union(here)
        rows = placed.where("leaf is null").drop("leaf")
        if rows.isEmpty():
            return done
        above, depth = depth, min(BITS, depth + STEP)
        if above == BITS:  # all bits are spent: rows that still share a bucket get more
            generation += 1
            more = F.shiftrightunsigned(F.xxhash64(F.lit(generation), "row_file", "row_at"), 64 - BITS)
            rows = rows.withColumn("path", F.concat("path", _bits("code", str(BITS)))).withColumn("code", more)
            above, depth = 0, STEP


def write_shards(docs: DataFrame, path: str, limit: int, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Write the rows as Parquet, one folder per shard, all columns kept."""
    docs = common.scanned(docs)
    placed = shard(docs, limit, id_column, text_column).select("row_file", "row_at", "shard_id")
    rows = docs.select("*", *common.row_name(docs)).join(placed, ["row_file", "row_at"]).drop("row_file", "row_at")
    rows.repartition("shard_id").write.partitionBy("shard_id").parquet(path)
