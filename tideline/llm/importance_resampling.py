"""Importance resampling of documents towards a target distribution (operator 11).

Each text's word runs are hashed to buckets. What the texts hold is kept as a sparse document-by-bucket matrix, stored
once as CSR blocks of bounded size. Its column sums are the corpus' distribution; the target's come from its own
matrix. The gains of the buckets, a vector that a parameter bounds, go to every task, and the product of matrix and
gains gives the documents' weights. Scores add Gumbel noise that the id alone decides, so the highest scores are
a weighted sample without replacement; they are ranked by ranges, never in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ranks
from . import common

#: Buckets of the hashed runs, and the longest run of words.
BUCKETS, RUNS = 10_000, 2
#: Words that a document needs in order to be drawn, and the share of such documents that is drawn.
LEAST_WORDS, PERCENT = 20, 25
#: Bytes of a word up to which checksums are joined by tables.
_TABLED = 64
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
#: ``docs``: key, whether it is known, words. ``starts``, ``columns``, ``counts``: the CSR arrays, little-endian.
_BLOCKS = pa.schema([("docs", pa.binary()), ("starts", pa.binary()), ("columns", pa.binary()), ("counts", pa.binary())])
_BLOCKS_DDL = "docs binary, starts binary, columns binary, counts binary"
_DOC = np.dtype([("key", "<i8"), ("known", "?"), ("words", "<i8")])
_WEIGHTS = pa.schema([("doc_key", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])
_WEIGHTS_DDL = "doc_key long, n_words long, n_features long, weight long"


@lru_cache(maxsize=_TABLED + 2)
def _appended(length: int) -> np.ndarray:
    """What appending so many bytes does to a checksum, as four tables by the checksum's bytes: the sum of both parts
    is the xor of the four entries and the checksum of the bytes alone."""
    zeros = bytes(length)
    none = zlib.crc32(zeros)
    bits = np.array([zlib.crc32(zeros, 1 << i) ^ none for i in range(32)], np.uint32)
    tables = np.zeros((4, 256), np.uint32)
    for value in range(256):
        for bit in range(8):
            if value >> bit & 1:
                tables[:, value] ^= bits[bit::8]
    return tables


class _Words:
    """The words of a list of texts: a code for each, and the distinct ones as bytes."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        whole = np.frombuffer(b" ".join(raw).lower(), np.uint8)
        inside = _WORD[whole]
        edge = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
        start, end = edge[::2], edge[1::2]
        bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
        #: Where each text's words begin, and one end.
        self.first = np.searchsorted(start, bounds)
        offsets = np.zeros(len(start) + 1, np.int32)
        np.cumsum(end - start, out=offsets[1:])
        letters = whole[inside]
        coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        self.distinct: list[bytes] = coded.dictionary.to_pylist()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _joined(before: np.ndarray, codes: np.ndarray, parts: list[bytes], own: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums of ``before`` with the coded parts appended."""
    out = np.empty(len(before), np.uint32)
    of = lengths[codes]
    order = np.argsort(of, kind="stable")
    edges = np.r_[np.flatnonzero(np.r_[True, np.diff(of[order]) != 0]), len(order)]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        at = order[a:b]
        if not len(at):
            continue
        if (length := int(of[at[0]])) <= _TABLED:
            tables, c = _appended(length), before[at]
            out[at] = tables[0][c & 255] ^ tables[1][c >> 8 & 255] ^ tables[2][c >> 16 & 255] ^ tables[3][c >> 24] ^ own[codes[at]]
        else:
            out[at] = [zlib.crc32(parts[w], int(c)) for w, c in zip(codes[at].tolist(), before[at].tolist(), strict=True)]
    return out


def features(texts: list[str], runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and the text and bucket of every run of 1 to ``runs`` words, repeats kept."""
    words = _Words(texts)
    n_words = np.diff(words.first)
    rows, columns = [], []
    of_text = np.repeat(np.arange(len(texts)), n_words)
    if len(words.codes):
        alone = np.fromiter(map(zlib.crc32, words.distinct), np.uint32, len(words.distinct))
        spaced = [b" " + w for w in words.distinct]
        own = np.fromiter(map(zlib.crc32, spaced), np.uint32, len(spaced))
        lengths = np.fromiter(map(len, spaced), np.int64, len(spaced))
        sums = alone[words.codes]
        for run in range(1, runs + 1):
            if run > 1:
                sums = _joined(sums[:-1], words.codes[run - 1 :], spaced, own, lengths)
            one_text = of_text[: len(sums)] == of_text[run - 1 :]
            rows.append(of_text[: len(sums)][one_text])
            columns.append((sums[one_text] % np.uint32(buckets)).astype(np.int64))
    return n_words, *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, columns))


def _narrow(values: np.ndarray, most: int) -> np.ndarray:
    return values.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4")


def matrix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """The stored CSR blocks of a table: document by bucket, counts of runs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in common.chunks(batches):
            n_words, rows, columns = features(texts, runs, buckets)
            cells, counts = np.unique(rows * buckets + columns, return_counts=True)
            starts = np.searchsorted(cells, np.arange(len(texts) + 1) * buckets)
            about = np.zeros(len(texts), _DOC)
            about["key"] = [k or 0 for k in keys]
            about["known"] = [k is not None for k in keys]
            about["words"] = n_words
            own = _narrow(cells % buckets, buckets), _narrow(counts, int(counts.max(initial=0)))
            yield from common.rows_out(_BLOCKS, [[about.tobytes()], [starts.astype("<u8").tobytes()], [own[0].tobytes()], [own[1].tobytes()]])

    texts = common.own_columns(docs, key=id_column, text=text_column).select(F.col("key").cast("long"), "text")
    return common.stored(texts.mapInArrow(run, _BLOCKS_DDL))


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents, starts, columns and counts of each block."""
    for docs, starts, columns, counts in zip(*(batch.column(c).to_pylist() for c in _BLOCKS.names), strict=True):
        starts = np.frombuffer(starts, "<u8").astype(np.int64)
        held = max(1, int(starts[-1]))
        yield np.frombuffer(docs, _DOC), starts, np.frombuffer(columns, f"<u{len(columns) // held or 1}").astype(np.int64), np.frombuffer(counts, f"<u{len(counts) // held or 1}").astype(np.int64)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket, summed in tasks, then by bucket; as many numbers as buckets reach the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, columns, counts in _arrays(batch):
                np.add.at(total, columns, counts)
        held = np.flatnonzero(total)
        yield from common.rows_out(pa.schema([("bucket", pa.int64()), ("n", pa.int64())]), [held, total[held]])

    out = np.zeros(buckets, np.int64)
    for bucket, n in blocks.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm by which a bucket is likelier in the target than in the corpus, both smoothed by one
    feature a bucket, floored."""
    buckets = len(corpus)
    all_corpus, all_target = float(corpus.sum() + buckets), float(target.sum() + buckets)
    return np.array([floor(1000 * log((float(t + 1) * all_corpus) / (float(s + 1) * all_target))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_key, n_words, n_features, weight`` per document: the product of matrix and gains over the features' number,
    floored; 0 without features."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, starts, columns, counts in _arrays(batch):
                up = np.zeros((2, len(columns) + 1), np.int64)
                np.cumsum(gain[columns] * counts, out=up[0, 1:])
                np.cumsum(counts, out=up[1, 1:])
                product, n = up[:, starts[1:]] - up[:, starts[:-1]]
                yield from common.rows_out(_WEIGHTS, [pa.array(docs["key"].copy(), pa.int64(), mask=~docs["known"]), docs["words"].copy(), n, product // np.maximum(n, 1)])

    return blocks.mapInArrow(run, _WEIGHTS_DDL)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = 7, id_column: str = "doc_id", text_column: str = "text", target_text: str = "text", runs: int = RUNS, buckets: int = BUCKETS
) -> DataFrame:
    """``doc_key, n_words, n_features, weight, score, rank`` per row of ``docs``; ``rank`` is 1, 2, 3 ... for the
    ``percent`` of documents of ``least_words`` words or more that have the highest scores, ties to the smaller id, else null.

    Null texts hold no words; words are runs of digits, letters a-z after A-Z are lower-cased, and all that is not ASCII.
    Repeated rows are documents of their own, and equal in score where their ids are; a null id draws its noise as the
    empty string and stands before other ids in a tie. An empty target makes rare buckets gain; an empty table gives no row.
    """
    blocks = matrix(docs, id_column, text_column, runs, buckets)
    aims = matrix(target.select(F.lit(None).cast("long").alias("_key"), F.col(f"`{target_text}`").alias("_text")), "_key", "_text", runs, buckets)
    gain = gains(column_sums(blocks, buckets), column_sums(aims, buckets))
    drawn_from = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_key").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((drawn_from + 0.5) / 4294967296.0)))
    scored = common.stored(weights(blocks, gain).withColumn("score", F.col("weight") + noise))
    common.forget(blocks, aims)
    n = scored.where(F.col("n_words") >= least_words).count()
    eligible = scored.where(F.col("n_words") >= least_words)
    placed = ranks.numbered(eligible, [], [F.col("score").desc(), F.col("doc_key").asc()], number="rank")
    rank = F.when(F.col("rank") <= percent * n // 100, F.col("rank"))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", rank).unionByName(rest)


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, id_column: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose ids are drawn; ids should be unique, rows that share a drawn id all stay."""
    found = resample(docs, target, percent, id_column=id_column, **options).where("rank is not null and doc_key is not null")
    return common.by_ids(docs, id_column, found.select("doc_key"), "left_semi")
