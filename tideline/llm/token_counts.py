"""Token counts of whole documents without building their ids (operator 4).

A document's tokens are the sum of the pieces of its pre-tokens. So each text is cut into pre-tokens, the
frequencies are kept per chunk of documents as posting lists, the lists are dealt out by pre-token, every
distinct pre-token is counted once where its postings meet (long lists of one meet in several tasks, so that no task
holds a hot key), and the products are summed per document.
Pre-tokens that are one entry of the vocabulary (a set that the vocabulary bounds) need no meeting: this
keeps the frequent ones, which would be hot keys, out of the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, pretokens

_FREQUENCIES = pa.schema([("block", pa.int64()), ("pretoken", pa.string()), ("postings", pa.binary())])
_FREQUENCIES_DDL = "block long, pretoken string, postings binary"
_SUMS = pa.schema([("block", pa.int64()), ("of_docs", pa.bool_()), ("packed", pa.binary())])
_SUMS_DDL = "block long, of_docs boolean, packed binary"
_OUT_DDL = "key long, n_bytes long, n_tokens long"
#: A chunk's documents, and the sums of some of their pre-tokens.
_DOC = np.dtype([("key", "<i8"), ("known", "?"), ("n_bytes", "<i8"), ("n_tokens", "<i8")])
_SUM = np.dtype([("slot", "<u2"), ("n", "<u4")])
#: Sums that a task holds before it hands them on.
_HELD = 2_000_000
#: Bytes from which a posting list is a long one, and tasks that share those of one pre-token.
_LONG, _SALTS = 1_024, 256
#: Characters of a chunk.
_CHUNK = 8_000_000


def _frequencies(path: str):
    """Per chunk one row of its documents with the tokens counted so far, and per further pre-token one row
    whose postings name a document's slot (two bytes) once for each occurrence."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pretokens.whole_pieces(path)
        block = (TaskContext.get().partitionId() << 32) - 1
        for ids, texts in common.chunks(batches, most=_CHUNK):
            block += 1
            flat: list[str] = []
            lengths = np.empty(len(texts), np.int64)
            docs = np.zeros(len(texts), _DOC)
            for i, (key, text) in enumerate(zip(ids, texts, strict=True)):
                found, special = pretokens.byte_level_pretokens(text, path)
                flat += found
                lengths[i] = len(found)
                docs[i] = (key or 0, key is not None, len(text.encode()), special)
            coded = pa.array(flat, pa.string()).dictionary_encode()
            del flat
            names = coded.dictionary.to_pylist()
            codes = coded.indices.to_numpy()
            slots = np.repeat(np.arange(len(texts), dtype=np.uint16), lengths)
            single = np.fromiter((n in whole for n in names), bool, len(names))
            alone = single[codes] if len(codes) else np.zeros(0, bool)
            docs["n_tokens"] += np.bincount(slots[alone], minlength=len(texts))
            yield from common.rows_out(_FREQUENCIES, [[block], pa.nulls(1, pa.string()), [docs.tobytes()]])
            codes, slots = codes[~alone], slots[~alone]
            order = np.argsort(codes, kind="stable")
            posted = np.bincount(codes, minlength=len(names))
            kept = np.flatnonzero(posted)
            offsets = np.zeros(len(kept) + 1, np.int32)
            np.cumsum(2 * posted[kept], out=offsets[1:])
            postings = pa.Array.from_buffers(pa.binary(), len(kept), [None, pa.py_buffer(offsets), pa.py_buffer(slots[order])])
            yield from common.rows_out(_FREQUENCIES, [np.full(len(kept), block), coded.dictionary.take(pa.array(kept)), postings])

    return run


def _counted(path: str):
    """Rows sorted by pre-token: count each distinct one once, add its pieces to the slots of its postings."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pretokens.tokenizer(path)
        last: tuple[str | None, int] = (None, 0)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            block, slot, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((slot, block))
            block, slot, n = block[order], slot[order], n[order]
            first = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (slot[1:] != slot[:-1])])
            return block[first], slot[first], np.add.reduceat(n, first)

        def out(block, slot, n):
            sums = np.empty(len(n), _SUM)
            sums["slot"], sums["n"] = slot, n
            at = np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(block)]
            packed = [sums[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield from common.rows_out(_SUMS, [block[at[:-1]], [False] * len(packed), packed], 1_000)

        for batch in batches:
            named = pa.compute.is_valid(batch.column("pretoken"))
            if named.false_count:
                docs = batch.filter(pa.compute.invert(named))
                yield from common.rows_out(_SUMS, [docs.column("block"), [True] * docs.num_rows, docs.column("postings")], 10)
                batch = batch.filter(named)
            if not batch.num_rows:
                continue
            coded = batch.column("pretoken").dictionary_encode()
            names = coded.dictionary.to_pylist()
            fresh = names[1:] if names[0] == last[0] else names
            pieces = [len(x.ids) for x in made.encode_batch_fast(fresh, add_special_tokens=False)]
            if len(fresh) < len(names):
                pieces.insert(0, last[1])
            last = (names[-1], pieces[-1])
            each = np.array(pieces, np.int64)[coded.indices.to_numpy()]
            lists = batch.column("postings")
            ends = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
            slot = np.frombuffer(lists.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint16)
            times = np.diff(ends) // 2
            held.append((np.repeat(batch.column("block").to_numpy(), times), slot, np.repeat(each, times)))
            size += len(slot)
            if size > _HELD:
                held = [merged()]
                size = len(held[0][0])
                if size > _HELD // 2:
                    yield from out(*held[0])
                    held, size = [], 0
        if held:
            yield from out(*merged())

    return run


def _summed(chunk: pa.Table) -> pa.Table:
    """A chunk's documents with all sums added; no more than the chunk's own pre-tokens meet here."""
    of_docs = chunk.column("of_docs").to_pylist()
    packed = chunk.column("packed").to_pylist()
    docs = np.frombuffer(packed[of_docs.index(True)], _DOC)
    total = docs["n_tokens"].copy()
    for more, part in zip(of_docs, packed, strict=True):
        if not more:
            sums = np.frombuffer(part, _SUM)
            np.add.at(total, sums["slot"], sums["n"])
    return pa.table({"key": pa.array(docs["key"].copy(), pa.int64(), mask=~docs["known"]), "n_bytes": docs["n_bytes"].copy(), "n_tokens": total})


def token_counts(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens`` per row of ``docs``, as the library's byte-level BPE gives them without
    begin, end or padding; special strings inside a text count one token each, as by default.

    Null texts count as empty (0 tokens). Every input row gives one output row: repeated rows and null ids
    too. An empty table gives an empty result. Texts of any length are counted whole. Rows are told apart
    by partition and position, so a frame that is no scan, whose tasks repeat the same rows when they are run
    again, is stored first.
    """
    texts = common.own_columns(common.scanned(docs), key=id_column, text=text_column).select(F.col("key").cast("long"), "text")
    rows = texts.mapInArrow(_frequencies(tokenizer_path), _FREQUENCIES_DDL)
    # long posting lists, those of pre-tokens that are common but no single entry, meet in several tasks
    salted = F.xxhash64("pretoken", F.pmod(F.xxhash64("block"), F.lit(_SALTS)))
    meets = F.when(F.col("pretoken").isNull(), F.xxhash64("block")).when(F.octet_length("postings") >= _LONG, salted).otherwise(F.xxhash64("pretoken"))
    sums = rows.repartition(meets).sortWithinPartitions("pretoken").mapInArrow(_counted(tokenizer_path), _SUMS_DDL)
    return sums.groupBy("block").applyInArrow(_summed, _OUT_DDL)
