"""Packing of token ids into fixed-length sequences (operator 5).

First-fit decreasing: the bins' free room stands in a tournament tree, so the first bin with room is found
in logarithmic time. Groups of pieces are drawn at random by the position of their document, whatever its
key, and each group is packed on its own. Lengths alone decide the places; each piece's key brings its ids back.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, pretokens

_CUT = regex.compile(pretokens.WORD_LEVEL).findall
#: Words whose ids a Python worker keeps, of those seen last and of those before them.
_CACHE_WORDS = 400_000
#: Documents of each random group, and whole pieces of each further one; a group is packed in one task.
GROUP_ROWS, GROUP_WHOLE = 4_096, 1_024
#: Groups of whole pieces are numbered from here on.
_WHOLE, _WHOLE_OF_TASK = 1 << 30, 1 << 10
_PIECES = pa.schema([("piece", pa.int64()), ("grp", pa.int64()), ("doc_key", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
_PIECES_DDL = "piece long, grp long, doc_key long, start long, length long, doc_tokens long, ids binary"


class _Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers, without special tokens.

    Pre-tokens never reach over white space, so the ids of a text are those of its words one after another:
    each word is cut into pre-tokens, and each pre-token given to the library's model, once while it is
    remembered. Texts with uncommon characters or special strings the library encodes whole.
    """

    def __init__(self, path: str):
        self.library = pretokens.tokenizer(path)
        self.model = self.library.model
        self.special = pretokens.special_strings(path)
        self.words: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.pretokens: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        letters = map(chr, range(0xA1, 0x180))
        self.mapped = str.maketrans({c: "".join(x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(c)) for c in letters})

    def _pretoken(self, one: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(one if one.isascii() else one.translate(self.mapped))]).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isalpha():  # one pre-token, which the words remember
            return self._pretoken(word)
        young, old = self.pretokens
        out = []
        for one in _CUT(word):
            if (ids := young.get(one)) is None:
                ids = young[one] = old.get(one) or self._pretoken(one)
            out.append(ids)
        return b"".join(out)

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        plain = [not pretokens.UNCOMMON.search(t) and not (self.special is not None and self.special.search(t)) for t in texts]
        cut = [t.lower().split() if p else [] for t, p in zip(texts, plain, strict=True)]
        if len(self.words[0]) > _CACHE_WORDS:
            self.words = ({}, self.words[0])
        if len(self.pretokens[0]) > _CACHE_WORDS:
            self.pretokens = ({}, self.pretokens[0])
        young, old = self.words
        for word in set(chain.from_iterable(cut)).difference(young):
            ids = old.get(word)
            young[word] = self._word(word) if ids is None else ids
        for text, words, p in zip(texts, cut, plain, strict=True):
            yield b"".join(map(young.__getitem__, words)) if p else np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> _Encoder:
    """One a Python worker, so that tasks after the first find known words."""
    return _Encoder(path)


def _forget() -> None:
    encoder.cache_clear()
    pretokens.forget()


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pieces(path: str, room: int, end_id: int, groups: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.turn("packing", _forget)
        end = np.array([end_id], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        row, piece, whole = task << 36, task << 36, 0
        for keys, texts in common.chunks(batches, most=2_000_000):
            grp = (_mixed(np.arange(row, row + len(keys)) + 1) % np.uint64(groups)).astype(np.int64).tolist()
            row += len(keys)
            out: list[tuple] = []
            for own, key, ids in zip(grp, keys, encoder(path)(texts), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, room):
                    length, g = min(room, total - start), own
                    if length == room:  # it fills a sequence alone; such pieces of long documents don't swell the random groups
                        g, whole = _WHOLE + task * _WHOLE_OF_TASK + whole // GROUP_WHOLE, whole + 1
                    out.append((piece, g, key, start, length, total, ids[4 * start : 4 * (start + room)]))
                    piece += 1
            yield from common.rows_out(_PIECES, list(zip(*out, strict=True)), 2_000)

    return run


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, longest first, each into the first bin that has room for it."""
    n = len(sizes)
    width = 1 << max(0, n - 1).bit_length()
    tree = [room] * (2 * width)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, at = int(sizes[i]), 1
        while at < width:
            at *= 2
            if tree[at] < size:
                at += 1
        bins[i], offsets[i] = at - width, room - tree[at]
        tree[at] -= size
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
    return bins, offsets


def _packed(room: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_key", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(group.column("length").to_numpy(), room)
        first = group.column("grp")[0].as_py() << 20  # below 2 ** 53
        return group.drop_columns(["grp"]).append_column("sequence_id", pa.array(first + bins)).append_column("offset", pa.array(offsets))

    return run


def pieces(docs: DataFrame, tokenizer_path: str, room: int = 4096, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """``piece, grp, doc_key, start, length, doc_tokens, ids`` (little-endian unsigned 32-bit): each document encoded,
    closed with ``end_id`` and cut at multiples of ``room``, with a key of its own and the random group that it is
    packed in. Keys and groups go by row position: write the pieces once before they are read twice.

    Null texts are empty and give the end id alone. Every row of ``docs`` counts, repeated rows and null ids too;
    an empty table gives no piece.
    """
    texts = common.own_columns(docs, doc_key=id_column, text=text_column).select(F.col("doc_key").cast("long"), "text")
    groups = max(1, -(-docs.count() // group_rows))  # of Parquet, from its footers
    return texts.mapInArrow(_pieces(tokenizer_path, room, end_id, groups), _PIECES_DDL)


def placed(cut: DataFrame, room: int = 4096) -> DataFrame:
    """Each piece with its ``sequence_id`` and ``offset``; other columns pass. Only lengths decide, so a caller that
    needs no ids here drops them, and nothing large is shuffled. Offsets in a sequence run without a gap from 0."""
    schema = T.StructType([f for f in cut.schema if f.name != "grp"]).add("sequence_id", "long").add("offset", "long")
    return cut.groupBy("grp").applyInArrow(_packed(room), schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, room: int = 4096, **options) -> DataFrame:
    """Pieces with their ids and places: ``doc_key, start, length, doc_tokens, ids, sequence_id, offset``.

    The pieces are written once, lengths are placed without ids, and the places, small beside the ids, are joined
    back by the piece's key. Their side is hashed, so ids are shuffled but never sorted or held in a group.
    """
    cut = common.stored(pieces(docs, tokenizer_path, room, **options))
    places = placed(cut.select("piece", "grp", "doc_key", "start", "length"), room).select("piece", "sequence_id", "offset")
    return cut.drop("grp").join(places.hint("shuffle_hash"), "piece").select("doc_key", "start", "length", "doc_tokens", "ids", "sequence_id", "offset")


def sequences(packed: DataFrame, room: int = 4096, pad_id: int = 0) -> DataFrame:
    """The training rows themselves: ``sequence_id, ids array<int>``, padded to ``room`` unless the length
    is a power of two already. A sequence holds at most ``room`` ids, so its pieces meet in small groups."""

    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by("offset")
        ids = np.frombuffer(b"".join(group.column("ids").to_pylist()), "<u4").astype(np.int32)
        if len(ids) & (len(ids) - 1):
            ids = np.r_[ids, np.full(room - len(ids), pad_id, np.int32)]
        return pa.table({"sequence_id": group.column("sequence_id")[:1], "ids": pa.array([ids], pa.list_(pa.int32()))})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(join, "sequence_id long, ids array<int>")
