"""Benchmark decontamination by pigeonhole edit matching (operator 3).

A test item with an error budget of e edits is split into e + 1 pieces: wherever a document holds the item
within that budget, it holds one piece exactly. All pieces of a slice of the benchmark are found in one pass
of an Aho-Corasick automaton; the window around a hit is verified with Myers' bit-parallel edit distance.
Items so short that their budget is none must stand as whole words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edits that an item may have lost or gained, as a share of its length.
ERROR_RATE = 0.08
#: Characters of items in one slice of the benchmark: what a task holds, however large the benchmark.
SLICE_CHARS = 4_000_000

_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normalised(text: str) -> bytes:
    """Lower case; ASCII marks and white space are single spaces."""
    return b" ".join(text.lower().encode().translate(_PLAIN).split())


def budget(length: int, rate: float = ERROR_RATE) -> int:
    return int(length * rate)


def pieces(item: bytes, errors: int) -> list[tuple[int, bytes]]:
    """``errors + 1`` adjoining pieces of nearly equal length, with their offsets."""
    edges = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def myers(item: bytes, text: bytes) -> tuple[int, int]:
    """Least edit distance of the item to any substring of the text, and where the first such one ends."""
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, score = full, 0, len(item)
    least, end = score, 0
    get = masks.get
    for at, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up)
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < least:
                least, end = score, at
        ph <<= 1
        up = ((mh << 1) | ~(xv | ph)) & full
        down = ph & xv & full
    return least, end


class Matcher:
    """Finds the items of one slice in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = []
        self.found = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            item = normalised(text)
            errors = budget(len(item), rate)
            if item and not errors:
                places.setdefault(f" {item.decode('latin-1')} ", []).append((len(self.items), -1))
                self.items.append((key, item, errors))
            elif item:
                for offset, piece in pieces(item, errors):
                    places.setdefault(piece.decode("latin-1"), []).append((len(self.items), offset))
                self.items.append((key, item, errors))
        for piece, at in places.items():
            self.found.add_word(piece, (len(piece), at))
        if places:
            self.found.make_automaton()

    def __call__(self, text: str | None, first: bool = False) -> list[tuple[int, int, int]]:
        """(item key, distance, item length) of each item within its budget, or of any one item."""
        if not self.items or not text:
            return []
        text = normalised(text)
        hits: dict[int, set[int]] = {}
        # a space on either side closes the first and last words; places count from the text's own start
        for end, (length, at) in self.found.iter(f" {text.decode('latin-1')} "):
            for n, offset in at:
                hits.setdefault(n, set()).add(end - length - offset)
        out = []
        for n, starts in hits.items():
            key, item, errors = self.items[n]
            least, reach = errors + 1, None
            for start in sorted(starts):
                if reach is not None and start <= reach:
                    continue
                # one window holds every start up to `errors` after this one
                window = text[max(0, start - errors) : start + len(item) + 2 * errors]
                least = min(least, myers(item, window)[0])
                reach = start + errors
                if least == 0:
                    break
            if least <= errors:
                out.append((key, least, len(item)))
                if first:
                    break
        return out


def _slices(benchmark: DataFrame, id_column: str, text_column: str) -> Iterator[list[tuple[int, str]]]:
    held, size = [], 0
    for key, text in common.own_columns(benchmark, key=id_column, text=text_column).where("text is not null").toLocalIterator():
        if held and size + len(text) > SLICE_CHARS:
            yield held
            held, size = [], 0
        held.append((key, text))
        size += len(text)
    yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """``doc_key, item_key, distance, item_chars``: each document and each test item that it holds within
    the item's error budget, with the least distance found.

    Texts are compared in lower case with runs of marks and white space as one space. Null and empty texts
    match nothing; items whose budget is no error match whole words only. Repeated documents and items give
    repeated rows. The benchmark is taken in slices of bounded size, each one pass over the documents.
    """
    texts = common.own_columns(docs, doc_key=id_column, text=text_column).select(F.col("doc_key").cast("long"), "text")
    schema = pa.schema([("doc_key", pa.int64()), ("item_key", pa.int64()), ("distance", pa.int64()), ("item_chars", pa.int64())])
    out = None
    for items in _slices(benchmark, item_column, item_text_column):

        def run(batches: Iterable[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            common.turn("benchmark items")
            match = Matcher(items, rate)
            for keys, parts in common.chunks(batches):
                rows = [(key, *hit) for key, text in zip(keys, parts, strict=True) for hit in match(text)]
                if rows:
                    yield from common.rows_out(schema, list(zip(*rows, strict=True)))

        found = texts.mapInArrow(run, "doc_key long, item_key long, distance long, item_chars long")
        out = found if out is None else out.union(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item; nothing is shuffled."""
    for items in _slices(benchmark, item_column, item_text_column):

        def test(items=items):
            common.turn("benchmark items")
            match = Matcher(items, rate)
            return lambda texts: [not match(t, first=True) for t in texts]

        docs = common.rows_where(docs, text_column, test)
    return docs
