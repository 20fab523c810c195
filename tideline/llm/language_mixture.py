"""Languages of documents as mixtures (operator 8).

Character trigrams, hashed into a fixed number of buckets, are counted per language over labelled rows. A
document's language shares are then estimated by expectation-maximisation from the likelihoods of its
trigrams; languages join the set one by one while the penalised likelihood grows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 15
#: Labelled rows of one language, about, from which its likelihoods are learned; a documented bound. A language
#: of fewer rows is learned from all of them, so that none is lost as the table grows.
LANGUAGE_ROWS = 5_000
#: Occurrences that a language borrows from the mean of all, so that one of few rows isn't a flat one.
BORROWED = 300.0
#: Rounds of expectation-maximisation, and by how much trigrams count as dependent in the penalty.
ROUNDS, DEPENDENCE = 12, 4.0
UNKNOWN = "und"

_LETTERS = np.array([chr(c).isalpha() for c in range(0x250)])


def trigram_counts(text: str) -> tuple[np.ndarray, int]:
    """Counts by bucket of a text's letter trigrams, other characters as single spaces; and its letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = _LETTERS[np.minimum(points, 0x24F)]
    high = np.flatnonzero(points >= 0x250)
    if len(high):
        own, back = np.unique(points[high], return_inverse=True)
        letter[high] = np.array([chr(c).isalpha() for c in own])[back]
    letters = int(letter.sum())
    points = np.where(letter, points, 32)
    keep = np.r_[True, letter[1:] | letter[:-1]][: len(points)]
    points = np.r_[32, points[keep], 32].astype(np.uint64)
    if not letters:
        return np.zeros(BUCKETS, np.int64), 0
    with np.errstate(over="ignore"):
        code = points[:-2] * np.uint64(0x9E3779B97F4A7C15) + points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[2:] * np.uint64(0x165667B19E3779F9)
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.bincount((code >> np.uint64(49)).astype(np.int64), minlength=BUCKETS), letters


def learn(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", language_rows: int = LANGUAGE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their log-likelihoods by bucket, from about ``language_rows`` rows of each language that have a
    text and a label, drawn by a hash of the row's place (all, where there are fewer; one is enough). The result
    holds 128 KB a language, so its size is bounded by the set of labels. Texts without a letter teach nothing."""
    docs = common.scanned(docs)
    rows = common.named_columns(docs, text=text_column, lang=lang_column).where("text is not null and lang is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    parts = 1 << 20
    shares = [x for lang, n in sorted(sizes.items()) if n > language_rows for x in (F.lit(lang), F.lit(int(parts * language_rows / n)))]
    if shares:
        place = F.pmod(F.xxhash64("row_file", "row_at"), F.lit(parts))
        rows = rows.where(place < F.coalesce(F.element_at(F.create_map(*shares), F.col("lang")), F.lit(parts)))
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.turn("languages")
        held: dict[str, np.ndarray] = {}

        def out():
            for lang, counts in held.items():
                at = np.flatnonzero(counts)
                yield from common.rows_out(schema, [[lang] * len(at), at.astype(np.int32), counts[at]])

        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                counts, letters = trigram_counts(text.as_py())
                if letters:
                    held[lang] = held.get(lang, 0) + counts
            if len(held) > 64:
                yield from out()
                held = {}
        yield from out()

    sums = rows.select("text", "lang").mapInArrow(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = sums.toArrow()
    names = sorted(sums.column("lang").unique().to_pylist())
    places = {name: i for i, name in enumerate(names)}
    table = np.zeros((len(names), BUCKETS), np.float32)
    for part in sums.to_batches():
        at = np.array([places[x] for x in part.column("lang").to_pylist()], int)
        table[at, part.column("bucket").to_numpy()] = part.column("n").to_numpy()
    return names, likelihoods(table)


def likelihoods(table: np.ndarray) -> np.ndarray:
    """Log-likelihoods from counts by language and bucket. Each language borrows from the mean of all languages,
    which gives even a bucket that none has seen a little."""
    if not len(table):
        return table
    totals = table.sum(axis=1, keepdims=True)
    mean = (table / np.maximum(totals, 1)).mean(axis=0) * 0.9 + 0.1 / BUCKETS
    return np.log((table + BORROWED * mean) / (totals + BORROWED)).astype(np.float32)


def _mixture(likely: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares of the languages (rows of ``likely``) and the log-likelihood of the counts."""
    shares = np.full(len(likely), 1 / len(likely))
    total = counts.sum()
    for _ in range(ROUNDS):
        mixed = shares @ likely
        shares = shares * (likely @ (counts / mixed)) / total
    return shares, float(np.log(shares @ likely) @ counts)


def mixture(text: str | None, names: list[str], logs: np.ndarray) -> dict[str, float]:
    """Selected languages of a text and their shares; empty where it has no letter or nothing was learned."""
    counts, letters = trigram_counts(text or "") if text else (None, 0)
    if not letters or not names:
        return {}
    at = np.flatnonzero(counts)
    n = counts[at].astype(np.float64)
    own = logs[:, at].astype(np.float64)
    alone = own @ n
    likely = np.exp(own)
    chosen = [int(alone.argmax())]
    best, shares = float(alone[chosen[0]]), np.ones(1)
    if len(names) > 1:
        overall, _ = _mixture(likely, n)
        price = 0.5 * np.log(n.sum() + 1) * DEPENDENCE
        for i in [i for i in np.argsort(-overall, kind="stable").tolist() if i != chosen[0]]:
            more, value = _mixture(likely[[*chosen, i]], n)
            if value - best <= price:
                break
            chosen, best, shares = [*chosen, i], value, more
    return {names[i]: float(s) for i, s in zip(chosen, shares, strict=True)}


def predicted(text: str | None, names: list[str], logs: np.ndarray) -> tuple[str, float]:
    """The language of the largest share (ties: first by name), and that share."""
    shares = mixture(text, names, logs)
    if not shares:
        return UNKNOWN, 0.0
    name = min(shares, key=lambda k: (-shares[k], k))
    return name, min(1.0, max(0.0, shares[name]))


def detect(docs: DataFrame, model: tuple[list[str], np.ndarray], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_key, lang_pred, score, languages`` (all selected, with shares) per row of ``docs``.

    A null text, or one without letters, is ``und`` with score 0; so is every text where no label was there
    to learn from. Whole texts count.
    """
    names, logs = model
    texts = common.own_columns(docs, doc_key=id_column, text=text_column).select(F.col("doc_key").cast("long"), "text")
    schema = pa.schema([("doc_key", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.map_(pa.string(), pa.float64()))])
    shared = docs.sparkSession.sparkContext.broadcast(logs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.turn("languages")
        for keys, parts in common.chunks(batches):
            found = [mixture(t, names, shared.value) for t in parts]
            best = [min(f, key=lambda k, f=f: (-f[k], k)) if f else UNKNOWN for f in found]
            yield from common.rows_out(schema, [keys, best, [min(1.0, max(0.0, f.get(b, 0.0))) for f, b in zip(found, best, strict=True)], pa.array([list(f.items()) for f in found], schema.field(3).type)])

    return texts.mapInArrow(run, "doc_key long, lang_pred string, score double, languages map<string,double>")


def known_language(docs: DataFrame, model: tuple[list[str], np.ndarray], least_share: float = 0.5, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose largest share is ``least_share`` or more; others are rejected."""
    names, logs = model
    shared = docs.sparkSession.sparkContext.broadcast(logs)

    def test():
        common.turn("languages")
        return lambda texts: [predicted(t, names, shared.value)[1] >= least_share for t in texts]

    return common.rows_where(docs, text_column, test)
