"""Quality scores from a sparse rule ensemble (operator 10).

Statistics of each text feed a small random forest; every path of its trees is a conjunctive rule; a logistic
regression with lasso keeps a few of them with weights; and these are compiled into one Spark column, so that
scoring is an expression over the statistics.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows, about, that the ensemble is fitted to; a documented bound.
SAMPLE_ROWS = 20_000
TREES, DEPTH, LASSO = 20, 3, 0.002

STATISTICS = ("log_bytes", "upper", "digit", "comma_stop", "odd_marks", "bars", "line_ends", "high_bytes", "word_length", "long_words", "marked_words", "distinct_words", "distinct_lines", "longest_line", "capital_words", "top_word")
_SCHEMA = pa.schema([("doc_key", pa.int64()), *((s, pa.float64()) for s in STATISTICS)])
_DDL = "doc_key long, " + ", ".join(f"{s} double" for s in STATISTICS)
_ODD = re.compile(rb"[^\w\s.,;:'\"()\x80-\xff-]\s", re.ASCII)

Rule = tuple[tuple[str, str, float], ...]


def statistics(text: str) -> list[float]:
    """The statistics of one text, whole; all 0 where it is empty."""
    raw = text.encode()
    if not raw:
        return [0.0] * len(STATISTICS)
    n = len(raw)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    count = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    kinds: dict[bytes, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    marks = byte[33:48].sum() + byte[58:65].sum() + byte[91:97].sum() + byte[123:127].sum()
    plain = byte[[44, 46, 59, 58, 39, 34, 40, 41, 45]].sum()
    return [
        float(np.log1p(n)), byte[65:91].sum() / n, byte[48:58].sum() / n, byte[[44, 46]].sum() / n, (marks - plain) / n, byte[124] / n, byte[10] / n, byte[128:].sum() / n,
        float(lengths.sum() / count), float((lengths > 12).sum() / count), sum(1 for _ in _ODD.finditer(raw + b" ")) / count, len(kinds) / count, len(set(lines)) / max(1, len(lines)),
        max(map(len, lines), default=0) / n, sum(1 for w in kinds if w[:1].isupper()) / max(1, len(kinds)), max(kinds.values(), default=0) / count,
    ]


def described(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_key`` and the statistics per row of ``docs``; a null text is empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in common.chunks(batches):
            yield from common.rows_out(_SCHEMA, [keys, *zip(*map(statistics, texts), strict=True)])

    texts = common.own_columns(docs, doc_key=id_column, text=text_column).select(F.col("doc_key").cast("long"), "text")
    return texts.mapInArrow(run, _DDL)


def rules_of(tree: str) -> set[Rule]:
    """The paths of a printed tree, to inner nodes and leaves alike, as rules over the statistics."""
    out: set[Rule] = set()
    path: list[tuple[int, tuple[str, str, float]]] = []
    for line in tree.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, (STATISTICS[int(m[2])], m[3], float(m[4])))]
            out.add(tuple(sorted(c for _, c in path)))
    return out


def condition(rule: Rule) -> Column:
    """A rule as a boolean column over the statistics."""
    return reduce(and_, ((F.col(s) <= v) if op == "<=" else (F.col(s) > v) for s, op, v in rule))


def fit(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules from about ``sample_rows`` of the labelled rows (all, where there are fewer),
    drawn by a hash of the id. ``labels``: doc_key, label (0 or 1). Without labels every score is one half;
    with one label alone it is close to that."""
    labels = labels.where("label in (0, 1) and doc_key is not null")
    share = min(1.0, sample_rows / max(1, labels.count()))
    drawn = labels.where(F.pmod(F.xxhash64("doc_key"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = common.stored(common.by_ids(stats, "doc_key", drawn.select("doc_key", "label"), "inner").select(F.col("label").cast("double").alias("label"), *STATISTICS))
    seen = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(seen) < 2:
        return (0.0 if not seen else 4.0 if 1.0 in seen else -4.0), []
    table = rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, minInstancesPerNode=max(1, min(20, min(seen.values()) // 5))).fit(table)
    rules = sorted(set().union(*(rules_of(t.toDebugString) for t in forest.trees)))
    if not rules:
        return float(np.log(seen[1.0] / seen[0.0])), []
    fired = rows.select("label", array_to_vector(F.array(*[condition(r).cast("double") for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, standardization=True, maxIter=100).fit(fired)
    return float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, lasso.coefficients, strict=True) if w]


def score(model: tuple[float, list[tuple[Rule, float]]]) -> Column:
    """The ensemble as one column over the statistics: 0 to 1, higher where label 1 is likelier."""
    intercept, rules = model
    total = reduce(lambda a, b: a + b, [F.when(condition(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in rules], F.lit(intercept))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def score_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_key, score`` and the statistics per row of ``docs``; ``labels`` as for ``fit``. Null texts score
    as empty ones; repeated rows and null ids are scored like any; an empty table gives no row."""
    stats = common.stored(described(docs, id_column, text_column))
    return stats.withColumn("score", score(fit(stats, labels)))
