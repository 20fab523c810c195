"""License notices by an exact set-similarity join of text blocks and templates (operator 13).

A block is a window of words, and a template is found in it where the block holds the stated share of the template's
distinct words. Tokens are ordered by their frequency over all documents, rarest first. Then a block that
holds enough of a template shares a token with it among the first few of both (prefix filter), has enough tokens itself
(length filter), and has enough left behind that token (positional filter); what passes is counted exactly. Nothing
that meets the threshold is lost.

Texts are read once: only the places of words that stand in some template are kept of them. The templates are a
parameter; what is broadcast of them is one row for each token of their prefixes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .importance_resampling import _Words

#: Share of a template's distinct words that a block must hold, in percent.
PERCENT = 80
#: Phrases whose words must stand consecutively, and their labels: fixed values.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


class Template(NamedTuple):
    """A notice in lower case; ``named`` are words without which it is another license's."""

    label: str
    text: str
    named: str


#: Notices, as their licenses word them.
TEMPLATES = (
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "this software is distributed under the terms of the mit license", "mit license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "permission granted sublicense",
    ),
    Template("apache-2", "licensed under the apache license version 2 0", "apache 2"),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache 2"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc nc"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative noncommercial"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu 3"),
    Template(
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "gnu 3",
    ),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution binary forms"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license version 2 0", "mozilla 2"),
)

_TAPE = pa.schema([
    ("row_file", pa.int64()), ("row_at", pa.int64()), ("doc_key", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.list_(pa.string())), ("places", pa.binary()), ("tokens", pa.binary()),
])
_TAPE_DDL = "row_file long, row_at long, doc_key long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, places binary, tokens binary"
_BLOCKS = pa.schema([("row_file", pa.int64()), ("row_at", pa.int64()), ("width", pa.int32()), ("start", pa.int64()), ("tokens", pa.list_(pa.int32()))])
_BLOCKS_DDL = "row_file long, row_at long, width int, start long, tokens array<int>"


def width_of(template: Template) -> int:
    """Words of the blocks that a template is sought in: a power of two, twice the template or more. Blocks begin every half
    width, so any run of words as long as the template lies in one."""
    return 1 << (2 * len(template.text.split()) - 1).bit_length()


def need_of(template: Template, percent: int) -> int:
    """Distinct words of a template that a block must hold."""
    return max(1, ceil(percent * len(set(template.text.split())) / 100))


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.text.split()})


def tape(docs: DataFrame, templates: tuple[Template, ...], phrases: dict[str, str], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of a scanned frame: its name, words, places of phrases, and the places and numbers of vocabulary words."""
    words_of = pa.array([w.encode() for w in vocabulary(templates)], pa.binary())
    sought = [(label, [w.encode() for w in phrase.split()]) for phrase, label in phrases.items()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in common.chunks(batches, text_at=3):
            words = _Words(texts)
            codes, first = words.codes, words.first
            of_text = np.repeat(np.arange(len(texts)), np.diff(first))
            distinct = pa.array(words.distinct, pa.binary())
            starts, labels = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at, (_, phrase) in enumerate(sought):
                numbers = pa.compute.index_in(pa.array(phrase, pa.binary()), value_set=distinct).to_pylist()
                if None in numbers or len(codes) < len(phrase):
                    continue
                full = len(codes) - len(phrase) + 1
                here = of_text[:full] == of_text[len(phrase) - 1 :]
                for j, n in enumerate(numbers):
                    here &= codes[j : j + full] == n
                starts.append(np.flatnonzero(here))
                labels.append(np.full(len(starts[-1]), at))
            start, label = np.concatenate(starts), np.concatenate(labels)
            order = np.argsort(start, kind="stable")
            start, label = start[order], label[order]
            edge = np.searchsorted(start, first)
            known = pa.compute.index_in(distinct, value_set=words_of)
            token_of = pa.compute.fill_null(known, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            tokens = token_of[codes] if len(codes) else codes
            place = np.flatnonzero(tokens >= 0)
            cut = np.searchsorted(place, first)
            rows = []
            for i, (file, at, key) in enumerate(keys):
                own = start[edge[i] : edge[i + 1]] - first[i]
                own_place = place[cut[i] : cut[i + 1]]
                named = sorted({sought[x][0] for x in label[edge[i] : edge[i + 1]].tolist()})
                ends = (int(own[0]), int(own[-1])) if len(own) else (None, None)
                rows.append((file, at, key, int(first[i + 1] - first[i]), len(own), *ends, named, (own_place - first[i]).astype("<u4").tobytes(), tokens[own_place].astype("<u2").tobytes()))
            yield from common.rows_out(_TAPE, list(zip(*rows, strict=True)), 1_000)

    texts = common.named_columns(docs, doc_key=id_column, text=text_column).withColumn("doc_key", F.col("doc_key").cast("long"))
    return texts.mapInArrow(run, _TAPE_DDL)


def frequencies(tape_: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each vocabulary word; as many numbers as the templates have words reach the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for tokens in batch.column(0).to_pylist():
                total[np.unique(np.frombuffer(tokens, "<u2"))] += 1
        held = np.flatnonzero(total)
        yield from common.rows_out(pa.schema([("token", pa.int64()), ("n", pa.int64())]), [held, total[held]])

    out = np.zeros(size, np.int64)
    for token, n in tape_.where("octet_length(tokens) > 0").select("tokens").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n")).collect():
        out[token] = n
    return out


def blocks(tape_: DataFrame, rank: np.ndarray, classes: dict[int, tuple[int, set[int]]]) -> DataFrame:
    """Blocks of every width that hold a token of some prefix, and enough tokens for the smallest need: their distinct
    tokens, rarest first."""
    reached = {width: np.isin(np.arange(len(rank)), list(prefix)) for width, (_, prefix) in classes.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, at, places, tokens in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                place, own = np.frombuffer(places, "<u4").astype(np.int64), rank[np.frombuffer(tokens, "<u2")]
                for width, (least, _) in classes.items():
                    half = width // 2
                    last = place[reached[width][own]] // half
                    for start in (np.unique(np.concatenate([last, last[last > 0] - 1])) * half).tolist():
                        a, b = np.searchsorted(place, (start, start + width))
                        if b - a >= least and len(held := np.unique(own[a:b])) >= least:
                            rows.append((file, at, width, start, held.astype(np.int32)))
            if rows:
                yield from common.rows_out(_BLOCKS, list(zip(*rows, strict=True)))

    least = min((n for n, _ in classes.values()), default=1)
    held = tape_.where(F.octet_length("tokens") >= 2 * least).select("row_file", "row_at", "places", "tokens")
    return held.mapInArrow(run, _BLOCKS_DDL)


def matches(tape_: DataFrame, templates: tuple[Template, ...] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """``row_file, row_at, label, template, start, width, containment`` per block and template that meet the threshold;
    ``template`` is its number, ``start`` the block's first word."""
    words = vocabulary(templates)
    order = np.lexsort((np.arange(len(words)), frequencies(tape_, len(words))))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    number = dict(zip(words, rank.tolist(), strict=True))
    prefixes, classes = [], {}
    for t, template in enumerate(templates):
        tokens = sorted({number[w] for w in template.text.split()})
        need, width = need_of(template, percent), width_of(template)
        prefix = tokens[: len(tokens) - need + 1]
        named = [number[w] for w in template.named.split()]
        prefixes += [(width, token, i, t, template.label, need, tokens, named) for i, token in enumerate(prefix)]
        least, reached = classes.get(width, (need, set()))
        classes[width] = min(least, need), reached | set(prefix)
    spark = tape_.sparkSession
    ddl = "_width int, _token int, i int, template int, label string, need int, wanted array<int>, named array<int>"
    table = spark.createDataFrame(prefixes, ddl)
    found = blocks(tape_, rank, classes)
    held = F.size("tokens")
    each = found.select("*", F.posexplode("tokens").alias("j", "token"))
    met = each.join(F.broadcast(table), (F.col("width") == F.col("_width")) & (F.col("token") == F.col("_token")))
    met = met.where((held >= F.col("need")) & (F.col("j") <= held - F.col("need")) & (F.least(F.size("wanted") - F.col("i"), held - F.col("j")) >= F.col("need")))
    met = met.withColumn("common", F.array_intersect("tokens", "wanted"))
    met = met.where((F.size("common") >= F.col("need")) & (F.array_min("common") == F.col("token")) & (F.size(F.array_except("named", "tokens")) == 0))
    return met.select("row_file", "row_at", "label", "template", "start", "width", (F.size("common") / F.size("wanted")).alias("containment"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] | None = None, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_key, n_words, n_base, first_word, last_word, base_labels, labels, score`` per row of ``docs``.

    ``n_base`` counts all places where a phrase's words stand consecutively, ``first_word`` and ``last_word`` are the
    smallest and largest of them, null without any. ``labels`` adds to the phrases' those of templates found; ``score`` is 1
    with a phrase, else the greatest share of a template that a block holds which meets the threshold, else 0. Words are runs
    of digits, letters a-z after A-Z are lower-cased, and all that is not ASCII. Null texts are empty; repeated rows and
    null ids are scanned like any; an empty table gives no row.
    """
    laid = common.stored(tape(common.scanned(docs), templates, PHRASES if phrases is None else phrases, id_column, text_column))
    found = matches(laid, templates, percent).groupBy("row_file", "row_at").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    base = laid.drop("places", "tokens")
    met = base.join(found.withColumnsRenamed({"row_file": "_file", "row_at": "_at"}), (F.col("row_file") == F.col("_file")) & (F.col("row_at") == F.col("_at")), "left")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return met.select("doc_key", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))
