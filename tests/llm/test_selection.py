"""Importance resampling, centroid clusters and license notices."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import common, importance_resampling, license_scan, queries, yinyang

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


# ---- importance resampling


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aB9 é-x漢", max_size=60), max_size=6))
def test_features_are_checksums_of_runs(texts):
    n_words, rows, columns = importance_resampling.features([*texts, "y" * 200 + " " + "z" * 90 + " é"], 3, 10_000)
    want = []
    for i, t in enumerate([*texts, "y" * 200 + " " + "z" * 90 + " é"]):
        w = words_of(t)
        assert n_words[i] == len(w)
        want += [(i, zlib.crc32(" ".join(w[j : j + k]).encode()) % 10_000) for k in (1, 2, 3) for j in range(len(w) - k + 1)]
    assert sorted(zip(rows.tolist(), columns.tolist(), strict=True)) == sorted(want)


def resampled(docs, target, percent=25, least=20, buckets=10_000):
    """doc -> n_features, weight, score, rank, by plain loops."""

    def runs(text):
        w = words_of(text)
        return len(w), [zlib.crc32(x.encode()) % buckets for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]

    own = [(key, *runs(text)) for key, text in docs]
    s, t = [0] * buckets, [0] * buckets
    for _, _, fs in own:
        for f in fs:
            s[f] += 1
    for text in target:
        for f in runs(text)[1]:
            t[f] += 1
    total, aim = float(sum(s) + buckets), float(sum(t) + buckets)
    gain = [math.floor(1000 * math.log((float(t[i] + 1) * total) / (float(s[i] + 1) * aim))) for i in range(buckets)]
    out = []
    for key, n, fs in own:
        weight = sum(gain[f] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = {id(r): i + 1 for i, r in enumerate(fit[: percent * len(fit) // 100])}
    return [(*r, drawn.get(id(r))) for r in out]


def test_op11_query_against_plain_loops(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = queries.queries()["op11_importance_resampling"](spark, sf).collect()
    want = [(r[0], r[2], r[3], r[4], r[5]) for r in resampled(docs, target)]
    assert sorted((r.doc_id, r.n_features, r.weight, r.score, r.rank or 0) for r in got) == sorted((*w[:4], w[4] or 0) for w in want)
    assert sum(r.rank is not None for r in got) > 10


def test_resampling_of_awkward_rows(spark, awkward, awkward_rows, empty):
    key = lambda r: (r[0] is None, *(x or 0 for x in r))
    target = spark.createDataFrame([("the quick brown fox",), (None,)], "text string")
    got = importance_resampling.resample(awkward, target, least_words=1, percent=60)
    want = resampled([r[:2] for r in awkward_rows], ["the quick brown fox", None], percent=60, least=1)
    # rows of one id and score share their ranks, in any order
    ranks = {}
    for r in want:
        ranks.setdefault((r[0], r[4]), []).append(r[5])
    assert sorted((tuple(r)[:5] for r in got.collect()), key=key) == sorted((r[:5] for r in want), key=key)
    found = {}
    for r in got.collect():
        found.setdefault((r.doc_key, r.score), []).append(r["rank"])
    assert {k: sorted(v, key=str) for k, v in found.items()} == {k: sorted(v, key=str) for k, v in ranks.items()}
    assert importance_resampling.resample(empty, target).collect() == []
    none = importance_resampling.resample(awkward, target.limit(0), least_words=1)
    assert none.count() == len(awkward_rows)
    kept = importance_resampling.drawn(awkward, target, least_words=1, percent=60)
    assert kept.columns == awkward.columns and 0 < kept.count() < len(awkward_rows)


# ---- centroid clusters


def clustered(rows, k, rounds, size, scale=1024, seed=3):
    """(key, cluster, distance) per kept vector and the centroids, by full scans of plain integers."""
    kept = [(key, [math.floor(scale * x) for x in v]) for key, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=name)[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for i in range(len(centroids)):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == i]
            if own:
                centroids[i] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(key, *reversed(nearest(v))) for key, v in kept], centroids


ORDER = lambda r: tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize(("k", "spread"), [(8, 1.0), (23, 0.2), (40, 0.01)])
def test_clusters_are_those_of_full_scans(spark, monkeypatch, k, spread):
    monkeypatch.setattr(yinyang, "BLOCK", 37)
    rnd = random.Random(k)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = [(i, [c + rnd.gauss(0, spread) for c in rnd.choice(centres)]) for i in range(400)]
    rows += [(400 + i, [float(rnd.randint(-1, 1)) for _ in range(6)]) for i in range(150)] + rows[:40]  # ties and repeats
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    placed, centroids = yinyang.cluster(df, clusters=k, size=6)
    want, ends = clustered(rows, k, yinyang.ROUNDS, 6)
    assert sorted(map(tuple, placed.collect())) == sorted(want)
    assert centroids.tolist() == ends


def test_bounds_spare_scans():
    rnd = np.random.default_rng(2)
    own = np.floor(1024 * (rnd.integers(0, 16, (2_000, 1)) * 3 + rnd.normal(0, 0.1, (2_000, 8)))).astype(np.int64)
    centroids = own[np.argsort(own[:, 0])[::125]]
    groups = yinyang.grouped(centroids)
    cluster, upper, lower = np.zeros(2_000, np.int32), np.full(2_000, np.inf), np.zeros((2_000, groups.max() + 1))
    yinyang.Round(centroids, centroids, groups).assign(own, cluster, upper, lower)
    later = yinyang.Round(centroids + 1, centroids, groups)
    later.assign(own, cluster, upper, lower)
    assert later.scanned < 200 and later.distances < 2_000
    assert (cluster == yinyang.squared(own, centroids + 1).argmin(axis=1)).all()


def test_clusters_of_awkward_rows(spark):
    far = [2.0**16, *[0.5] * 3]
    rows = [
        (1, [0.1, 0.2, 0.3, 0.4]), (2, None), (3, []), (4, [1.0, None, 0.0, 0.0]), (5, [float("nan"), 0.0, 0.0, 0.0]), (6, [float("inf"), 0.0, 0.0, 0.0]), (7, [1.0, 2.0]),
        (None, [0.5, 0.5, 0.5, 0.5]), (None, [0.25, 0.5, 0.5, 0.5]), (1, [0.1, 0.2, 0.3, 0.4]), (8, far), (9, [0.0] * 4),
    ]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "vec_id long, embedding array<double>, vec_key string, cluster int, keys string")
    for k in (2, 8):
        placed, centroids = yinyang.cluster(df, clusters=k, size=4)
        want, ends = clustered(rows, k, yinyang.ROUNDS, 4)
        assert sorted(map(tuple, placed.collect()), key=ORDER) == sorted(want, key=ORDER) and centroids.tolist() == ends
    placed, centroids = yinyang.cluster(df.limit(0), size=4)
    assert placed.collect() == [] and len(centroids) == 0
    with pytest.raises(Exception, match="no long holds"):
        yinyang.cluster(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"), size=1)


# ---- license notices


def brute_scan(text, templates, phrases, percent):
    w = words_of(text)
    places = sorted((i, label) for phrase, label in phrases.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    best, labels = 0.0, {label for _, label in places}
    for t in templates:
        wanted, width = set(t.text.split()), license_scan.width_of(t)
        for start in range(0, len(w), width // 2):
            block = set(w[start : start + width])
            if set(t.named.split()) <= block and 100 * len(block & wanted) >= percent * len(wanted):
                labels.add(t.label)
                best = max(best, len(block & wanted) / len(wanted))
    ends = (places[0][0], places[-1][0]) if places else (None, None)
    return (len(w), len(places), *ends, sorted({label for _, label in places}), sorted(labels), 1.0 if places else best)


def test_notices_against_every_block(spark, monkeypatch):
    monkeypatch.setattr(common, "CHUNK_CHARS", 2_000)
    rnd = random.Random(8)
    templates = (*license_scan.TEMPLATES, license_scan.Template("odd", "alpha beta gamma delta", "alpha"), license_scan.Template("lone", "zeta", "zeta"))
    pool = sorted({w for t in templates for w in t.text.split()}) + ["other", "plain", "words", "here", "über", "x1"]
    texts = [None, "", "zeta", "under the MIT license", "Under the MIT-License: under, the mit license!", "cc by nc apache license version 2 cc by nc", "a" * 5_000]
    for _ in range(250):
        own = [rnd.choice(pool) for _ in range(rnd.randint(0, 90))]
        if rnd.random() < 0.6:
            notice = list(rnd.choice(templates).text.split())
            for _ in range(rnd.randint(0, max(1, len(notice) // 3))):
                at = rnd.randrange(len(notice))
                notice[at : at + rnd.randint(0, 1)] = [] if rnd.random() < 0.5 else [rnd.choice(pool)]
                notice = notice or ["x"]
            at = rnd.randint(0, len(own))
            own[at:at] = notice
        texts.append(rnd.choice([" ", ", ", "\n"]).join(own).title())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for percent in (60, 80, 100):
        got = {r.doc_key: tuple(r)[1:] for r in license_scan.scan(df, templates, percent=percent).collect()}
        want = {i: brute_scan(t, templates, license_scan.PHRASES, percent) for i, t in enumerate(texts)}
        assert got == want
    assert len({x for r in want.values() for x in r[5]}) >= 6


def test_op13_labels_other_licenses_and_leaves_prose(spark):
    cases = {
        "This work is licensed under the GNU General Public License, version 3.": ["gpl-3"], "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License": [],
        "Licensed under the Apache License, Version 2.0 (the \"License\");": ["apache-2"], "Licensed under the Mozilla license, version 2.0": [], "Released under the Apache license.": [],
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following": ["bsd"], "MIT released a study under the title license to drive": ["mit"], "the license of the people is free": [],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_key: r.labels for r in license_scan.scan(df).collect()}
    assert got == dict(enumerate(cases.values()))


def test_notices_of_awkward_rows(spark, awkward, awkward_rows, empty):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:3])
    got = sorted((tuple(r) for r in license_scan.scan(awkward).collect()), key=key)
    assert got == sorted(((k, *brute_scan(t, license_scan.TEMPLATES, license_scan.PHRASES, 80)) for k, t, _ in awkward_rows), key=key)
    assert license_scan.scan(empty).collect() == []
    assert license_scan.scan(awkward, templates=()).count() == len(awkward_rows)
