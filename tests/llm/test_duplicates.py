"""Near-duplicate documents and vectors, and components, against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tideline.llm import components, embed_dedup, hyperminhash, shingles

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_sets(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rnd.randrange(50), 100 + rnd.randrange(50)) for _ in range(40)] + [(200, i) for i in range(201, 260)] + [(7, 7)]
    rows = components.components(spark.createDataFrame([*edges, (None, 5)], "u long, v long")).collect()
    want = roots(300, edges)
    assert {r.node: r.component for r in rows} == {i: want[i] for i in range(300) if want[i] != i}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_shingles_match_word_tuples():
    texts = ["", "a", "a b", "a b c", "a  b\tc\nd", "A B C D", "a b c d a b c d", "é É  x y", "x" * 5000 + " y z w v"]
    for k in (4, 5):
        sets = list(shingles.shingle_sets(texts, k))
        words = [word_sets(t, k) for t in texts]
        for i in range(len(texts)):
            assert len(sets[i]) == len(words[i])
            for j in range(len(texts)):
                assert len(np.intersect1d(sets[i], sets[j])) == len(words[i] & words[j])


def test_shingles_do_not_depend_on_slices(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000))
    whole = next(shingles.shingle_sets([text], 4))
    monkeypatch.setattr(shingles, "_SLICE", 64)
    assert (next(shingles.shingle_sets([text], 4)) == whole).all()


def test_estimate_is_close():
    rng = np.random.default_rng(4)
    for share in (0.5, 0.8, 0.95):
        n = 5000
        common = rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64) * np.uint64(2)
        sets = [np.unique(np.r_[common, rng.integers(0, 1 << 63, n - len(common), dtype=np.uint64) * np.uint64(2)]) for _ in range(2)]
        both = len(np.intersect1d(*sets))
        true = both / (len(sets[0]) + len(sets[1]) - both)
        r = hyperminhash.registers(sets)
        got, used = hyperminhash.estimate(r[:1], r[1:], np.array([n]), np.array([n]))
        assert used[0] == 128 and abs(got[0] - true) < 0.15


def near_texts(seed, families=25, loners=40):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 5)))
    texts = []
    for _ in range(families):
        base = [word() for _ in range(rnd.randint(3, 200))]
        for _ in range(rnd.randint(1, 8)):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(own) // 25))):
                own[rnd.randrange(len(own))] = word()
            texts.append(" ".join(own).upper() if rnd.random() < 0.2 else "  ".join(own))
    texts += [" ".join(word() for _ in range(rnd.randint(1, 60))) for _ in range(loners)]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("words", [4, 5])
def test_documents_against_brute_force(spark, words):
    texts = near_texts(words)
    texts += [texts[0]] * 20 + [None, "", " \n"]
    sets = [word_sets(t, words) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = roots(len(texts), links)
    rows = {r.doc_key: r for r in hyperminhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), words=words).collect()}
    assert {i: rows[i].component_id for i in range(len(texts))} == dict(enumerate(want))
    assert all(rows[i].n_shingles == len(sets[i]) and rows[i].kept == (want[i] == i) for i in range(len(texts)))


def test_large_groups_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(hyperminhash, "BLOCK", 8)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        own = list(base)
        for at in rnd.sample(range(120), rnd.randint(0, 5)):
            own[at] = f"v{rnd.randrange(10_000)}"
        texts.append(" ".join(own))
    sets = [word_sets(t, 5) for t in texts]
    want = roots(60, [(i, j) for i in range(60) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    rows = hyperminhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_key: r.component_id for r in rows} == dict(enumerate(want))


def test_awkward_documents(awkward, awkward_rows):
    rows = hyperminhash.near_duplicates(awkward, words=4).collect()
    assert len(rows) == len(awkward_rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_key, []).append(r)
    assert {by[k][0].component_id for k in (5, 6, 7)} == {5} and len(by[5]) == 2
    assert sorted((r.component_id is None, r.n_shingles) for r in by[None]) == [(False, 5), (True, 0)]  # one links with 5
    assert all(by[k][0].n_shingles == 0 and by[k][0].kept for k in (0, 1, 2))


def test_no_documents(empty):
    assert hyperminhash.near_duplicates(empty).collect() == []
    assert hyperminhash.without_near_duplicates(empty).collect() == []


def test_one_row_of_each_group_stays(spark):
    """Repeated ids, repeated rows, null ids and clashing columns: a row is dropped for its own text alone."""
    rnd = random.Random(21)
    texts = [" ".join(f"w{rnd.randrange(300)}" for _ in range(40)) for _ in range(8)]
    near = [t + " tail" for t in texts]
    rows = [
        (1, texts[0]), (2, texts[0]), (2, texts[1]), (3, texts[2]), (3, texts[2]), (5, texts[3]), (5, texts[4]), (3, texts[3]),
        (None, texts[5]), (None, texts[5]), (None, near[5]), (9, near[4]), (None, texts[6]), (7, texts[6]), (None, None), (4, ""), (4, ""),
    ]
    rows = [(*r, "c", 1.5, i) for i, r in enumerate(rows)]
    table = spark.createDataFrame(rows, "doc_id long, text string, component string, row_at double, place long").repartition(3)
    kept = hyperminhash.without_near_duplicates(table)
    assert kept.columns == table.columns
    got = kept.collect()
    sets = [word_sets(r[1], 5) for r in rows]
    groups = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    want = []
    for g in sorted(set(groups)):
        members = [i for i in range(len(rows)) if groups[i] == g]
        want.append(min((rows[i][0] is None, rows[i][0] or 0) for i in members))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(want)
    assert {groups[r.place] for r in got} == set(groups) and len(got) == len(set(groups))
    found = hyperminhash.near_duplicates(table).collect()
    least = {g: min((rows[i][0] for i in range(len(rows)) if groups[i] == g and rows[i][0] is not None), default=None) for g in groups}
    want = sorted(repr((rows[i][0], least[groups[i]] if sets[i] else rows[i][0])) for i in range(len(rows)))
    assert sorted(repr((r.doc_key, r.component_id)) for r in found) == want


def test_rows_of_a_scan_have_names(spark, sf, tmp_path):
    from tideline.llm import common

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert common.scanned(docs) is docs and common.scanned(docs.where("doc_id > 3").select("text")).columns == ["text"]
    assert docs.select(*common.row_name(docs)).distinct().count() == docs.count()
    joined = docs.join(docs.select("doc_id"), "doc_id")
    assert common.scanned(joined) is not joined and common.scanned(joined).count() == joined.count()


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from tideline.llm import common

    session = lambda master, root: SimpleNamespace(conf={"spark.checkpoint.dir": root}, sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(session("spark://host:7077", None))
    assert common.shared_folder(session("spark://host:7077", "hdfs://x/y/")).startswith("hdfs://x/y/")
    assert common.shared_folder(session("local[4]", None))


def test_stored_steps_go(spark, sf):
    import os

    root = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    assert hyperminhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).count() > 0
    assert len(set(os.listdir(root)) - before) <= 3


def vectors(seed=2, n=220, size=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, size))
    out = []
    for i in range(n):
        v = centres[rng.integers(30)] + rng.normal(size=size) * rng.choice([0.02, 0.1, 0.2, 1.0])
        out.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    out += [(n + k, out[0][1], out[0][2]) for k in range(12)]
    return out


def test_vectors_against_brute_force(spark):
    rows = vectors()
    n = len(rows)
    bad = [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 24, 1), (n + 3, [1.0, None], 1), (n + 4, [float("nan")] * 24, 1), (n + 5, [float("inf")] + [1.0] * 23, 1), (n + 6, rows[0][1], None), (n + 7, rows[0][1][:5], rows[0][2])]
    x = np.array([r[1] for r in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([r[2] for r in rows])
    near = ((x @ x.T) >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    want = roots(n, list(zip(*np.nonzero(near), strict=True)))
    table = spark.createDataFrame([(*r, "extra") for r in rows + bad], "vec_id long, embedding array<float>, label int, rep string").repartition(3)
    got = {r.vec_key: r for r in embed_dedup.near_vectors(table).collect()}
    assert len(got) == n + len(bad)
    assert all(got[i].n_links == near[i].sum() and got[i].component_id == want[i] and got[i].kept == (want[i] == i) for i in range(n))
    assert all(got[r[0]].n_links == 0 and got[r[0]].component_id == r[0] and got[r[0]].kept for r in bad)


def test_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 8)
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    rows = [(i, [float(v) for v in base + rng.normal(size=16) * 0.01], 1) for i in range(50)]
    got = embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(49, 0)}


def test_no_vectors(spark):
    assert embed_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_ids_are_kept_or_dropped_either_way(spark, monkeypatch):
    from tideline.llm import common

    frame = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "doc_id long, text string")
    ids = spark.createDataFrame([(2,), (2,), (9,), (None,)], "x long")
    for bound in (common.BROADCAST_IDS, 0):
        monkeypatch.setattr(common, "BROADCAST_IDS", bound)
        assert sorted(r.text for r in common.by_ids(frame, "doc_id", ids, "left_semi").collect()) == ["b", "c"]
        assert sorted(r.text for r in common.by_ids(frame, "doc_id", ids, "left_anti").collect()) == ["a", "d"]


def test_more_signs_than_two_bytes_hold(spark, monkeypatch):
    assert embed_dedup.shape(1_000, 0.98) == (16, 24) and embed_dedup.shape(1 << 24, 0.98)[0] == 24
    monkeypatch.setattr(embed_dedup, "LEAST_BITS", 21)
    rows = vectors(seed=3)
    x = np.array([r[1] for r in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([r[2] for r in rows])
    near = ((x @ x.T) >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    got = {r.vec_key: r for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert all(got[i].n_links == near[i].sum() for i in range(len(rows)))


def test_links_at_the_threshold_itself(spark):
    """Cosines of exactly 0.6 and beside it, and repeated ids with other vectors, which share their id's links."""
    rows = [(0, [3.0, 4.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, -1e-9], 1), (3, [0.0, 1.0], 2), (3, [0.0, -1.0], 2), (4, [0.0, 2.0], 2)]
    got = [(r.vec_key, r.n_links, r.component_id) for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), least=0.6).collect()]
    links = {k: n for k, n, _ in got}
    assert links[1] == 2 and links[0] == 1 and links[2] == 1 and links[4] == 1
    assert {c for k, _, c in got if k in (3, 4)} == {3} and {c for k, _, c in got if k < 3} == {0}


def test_a_head_that_many_choose_is_met_in_parts(spark, monkeypatch):
    monkeypatch.setattr(hyperminhash, "HEAD", 3)
    text = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(text[:k] + [f"own{i}"] + text[k:])) for i, k in enumerate(range(0, 200, 5))]
    docs += [(100 + i, " ".join(f"o{i}-{j}" for j in range(30))) for i in range(5)]
    got = {r.doc_key: r for r in hyperminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=5, percent=80).collect()}
    assert {got[i].component_id for i in range(40)} == {0} and all(got[100 + i].component_id == 100 + i for i in range(5))
