"""Token counts and packing against the library itself."""

from __future__ import annotations

import base64
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from tideline.llm import packing, pretokens, queries, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


def test_counts_are_the_librarys(awkward, awkward_rows, byte):
    got = Counter((r.key, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(awkward, BYTE).collect())
    want = Counter((i, len((t or "").encode()), len(byte.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in awkward_rows)
    assert got == want


def test_counts_of_an_empty_table(empty):
    assert token_counts.token_counts(empty, BYTE).collect() == []


def test_registered_counts_are_the_librarys(spark, sf, byte):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op4_token_counts(spark, sf).collect()
    want = {k: (len(t.encode()), len(byte.encode(t, add_special_tokens=False).ids)) for k, t in texts.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == want and all(r.over_limit == (r.n_tokens > 1024) for r in rows)


def test_hot_pretokens_are_shared_out(spark, byte, monkeypatch):
    monkeypatch.setattr(token_counts, "_LONG", 8)
    texts = [f"{'zqxjkv ' * (i % 9)} plain words {i}" for i in range(200)]
    rows = token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), BYTE).collect()
    assert {r.key: r.n_tokens for r in rows} == {i: len(byte.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_registered_packing_is_the_librarys(spark, sf, word):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    ids = {k: [*word.encode(t, add_special_tokens=False).ids, 2] for k, t in texts.items()}
    rows = queries.op5_packing(spark, sf).collect()
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        covered[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(covered) == set(ids)
    for key, parts in [*covered.items(), *sequences.items()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
    assert all(sum(n for _, n in covered[k]) == len(ids[k]) for k in ids)
    used = [sum(n for _, n in parts) for parts in sequences.values()]
    assert max(used) <= 4096 and sum(used) / (4096 * len(used)) > 0.95  # little padding


TEXTS = st.text(alphabet=st.one_of(st.sampled_from("aA'sd ,.\n\t\r!0129éßÉſK \x1c\x85²ªº_-|<>"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_pretokens_carry_all_tokens(text):
    made = Tokenizer.from_file(BYTE) if not hasattr(test_pretokens_carry_all_tokens, "t") else test_pretokens_carry_all_tokens.t
    test_pretokens_carry_all_tokens.t = made
    found, special = pretokens.byte_level_pretokens(text, BYTE)
    assert special + sum(len(made.encode(p, add_special_tokens=False).ids) for p in found) == len(made.encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_encoder_gives_the_librarys_ids(text):
    ids = np.frombuffer(next(packing.encoder(WORD)([text])), "<u4").tolist()
    assert ids == pretokens.tokenizer(WORD).encode(text, add_special_tokens=False).ids


def test_whole_pieces_are_single(byte):
    pieces = random.Random(1).sample(sorted(pretokens.whole_pieces(BYTE)), 500)
    assert all(len(byte.encode(p, add_special_tokens=False).ids) == 1 for p in pieces)


def test_packing_holds_every_id_once(awkward, awkward_rows, word):
    rows = packing.pack_documents(awkward, WORD, room=64, group_rows=5).collect()
    want = Counter()
    for i, t, _ in awkward_rows:
        want[(i, zlib.crc32(np.array([*word.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()))] += 1
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_key].append(r)
        assert 0 < r.length <= 64 and len(r.ids) == 4 * r.length and r.start % 64 == 0
    assert sum(r.length for r in rows) == sum(len(word.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in awkward_rows)
    single = {i for i, _, _ in awkward_rows if [x for x, *_ in awkward_rows].count(i) == 1}
    for i in single:
        ids = b"".join(r.ids for r in sorted(by_doc[i], key=lambda r: r.start))
        assert (i, zlib.crc32(ids)) in want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_registered_packing_returns_every_id(spark, tmp_path, sf, word):
    texts = [(1, "one two three"), (1, "four five"), (None, None), (2, "a " * 9_000)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = sorted(repr((i, [*word.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in texts)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for packed in (queries.op5_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, sf)):
        found = defaultdict(list)
        for r in sorted(packed.collect(), key=lambda r: r.start):
            ids = base64.b64decode(r.ids_base64)
            assert len(ids) == 4 * r.length and zlib.crc32(ids) == r.ids_crc32
            found[r.doc_id, r.doc_tokens].extend(np.frombuffer(ids, "<u4").tolist())
        assert sorted(repr((i, ids)) for (i, _), ids in found.items()) == want


def test_packing_an_empty_table(empty):
    assert packing.pack_documents(empty, WORD).collect() == []


def test_sequences_pad_unless_a_power_of_two(spark, word):
    docs = spark.createDataFrame([(1, "one two three"), (2, "a " * 63)], "doc_id long, text string")
    packed = packing.pack_documents(docs, WORD, room=64)
    lengths = {r.sequence_id: len(r.ids) for r in packing.sequences(packed, 64).collect()}
    assert sorted(lengths.values()) == [4, 64]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
def test_first_fit_decreasing_is_first_fit(sizes):
    bins, offsets = packing.first_fit_decreasing(np.array(sizes), 64)
    free: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
        if k == len(free):
            free.append(64)
        assert (bins[i], offsets[i]) == (k, 64 - free[k])
        free[k] -= sizes[i]


def test_words_of_letters_are_one_pretoken():
    common = [chr(c) for c in range(0x180) if not pretokens.UNCOMMON.search(chr(c))]
    assert all(c.isalpha() == (packing._CUT("a" + c) == ["a" + c]) for c in common)
    encoder = packing._Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Straße ÀÉŒ naïve it's a1b2 ªº foo_bar don't", "".join(c for c in common if c.isalpha()), " ".join(common)]
    assert list(encoder(texts)) == [np.array(encoder.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert not {"straße", "naïve"} & encoder.pretokens[0].keys()  # remembered once, among the words
