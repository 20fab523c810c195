"""Reply trees and extendible hashing, against brute force and exact round trips."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tideline.llm import chat_trees, extendible_sharding

NASTY = ["<|im_end|>", "<\\|im_end|>", "<\\\\|", "a<|im_start|>user\nb", "", None, "\n", "<|", "é<|x|>漢", "\\s\\n", "$1 \\1 <|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"]


def conversations(spark):
    rows = [(1, i, ["system", "user", "assistant"][min(i, 1 + i % 2)], t, "clash") for i, t in enumerate(NASTY)]
    rows += [(2, 0, "user", "q", "c"), (2, 0, "assistant", "same turn", "c"), (2, None, "user", "first", "c"), (2, 0, "user", "q", "c")]
    rows += [(None, 1, "assistant", "lost", "c"), (None, 0, "us\ner\\", "x", "c"), (3, 5, None, "no role", "c")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree string")


def expected(df):
    out = {}
    rows = df.collect()
    none_first = lambda v: (v is not None, v if v is not None else "")
    for conv in {r.conv_id for r in rows}:
        own = sorted((r for r in rows if r.conv_id == conv), key=lambda r: (none_first(r.turn), none_first(r.role), none_first(r.text)))
        out[conv] = [(r.role or "", r.text or "") for r in own]
    return out


def test_round_trip_and_loss(spark):
    df = conversations(spark)
    done = chat_trees.format_trees(chat_trees.threads(df)).select("conv", "n_turns", "formatted", "loss_spans", chat_trees.read_back(F.col("formatted")).alias("back"), chat_trees.loss_text(F.col("segments")).alias("loss"), F.array_join(F.transform("loss_spans", lambda s: chat_trees.unescaped(F.substring("formatted", s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "").alias("spanned")).collect()
    want = expected(df)
    assert len(done) == len(want)
    for r in done:
        assert [(t.role, t.text) for t in r.back] == want[r.conv] and r.n_turns == len(want[r.conv])
        said = "".join(t for role, t in want[r.conv] if role == "assistant")
        assert r.loss == said == r.spanned
        assert all(0 <= s.start <= s.end <= len(r.formatted) for s in r.loss_spans)


def test_trees_enumerate_ranked_paths(spark):
    rnd = random.Random(8)
    rows, parents, scores = [], {}, {}
    for node in range(60):
        parents[node] = None if node == 0 else rnd.randrange(max(0, node - 9), node)
        scores[node] = rnd.choice([None, 0.0, 1.0, 2.0])
        rows.append((1, node, parents[node], "assistant" if node % 2 else "user", f"m{node}", scores[node], "clash"))
    rows += [(1, 100, 101, "user", "circle", 0.0, "c"), (1, 101, 100, "user", "circle", 0.0, "c"), (1, 102, 101, "user", "hangs on it", 0.0, "c"), (1, 200, 999, "user", "orphan", 9.0, "c")]
    df = spark.createDataFrame(rows, "conv long, node long, parent long, role string, text string, score double, tree string")
    leaves = [n for n in range(60) if n not in set(parents.values())]
    want = {}
    for leaf in leaves:
        path, at = [], leaf
        while at is not None:
            path.append(at)
            at = parents[at]
        want[leaf] = (path[::-1], sum(scores[n] or 0.0 for n in path) / len(path))
    want[200] = ([200], 9.0)
    got = {r.leaf: r for r in chat_trees.format_trees(df).select("leaf", "rank", "path_score", chat_trees.read_back(F.col("formatted")).alias("back")).collect()}
    assert set(got) == set(want)
    order = sorted(want, key=lambda n: (-round(want[n][1], 12), n))
    for leaf, r in got.items():
        assert [t.text for t in r.back] == (["orphan"] if leaf == 200 else [f"m{n}" for n in want[leaf][0]])
        assert abs(r.path_score - want[leaf][1]) < 1e-9 and r["rank"] == order.index(leaf) + 1
    assert [r.leaf for r in chat_trees.format_trees(df, branches=2).orderBy("rank").collect()] == order[:2]


def test_deep_conversation(spark):
    df = spark.range(700).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    row = chat_trees.format_trees(chat_trees.threads(df)).select("n_turns", chat_trees.read_back(F.col("formatted")).alias("b")).first()
    assert row.n_turns == 700 and [t.text for t in row.b] == [str(i) for i in range(700)]


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_trees.format_trees(chat_trees.threads(df)).collect() == []


def check_shards(rows, limit):
    by = {}
    for r in rows:
        by.setdefault(r.shard_id, []).append(r)
    for shard, own in by.items():
        assert sum(r.n_bytes for r in own) == own[0].shard_bytes and len(own) == own[0].shard_docs
        assert own[0].shard_bytes <= limit or len(own) == 1
        assert len(shard) == len("shard-") + own[0].depth
    names = sorted(by)
    assert not any(b.startswith(a) for a, b in zip(names[:-1], names[1:], strict=True))  # prefixes part the space
    for shard, own in by.items():
        if own[0].depth:  # the parent does not fit
            assert sum(r.n_bytes for n, o in by.items() if n.startswith(shard[:-1]) for r in o) > limit or sum(len(o) for n, o in by.items() if n.startswith(shard[:-1])) == 1


@pytest.mark.parametrize("limit", [200, 2_000, 10**9])
def test_shards_fit(spark, limit):
    rnd = random.Random(limit)
    rows = [(i, "x" * rnd.randint(0, 300)) for i in range(400)] + [(7, "y" * 50)] * 150 + [(None, "z" * 20)] * 100 + [(900, None), (901, "w" * 5_000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, code string").repartition(4)
    df = spark.createDataFrame(df.collect(), df.schema)  # a fixed order of rows, as a scan gives
    placed = extendible_sharding.shard(df, limit).collect()
    assert len(placed) == len(rows)
    check_shards(placed, limit)


def test_written_shards(spark, tmp_path, awkward):
    path = str(tmp_path / "docs")
    awkward.write.parquet(path)
    docs = spark.read.parquet(path)
    extendible_sharding.write_shards(docs, str(tmp_path / "shards"), 1_000)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.drop("shard_id").exceptAll(docs).isEmpty() and back.count() == docs.count() and back.select("shard_id").distinct().count() > 1


def test_no_documents(empty):
    assert extendible_sharding.shard(empty, 100).collect() == []


def test_rows_of_one_key_are_parted_past_all_bits(spark, monkeypatch):
    """Few bits for a key's rows, so that several generations of them are needed; null and repeated ids alike."""
    monkeypatch.setattr(extendible_sharding, "STEP", 20)
    rows = [(None, "abcdef")] * 300 + [(7, "abcdef")] * 200 + [(i, "x" * (i % 30)) for i in range(100, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    coded = extendible_sharding.coded
    # rows of a key share their first bits altogether: only further generations part them
    monkeypatch.setattr(extendible_sharding, "coded", lambda *a: coded(*a).withColumn("code", F.shiftleft(F.shiftright("code", 20), 20)))
    placed = extendible_sharding.shard(df, 10).collect()
    assert len(placed) == len(rows)
    check_shards(placed, 10)
    assert max(r.depth for r in placed) > 60
