"""The corpus pipeline against its parts, and the registered queries against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from tideline.llm import queries

from .test_duplicates import word_sets


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.common.stored(stage(spark, docs, sf))
        if name != "packing":
            assert docs.columns == before.columns
        seen.append((name, docs))
    by = dict(seen)
    texts = {r.doc_id: r.text for r in by["near-duplicates"].collect()}
    sets = {k: word_sets(t, 5) for k, t in texts.items()}
    keys = sorted(sets)
    assert not any(sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for i, a in enumerate(keys) for b in keys[:i])
    assert by["personal data"].where("text rlike '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}' or text rlike '[a-z0-9]@[a-z0-9]+[.]'").isEmpty()
    assert by["personal data"].where("n_chars <> char_length(text)").isEmpty()
    assert by["packing"].count() >= by["personal data"].count() > 0


def test_pipeline_of_awkward_documents(spark, tmp_path, awkward, sf):
    docs = awkward.select("doc_id", "text", "lang")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.common.stored(stage(spark, docs, sf))
        assert docs.columns == ["doc_id", "text", "lang"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), sf).collect() == []


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    frame = queries.queries()[name](spark, sf)
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in frame.collect()))) == sorted(map(repr, found.fetchall()))
