"""Awkward documents that every operator must take."""

from __future__ import annotations

import pytest

DDL = "doc_id long, text string, lang string, key string, doc_key int, n_tokens string, band double, component string, slot int"


@pytest.fixture(scope="session")
def awkward_rows():
    long_word = "x" * 300_000
    texts = [None, "", "   \n\t ", "one", "two words", "a b c d e f g h", "A b C d e f g h", "a b c d e f g h", "Zwölf Boxkämpfer jagen Viktor quer über den Sylter Deich " * 3, "漢字 かな ﷺ é 👩‍👩‍👧", "<|endoftext|> mid <|endoftext|>", "don't STOP it's 123 4 5678!!", long_word, "the quick brown fox " * 5_000, "  x\u001cy", "###$$$ %%% &&&"]
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)]
    rows += [(5, "a b c d e f g h", "en"), (None, "a b c d e f g h", None), (None, None, None)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame([(*r, "k", 1, "n", 0.5, "c", 2) for r in awkward_rows], DDL).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)
