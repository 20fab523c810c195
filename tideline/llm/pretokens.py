"""Pre-tokens of the public byte-level and word-level BPE files, cut the way the ``tokenizers`` library cuts them.

Texts of common Latin characters are cut by a regular expression; any other text is cut by the library
itself, so that differing Unicode tables can't change a result.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import regex

#: The split patterns that the two tokenizer files state.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Characters on which libraries may differ: controls, and all beyond Latin Extended-A.
UNCOMMON = re.compile("[^\t-\r -~¡-įı-ſ]")


@lru_cache(maxsize=8)
def tokenizer(path: str):
    """The library's tokenizer, one a Python worker, in one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_padding()
    made.no_truncation()
    return made


@lru_cache(maxsize=8)
def special_strings(path: str) -> re.Pattern | None:
    """Matches the added tokens, which the library takes out of a text before anything else."""
    added = sorted((t.content for t in tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, added))) if added else None


@lru_cache(maxsize=8)
def whole_pieces(path: str) -> frozenset[str]:
    """Pre-tokens that are a single piece: the entries of the vocabulary for which the library says so.
    The vocabulary's size bounds this set."""
    made = tokenizer(path)
    entries = [made.decoder.decode([t]) for t in made.get_vocab(with_added_tokens=False)]
    entries = [e for e in entries if "�" not in e and e]
    encoded = made.encode_batch_fast(entries, add_special_tokens=False)
    return frozenset(e for e, x in zip(entries, encoded, strict=True) if len(x.ids) == 1)


def forget() -> None:
    """Drop what a Python worker keeps of tokenizers, once another operator takes it over."""
    for kept in (tokenizer, special_strings, whole_pieces):
        kept.cache_clear()


def byte_level_pretokens(text: str, path: str, _cut=regex.compile(BYTE_LEVEL).findall) -> tuple[list[str], int]:
    """The pre-tokens of a text, and how many special strings it holds, which count as one token each."""
    special = special_strings(path)
    parts, found = [text], 0
    if special is not None and special.search(text):
        found = sum(1 for _ in special.finditer(text))
        parts = special.split(text)
    out: list[str] = []
    for part in parts:
        if UNCOMMON.search(part):
            out += [part[a:b] for _, (a, b) in tokenizer(path).pre_tokenizer.pre_tokenize_str(part)]
        else:
            out += _cut(part)
    return out, found
