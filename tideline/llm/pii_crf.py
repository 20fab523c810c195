"""Personal data in texts (operator 6): fixed patterns, and a linear-chain conditional random field.

The field labels every white-space token. Scores come from tables by distinct word; a token whose change to outside
would better any path is outside in the best one, which parts the chain into runs without loss, and Viterbi decodes
the runs in numpy batches. It is trained by gradient ascent on a small labelled table. Its spans are added where no
pattern's span stands.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

Span = tuple[int, int, str]
KINDS = ("email", "ip", "card", "phone")
#: Kinds of the field's spans, after those of the patterns.
FIELD_KINDS = (*KINDS, "id", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A start inside a run of digits can't match where the run's own start does not: the look-behind keeps this linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _MARK = re.compile(r"[0-9]"), re.compile(r"[0-9@]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and not overlapping within a kind; failing matches are dropped."""
    out: list[Span] = []
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], FIELD_KINDS.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    """``kind:start:end`` by start, then kind, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in ordered(spans))


# ---- the field -------------------------------------------------------------------------------------------

LABELS = ("O", *(f"{p}-{k}" for k in FIELD_KINDS for p in "BI"))
_TOKEN = re.compile(r"\S+")
_TRIM_LEFT, _TRIM_RIGHT = "([{<\"'`,;:*#$%&", ")]}>\"'`,;:.!?*#$%&"


def shape(word: str) -> str:
    """Runs of digits, capitals and small letters as 0, A and a with their lengths up to 4; marks as they are."""
    def run(m: re.Match) -> str:
        c = m[0][0]
        return ("0" if c.isdigit() else "A" if c.isupper() else "a") + (str(len(m[0])) if len(m[0]) <= 4 else "+")

    return re.sub(r"[0-9]+|[A-Z]+|[a-zß-ſ]+", run, word)


def _trimmed(word: str) -> str:
    return word.strip(_TRIM_LEFT + _TRIM_RIGHT)


def own_features(raw: str) -> list[str]:
    """Features of a token by itself."""
    word = _trimmed(raw) or raw
    digits = sum(c.isdigit() for c in word)
    letters = sum(c.isalpha() for c in word)
    coarse = re.sub(r"[0-9]+", "0", re.sub(r"[A-Za-zß-ſ]+", "a", word))
    hexed = len(word) >= 16 and re.fullmatch(r"[0-9a-f]+", word) is not None
    return [
        "bias", f"shape={shape(word)}", f"raw={shape(raw)}", f"coarse={coarse}", f"digits={min(digits, 20)}", f"letters={min(letters, 12)}",
        f"long={min(len(word) // 4, 10)}", f"mixed={digits > 2 and letters > 2}/{len(word) >= 16}", f"hex={hexed}", f"upper={word.isupper() and len(word) >= 16}",
        f"at={'@' in word}/{'.' in word}", f"equals={'=' in word}", f"plus={raw[:1] == '+'}", f"open={raw[:1] == '('}", f"head={word[:4]}",
    ]


def near_features(raw: str | None) -> list[list[str]]:
    """What a token, or the text's edge, tells the next one, the one after that, and the one before."""
    near = "<>" if raw is None else _trimmed(raw).lower()
    beside = shape(raw) if raw is not None and _MARK.search(raw) else "-"
    return [[f"prev={near}", f"before={beside}"], [f"prev2={near}"], [f"next={near}", f"after={beside}"]]


def features(words: list[str], i: int) -> list[str]:
    """Word-shape features of token i, and of its neighbours."""
    at = lambda k: near_features(words[k] if 0 <= k < len(words) else None)
    return own_features(words[i]) + at(i - 1)[0] + at(i - 2)[1] + at(i + 1)[2]


def labelled_rows(n: int = 900, seed: int = 5) -> list[tuple[str, list[Span]]]:
    """The small labelled table: sentences with marked personal data, and with numbers that are none."""
    rnd = random.Random(seed)
    digits = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    hexed = lambda k: "".join(rnd.choice("0123456789abcdef") for _ in range(k))
    capital = lambda k: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(k))
    word = lambda: "".join(rnd.choice(["an", "er", "the", "ou", "st", "in", "re", "li", "mo", "ka"]) for _ in range(rnd.randint(1, 4)))
    part = lambda: str(rnd.randint(0, 255))
    made = {
        "email": [lambda: f"{word()}{digits(2)}@{word()}.com", lambda: f"{word()}.{word()}@{word()}.example.org", lambda: f"{word()}@{word()}", lambda: f"{word()}.{digits(2)}@mail{digits(1)}.example.com"],
        "ip": [lambda: ".".join(part() for _ in range(4)), lambda: ":".join(hexed(4) for _ in range(8))],
        "card": [lambda: digits(16), lambda: " ".join(digits(4) for _ in range(4)), lambda: "-".join(digits(4) for _ in range(4))],
        "phone": [lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}", lambda: f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"+{digits(2)} {digits(3)} {digits(4)} {digits(3)}"],
        "id": [lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: f"{capital(2)}{digits(2)}{capital(4)}{digits(14)}"],
        "secret": [lambda: "AKIA" + capital(16), lambda: f"password={hexed(18)}", lambda: f'token = "{hexed(40)}"', lambda: hexed(rnd.choice([32, 40, 64])), lambda: f"api_key={hexed(32)}"],
    }
    clean = [lambda: f"version {digits(1)}.{digits(1)}.{digits(1)}", lambda: f"in {rnd.randint(1900, 2030)}", lambda: f"20{digits(2)}-0{rnd.randint(1, 9)}-{rnd.randint(10, 28)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(1)}.{digits(2)}", lambda: f"${digits(3)}.{digits(2)}", lambda: f"{digits(2)}%", lambda: f"{digits(1)},{digits(3)},{digits(3)}", lambda: digits(rnd.randint(1, 7)), lambda: f"CC BY-NC {digits(1)}.{digits(1)}.", lambda: f"{word()}{digits(2)}", lambda: f"version {digits(1)}.", lambda: f"{rnd.randint(1, 31)}/{rnd.randint(1, 12)}/{rnd.randint(1950, 2030)}", lambda: f"{digits(3)}-{digits(3)}", lambda: f"{word()}-{digits(3)}", lambda: f"@{word()}", lambda: f"#{digits(4)}", lambda: f"{rnd.randint(1, 99)}th", lambda: digits(9), lambda: f"{digits(3)} {digits(3)}", lambda: f"v{digits(1)}.{digits(2)}.{digits(1)}", lambda: f"{digits(4)} {digits(2)} {digits(2)}"]
    rows = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rnd.randint(1, 3)):
            text += " ".join(word() for _ in range(rnd.randint(0, 5))) + " "
            if rnd.random() < 0.6:
                kind = rnd.choice(FIELD_KINDS)
                own = rnd.choice(made[kind])()
                text += rnd.choice(["", "", "", "(", '"'])
                quoted = own.find('"') + 1
                spans.append((len(text) + quoted, len(text) + len(own) - (quoted > 0), kind))
                text += own + rnd.choice(["", "", "", ".", ",", ")", "###", "$$$"])
            else:
                text += rnd.choice(clean)()
            text += " "
        rows.append((text + word(), spans))
    return rows


def letter_rows(n: int = 400, seed: int = 6) -> list[tuple[str, list[Span]]]:
    """Further labelled rows: secrets of letters alone, among words of every case and length, marks and addresses."""
    rnd = random.Random(seed)
    pick = lambda letters, low, high: "".join(rnd.choice(letters) for _ in range(rnd.randint(low, high)))
    small, capital = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = lambda k: "".join(rnd.choice(["an", "er", "the", "ou", "st", "in", "ße", "li", "mo", "ka", "ä", "qu", "é", "sch"]) for _ in range(rnd.randint(1, k)))
    secret = [lambda: "AKIA" + pick(capital, 16, 16), lambda: f"password={pick(small, 8, 24)}", lambda: f"password={pick(small + capital, 8, 24)}", lambda: f'token = "{pick(small + capital, 24, 40)}"', lambda: f"api_key={pick(small + capital, 20, 40)}"]
    clean = [lambda: word(4), lambda: word(12), lambda: word(4).title(), lambda: word(10).title(), lambda: word(4).upper(), lambda: word(9).upper(), lambda: word(3) + "-" + word(3), lambda: word(3) + "'" + word(1), lambda: word(3) + rnd.choice(".,;:!?"), lambda: f"({word(3)})", lambda: f'"{word(3).title()}"', lambda: rnd.choice(["-", "=", "&", "|", "*", "###", "$$$", "%%%", "...", "--"]), lambda: f"https://{word(3)}.example.org/{word(2)}/{word(3)}", lambda: f"{word(2)}={word(2)}", lambda: f"{word(3)}:", lambda: f"password {word(2)}", lambda: f"token {word(2)}", lambda: f"the {word(3)} = {word(2)}", lambda: f"<{word(2)}>", lambda: f"{word(2)}_{word(2)}()", lambda: pick(small, 1, 9)]
    rows = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rnd.randint(4, 12)):
            if rnd.random() < 0.1:
                own = rnd.choice(secret)()
                quoted = own.find('"') + 1
                spans.append((len(text) + quoted, len(text) + len(own) - (quoted > 0), "secret"))
                text += own + rnd.choice(["", "", ".", ",", "###", "$$$"]) + " "
            else:
                text += rnd.choice(clean)() + " "
        rows.append((text, spans))
    return rows


def training_rows() -> list[tuple[str, list[Span]]]:
    """The labelled table that a field is trained on where none is given."""
    return labelled_rows() + letter_rows()


def _runs(text: str) -> list[list[tuple[int, int, list[str], int]]]:
    """All tokens of a text as one run, none of an empty one: start, end, words around, own place in them."""
    found = [(m[0], *m.span()) for m in _TOKEN.finditer(text)]
    words = [w for w, _, _ in found]
    run = [(a, b, words[max(0, i - 2) : i + 3], min(i, 2)) for i, (_, a, b) in enumerate(found)]
    return [run] if run else []


_FORM = str.maketrans("abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a" * 58 + "A" * 26 + "0" * 10)
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Distinct words, and characters of words and forms, that a field remembers from one batch to the next.
_WORDS, _WORD_CHARS = 150_000, 4_000_000
#: Rows of tokens whose scores are made at once.
_BLOCK = 8_192


class Field:
    """Weights of the field: per feature and label, per pair of labels, and at a run's start."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.index, self.emit, self.move, self.start = index, emit, move, start
        self._forget()

    def __getstate__(self):
        return self.index, self.emit, self.move, self.start

    def __setstate__(self, state):
        self.__init__(*state)

    def _forget(self) -> None:
        #: Row of each word; words of one form, one known beginning and one known name share it.
        self._known: dict[str | None, int] = {None: 0}
        self._forms: dict[str, int] = {}
        self._form_sums: list[tuple[np.ndarray, ...]] = []
        self._rows: dict[tuple[int, int, int], int] = {}
        self._chars = 0
        lone = [self._sum(names) for names in near_features(None)]
        self._tables = np.stack([np.zeros(len(LABELS)), *lone])[None]
        self._heads = {f[5:]: i for f, i in self.index.items() if f.startswith("head=")}
        names = dict.fromkeys(f.split("=", 1)[1] for f in self.index if f.startswith(("prev=", "prev2=", "next=")))
        self._names = {name: k for k, name in enumerate(names)}
        self._name_sums = [tuple(self._sum([f"{of}={name}"]) for of in ("prev", "prev2", "next")) for name in names]

    def _sum(self, names: list[str]) -> np.ndarray:
        return self.emit[[self.index[f] for f in names if f in self.index]].sum(axis=0)

    def _learn(self, words: Iterable[str]) -> None:
        """Rows for words not seen before. What a word's features are follows from its form (letters and digits
        by class; whether it is hexadecimal), its first letters, and its own name as a neighbour."""
        known, forms, rows, heads, names = self._known, self._forms, self._rows, self._heads, self._names
        made = []
        for w in words:
            form = w.translate(_FORM)
            trimmed = _trimmed(w)
            if len(w) >= 16 and _HEX.fullmatch(trimmed or w):
                form += "\0"
            own = forms.get(form)
            if own is None:
                own = forms[form] = len(self._form_sums)
                beside = near_features(w)
                self._form_sums.append((self._sum(own_features(w)[:-1]), self._sum(beside[0][1:]), self._sum(beside[2][1:])))
                self._chars += len(form)
            key = (own, heads.get((trimmed or w)[:4], -1), names.get(trimmed.lower(), -1))
            row = rows.get(key)
            if row is None:
                row = rows[key] = len(self._tables) + len(made)
                made.append(key)
            known[w] = row
            self._chars += len(w)
        if made:
            table = np.zeros((len(made), 4, len(LABELS)))
            for k, (own, head, name) in enumerate(made):
                table[k, 0], table[k, 1], table[k, 3] = self._form_sums[own]
                if head >= 0:
                    table[k, 0] += self.emit[head]
                if name >= 0:
                    table[k, 1:] += self._name_sums[name]
            self._tables = np.concatenate([self._tables, table])

    def _places(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Table rows of all texts' tokens one after another, with two edge rows before each text and at the end;
        and where each text's first token is."""
        if len(self._known) > _WORDS or self._chars > _WORD_CHARS:
            self._forget()
        known = self._known
        self._learn(set().union(*texts).difference(known))
        at = np.zeros(sum(map(len, texts)) + 2 * len(texts) + 2, np.int32)
        first, done = np.empty(len(texts), int), 2
        for n, words in enumerate(texts):
            first[n] = done
            at[done : done + len(words)] = [known[w] for w in words]
            done += len(words) + 2
        return at, first

    def _scores(self, at: np.ndarray, low: int, high: int) -> np.ndarray:
        """Scores by label of the tokens in rows ``low`` to ``high``, from their own and their neighbours' tables."""
        tables = self._tables
        out = tables[at[low:high], 0]
        out[max(0, 1 - low) :] += tables[at[max(0, low - 1) : high - 1], 1]
        out[max(0, 2 - low) :] += tables[at[max(0, low - 2) : high - 2], 2]
        out[: len(at) - 1 - low] += tables[at[low + 1 : high + 1], 3]
        return out

    def emissions(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all rows of ``_places``, and the first token's row of each text."""
        at, first = self._places(texts)
        return self._scores(at, 0, len(at)), first

    def scores(self, run) -> np.ndarray:
        return self.emissions([[words[i] for _, _, words, i in run]])[0][2:-2]

    def open_rows(self, at: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether a token may have a label in a best path, of texts in rows ``first`` to ``ends``. How far the best
        way to a label may lead the best way to outside is bounded whatever stands before, and likewise behind.
        Where the bounds leave each label behind, none can win; where they do not, they are narrowed by the
        neighbours' own bounds. Rows between texts are closed."""
        move, to, back = self.move, self.move - self.move[:, :1], self.move - self.move[:1]
        edge = self.start - self.start[0]
        plain = [i for i, n in enumerate(LABELS) if n[0] != "I"]
        ahead_most, behind_most = to.max(axis=0), back[:, plain].max(axis=1)
        inner = []  # a span that goes on behind could begin anew there
        for kind in FIELD_KINDS:
            x, y = LABELS.index(f"B-{kind}"), LABELS.index(f"I-{kind}")
            anew = max(0.0, (move[y, [*plain, y]] - move[x, [*plain, y]]).max())
            inner += [(label, x, y, move[label, y] - move[0, x] + anew) for label in (x, y)]
        out = np.zeros(len(at), bool)
        inside = np.zeros(len(at) + 1, int)
        inside[first], inside[ends] = 1, -1
        inside = inside.cumsum()[:-1] > 0
        for low in range(0, len(at), _BLOCK):
            # rows beside the block only lend their bounds
            top = min(len(at), low + _BLOCK)
            a, b = max(0, low - 2), min(len(at), top + 2)
            own = np.ascontiguousarray(self._scores(at, a, b).T)
            own -= own[0].copy()
            begins, stops = first[(first >= a) & (first < b)] - a, ends[(ends > a) & (ends <= b)] - a - 1
            ahead, behind = np.repeat(ahead_most[:, None], b - a, 1), np.repeat(behind_most[:, None], b - a, 1)
            for label, x, y, anew in inner:
                np.maximum(behind[label, :-1], own[y, 1:] - own[x, 1:] + anew, out=behind[label, :-1])
            behind[:, -1] = np.inf
            ahead[:, begins], behind[:, stops] = edge[:, None], 0.0
            lead, rest = own + ahead, own + behind
            most = (lead + behind)[1:, low - a : top - a].max(axis=0)
            here = np.flatnonzero((most > -1e-6) & inside[low:top]) + low - a
            own, ahead, behind, lead, rest = own[:, here], ahead[:, here], behind[:, here], lead[:, here - 1], rest[:, here + 1]
            came, goes = lead[0] + move[0][:, None], rest[0] + move[:, 0][:, None]
            for label in range(1, len(LABELS)):
                np.maximum(came, lead[label] + move[label][:, None], out=came)
                np.maximum(goes, rest[label] + move[:, label][:, None], out=goes)
            came[0], goes[0] = move[0, 0], move[0, 0]
            came, goes = np.minimum(ahead, came - move[0, 0]), np.minimum(behind, goes - move[0, 0])
            came[:, np.isin(here, begins)], goes[:, np.isin(here, stops)] = edge[:, None], 0.0
            out[here + a] = ((own + came + goes)[1:] > -1e-6).any(axis=0)
        return out

    def viterbi(self, runs: list) -> list[list[int]]:
        """Best labels of many runs at once."""
        scores = [self.scores(run) for run in runs]
        return self.decoded(scores, [(True, True)] * len(runs))

    def decoded(self, runs: list[np.ndarray], edges: list[tuple[bool, bool]]) -> list[list[int]]:
        """Best labels of runs by their scores, those of like length together; ``edges`` say whether a run begins
        and ends its text, or stands beside an outside token."""
        out: list[list[int]] = [[] for _ in runs]
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
        at = 0
        while at < len(order):
            batch = order[at : at + 512]
            while len(batch) > 1 and sum(len(runs[i]) for i in batch) > 1 << 16:
                batch = batch[: len(batch) // 2]
            at += len(batch)
            lengths = np.array([len(runs[i]) for i in batch])
            padded = np.zeros((len(batch), lengths.max(), len(LABELS)))
            for b, i in enumerate(batch):
                padded[b, : lengths[b]] = runs[i]
            best = padded[:, 0] + np.where([[edges[i][0]] for i in batch], self.start, self.move[0])
            back = np.zeros(padded.shape, np.int16)
            for t in range(1, padded.shape[1]):
                way = best[:, :, None] + self.move
                back[:, t] = way.argmax(axis=1)
                best = np.where((t < lengths)[:, None], way.max(axis=1) + padded[:, t], best)
            label = (best + np.where([[edges[i][1]] for i in batch], 0.0, self.move[:, 0])).argmax(axis=1)
            for b, i in enumerate(batch):
                path = [int(label[b])]
                for t in range(lengths[b] - 1, 0, -1):
                    path.append(int(back[b, t, path[-1]]))
                out[i] = path[::-1]
        return out

    def labels(self, texts: list[list[str]]) -> list[list[int] | None]:
        """Best labels of each text's words; None where all are outside."""
        at, first = self._places(texts)
        ends = first + np.array([len(words) for words in texts], int)
        some = ends > first
        open_ = self.open_rows(at, first[some], ends[some])
        turn = np.flatnonzero(np.diff(np.r_[False, open_, False]))
        low, high = turn[::2], turn[1::2]
        text = np.searchsorted(first, low, "right") - 1
        out: list[list[int] | None] = [None] * len(texts)
        paths = self.decoded([self._scores(at, a, b) for a, b in zip(low, high, strict=True)], [(a == first[n], b == ends[n]) for n, a, b in zip(text, low, high, strict=True)])
        for n, a, path in zip(text.tolist(), low.tolist(), paths, strict=True):
            if any(path):
                own = out[n] = out[n] or [0] * len(texts[n])
                own[a - first[n] : a - first[n] + len(path)] = path
        return out

    def spans(self, texts: list[str]) -> list[list[Span]]:
        """The field's spans in each text, without brackets and marks around them."""
        out: list[list[Span]] = [[] for _ in texts]
        for n, labels in enumerate(self.labels([text.split() for text in texts])):
            if labels is None:
                continue
            run = [m.span() for m in _TOKEN.finditer(texts[n])]
            open_at = None
            for k in range(len(run) + 1):
                name = LABELS[labels[k]] if k < len(run) else "O"
                if open_at is not None and name[:2] != "I-":
                    a, b = run[open_at][0], run[k - 1][1]
                    while a < b and texts[n][a] in _TRIM_LEFT[1:]:
                        a += 1
                    while b > a and texts[n][b - 1] in _TRIM_RIGHT:
                        b -= 1
                    if texts[n][a] == "(" and texts[n].count("(", a, b) > texts[n].count(")", a, b):
                        a += 1
                    if a < b:
                        out[n].append((a, b, LABELS[labels[open_at]][2:]))
                    open_at = None
                if name[:2] == "B-":
                    open_at = k
        return out


def train(rows: Iterable[tuple[str, list[Span]]], rounds: int = 150, rate: float = 0.2, ridge: float = 2e-4) -> Field:
    """Fit the field to labelled texts by gradient ascent on the penalised likelihood (forward-backward, scaled
    at each token). The table is small, so this runs where it is called."""
    runs, golds = [], []
    for text, spans in rows:
        for run in _runs(text):
            gold = []
            for t, (a, b, _, _) in enumerate(run):
                hit = next((s for s in spans if s[0] < b and a < s[1]), None)
                started = hit is not None and any(s < a and e > hit[0] for s, e, _, _ in run[max(0, t - 20) : t])
                gold.append(0 if hit is None else LABELS.index(("I-" if started else "B-") + hit[2]))
            runs.append(run)
            golds.append(gold)
    index: dict[str, int] = {}
    seen: dict[str, int] = {}
    for run in runs:
        for _, _, words, i in run:
            for f in features(words, i):
                seen[f] = seen.get(f, 0) + 1
    for f in sorted(f for f, n in seen.items() if n > 2):
        index[f] = len(index)
    k, longest = len(LABELS), max(map(len, runs))
    flat_feature, flat_token = [], []
    token_at = np.full((len(runs), longest), -1)
    gold_at = np.zeros((len(runs), longest), int)
    tokens = 0
    for r, run in enumerate(runs):
        for t, (_, _, words, i) in enumerate(run):
            for f in features(words, i):
                if f in index:
                    flat_feature.append(index[f])
                    flat_token.append(tokens)
            token_at[r, t], gold_at[r, t] = tokens, golds[r][t]
            tokens += 1
    flat_feature, flat_token = np.array(flat_feature), np.array(flat_token)
    by_feature = np.argsort(flat_feature, kind="stable")
    token_of, feature_starts = flat_token[by_feature], np.searchsorted(flat_feature[by_feature], np.arange(len(index)))
    token_starts = np.searchsorted(flat_token, np.arange(tokens))
    real = token_at >= 0
    weights = [np.zeros((len(index), k)), np.zeros((k, k)), np.zeros(k)]
    # an inside label follows only its own kind
    barred = np.zeros((k, k))
    for j, name in enumerate(LABELS):
        if name[0] == "I":
            barred[[i for i, other in enumerate(LABELS) if other[2:] != name[2:]], j] = -1e4
    barred_start = np.where([n[0] == "I" for n in LABELS], -1e4, 0.0)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]

    both = real[:, 1:]
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (gold_at[:, :-1][both], gold_at[:, 1:][both]), 1.0)
    for step in range(1, rounds + 1):
        emit, move, start = weights[0], weights[1] + barred, weights[2] + barred_start
        per_token = np.add.reduceat(emit[flat_feature], token_starts)  # every token has the bias
        local = np.where(real[:, :, None], np.exp(per_token - per_token.max(axis=1, keepdims=True))[token_at], 1.0)
        step_to, scale = np.exp(move - move.max()), np.ones((*real.shape, 1))
        forward, backward = np.empty(local.shape), np.ones(local.shape)
        for t in range(longest):
            on = real[:, t, None]
            way = (forward[:, t - 1] @ step_to if t else np.exp(start - start.max())) * local[:, t]
            total = way.sum(axis=1, keepdims=True)
            forward[:, t] = np.where(on, way / total, forward[:, t - 1])
            scale[:, t] = np.where(on, total, 1.0)
        for t in range(longest - 2, -1, -1):
            way = (local[:, t + 1] * backward[:, t + 1] / scale[:, t + 1]) @ step_to.T
            backward[:, t] = np.where(real[:, t + 1, None], way, 1.0)
        gap = -forward * backward
        gap[(*np.nonzero(real), gold_at[real])] += 1.0
        gap[~real] = 0
        token_gap = np.zeros((tokens, k))
        token_gap[token_at[real]] = gap[real]
        came = (local * backward / scale)[:, 1:][both]
        grads = [np.add.reduceat(token_gap[token_of], feature_starts), gold_pairs - step_to * (forward[:, :-1][both].T @ came), gap[:, 0].sum(axis=0)]
        for w, g, (m, v) in zip(weights, grads, moments, strict=True):
            g = g / len(runs) - ridge * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(index, weights[0], weights[1] + barred, weights[2] + barred_start)


@lru_cache(maxsize=1)
def trained() -> Field:
    """The field of ``training_rows``, fitted once a process."""
    return train(training_rows())


def sound(found: str, kind: str) -> bool:
    """Whether a span of the field can be of its kind: a card's digits have a checksum, an address's parts a bound."""
    if kind == "card":
        digits = _NO_DIGIT.sub("", found)
        return 12 <= len(digits) <= 19 and _luhn(digits)
    if kind == "ip" and ":" not in found:
        parts = _NO_DIGIT.split(found)
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)
    return True


def all_spans(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """For each text the patterns' spans, and all: the field's sound ones are added where no pattern's stands."""
    out = []
    for text, more in zip(texts, field.spans(texts), strict=True):
        base = base_spans(text)
        added = [s for s in more if not any(a < s[1] and s[0] < b for a, b, _ in base) and sound(text[s[0] : s[1]], s[2])]
        out.append((base, base + added))
    return out


# ---- over tables -----------------------------------------------------------------------------------------


_sent: dict = {}


def _shared(docs: DataFrame, field: Field | None) -> Broadcast:
    """The field as a broadcast; the default one is sent once a session, so that workers hold it once."""
    context = docs.sparkSession.sparkContext
    if field is not None:
        return context.broadcast(field)
    if context.applicationId not in _sent:
        _sent[context.applicationId] = context.broadcast(trained())
    return _sent[context.applicationId]


def find(docs: DataFrame, field: Field | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_key, base, spans`` per row: arrays of (kind, start, end) in code points, end exclusive, by start and
    then kind. A null text is empty. Texts are searched whole, in time linear in their length."""
    made = _shared(docs, field)
    texts = common.own_columns(docs, doc_key=id_column, text=text_column).select(F.col("doc_key").cast("long"), "text")
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_key", pa.int64()), ("base", span), ("spans", span)])
    as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for a, b, k in ordered(spans)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.turn("personal data", made.value._forget)
        for keys, parts in common.chunks(batches, most=1_000_000):
            found = all_spans(parts, made.value)
            yield from common.rows_out(schema, [keys, [as_rows(b) for b, _ in found], [as_rows(a) for _, a in found]])

    ddl = "array<struct<kind:string,start:long,end:long>>"
    return texts.mapInArrow(run, f"doc_key long, base {ddl}, spans {ddl}")


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span, or union of overlapping ones, as [KIND] of its first."""
    if text is None or not spans:
        return text
    out, done, last = [], 0, None
    for a, b, kind in ordered(spans):
        if last is not None and a < done:
            done = max(done, b)
            continue
        out += [text[done:a], f"[{kind.upper()}]"]
        done, last = b, kind
    return "".join(out) + text[done:]


def redact(docs: DataFrame, field: Field | None = None, text_column: str = "text") -> DataFrame:
    """``docs``, all columns, with the spans of each text masked; nothing is shuffled."""
    made = _shared(docs, field)

    def change():
        common.turn("personal data", made.value._forget)
        return lambda texts: [redacted(t, a) for t, (_, a) in zip(texts, all_spans([t or "" for t in texts], made.value), strict=True)]

    return common.texts_changed(docs, text_column, change)
