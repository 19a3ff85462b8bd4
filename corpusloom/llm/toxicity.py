"""Abusive, hateful or sexual content (problem 10).

A linear-chain conditional random field tags every word of every text as part of an abusive span or not. It is trained
on the driver from rows with labelled spans: a table of the caller, or the rows of :mod:`toxic_rows`. Its features are
words and word classes at and around a place, pairs of classes, and which classes stand nearby. Forward-backward
marginals give each word the probability that it lies in a span; runs of likely words are the offending offsets.
"""

from __future__ import annotations

import html
import itertools
import random
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import toxic_rows

SCORES = "doc_id long, source string, score double, spans array<struct<first:int,last:int,score:double>>"
#: A document with a span of at least this score is a case.
THRESHOLD = 0.5
SEED, STEPS, L2 = 11, 200, 3e-5
#: Rows in a step of the training.
BATCH_ROWS = 4000
#: Sentences drawn from each pattern of the rows that ship with the operator.
PER_PATTERN = 24
#: Labelled rows of a caller's table that are used for training at most, those of the least hash of their text.
MOST_LABELLED = 50_000
#: Words that are scored at once.
BATCH_WORDS = 200_000
#: Weights that all couples of known neighbouring words share by a hash.
COUPLES = 1 << 16
#: Words to both sides in which classes count as nearby.
NEARBY = 8

_LOOKALIKE = str.maketrans(
    "аеорсхукмтнвіѕјԁһɡ" + "АЕОРСХУКМТНВІ" + "’‘´`", "aeopcxykmthbisjdhg" + "aeopcxykmthbi" + "''''"
)
_LEET = str.maketrans("@$013457!", "asoieasti")
_HIDDEN = re.compile("[​-‏⁠﻿­]")
#: What may hide a word. Every branch begins with a character that is rare, so that others are passed over at once.
_ODD = re.compile(
    r"[@$*013457!](?<=[^\W\d_].)[@$*013457!]*[^\W\d_]|[@$013457][^\W\d_]|[@$!](?<=[a-zA-Z].)(?!\w)|\*(?<=[a-zA-Z].)\*|-(?<=[a-zA-Z].)--"
    r"|[Ѐ-ӿԁһɡѕі\u0300-\u036f\u24b6-\u24e9\uff01-\uff5e\U0001d400-\U0001d7ff]"
)
_ODD_SPACED = re.compile(r"[ .*_-](?<=\b\w.)[ .*_-]{0,2}\w(?:[ .*_-]{1,3}\w){2,}(?!\w)")
_MARKS = re.compile("[\u0300-\u036f]")
_TRIPLES = [chr(c) * 3 for c in range(97, 123)]
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_BREAKS = r"[.!?]+(?=[\s\"')]|$)|\n[ \t>*#/-]*\n"
_WORD = r"[^\W\d_]+(?:['’][^\W\d_]+)*"
_TOKEN = re.compile(rf"{_WORD}|[\"“”«»„@,:;]|{_BREAKS}")
#: Single signs between letters; two stars or dashes are letters that a mask hides.
_SPACED = r"(?<![\w@$])[\w@$](?:(?: {1,3}| ?[._]{1,3} ?| ?[*-] ?)[\w@$]){2,}(?![\w@$])"
_ROUGH = re.compile(rf"(?P<spaced>{_SPACED})|(?P<cut>{_BREAKS})|[\"“”«»„,:;]|[^\s\"“”«»„,:;()<>.?]+(?:[.?!][^\s\"“”«»„,:;()<>.?]+)*")
_MARKUP = re.compile(r"&#?\w+;|</?[a-zA-Z]{1,6}>")
#: Letters as entities, tags within a word and words cut at the end of a line.
_WITHIN = re.compile(r"(?<=[^\W\d_])(?:</?(?:[biu]|em|strong|span|font)>)+(?=[^\W\d_])|(?<=[^\W\d_]{2})-\r?\n[ \t>]*(?=[^\W\d_]{2})")
_MASKED = re.compile(r"[^\W\d_]+[*-]+[^\W\d_]*")

CLASSES = ["none", "edge", "quote", "comma", "at", "mask", *toxic_rows.WORDS]
_NO = {c: k for k, c in enumerate(CLASSES)}
#: Groups of classes whose presence nearby is a feature.
GROUPS = [
    ("you", "your"), ("group", "slur"), ("mention", "quote"), ("thing",), ("insult", "softins", "adj", "vulgar", "shut", "mask"),
    ("violence", "death", "expel", "weapon"), ("dehuman", "evil", "hate"), ("sexnoun", "sexverb"), ("kin", "body", "person", "at"),
]
_IN_GROUP = np.array([[c in g for c in CLASSES] for g in GROUPS])
SHIFTS = (-4, -3, -2, -1, 0, 1, 2, 3, 4)
PAIRS = ((-1, 0), (0, 1), (-2, 0), (0, 2), (-1, 1))


def _classes() -> dict[str, int]:
    out: dict[str, int] = {}
    for name, words in toxic_rows.WORDS.items():
        for w in words.split():
            out.setdefault(w, _NO[name])
    for w, c in list(out.items()):
        for x in toxic_rows.without_accents(w):
            out.setdefault(x, c)
    return out


_CLASS = _classes()
#: Words that disguised spellings are restored to.
_LOADED = {_NO[c] for c in ("insult", "adj", "vulgar", "shut", "slur", "dehuman", "violence", "death", "sexnoun", "sexverb")}
_RESTORED = {w for w, c in _CLASS.items() if c in _LOADED} | {"piece", "of", "off", "you", "your", "are", "kys"}
#: These as what a mask may stand for, the likeliest first: a word of abuse, those of the first classes, the first of a class.
_MASKABLE = list(dict.fromkeys(["piece", *(w for c in ("vulgar", "insult", "adj", "slur") for w, k in _CLASS.items() if k == _NO[c]), *sorted(_RESTORED)]))
_ENDINGS = ("'s", "est", "er", "s", "es", "en", "er", "n", "e", "in", "innen", "ing", "ed")


def class_of(word: str) -> int:
    """The class of WORD, or that of the word without a common ending; any people of some land is a group."""
    c = _CLASS.get(word)
    if c is None and len(word) > 4:
        for end in _ENDINGS:
            if word.endswith(end) and len(word) - len(end) >= 4 and (c := _CLASS.get(word[: -len(end)])) is not None:
                return c
        if len(word) > 8 and word.endswith("landers"):
            return _NO["group"]
    return c or 0


def disguised(text: str) -> bool:
    """Whether anything in TEXT may hide a word: signs for letters, blanks between them, repeats, lookalikes."""
    if _ODD.search(text) or _ODD_SPACED.search(text) or not text.isascii() and _HIDDEN.search(text):
        return True
    low = text.lower()
    return any(x in low for x in _TRIPLES) or not text.isascii() and _TRIPLE.search(low) is not None


_CHANGED = re.compile(r"[@$!\d]|(.)\1")


@lru_cache(maxsize=100_000)
def _plain_word(w: str) -> str:
    """The word that a disguised spelling W stands for, or W itself."""
    if len(w) > 30 or not _CHANGED.search(w) or w.isdigit():
        return w
    for x in (w, w.translate(_LEET), w.rstrip("!").translate(_LEET)):
        for y in (x, re.sub(r"(.)\1{2,}", r"\1", x), re.sub(r"(.)\1{2,}", r"\1\1", x), re.sub(r"(.)\1+", r"\1", x)):
            if y in _RESTORED or len(y) > 4 and class_of(y) in _LOADED:
                return y
    return w


@lru_cache(maxsize=10_000)
def _unmasked(w: str) -> str:
    """The word that W with ``*`` or ``-`` for letters stands for; ``<mask>`` if none of one length fits."""
    m = re.compile(re.sub(r"[*-]+", lambda m: f"[a-z]{{{len(m[0])}}}", w) + "$")
    return next((x for x in _MASKABLE if m.match(x)), "<mask>")


#: Words that may be spelled with blanks between their letters; shorter ones are those listed.
_SPELLED = {
    w
    for text in (*toxic_rows.WORDS.values(), *toxic_rows.SLOTS.values(), *toxic_rows.COMMON, toxic_rows.TOXIC.lower())
    for w in _TOKEN.findall(text)
    if len(w) >= 3
} | set("a i of to is in it my me so no go we he up at on or an as be do us ur du tu te le la de es un en".split())


@lru_cache(maxsize=100_000)
def _spelled(letters: str) -> str | None:
    """The word that LETTERS spell, if any."""
    if letters in _SPELLED:
        return letters
    w = _plain_word(letters) if len(letters) >= 3 else letters
    return w if w in _RESTORED else None


def _from_spaced(raw: str) -> list[tuple[int, int, str]]:
    """Words spelled with blanks or signs between their letters in RAW, the fewest that use the most letters; others stay apart."""
    out, at = [], 0
    for part in re.split(r"([ .*_-]{3}|(?<=\S) {2,}(?=\S))", raw):
        letters = [(m.start(), m[0]) for m in re.finditer(r"[^ .*_-]", part)]
        text = "".join(x for _, x in letters)
        # least cost of the letters up to each place: 1 for a word, 2 for a letter of none
        best: list[tuple[float, int, str | None]] = [(0, 0, None)]
        for e in range(1, len(text) + 1):
            ways = [(best[e - 1][0] + 2, e - 1, None)]
            ways += [(best[b][0] + 1, b, w) for b in range(max(0, e - 20), e) if (w := _spelled(text[b:e]))]
            best.append(min(ways, key=lambda x: x[:2]))
        found, e = [], len(text)
        while e:
            _, b, w = best[e]
            if w:
                found.append((at + letters[b][0], at + letters[e - 1][0] + 1, w))
            e = b
        if any(len(w) >= 3 for _, _, w in found):
            out += found[::-1]
        at += len(part)
    return out


def _rough(body: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _ROUGH.finditer(body):
        raw, at = m[0], m.start()
        if m["cut"] or len(raw) == 1 and raw in '"“”«»„,:;':
            out.append((at, m.end(), raw))
        elif raw.isascii() and raw.isalpha():
            out.append((at, m.end(), _plain_word(raw.lower())))
        elif m["spaced"]:
            out += [(at + a, at + b, w) for a, b, w in _from_spaced(unicodedata.normalize("NFKC", raw).lower().translate(_LOOKALIKE))]
        else:
            w = _MARKS.sub("", unicodedata.normalize("NFKC", _HIDDEN.sub("", raw))).lower().translate(_LOOKALIKE)
            core = w.strip("*_~'[]{}|")
            if w.startswith("@") and w[1:].isalpha() and _plain_word(w) == w:
                out += [(at, at + 1, "@"), (at + 1, m.end(), w[1:])]
            elif (mask := _MASKED.match(w)) and not w[mask.end() :].strip("!'*_~") and ("**" in mask[0] or "--" in mask[0] or re.fullmatch(r"[a-z]+\*[a-z]+", mask[0])):
                out.append((at, m.end(), _unmasked(mask[0])))
            elif (p := _plain_word(core)) != core or p in _RESTORED:
                out.append((at, m.end(), p))
                if w.endswith("!"):
                    out.append((m.end() - 1, m.end(), "!"))
            else:
                for x in _TOKEN.finditer(w):
                    out.append((at + x.start(), min(m.end(), at + x.end()), x[0]))
    return out


#: A hidden character, which leaves the word around it whole.
_PAD = "\u200b"


def _unescaped(m: re.Match) -> str:
    """What the entity or tag M stands for, filled up to its length; a letter keeps its place within the word."""
    x = html.unescape(m[0]) if m[0][0] == "&" else ""
    return x[: len(m[0])].ljust(len(m[0]), _PAD if len(x) == 1 and (x.isalpha() or x == "'") else " ")


def _body(text: str) -> tuple[str, str]:
    """TEXT with entities and simple tags replaced at equal length, and its lower case of the same length."""
    if "-\n" in text or "-\r" in text or "</" in text:
        text = _WITHIN.sub(lambda m: _PAD * len(m[0]), text)
    if "&" in text or "<" in text:
        text = _MARKUP.sub(_unescaped, text)
    low = text.lower()
    return text, low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def words_at(text: str) -> list[tuple[int, int, str]]:
    """The words and marks of TEXT as (first character, end, word in its usual spelling)."""
    body, low = _body(text)
    if disguised(body):
        return _rough(body)
    return [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(low)]


def words(text: str) -> list[str]:
    """The words of :func:`words_at`."""
    body, low = _body(text)
    if disguised(body):
        return [w for _, _, w in _rough(body)]
    return _TOKEN.findall(low)


class Field:
    """A linear-chain conditional random field with two labels; words that it has not seen count by their class alone."""

    def fit(self, rows: list[tuple[str, list[tuple[int, int]]]], steps: int = STEPS, l2: float = L2) -> "Field":
        """Train on ROWS of (text, character spans that are abusive)."""
        seen: dict[str, int] = {}
        read = [(words_at(t), s) for t, s in rows]
        for ws, _ in read:
            for w in {w for _, _, w in ws}:
                seen[w] = seen.get(w, 0) + 1
        # things and names stand for any others, so these are known by their class only
        skip = {"thing", "insult", "group", "violence", "sexnoun", "dehuman", "evil"}
        self.known = {w: k for k, w in enumerate(sorted(w for w, n in seen.items() if n >= 8 and CLASSES[class_of(w)] not in skip), 1)}
        self.look = _Codes(self.known)
        order = random.Random(SEED).sample(range(len(read)), len(read))
        flat, labels, ends = [], [], []
        for ws, spans in (read[k] for k in order):
            flat += [self.look[w] for _, _, w in ws] + [-1]
            labels += [int(any(a < z and y < b for y, z in spans)) for a, b, _ in ws] + [0]
            ends.append(len(flat))
        codes, y = np.array(flat), np.array(labels)
        self._layout()
        batches = []
        # codes hold whole rows in any order, so that runs of them are samples of all
        cuts = [0] + [ends[k - 1] for k in range(BATCH_ROWS, len(ends) - BATCH_ROWS // 2, BATCH_ROWS)] + [len(codes)]
        for lo, hi in itertools.pairwise(cuts):
            seqs = _Sequences(codes[lo:hi])
            places, yy = np.arange(hi - lo), y[lo:hi]
            parts = [seqs.pad(places, part) for part in seqs.parts(20_000)]
            gold = np.zeros((2, 2))
            for cells, real in parts:
                v, both = yy[cells], real[:, 1:]
                gold += [[(both & (v[:, :-1] == a) & (v[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)]
            batches.append((self._features(codes[lo:hi]).astype(np.int32), yy, parts, gold, max(1, len(seqs.begin))))
        w, t = np.zeros(self.size), np.zeros((2, 2))
        m1, m2, s1, s2 = np.zeros(self.size), np.zeros(self.size), np.zeros((2, 2)), np.zeros((2, 2))
        for step in range(1, steps + 1):
            x, yy, parts, gold, n = batches[step % len(batches)]
            u = w[x].sum(axis=1)
            g, pair = np.zeros(len(yy)), np.zeros((2, 2))
            for cells, real in parts:
                p, two = _forward_backward(u[cells], t, real, True)
                g[cells[real]] = (p - yy[cells])[real]
                pair += two
            gw = np.bincount(x.ravel(), weights=np.repeat(g, x.shape[1]), minlength=self.size) / n + l2 * w
            gt = (pair - gold) / n + l2 * t
            rate = 0.1 * min(1.0, 1.05 - step / steps)
            for g_, v, a1, a2 in ((gw, w, m1, m2), (gt, t, s1, s2)):
                a1 *= 0.9
                a1 += 0.1 * g_
                a2 *= 0.99
                a2 += 0.01 * g_ * g_
                v -= rate * (a1 / (1 - 0.9**step)) / (np.sqrt(a2 / (1 - 0.99**step)) + 1e-8)
        self.weights, self.trans = w, t
        return self

    def _layout(self) -> None:
        """Where the weights of each kind of feature begin."""
        n_words, n = len(self.known) + 1, len(CLASSES)
        sizes = [n_words] * 3 + [COUPLES] * 2 + [n] * len(SHIFTS) + [n * n] * len(PAIRS) + [2 * n] * len(GROUPS)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.size = int(self.starts[-1])

    def _columns(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        """One array of weight indices after the other, for all places of CODES at once; -1 there ends a sequence."""
        n_words, n = len(self.known) + 1, len(CLASSES)
        sep = codes < 0
        at = np.where(sep, 0, codes)
        word = np.where(at < n_words, at, 0)
        cls = np.where(sep, _NO["edge"], np.where(at < n_words, self.look.classes[np.minimum(at, n_words - 1)], at - n_words))
        seq = np.cumsum(sep) - sep
        size = len(codes)

        def shifted(v: np.ndarray, by: int, fill: int) -> np.ndarray:
            out = np.full(size, fill, v.dtype)
            if 0 <= by < size:
                out[: size - by] = np.where(seq[by:] == seq[: size - by], v[by:], fill)
            elif 0 < -by < size:
                out[-by:] = np.where(seq[:by] == seq[-by:], v[:by], fill)
            return out

        starts = iter(self.starts)
        for by in (-1, 0, 1):
            yield next(starts) + shifted(word, by, 0)
        after = shifted(word, 1, 0)
        couple = np.where((word > 0) & (after > 0), 1 + (word * 7919 + after * 104729) % (COUPLES - 15), 0)
        for by in (-1, 0):
            yield next(starts) + shifted(couple, by, 0)
        near = {by: shifted(cls, by, _NO["edge"]) for by in SHIFTS}
        for by in SHIFTS:
            yield next(starts) + near[by]
        for a, b in PAIRS:
            yield next(starts) + near[a] * n + near[b]
        first = np.searchsorted(seq, seq, "left")
        end = np.searchsorted(seq, seq, "right")
        k = np.arange(size)
        lo, hi = np.maximum(first, k - NEARBY), np.minimum(end, k + NEARBY + 1)
        for g in _IN_GROUP:
            sums = np.concatenate([[0], np.cumsum(g[cls] & ~sep)])
            yield next(starts) + (sums[hi] > sums[lo]) * n + cls

    def _features(self, codes: np.ndarray) -> np.ndarray:
        return np.stack(list(self._columns(codes)), axis=1)

    def tag(self, codes: np.ndarray) -> np.ndarray:
        """For each place of CODES the probability that it lies in an abusive span; 0 at the ends of sequences."""
        u = np.zeros(len(codes))
        for column in self._columns(codes):
            u += self.weights[column]
        out = np.zeros(len(codes))
        seqs = _Sequences(codes)
        for part in seqs.parts():
            cells, real = seqs.pad(np.arange(len(codes)), part)
            p, _ = _forward_backward(u[cells], self.trans, real)
            out[cells[real]] = p[real]
        return out

    def marginals(self, text: list[str]) -> list[float]:
        """The marginals of the words TEXT as one sequence."""
        return self.tag(np.array([self.look[w] for w in text] + [-1]))[:-1].tolist()


class _Codes(dict):
    """Word to code: known words by number, others after these by class, what ends a sequence as -1."""

    MOST = 500_000

    def __init__(self, known: dict[str, int]):
        super().__init__()
        self.known = known
        self.classes = np.zeros(len(known) + 1, dtype=np.int64)
        for w, k in known.items():
            self.classes[k] = self._class(w)

    @staticmethod
    def _class(w: str) -> int:
        if w in '"“”«»„':
            return _NO["quote"]
        if w in ",:;":
            return _NO["comma"]
        return _NO["at"] if w == "@" else _NO["mask"] if w == "<mask>" else class_of(w.replace("’", "'"))

    def __missing__(self, w: str) -> int:
        code = -1 if w[0] in ".!?\n" else self.known.get(w.replace("’", "'")) or len(self.known) + 1 + self._class(w)
        if len(self) >= self.MOST:
            self.clear()
        self[w] = code
        return code

    def __reduce__(self):
        return _Codes, (self.known,)


class _Sequences:
    """The runs between -1 in an array of codes."""

    def __init__(self, codes: np.ndarray):
        cut = np.flatnonzero(codes < 0)
        begin = np.concatenate([[0], cut + 1])
        end = np.concatenate([cut, [len(codes)]])
        some = end > begin
        order = np.argsort((end - begin)[some], kind="stable")
        self.begin, self.end = begin[some][order], end[some][order]

    def parts(self, most: int = 400_000) -> Iterator[slice]:
        """Slices of the sequences, by length, whose padded size stays about MOST."""
        k = 0
        while k < len(self.begin):
            e = k + 1
            while e < len(self.begin) and (e - k + 1) * (self.end[e] - self.begin[e]) <= most and self.end[e] - self.begin[e] <= 1.3 * (self.end[k] - self.begin[k]) + 4:
                e = min(len(self.begin), e + max(1, (e - k) // 8))
            yield slice(k, e)
            k = e

    def pad(self, values: np.ndarray, part: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """VALUES of the sequences as rows of a matrix, and which of its cells are real."""
        b, e = self.begin[part], self.end[part]
        longest = int((e - b).max()) if len(b) else 0
        at = b[:, None] + np.arange(longest)[None, :]
        real = at < e[:, None]
        return values[np.where(real, at, 0)], real


def _forward_backward(u: np.ndarray, t: np.ndarray, real: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1 for all rows of U at once and, if asked for, the summed marginals of label pairs.

    Label 0 scores 0 and label 1 scores U; T are the scores of transitions. Messages are kept as probabilities.
    """
    n, k = u.shape
    e = np.exp(np.clip(u, -30, 30)).T.copy()
    t = np.exp(np.clip(t, -15, 15))
    ok = real.T
    fw, bw = np.zeros((k, n)), np.zeros((k, n))
    a = e[0] / (1 + e[0])
    fw[0] = a
    for j in range(1, k):
        x1 = ((1 - a) * t[0, 1] + a * t[1, 1]) * e[j]
        a = x1 / ((1 - a) * t[0, 0] + a * t[1, 0] + x1)
        fw[j] = a
    b = np.full(n, 0.5)
    for j in range(k - 1, -1, -1):
        bw[j] = b
        y0, y1 = 1 - b, e[j] * b
        b1 = t[1, 0] * y0 + t[1, 1] * y1
        b = np.where(ok[j], b1 / (t[0, 0] * y0 + t[0, 1] * y1 + b1), 0.5)
    y = fw * bw
    p = y / ((1 - fw) * (1 - bw) + y)
    both = np.zeros((2, 2))
    if pairs and k > 1:
        left, right = (1 - fw[:-1], fw[:-1]), (1 - bw[1:], e[1:] * bw[1:])
        v = {(c, d): left[c] * t[c, d] * right[d] for c in (0, 1) for d in (0, 1)}
        z = sum(v.values())
        for c, d in v:
            both[c, d] = (v[c, d] / z)[ok[1:]].sum()
    return np.where(real, p.T, 0.0), both


class Scorer:
    def __init__(self, field: Field):
        self.field = field

    def documents(self, texts: list[str | None]) -> list[tuple[float, list[tuple[int, int, float]]]]:
        """For each text its score and its offending spans (first and end character, score)."""
        out: list[tuple[float, list[tuple[int, int, float]]]] = [(0.0, [])] * len(texts)
        look, held, codes = self.field.look, [], []
        for k, text in enumerate(texts):
            if text:
                held.append((k, len(codes)))
                codes += [look[w] for w in words(text)]
                codes.append(-1)
            if len(codes) > BATCH_WORDS or k == len(texts) - 1:
                if codes:
                    self._score(texts, out, held, np.array(codes))
                held, codes = [], []
        return out

    def _score(self, texts: list, out: list, held: list[tuple[int, int]], codes: np.ndarray) -> None:
        p = self.field.tag(codes)
        ends = [a for _, a in held[1:]] + [len(codes)]
        tops = np.maximum.reduceat(p, [a for _, a in held])
        for (k, a), e, top in zip(held, ends, tops.tolist()):
            if top < THRESHOLD:
                out[k] = round(top, 6), []
                continue
            at, q, spans = words_at(texts[k]), p[a:e].tolist(), []
            s = 0
            while s < len(at):
                if q[s] >= THRESHOLD:
                    f = s
                    while f < len(at) and q[f] >= THRESHOLD:
                        f += 1
                    spans.append((at[s][0], at[f - 1][1], round(max(q[s:f]), 6)))
                    s = f
                s += 1
            out[k] = round(top, 6), spans

    def document(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The score of TEXT and its offending spans (first and end character, score)."""
        return self.documents([text])[0]


@lru_cache(maxsize=4)
def trained_field(seed: int = SEED) -> Field:
    """The field trained on the rows that ship with the operator; the same SEED gives the same weights."""
    return Field().fit(toxic_rows.labelled_rows(seed, PER_PATTERN))


def fit_field(labelled: DataFrame, most: int = MOST_LABELLED) -> Field:
    """A field trained on LABELLED (``text, spans array<struct<first:int,last:int>>``): at most MOST rows, of the least hash."""
    rows = labelled.where(F.col("text").isNotNull()).select("text", "spans").orderBy(F.xxhash64("text"), "text").limit(most).collect()
    return Field().fit([(r["text"], [(s["first"], s["last"]) for s in r["spans"] or []]) for r in rows])


def score_documents(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Every row of DOCS with ``score`` from 0 to 1 and the offending ``spans`` as character offsets (``SCORES``).

    The score is the greatest marginal of any word. Null and empty texts score 0. Each text is scored as a whole, every
    word of it, where it lies; nothing is shuffled. Copies of a text score alike. The field (:func:`trained_field` or
    :func:`fit_field`) has some thousand weights, independent of the data.
    """
    model = field or trained_field()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for d in batches:
            found = scorer.documents(d["text"].tolist())
            yield pd.DataFrame({
                "doc_id": d["doc_id"], "source": d["source"], "score": [s for s, _ in found],
                "spans": [[{"first": a, "last": b, "score": x} for a, b, x in sp] for _, sp in found],
            })

    return docs.select("doc_id", "source", "text").mapInPandas(run, SCORES)


def toxic_rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents and share of toxic ones per source, in one spelling: ``source, docs, toxic, rate``."""
    source = F.regexp_replace(F.lower(F.trim("source")), r"[-\s]+", "_")
    hit = (F.col("score") >= threshold).cast("int")
    return scored.groupBy(source.alias("source")).agg(
        F.count("*").alias("docs"), F.sum(hit).alias("toxic"), F.round(F.avg(hit), 6).alias("rate")
    )
