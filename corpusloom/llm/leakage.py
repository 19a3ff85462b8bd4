"""Evaluation texts leaking into training text (problem 8).

Pigeonhole edit matching: a stretch of WINDOW words that holds at most BUDGET edits, cut into BUDGET + 1 pieces, holds
one piece unchanged. So the pieces of all stretches of the items are looked up in the document, and wherever one is found
the stretches that it is a piece of are compared with the document by Myers' bit-parallel edit distance, words being
the letters.
"""

from __future__ import annotations

import html
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut

#: A stretch of so many words of an item is a leak.
WINDOW = 20
#: Words of it that may be changed, missing or inserted.
BUDGET = 4
#: Items up to this number, of at most so many characters in all, are sent to every task; more meet the documents by a join.
MOST_ITEMS, MOST_CHARS = 50_000, 100_000_000

MATCHES = "doc_id long, item_id int, suite string, edits int, item_word int, start_word int, end_word int, kept boolean"

_NOISE = re.compile(r"</?[a-zA-Z][^<>\n]{0,80}>|\\[nrt\"]|[​-‏⁠﻿­]|(?<=\n)[ \t]*(?://+|#+|\*+|>+|--|;+|%+|\|)[ \t]?")
_WORD = re.compile(r"[^\W_]+(?:\\?_[^\W_]+)*")


def words(text: str | None) -> list[str]:
    """The words of TEXT, lower case, without markup, entities, escapes, comment marks and line structure."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    flat = _NOISE.sub(lambda m: "" if m[0][0] in "​‌‍‎‏⁠﻿­" else " ", "\n" + text)
    return [w.replace("\\", "") for w in _WORD.findall(flat.lower())]


def sentences(text: str | None) -> list[list[str]]:
    """The sentences of TEXT as lists of words."""
    return [w for w in (words(s) for s in re.split(r"(?<=[.!?:;])\s+|\n+", text or "")) if w]


def distance(peq: dict[int, int], m: int, text: list[int], most: int) -> tuple[int, int]:
    """Least edit distance of a pattern to a part of TEXT and where that part ends; (most + 1, -1) if it is above MOST.

    Myers' bit-vector algorithm; PEQ maps each letter of the pattern, of M letters, to the bits where it stands.
    """
    ones, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = ones, 0, m, most + 1, -1
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (ones & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & ones
        mh = (mh << 1) & ones
        pv = mh | (ones & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, at = score, j
    return best, at


def pieces(run: list, window: int = WINDOW, budget: int = BUDGET) -> Iterator[tuple[int, tuple]]:
    """The pieces of all stretches of RUN as (place, words): of a long run every piece of WINDOW // (BUDGET + 1) words.

    A run shorter than WINDOW is one stretch, with edits in proportion and as many pieces.
    """
    size = min(window, len(run))
    most = budget if size == window else size * budget // window
    n = max(1, size // (most + 1))
    places = range(len(run) - n + 1) if len(run) >= window else range(0, n * (most + 1), n)
    for q in places:
        yield q, tuple(run[q : q + n])


Claim = tuple[int, int, int, int, int]


class Matcher:
    """Finds items in documents. RUNS are the runs of words of each item, without sentences that items share."""

    def __init__(self, runs: dict[int, list[list[str]]], window: int = WINDOW, budget: int = BUDGET):
        self.ids: dict[str, int] = {}
        self.window, self.budget = window, budget
        self.text = {i: [[self.ids.setdefault(w, len(self.ids) + 1) for w in r] for r in rs] for i, rs in runs.items()}
        self.pieces: dict[tuple[int, ...], list[tuple[int, int, int]]] = {}
        self.masks: dict[tuple[int, int, int], dict[int, int]] = {}
        for i, rs in self.text.items():
            for k, r in enumerate(rs):
                for q, piece in pieces(r, window, budget):
                    self.pieces.setdefault(piece, []).append((i, k, q))
        self.lengths = sorted({len(g) for g in self.pieces})

    def _mask(self, i: int, k: int, s: int, size: int) -> dict[int, int]:
        key = (i, k, s)
        if key not in self.masks:
            peq: dict[int, int] = {}
            for b, c in enumerate(self.text[i][k][s : s + size]):
                peq[c] = peq.get(c, 0) | 1 << b
            self.masks[key] = peq
        return self.masks[key]

    def claims(self, text: str | None) -> list[Claim]:
        """All stretches of items that TEXT holds within the budget, as (edits, item, item_word, start_word, end_word)."""
        get = self.ids.get
        w = [get(x, 0) for x in words(text)]
        tried: set[tuple[int, int, int, int]] = set()
        out: list[Claim] = []
        for n in self.lengths:
            known = self.pieces
            hits = [(p, g) for p, g in enumerate(zip(*(w[j:] for j in range(n)))) if g in known]
            for p, g in hits:
                for i, k, q in known[g]:
                    length = len(self.text[i][k])
                    size = min(self.window, length)
                    most = self.budget if size == self.window else size * self.budget // self.window
                    # the stretches that this is a piece of: it stands a whole number of pieces after their start
                    for s in range(q, max(-1, q - n * (most + 1)), -n) if length >= self.window else (0,):
                        if not 0 <= s <= length - size or (i, k, s, p - q) in tried:
                            continue
                        tried.add((i, k, s, p - q))
                        a = max(0, p - q + s - most)
                        part = w[a : p - q + s + size + most]
                        peq = self._mask(i, k, s, size)
                        if sum(map(peq.__contains__, part)) < size - most:
                            continue  # too few words of the stretch for any alignment
                        d, end = distance(peq, size, part, most)
                        if d <= most:
                            out.append((d, i, s, max(0, a + end - size + 1), a + end))
        return out

    def find(self, text: str | None) -> list[tuple[int, int, int, int, int, bool]]:
        """Leaks in TEXT as (item_id, edits, item_word, start_word, end_word, kept), one per item."""
        return compete(self.claims(text))


def compete(claims: list[Claim]) -> list[tuple[int, int, int, int, int, bool]]:
    """The best claim of each item as (item_id, edits, item_word, start_word, end_word, kept).

    Where two items claim the same words of the document, only those with the fewest edits keep the claim: items are
    alike in their phrases, a leak is one item's text. Of an item that keeps none the claim with the fewest edits is
    returned with ``kept`` false.
    """
    best: dict[int, int] = {}
    for d, _, _, a, b in claims:
        for x in range(a, b + 1):
            if d < best.get(x, 99):
                best[x] = d
    out: dict[int, tuple[bool, int, tuple]] = {}
    for d, i, s, a, b in sorted(claims):
        lost = d > min(best[x] for x in range(a, b + 1)) and not _owns(best, d, a, b)
        if i not in out or (lost, d) < out[i][:2]:
            out[i] = lost, d, (i, d, s, a, b, not lost)
    return [r for _, _, r in out.values()]


def _owns(best: dict[int, int], d: int, a: int, b: int) -> bool:
    """Whether most words from A to B have no claim with fewer edits than D."""
    return 2 * sum(best[x] >= d for x in range(a, b + 1)) > b - a + 1


_NAMES = [c.split()[0] for c in MATCHES.split(", ")]


def item_runs(items: DataFrame) -> DataFrame:
    """``item_id, suite, runs`` of ITEMS: their words, cut where a sentence that several items share was taken out.

    Such sentences are instructions, not content. Of items with one id the greatest text holds.
    """

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            yield pd.DataFrame({"item_id": d["item_id"], "suite": d["suite"], "s": [[" ".join(ws) for ws in sentences(t)] for t in d["text"]]})

    one = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).groupBy("item_id").agg(F.max(F.struct("text", "suite")).alias("v"))
    kind = "item_id int, suite string, s array<string>"
    split = one.select("item_id", "v.suite", "v.text").mapInPandas(cut_up, kind).select("item_id", "suite", F.posexplode("s").alias("at", "s"))
    shared = split.groupBy("s").agg(F.count_distinct("item_id").alias("n")).where(F.col("n") > 1).select("s", F.lit(True).alias("shared"))
    rows = split.join(shared, "s", "left").groupBy("item_id").agg(F.max("suite").alias("suite"), F.array_sort(F.collect_list(F.struct("at", "s", F.coalesce("shared", F.lit(False)).alias("shared")))).alias("a"))
    joined = F.array_join(F.transform("a", lambda x: F.when(x["shared"], F.lit("\n")).otherwise(x["s"])), " ")
    return rows.select("item_id", "suite", F.filter(F.transform(F.split(joined, "\n"), F.trim), lambda r: r != "").alias("runs"))


def find_leaks(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, budget: int = BUDGET, most_items: int = MOST_ITEMS, most_chars: int = MOST_CHARS
) -> DataFrame:
    """Documents that hold an item's text or a stretch of WINDOW words of it (columns ``MATCHES``).

    One row per document and item, with the fewest edits of any such stretch, its place in the item (``item_word``) and
    in the document's words; ``kept`` is false where other items claim the same words with fewer edits (:func:`compete`).
    Null and empty texts hold nothing; a document that occurs twice is reported twice.

    Up to MOST_ITEMS items of MOST_CHARS characters are sent to the tasks, and documents are scanned once where they lie.
    More items are joined with the documents on hashed pieces (:func:`_by_pieces`), with the same result.
    """
    runs = cut(item_runs(items))
    size = runs.agg(F.count("*").alias("n"), F.sum(F.length(F.array_join("runs", " "))).alias("chars")).first()
    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    if size["n"] > most_items or (size["chars"] or 0) > most_chars:
        return _by_pieces(known, runs, window, budget)
    held = {r["item_id"]: (r["suite"], [x.split(" ") for x in r["runs"]]) for r in runs.collect()}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher({i: r for i, (_, r) in held.items()}, window, budget)
        for d in batches:
            found = [(doc, i, held[i][0], *rest) for doc, text in zip(d["doc_id"].tolist(), d["text"].tolist()) for i, *rest in m.find(text)]
            if found:
                yield pd.DataFrame(found, columns=_NAMES)

    return known.mapInPandas(scan, MATCHES)


def _hash(words_: tuple) -> int:
    return xxhash.xxh64_intdigest(" ".join(words_)) - (1 << 63)


def _by_pieces(docs: DataFrame, runs: DataFrame, window: int, budget: int) -> DataFrame:
    """:func:`find_leaks` for any number of items: the pieces of items and the runs of as many words of documents meet by hash.

    The hashes of a document are made distinct where it lies. Pairs of a document and an item that share a piece meet
    their texts again and are verified one by one; claims of a document compete as in a scan.
    """

    def of_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            found = {(i, len(p), _hash(p)) for i, rs in zip(d["item_id"].tolist(), d["runs"]) for r in rs for _, p in pieces(r.split(" "), window, budget)}
            yield pd.DataFrame(sorted(found), columns=["item_id", "n", "h"])

    longest = max(1, window // (budget + 1)) if window > budget else 1
    lengths = sorted({len(p) for size in range(1, window + 1) for _, p in pieces([0] * size, window, budget)} | {longest})

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            d = d.copy()
            d["row"] = [uuid.uuid4().hex for _ in range(len(d))]
            yield d[["row", "doc_id", "text"]]

    rows = cut(docs.mapInPandas(named, "row string, doc_id long, text string"))  # ids may repeat

    def of_docs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for row, text in zip(d["row"], d["text"]):
                w = words(text)
                found = {(n, _hash(tuple(w[k : k + n]))) for n in lengths for k in range(len(w) - n + 1)}
                if found:
                    ns, hs = zip(*found)
                    yield pd.DataFrame({"row": row, "n": ns, "h": hs})

    keys = runs.select("item_id", "runs").mapInPandas(of_items, "item_id int, n int, h long")
    pairs = rows.select("row", "text").mapInPandas(of_docs, "row string, n int, h long").join(keys, ["n", "h"]).select("row", "item_id").distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out = [
                (row, doc, suite, [list(map(int, c)) for c in found])
                for row, doc, text, item, suite, rs in zip(d["row"], d["doc_id"].tolist(), d["text"], d["item_id"].tolist(), d["suite"], d["runs"])
                if (found := Matcher({item: [r.split(" ") for r in rs]}, window, budget).claims(text))
            ]
            yield pd.DataFrame(out, columns=["row", "doc_id", "suite", "claims"])

    claims = pairs.join(rows, "row").join(runs, "item_id").mapInPandas(verify, "row string, doc_id long, suite string, claims array<array<int>>")

    def settle(d: pd.DataFrame) -> pd.DataFrame:
        every = [tuple(c) for cs in d["claims"] for c in cs]
        suite = {cs[0][1]: s for cs, s in zip(d["claims"], d["suite"])}
        return pd.DataFrame([(d["doc_id"].iat[0], i, suite[i], *rest) for i, *rest in compete(every)], columns=_NAMES)

    return claims.groupBy("row").applyInPandas(settle, MATCHES)


def leak_report(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """Every item with the number of documents that hold it: ``item_id, suite, docs``."""
    n = leaks.where("kept").groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"))
    every = items.where(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.max("suite").alias("suite"))
    return every.join(n, "item_id", "left").select("item_id", "suite", F.coalesce("docs", F.lit(0)).alias("docs"))
