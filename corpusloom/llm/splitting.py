"""Splitting oversized items at natural boundaries (problem 2).

Lexical-cohesion segmentation: between any two lines the words of the lines before and after are compared; valleys of
that similarity mark changes of topic. Each piece ends at the best boundary of the window that its size allows, then
the next one starts some lines earlier.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines on either side of a boundary whose words are compared.
BLOCK = 8
#: A piece is filled at least to this share before a boundary is looked for.
LEAST_FILL = 0.5
#: What the end of a nested symbol and a blank line add to a boundary's depth (depths lie between 0 and 2).
SYMBOL_BONUS, BLANK_BONUS = 1.0, 0.5
#: Lines of a file that share a bucket when symbols are matched to items.
BUCKET = 256

PIECES = (
    "item_id long, piece_no int, kind string, max_tokens int, overlap_lines int, first_line int, last_line int, "
    "start_char int, end_char int, n_tokens int, content string"
)
_WORD = re.compile(r"[^\W\d_]+")


def boundary_depths(lines: list[str]) -> list[float]:
    """Depth of the cohesion valley at each boundary; entry i is the boundary before line i (0 for the first)."""
    n = len(lines)
    words = [Counter(w.lower() for w in _WORD.findall(x)) for x in lines]
    left: Counter = Counter()
    right: Counter = Counter()
    for w in words[:BLOCK]:
        right.update(w)
    dot = nl = nr = 0
    nr = sum(v * v for v in right.values())

    def change(bag: Counter, other: Counter, word: Counter, sign: int) -> tuple[int, int]:
        norm = d = 0
        for k, v in word.items():
            old = bag[k]
            new = old + sign * v
            norm += new * new - old * old
            d += sign * v * other.get(k, 0)
            if new:
                bag[k] = new
            else:
                del bag[k]
        return norm, d

    sims = [1.0] * (n + 1)
    for i in range(1, n):
        moved = words[i - 1]
        for bag, other, w, sign, which in (
            (right, left, moved, -1, "r"),
            (left, right, moved, 1, "l"),
            *(((left, right, words[i - 1 - BLOCK], -1, "l"),) if i > BLOCK else ()),
            *(((right, left, words[i - 1 + BLOCK], 1, "r"),) if i - 1 + BLOCK < n else ()),
        ):
            norm, d = change(bag, other, w, sign)
            dot += d
            if which == "l":
                nl += norm
            else:
                nr += norm
        sims[i] = dot / (nl * nr) ** 0.5 if nl and nr else 0.0
    before, after = sims[:], sims[:]
    for i in range(1, n):
        before[i] = max(before[i - 1], sims[i]) if sims[i - 1] >= sims[i] and i > 1 else sims[i]
    for i in range(n - 1, 0, -1):
        after[i] = max(after[i + 1], sims[i]) if sims[i + 1] >= sims[i] and i < n - 1 else sims[i]
    return [0.0] + [before[i] + after[i] - 2 * sims[i] for i in range(1, n)] + [0.0]


def _units(text: str, room: int) -> list[tuple[int, int, bool, bool]]:
    """TEXT as runs ``(start, end, whole, line_end)`` of at most ROOM characters: lines, and parts of longer lines."""
    out, at = [], 0
    for line in text.splitlines(keepends=True) if "\r" not in text else re.findall(r"[^\n]*\n|[^\n]+$", text):
        end = at + len(line)
        if len(line) <= room:
            out.append((at, end, True, True))
        else:
            s = at
            while end - s > room:
                gap = max(text.rfind(" ", s + room // 2, s + room), text.rfind(",", s + room // 2, s + room))
                e = gap + 1 if gap > s else s + room
                out.append((s, e, False, False))
                s = e
            out.append((s, end, False, True))
        at = end
    return out


def split_text(text: str, max_tokens: int, overlap: int, inner_ends: set[int]) -> list[tuple[int, int, int, int]]:
    """Pieces ``(start_char, end_char, first_line, last_line)`` of TEXT, each of at most MAX_TOKENS tokens.

    Consecutive pieces share OVERLAP whole lines, fewer only where these and the next line do not fit the limit
    together. A line longer than the limit is cut at blanks or commas, else anywhere; there nothing overlaps.
    INNER_ENDS holds the line indices (from 0) after which a nested symbol ends.
    """
    room = 4 * max_tokens + 3
    if len(text) <= room:
        return [(0, len(text), 0, max(0, text.count("\n")))]
    units = _units(text, room)
    n = len(units)
    line_of, k = [], 0
    for u in units:
        line_of.append(k)
        k += u[3]
    depth = boundary_depths([text[a:b] for a, b, _, _ in units])
    for i in range(1, n):
        if not units[i - 1][3]:
            depth[i] = -1.0
            continue
        if line_of[i - 1] in inner_ends:
            depth[i] += SYMBOL_BONUS
        if not text[units[i - 1][0] : units[i - 1][1]].strip() or not text[units[i][0] : units[i][1]].strip():
            depth[i] += BLANK_BONUS
    pieces, cur, first = [], 0, 0
    while cur < n:
        while first < cur and units[cur][1] - units[first][0] > room:
            first += 1
        start, last = units[first][0], cur
        while last + 1 < n and units[last + 1][1] - start <= room:
            last += 1
        stop = last + 1
        if stop < n:
            fill = [i for i in range(cur + 1, stop + 1) if units[i - 1][1] - start >= LEAST_FILL * room]
            stop = max(fill or [stop], key=lambda i: (depth[i], i))
        pieces.append((start, units[stop - 1][1], line_of[first], line_of[stop - 1]))
        cur = first = stop
        while first > 0 and stop - first < overlap and units[first - 1][2] and first - 1 > 0:
            first -= 1
    return pieces


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in PIECES.split(", ")]
    for d in batches:
        rows = []
        for r in d.itertuples(index=False):
            text, base = r.content, r.base_line
            ends = set() if r.inner_ends is None else {int(x) for x in r.inner_ends}
            for no, (a, b, l0, l1) in enumerate(split_text(text, int(r.max_tokens), int(r.overlap_lines), ends), 1):
                rows.append((r.item_id, no, r.kind, r.max_tokens, r.overlap_lines, base + l0, base + l1, a, b, (b - a) // 4, text[a:b]))
                if len(rows) >= 2000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)


def split_oversized(items: DataFrame, symbols: DataFrame, files: DataFrame, limits: DataFrame) -> DataFrame:
    """Items over the limit of their kind as numbered pieces within it (columns ``PIECES``).

    The kind is that of the item's symbol, ``slice`` for an item without symbol; items of a kind without limit, of a
    symbol that does not exist, with null content, or within their limit yield nothing. ``first_line`` and
    ``last_line`` count in the file where the content is lines of it, else from 1 within the content. ``start_char``
    and ``end_char`` tell where the piece lies in the content: pieces overlap by whole lines and leave nothing out.
    A null or non-positive limit does not limit; of several limits of one kind the least holds.

    Keys are joined without the content; only the content of items above the least limit is shuffled, once. LIMITS is
    one row per kind and checked to be small before it is made part of the expression.
    """
    rows = limits.where(F.col("max_tokens") > 0).groupBy("kind").agg(
        F.min("max_tokens").alias("t"), F.min(F.struct("max_tokens", F.coalesce("overlap_lines", F.lit(0)).alias("o"))).alias("s")
    ).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("size_limits has more than 1000 kinds")
    known = {r["kind"]: (int(r["t"]), max(0, int(r["s"]["o"]))) for r in rows if r["kind"] is not None}
    least = min((t for t, _ in known.values()), default=None)
    size = F.floor(F.length("content") / 4)
    big = items.where(size > least if least is not None else F.lit(False))
    keys = big.select("item_id", "symbol_id", "path", "start_line", "end_line", size.alias("n"))
    limit_of = lambda kind, i: F.coalesce(*(F.when(kind == k, F.lit(v[i])) for k, v in known.items()), F.lit(None).cast("int")) if known else F.lit(None).cast("int")
    about = symbols.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct("kind", "file_id")).alias("s"))
    of_symbol = keys.where(F.col("symbol_id").isNotNull()).join(about, F.col("symbol_id") == F.col("id")).select(
        keys["*"], F.col("s.kind").alias("kind"), F.col("s.file_id").alias("file_id")
    )
    paths = files.where(F.col("path").isNotNull()).groupBy("path").agg(F.min("id").alias("file_id"))
    of_file = keys.where(F.col("symbol_id").isNull() & (F.col("n") > limit_of(F.lit("slice"), 0))).join(
        paths, "path", "left"
    ).select(keys["*"], F.lit("slice").alias("kind"), "file_id")
    over = of_symbol.unionByName(of_file).select(
        "*", limit_of(F.col("kind"), 0).alias("max_tokens"), limit_of(F.col("kind"), 1).alias("overlap_lines")
    ).where(F.col("n") > F.col("max_tokens"))
    real = F.col("kind").isin("function", "method", "module", "slice") & F.col("start_line").isNotNull()
    spans = over.where(real & F.col("file_id").isNotNull() & (F.col("end_line") >= F.col("start_line"))).select(
        "item_id", "file_id", "start_line", "end_line",
        F.explode(F.sequence(F.floor(F.col("start_line") / BUCKET), F.floor(F.col("end_line") / BUCKET))).alias("bucket"),
    )
    ends = symbols.select(
        F.col("file_id").alias("f"), F.col("end_line").alias("e"), F.col("start_line").alias("b"),
        F.floor(F.col("end_line") / BUCKET).alias("k"),
    ).groupBy("f", "e", "k").agg(F.max("b").alias("b"))
    inner = (
        spans.join(ends, (F.col("file_id") == F.col("f")) & (F.col("bucket") == F.col("k")))
        .where((F.col("b") >= F.col("start_line")) & (F.col("e") < F.col("end_line")))
        .groupBy("item_id")
        .agg(F.collect_set(F.col("e") - F.col("start_line")).alias("inner_ends"))
    )
    plan = over.join(inner, "item_id", "left").select(
        "item_id", "kind", "max_tokens", "overlap_lines", "inner_ends",
        F.when(real, F.col("start_line")).otherwise(F.lit(1)).cast("int").alias("base_line"),
    )
    return plan.join(big.select("item_id", "content"), "item_id").mapInPandas(_split, PIECES)
