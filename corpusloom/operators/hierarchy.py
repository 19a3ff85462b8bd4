"""Parent-child links to full hierarchies, with cycles (problem 7).

Chains are contracted where they lie: rows are laid out in blocks of neighbouring ids, every task follows parents as
far as they stay among its own rows, and only exits remain (parents that lie in another task). The exits form a much
smaller quotient forest. It is solved in the same way until it fits one task, then the fragments are joined back.
A cycle closes either within one task or in the quotient forest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut

#: Exits of a quotient forest that one task solves: a checked size, beyond which the forest is contracted again.
ONE_TASK_ROWS = 200_000
#: Rows that one task contracts.
BLOCK_ROWS = 32_000
#: Neighbouring ids that stay together: a file's symbols meet in one task, yet no file is a hot key.
NEIGHBOURS = 4096

PLAIN = "id long, top long, exit long, steps long, low long, end string"
FULL = PLAIN + ", names array<string>, anc array<long>"


def _least_on_ring(parent: np.ndarray, low: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each node of AT, all of which lie on cycles, the least LOW of its cycle; every cycle is walked once."""
    found: dict[int, int] = {}
    for s in np.unique(at).tolist():
        if s not in found:
            ring, x = [s], int(parent[s])
            while x != s:
                ring.append(x)
                x = int(parent[x])
            least = int(low[ring].min())
            found.update(dict.fromkeys(ring, least))
    return np.array([found[s] for s in at.tolist()], dtype=np.int64)


def _follow(d: pd.DataFrame) -> pd.DataFrame:
    """Where each row of D (``id, up, low, steps``) leaves these rows, by pointer doubling: log2(n) vector passes.

    ``steps`` is the number of original links from a row to its ``up``. A row whose parent is not among the rows ends
    as ``exit``, one without parent as ``root``, one on or below a closed ring as ``cycle``.
    """
    n = len(d)
    ids = d["id"].to_numpy(np.int64)
    has_up = d["up"].notna().to_numpy()
    up = d["up"].fillna(0).to_numpy(np.int64)
    low = d["low"].to_numpy(np.int64)
    step = d["steps"].to_numpy(np.int64)
    order = np.argsort(ids, kind="stable")
    place = np.minimum(np.searchsorted(ids[order], up), n - 1)
    inside = has_up & (ids[order][place] == up)
    parent = np.where(inside, order[place], np.arange(n))
    to, dist, least = parent.copy(), np.where(inside, step, 0), np.where(inside, np.minimum(low, low[parent]), low)
    for _ in range(n.bit_length() + 1):
        if (to[to] == to).all():
            break
        dist, least, to = dist + dist[to], np.minimum(least, least[to]), to[to]
    ring = inside[to]
    if ring.any():
        least[ring] = _least_on_ring(parent, low, to[ring])
    leaves = ~ring & has_up[to]
    return pd.DataFrame(
        {
            "id": ids,
            "top": ids[to],
            "exit": pd.array(np.where(leaves, up[to], 0), dtype="Int64").copy(),
            "steps": np.where(leaves, dist + step[to], dist),
            "low": least,
            "end": np.where(ring, "cycle", np.where(leaves, "exit", "root")),
            "_parent": parent,
            "_dist": dist,
        }
    ).assign(exit=lambda x: x["exit"].mask(x["end"] != "exit"))


def _contract(full: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        d = pd.concat(rows, ignore_index=True)
        out = _follow(d)
        if full:
            names, anc = [list(x) for x in d["names"]], [list(x) for x in d["anc"]]
            for i in np.argsort(out["_dist"].to_numpy(), kind="stable").tolist():
                p = out["_parent"].iat[i]
                if p != i:
                    names[i], anc[i] = names[p] + names[i], anc[p] + anc[i]
            out["names"], out["anc"] = names, anc
        yield out.drop(columns=["_parent", "_dist"])

    return run


def _onto(lower: DataFrame, upper: DataFrame, full: bool) -> DataFrame:
    """LOWER with every exit that is a row of UPPER continued by it."""
    u = upper.select(*(F.col(c).alias(f"u_{c}") for c in upper.columns))
    hit = F.col("u_id").isNotNull()
    columns = [
        F.col("id"),
        F.coalesce("u_top", "top").alias("top"),
        F.when(hit, F.col("u_exit")).otherwise(F.col("exit")).alias("exit"),
        (F.col("steps") + F.coalesce("u_steps", F.lit(0))).alias("steps"),
        F.when(F.col("u_end") == "cycle", F.col("u_low")).otherwise(F.least("low", "u_low")).alias("low"),
        F.coalesce("u_end", "end").alias("end"),
    ]
    if full:
        columns += [F.when(hit, F.concat(f"u_{c}", c)).otherwise(F.col(c)).alias(c) for c in ("names", "anc")]
    return lower.join(u, F.col("exit") == F.col("u_id"), "left").select(*columns)


def _double(pending: DataFrame, rows: int, full: bool) -> DataFrame:
    """PENDING solved by joins alone, for forests too large and too scattered to contract in blocks."""
    now = pending
    for _ in range(max(1, rows.bit_length() + 1)):
        now = cut(_onto(now, now, full))
        if not now.join(now.select(F.col("id").alias("k")), F.col("exit") == F.col("k"), "left_semi").take(1):
            return now
    ring = now.select(F.col("id").alias("k"), F.col("low").alias("k_low"))
    hit = F.col("k").isNotNull()
    return now.join(ring, F.col("exit") == F.col("k"), "left").select(
        "id", "top", F.when(~hit, F.col("exit")).alias("exit"), "steps",
        F.when(hit, F.col("k_low")).otherwise(F.col("low")).alias("low"),
        F.when(hit, F.lit("cycle")).otherwise(F.col("end")).alias("end"), *(["names", "anc"] if full else []),
    )


def climb(links: DataFrame, full: bool, one_task: int = ONE_TASK_ROWS, block: int = BLOCK_ROWS) -> DataFrame:
    """Follow every row of LINKS (``id, up, low, steps`` and, if FULL, ``names, anc``) to the end of its chain.

    At every size the rows are contracted in tasks of about BLOCK rows; what is left are the exits that other tasks
    lead to. Up to ONE_TASK of these are solved at once, more are contracted in turn.
    """
    rows = links.count()
    schema = FULL if full else PLAIN
    parts = max(1, -(-rows // block))
    near = F.pmod(F.xxhash64(F.floor(F.col("id") / NEIGHBOURS)), F.lit(parts))
    local = cut(links.repartition(parts, near).mapInPandas(_contract(full), schema))
    exits = local.where(F.col("end") == "exit").select(F.col("exit").alias("id")).distinct()
    portals = cut(local.join(exits, "id", "left_semi"))
    settled, pending = portals.where(F.col("end") != "exit"), portals.where(F.col("end") == "exit")
    left = pending.count()
    if left == 0:
        return _onto(local, settled, full)
    keep = ["names", "anc"] if full else []
    quotient = pending.select("id", F.col("exit").alias("up"), "low", "steps", *keep)
    if left > one_task and left > rows // 2:
        deep = _double(pending, left, full)
    else:
        deep = quotient.coalesce(1).mapInPandas(_contract(full), schema) if left <= one_task else climb(quotient, full, one_task, block)
        tops = pending.select(F.col("id").alias("t_id"), F.col("top").alias("t_top"))
        deep = deep.join(tops, F.col("top") == F.col("t_id"), "left").withColumn("top", F.coalesce("t_top", "top")).drop("t_id", "t_top")
    solved = settled.unionByName(_onto(deep, settled, full))
    return _onto(local, solved, full)


def clean_links(symbols: DataFrame) -> DataFrame:
    """One row ``id, parent_id, name`` per symbol: repeats collapse, rows without an id are left out.

    Should rows of one id differ, the greatest (parent_id, name) holds.
    """
    return (
        symbols.where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max(F.struct("parent_id", "name")).alias("v"))
        .select("id", "v.parent_id", "v.name")
    )


def cycle_members(symbols: DataFrame, one_task: int = ONE_TASK_ROWS, block: int = BLOCK_ROWS) -> DataFrame:
    """Symbols that never reach a root, on a cycle of parents or below one: ``symbol_id, cycle_id``.

    ``cycle_id`` is the least id on that cycle. A null parent and one that does not exist make a root; a row that is
    its own parent is a cycle of one. An empty table gives an empty result.
    """
    links = clean_links(symbols).select("id", F.col("parent_id").alias("up"), F.col("id").alias("low"), F.lit(1).cast("long").alias("steps"))
    ends = climb(cut(links), False, one_task, block)
    return ends.where(F.col("end") == "cycle").select(F.col("id").alias("symbol_id"), F.col("low").alias("cycle_id"))


def hierarchy(symbols: DataFrame, one_task: int = ONE_TASK_ROWS, block: int = BLOCK_ROWS) -> DataFrame:
    """Every symbol that reaches a root: ``symbol_id, root_id, depth, names, ancestors``.

    ``names`` are the names from the root down to the symbol (a null name reads as empty), ``ancestors`` the ids in the
    same order without the symbol itself, ``depth`` is 0 for a root. What never reaches a root is in
    :func:`cycle_members`.
    """
    base = cut(clean_links(symbols))
    plain = base.select("id", F.col("parent_id").alias("up"), F.col("id").alias("low"), F.lit(1).cast("long").alias("steps"))
    lost = climb(plain, False, one_task, block).where(F.col("end") == "cycle").select("id")
    links = base.join(lost, "id", "left_anti").select(
        "id", F.col("parent_id").alias("up"), F.col("id").alias("low"), F.lit(1).cast("long").alias("steps"),
        F.array(F.coalesce("name", F.lit(""))).alias("names"), F.array("id").alias("anc"),
    )
    return climb(cut(links), True, one_task, block).select(
        F.col("id").alias("symbol_id"),
        F.element_at("anc", 1).alias("root_id"),
        (F.size("anc") - 1).alias("depth"),
        "names",
        F.slice("anc", F.lit(1), F.size("anc") - 1).alias("ancestors"),
    )


def descendants(symbols: DataFrame, one_task: int = ONE_TASK_ROWS, block: int = BLOCK_ROWS) -> DataFrame:
    """All symbols below each symbol: ``symbol_id, below_id, distance``; as many rows as the depths add up to."""
    h = hierarchy(symbols, one_task, block)
    return h.select(F.col("symbol_id").alias("below_id"), "depth", F.posexplode("ancestors").alias("at", "symbol_id")).select(
        "symbol_id", "below_id", (F.col("depth") - F.col("at")).alias("distance")
    )
