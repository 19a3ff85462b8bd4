"""Filling fixed-capacity containers with items (problem 4).

Items of one size are interchangeable, so each request is packed as a histogram of sizes, which has at most as many
rows as its capacity has tokens, however many items it holds. Martello and Toth's reduction fixes small sets that
dominate all others for the largest item; the rest is packed best-fit, largest first.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUDGET, BUDGET_CAP = 8000, 20000  # fixed values of the reference
#: Parts in which the items of one size of one request are numbered.
SALTS = 64


def capacity(budget: Column) -> Column:
    """Tokens that a container holds: null and values below 1 mean the default, larger ones are capped."""
    return F.least(F.when(budget >= 1, budget).otherwise(F.lit(DEFAULT_BUDGET)), F.lit(BUDGET_CAP)).cast("int")


Pattern = dict[int, int]  # how many parts of each size a container holds


def reduce_dominated(sizes: dict[int, int], cap: int) -> list[tuple[Pattern, int]]:
    """Fix containers that some optimal packing holds; SIZES (size to count) keeps what is left.

    For the largest item j with room r beside it, k being the largest item within r: nothing fits, so j stays alone; or k
    fits exactly. Else, as long as no three items fit beside j: no pair within r is larger than k, so {j, k} dominates
    every other choice; or b is the largest beside j and k, and no two items above b fit, so {j, k, b} does.
    Returns (container, how many such containers).
    """
    fixed: list[tuple[Pattern, int]] = []
    keys = sorted(s for s in sizes if sizes[s] > 0)

    def fix(*items: int) -> None:
        p: Pattern = {}
        for s in items:
            p[s] = p.get(s, 0) + 1
        m = min(sizes[s] // c for s, c in p.items())
        fixed.append((p, m))
        for s, c in p.items():
            sizes[s] -= m * c
            if not sizes[s]:
                del sizes[s]
                keys.pop(bisect_left(keys, s))

    for j in reversed(list(keys)):
        while sizes.get(j):
            r = cap - j
            i = bisect_left(keys, r + 1) - 1
            if i >= 0 and keys[i] == j and sizes[j] == 1:
                i -= 1  # the item itself is no company
            if i < 0:
                fix(j)
                continue
            k = keys[i]
            if k == r:
                fix(j, k)
                continue
            if sum(_smallest(sizes, keys, j, 3)) <= r and len(_smallest(sizes, keys, j, 3)) == 3:
                break
            if not _pair_above(sizes, keys, i, j, k, r):
                fix(j, k)
                continue
            at = bisect_left(keys, r - k + 1) - 1
            while at >= 0 and sizes[keys[at]] <= (keys[at] == j) + (keys[at] == k):
                at -= 1
            if at < 0:
                break
            b = keys[at]
            if sum(_smallest(sizes, keys, j, 2, b)) <= r and len(_smallest(sizes, keys, j, 2, b)) == 2:
                break
            fix(j, k, b)
    return fixed


def _smallest(sizes: dict[int, int], keys: list[int], j: int, n: int, above: int = -1) -> list[int]:
    """The N smallest items larger than ABOVE, other than one j."""
    out: list[int] = []
    for s in keys[bisect_left(keys, above + 1) :]:
        out += [s] * min(n - len(out), sizes[s] - (s == j))
        if len(out) == n:
            break
    return out


def _pair_above(sizes: dict[int, int], keys: list[int], top: int, j: int, k: int, r: int) -> bool:
    """Whether two of the items other than one j sum to more than K and at most R."""
    a, b = 0, top
    while a <= b:
        x, y = keys[a], keys[b]
        if x + y > r:
            b -= 1
            continue
        need = {x: 0, y: 0}
        need[x] += 1
        need[y] += 1
        if x + y > k and all(sizes[q] - (q == j) >= c for q, c in need.items()):
            return True
        a += 1
    return False


def best_fit(sizes: dict[int, int], cap: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing, each item into the fullest container with room for it, for all items of a size at once.

    Containers alike are kept as one with their number. The fullest that have room take items of one size until they
    have none for another, so what is held grows with the number of sizes, not of items.
    """
    rooms: list[int] = []
    alike: dict[int, list[tuple[Pattern, int]]] = {}

    def put(room: int, p: Pattern, n: int) -> None:
        if n:
            if room not in alike:
                insort(rooms, room)
                alike[room] = []
            alike[room].append((p, n))

    for s in sorted(sizes, reverse=True):
        left = sizes[s]
        while left:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                t = cap // s
                put(cap - t * s, {s: t}, left // t)
                if left % t:
                    put(cap - left % t * s, {s: left % t}, 1)
                break
            room = rooms[at]
            p, n = alike[room].pop()
            if not alike[room]:
                del alike[room], rooms[at]
            t = room // s
            full = min(n, left // t)
            put(room - t * s, {**p, s: t}, full)
            left -= full * t
            if full < n:
                some = int(left > 0)
                put(room - left * s, {**p, s: left} if some else p, some)
                put(room, p, n - full - some)
                left = 0
    return [x for room in rooms for x in alike[room]]


def pack_sizes(sizes: dict[int, int], cap: int) -> list[tuple[Pattern, int]]:
    """Containers as (how many of each size, how many alike). Items without tokens go into the first container."""
    left = {s: n for s, n in sizes.items() if s > 0 and n > 0}
    out = reduce_dominated(left, cap)
    out += best_fit(left, cap)
    if sizes.get(0):
        first, n = out[0] if out else ({}, 1)
        out = [({**first, 0: sizes[0]}, 1)] + ([(first, n - 1)] if n > 1 else []) + out[1:]
    return out


#: Seats that one row of a packing names.
RUN = 1 << 16


def _pack(d: pd.DataFrame) -> pd.DataFrame:
    cap = int(d["capacity"].iat[0])
    runs, taken, no = [], {}, 0
    for pattern, alike in pack_sizes(dict(zip(d["size"].tolist(), d["n"].tolist())), cap):
        for s, each in pattern.items():
            at = taken.get(s, 0)
            taken[s] = at + each * alike
            # the seats at + 1, at + 2, ... of a size fill one container after the other, EACH at a time
            runs += [(s, no + 1, each, at, k, min(k + RUN, each * alike)) for k in range(0, each * alike, RUN)]
        no += alike
    out = pd.DataFrame(runs, columns=["size", "first", "each", "before", "from_seat", "to_seat"])
    out.insert(0, "request_id", d["request_id"].iat[0])
    return out


def parts_of_items(calls: DataFrame, items: DataFrame) -> DataFrame:
    """What has to be packed: ``request_id, capacity, item_id, part_no, start_char, end_char, size``.

    An item larger than its container is cut into full containers and a rest, all others are one part. Null content
    is empty. Items of a request that is not among CALLS, or with null keys, belong to no container and are left out.
    A request that is delivered twice counts once, with its greatest budget.
    """
    caps = calls.where(F.col("request_id").isNotNull()).groupBy("request_id").agg(F.max("budget_tokens").alias("b")).select(
        "request_id", capacity(F.col("b")).alias("capacity")
    )
    n = F.coalesce(F.length("content"), F.lit(0))
    sized = items.select("request_id", "item_id", n.alias("chars")).join(caps, "request_id")
    step = F.col("capacity") * 4
    fits = F.floor(F.col("chars") / 4) <= F.col("capacity")
    last = F.when(fits, F.lit(0)).otherwise(F.ceil(F.col("chars") / step) - 1).cast("int")
    cut = sized.withColumn("fits", fits).select("*", F.explode(F.sequence(F.lit(0), last)).alias("p"))
    begin = F.col("p") * step
    end = F.when(F.col("fits"), F.col("chars")).otherwise(F.least(begin + step, F.col("chars")))
    return cut.select(
        "request_id", "capacity", "item_id", (F.col("p") + 1).alias("part_no"), begin.alias("start_char"),
        end.alias("end_char"), F.floor((end - begin) / 4).cast("int").alias("size"),
    )


def _numbered(parts: DataFrame) -> DataFrame:
    """PARTS with ``no``, counting the parts of one size of one request; such a group is numbered in SALTS tasks."""
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("item_id", "part_no"), F.lit(SALTS)).cast("int"))
    group = ["request_id", "size"]
    before = Window.partitionBy(*group).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy(*group, "salt").agg(F.count("*").alias("n")).select(
        *group, "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    within = Window.partitionBy(*group, "salt").orderBy("item_id", "part_no", "start_char", "end_char")
    return salted.withColumn("r", F.row_number().over(within)).join(starts, [*group, "salt"]).select(
        *parts.columns, (F.col("start") + F.col("r")).alias("no")
    )


def pack_items(calls: DataFrame, items: DataFrame) -> DataFrame:
    """Every part of every item in a container: :func:`parts_of_items` and ``container_no`` (from 1 per request).

    No container exceeds its capacity. The histogram of a request goes to one task, which returns containers alike as
    one: what it reads, holds and returns is bounded by the number of sizes (and one row for each RUN seats), however many
    items the request has. The items meet their container by an equality join on (request, size, running number).
    """
    parts = parts_of_items(calls, items)
    counts = parts.groupBy("request_id", "capacity", "size").agg(F.count("*").alias("n"))
    # histograms are small but costly to pack: a stated number of partitions keeps them from being coalesced into few
    session = calls.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    runs = counts.repartition(tasks, "request_id").groupBy("request_id").applyInPandas(
        _pack, "request_id long, size int, first long, each long, before long, from_seat long, to_seat long"
    )
    seats = runs.select("*", F.explode(F.sequence(F.col("from_seat"), F.col("to_seat") - 1)).alias("seat")).select(
        "request_id", "size", (F.col("before") + F.col("seat") + 1).alias("no"), (F.col("first") + F.floor(F.col("seat") / F.col("each"))).cast("int").alias("container_no")
    )
    return _numbered(parts).join(seats, ["request_id", "size", "no"]).select(
        "request_id", "capacity", "container_no", "item_id", "part_no", "start_char", "end_char", F.col("size").alias("n_tokens")
    )


def packing_report(packed: DataFrame) -> DataFrame:
    """Per request: containers used, the least that any packing needs by volume, and the share of room left unused."""
    per = packed.groupBy("request_id", "capacity").agg(
        F.max("container_no").alias("containers"), F.count("*").alias("parts"), F.sum("n_tokens").alias("n_tokens")
    )
    return per.select(
        "request_id", "capacity", "containers", "parts", "n_tokens",
        F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("capacity"))).cast("long").alias("least_containers"),
        F.round(1 - F.col("n_tokens") / (F.col("containers") * F.col("capacity")), 6).alias("unused"),
    )
