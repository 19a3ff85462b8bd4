"""Bounded walks over the call and import graph, for many start symbols at once.

Every level is one join and one distinct on (start, node), so paths never multiply; levels are cut by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.session import cut

CALLERS_CAP, IMPACT_CAP = 50, 500  # fixed values of the reference


def _first(df: DataFrame, cap: int, *order) -> DataFrame:
    w = Window.partitionBy("start_id").orderBy(*order)
    return df.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= cap)


def callees(starts: DataFrame, edges: DataFrame, depth: int, cap: int = CALLERS_CAP) -> DataFrame:
    """What the STARTS (``start_id``) call: ``start_id, depth, edge_id, src_id, dst_id, dst_name, ord``.

    One row per call of every symbol reached over fewer than DEPTH resolved calls, unresolved ones included (their
    ``dst_id`` is null and sorts first), the first CAP by (depth, dst_id, edge).
    """
    calls = edges.where(F.col("kind") == "calls").select(F.col("id").alias("edge_id"), "src_id", "dst_id", "dst_name")
    level = starts.select("start_id", F.col("start_id").alias("node"), F.lit(0).alias("depth")).distinct()
    reached = [level]
    for d in range(1, depth):
        nxt = level.join(calls, F.col("node") == F.col("src_id")).where(F.col("dst_id").isNotNull())
        level = cut(nxt.select("start_id", F.col("dst_id").alias("node"), F.lit(d).alias("depth")).distinct())
        reached.append(level)
    all_ = reached[0]
    for r in reached[1:]:
        all_ = all_.unionByName(r)
    rows = all_.join(calls, F.col("node") == F.col("src_id")).select(
        "start_id", (F.col("depth") + 1).alias("depth"), "edge_id", "src_id", "dst_id", "dst_name"
    )
    return _first(rows, cap, F.asc("depth"), F.asc_nulls_first("dst_id"), F.asc("edge_id"))


def callers(starts: DataFrame, edges: DataFrame, symbols: DataFrame, depth: int, cap: int = CALLERS_CAP) -> DataFrame:
    """What calls the STARTS (``start_id``): ``start_id, depth, caller_id, edge_id, resolved, ord``.

    The first level takes calls resolved to the start and unresolved ones whose name matches it; deeper levels take
    resolved calls only. A caller occurs once per depth, with the least edge that leads to it. The first CAP by
    (depth, caller).
    """
    calls = edges.where(F.col("kind") == "calls").select(
        F.col("id").alias("edge_id"), "src_id", "dst_id", "dst_name", T.last_segment(F.col("dst_name")).alias("last")
    )
    named = starts.select("start_id").distinct().join(
        symbols.groupBy(F.col("id").alias("start_id")).agg(F.max("name").alias("name")), "start_id"
    ).withColumn("name_last", T.last_segment(F.col("name")))
    direct = named.join(calls, F.col("start_id") == F.col("dst_id")).select("start_id", "src_id", "edge_id", F.lit(True).alias("resolved"))
    loose = named.join(calls.where(F.col("dst_id").isNull()), F.col("name_last") == F.col("last")).where(
        T.suffix_match(F.col("dst_name"), F.col("name"))
    ).select("start_id", "src_id", "edge_id", F.lit(False).alias("resolved"))

    def once(df: DataFrame, d: int) -> DataFrame:
        return cut(df.groupBy("start_id", "src_id").agg(F.min(F.struct("edge_id", "resolved")).alias("e")).select(
            "start_id", F.lit(d).alias("depth"), F.col("src_id").alias("caller_id"), "e.edge_id", "e.resolved"
        ))

    level = once(direct.unionByName(loose), 1)
    out = level
    for d in range(2, depth + 1):
        nxt = level.select("start_id", "caller_id").join(calls, F.col("caller_id") == F.col("dst_id")).select(
            "start_id", "src_id", "edge_id", F.lit(True).alias("resolved")
        )
        level = once(nxt, d)
        out = out.unionByName(level)
    return _first(out, cap, F.asc("depth"), F.asc("caller_id"))


def impact_summary(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per start the symbols and files that its callers reach: ``start_id, symbols, files``."""
    of = symbols.groupBy(F.col("id").alias("caller_id")).agg(F.max("file_id").alias("file_id"))
    return rows.join(of, "caller_id").groupBy("start_id").agg(
        F.countDistinct("caller_id").alias("symbols"), F.countDistinct("file_id").alias("files")
    )


def imports(starts: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Imports of the modules that hold the STARTS, and of what imports these modules.

    ``start_id, direction, edge_id, other_id, dst_name``; an outgoing import that is not resolved has a null other.
    The module of a file is its symbol of kind module with the least id.
    """
    s = symbols.groupBy("id").agg(F.max(F.struct("file_id", "kind")).alias("s")).select("id", "s.file_id", "s.kind")
    module = s.where(F.col("kind") == "module").groupBy("file_id").agg(F.min("id").alias("module_id"))
    of = starts.select("start_id").distinct().join(s.select(F.col("id").alias("start_id"), "file_id"), "start_id").join(module, "file_id")
    imp = edges.where(F.col("kind") == "imports").select(F.col("id").alias("edge_id"), "src_id", "dst_id", "dst_name")
    out = of.join(imp, F.col("module_id") == F.col("src_id")).select(
        "start_id", F.lit("out").alias("direction"), "edge_id", F.col("dst_id").alias("other_id"), "dst_name"
    )
    into = of.join(imp, F.col("module_id") == F.col("dst_id")).select(
        "start_id", F.lit("in").alias("direction"), "edge_id", F.col("src_id").alias("other_id"), "dst_name"
    )
    return out.unionByName(into)


def collapse(rows: DataFrame) -> DataFrame:
    """Rows of :func:`callees` with equal targets as one with their number: ``start_id, depth, dst_id, label, times, ord``.

    Unresolved targets are alike by name, resolved ones by id; the first place in the order stays. Within a depth
    unresolved rows come last.
    """
    label = F.when(F.col("dst_id").isNull(), F.col("dst_name"))
    return rows.groupBy("start_id", "depth", "dst_id", label.alias("label")).agg(
        F.count("*").alias("times"), F.min("ord").alias("ord")
    )


def lookup(symbols: DataFrame, targets: DataFrame) -> DataFrame:
    """What each target (``target``) names: ``target, outcome, symbol_id, qualname``.

    A qualified name is exact; a plain name is exact if one symbol bears it, else up to ten candidates by qualified
    name; otherwise not found, with up to five suggestions whose name holds the target's last segment, shortest first.
    """
    s = symbols.groupBy("id").agg(F.max(F.struct("name", "qualname")).alias("s")).select("id", "s.name", "s.qualname")
    t = targets.select("target").distinct().withColumn("last", T.last_segment(F.col("target")))
    full = t.join(s, F.col("target") == F.col("qualname")).groupBy("target").agg(F.min("id").alias("symbol_id")).join(
        s.select(F.col("id").alias("symbol_id"), "qualname"), "symbol_id"
    ).select("target", F.lit("exact").alias("outcome"), "symbol_id", "qualname")
    rest = t.join(full, "target", "left_anti")
    w = Window.partitionBy("target")
    named = rest.join(s, F.col("target") == F.col("name")).select("target", F.col("id").alias("symbol_id"), "qualname")
    ranked = named.withColumn("r", F.row_number().over(w.orderBy("qualname", "symbol_id"))).where(F.col("r") <= 11)
    some = ranked.withColumn("n", F.max("r").over(w)).where(F.col("r") <= 10).select(
        "target", F.when(F.col("n") == 1, "exact").otherwise("candidate").alias("outcome"), "symbol_id", "qualname"
    )
    lost = rest.join(named.select("target").distinct(), "target", "left_anti")
    names = s.groupBy("name").agg(F.min(F.struct("qualname", "id")).alias("q"))
    # a substring needs no join on a range: names are cut into three-letter runs, which target and name share
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(F.lower(c), i, 3))))
    g = lost.where(F.length("last") > 0).select("target", "last", F.substring(F.lower("last"), 1, 3).alias("g"))
    near = g.join(names.select("name", "q", grams(F.col("name")).alias("g")), "g")
    close = near.where(F.contains(F.lower("name"), F.lower("last")))
    far = near.join(close.select("target").distinct(), "target", "left_anti")
    hits = close.unionByName(far).withColumn("r", F.row_number().over(w.orderBy(F.length("name"), "name"))).where(F.col("r") <= 5)
    found = hits.select("target", F.lit("suggestion").alias("outcome"), F.col("q.id").alias("symbol_id"), F.col("q.qualname").alias("qualname"))
    none = lost.join(found.select("target").distinct(), "target", "left_anti").select(
        "target", F.lit("not_found").alias("outcome"), F.lit(None).cast("long").alias("symbol_id"), F.lit(None).cast("string").alias("qualname")
    )
    return full.unionByName(some).unionByName(found).unionByName(none)
