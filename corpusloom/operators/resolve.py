"""Resolution of named references to symbols, with a confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

CROWD = 5  # fixed value of the reference: more candidates of one arity elsewhere are too many to choose from


def distinct_symbols(symbols: DataFrame) -> DataFrame:
    """SYMBOLS without repeated deliveries, one row per id."""
    cols = [c for c in symbols.columns if c != "id"]
    return symbols.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct(*cols)).alias("s")).select("id", "s.*")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """EDGES without repeated deliveries, one row per id."""
    return distinct_symbols(edges)


def resolve(edges: DataFrame, symbols: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Every edge with the symbol it means: ``id, src_id, kind, dst_name, dst_arity, dst_id, confidence``.

    Candidates are the symbols named like the last segment of ``dst_name``. First the one with just that qualified
    name (``exact``); then one of equal arity, in the caller's file or, if there are at most CROWD anywhere, the one of
    least id (``name_arity``); then one in the caller's file, or the only one anywhere (``name_only``). Otherwise
    ``dst_id`` is null and the confidence ``name_only``. Within a tier the caller's file comes first, then the id.

    TOUCHED (``name``) limits the work to edges that such names can affect; an edge is resolved once however many of
    the names it matches. Candidates are summarised per name, arity and file, and edges are reduced to their distinct
    (name, arity, file) before these meet, so that a name shared by very many symbols or edges never multiplies; the
    edges themselves are joined once, where the planner splits the skewed side.
    """
    s = distinct_symbols(symbols).select("id", "file_id", "name", "qualname", "arity")
    e = distinct_edges(edges).select("id", "src_id", "kind", "dst_name", "dst_arity")
    e = e.withColumn("last", T.last_segment(F.col("dst_name")))
    if touched is not None:
        e = e.join(touched.select(T.last_segment(F.col("name")).alias("last")).distinct(), "last", "left_semi")
    e = e.join(s.select(F.col("id").alias("src_id"), F.col("file_id").alias("src_file")), "src_id", "left")

    def least(name: str, *by: str) -> DataFrame:
        return s.groupBy(*by).agg(F.min("id").alias(name), F.count("*").alias(f"n_{name}"))

    name, arity, qual, file = "name", "arity", "qualname", "file_id"
    tables = [
        (least("x_file", name, qual, file), {name: "last", qual: "dst_name", file: "src_file"}),
        (least("x_any", name, qual), {name: "last", qual: "dst_name"}),
        (least("a_file", name, arity, file), {name: "last", arity: "dst_arity", file: "src_file"}),
        (least("a_any", name, arity), {name: "last", arity: "dst_arity"}),
        (least("s_file", name, file), {name: "last", file: "src_file"}),
        (least("s_any", name), {name: "last"}),
    ]
    # what an edge means depends on these columns alone, so each combination is resolved once and the edges meet it once
    by = ["dst_name", "last", "dst_arity", "src_file"]
    ways = e.select(*by).distinct()
    for t, keys in tables:
        for k in keys:
            t = t.withColumnRenamed(k, f"_{k}")
        cond = [F.col(v) == F.col(f"_{k}") for k, v in keys.items()]
        ways = ways.join(t, cond, "left").drop(*(f"_{k}" for k in keys))
    exact = F.coalesce("x_file", "x_any")
    by_arity = F.coalesce("a_file", F.when(F.col("n_a_any") <= CROWD, F.col("a_any")))
    by_name = F.coalesce("s_file", F.when(F.col("n_s_any") == 1, F.col("s_any")))
    meant = ways.select(
        *(F.col(c).alias(f"_{c}") for c in by), F.coalesce(exact, by_arity, by_name).alias("dst_id"),
        F.when(exact.isNotNull(), "exact").when(by_arity.isNotNull(), "name_arity").otherwise("name_only").alias("confidence"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return e.join(meant, same, "left").select("id", "src_id", "kind", "dst_name", "dst_arity", "dst_id", "confidence")
