"""Queries over the subpackage's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import docpairs, leakage, mixing, packing, provenance, splitting, syntax, toxicity
from corpusloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.classify_files(table(spark, d, "files")).where(F.col("kind").isNotNull()).select("file_id")


def p1_kinds(spark: SparkSession, d: str) -> DataFrame:
    kinds = provenance.classify_files(table(spark, d, "files"))
    kind = F.coalesce("kind", F.lit("hand-written"))
    return kinds.groupBy("repo", kind.alias("kind")).agg(F.count("*").alias("files"))


def p1_routes(spark: SparkSession, d: str) -> DataFrame:
    kinds = provenance.classify_files(table(spark, d, "files")).where(F.col("kind").isNotNull())
    return kinds.groupBy("route", "kind").agg(F.count("*").alias("files"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    t = {n: table(spark, d, n) for n in ("bundle_items", "symbols", "files", "size_limits")}
    return splitting.split_oversized(t["bundle_items"], t["symbols"], t["files"], t["size_limits"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where(F.col("piece_no") == 2).select("item_id")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.check_files(table(spark, d, "files")).where(~F.col("valid")).select("file_id")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.failure_rates(syntax.check_files(table(spark, d, "files")), table(spark, d, "index_reports"))


def p4_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_items(table(spark, d, "explore_calls"), table(spark, d, "bundle_items"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(p4_containers(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pairs(spark, d).select("symbol_id")


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.doc_pairs(table(spark, d, "bundle_items"), table(spark, d, "symbols"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).where("kept").select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items")
    return leakage.leak_report(leakage.find_leaks(table(spark, d, "documents"), items), items)


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    scored = toxicity.score_documents(table(spark, d, "documents"))
    return scored.where(F.col("score") >= toxicity.THRESHOLD).select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxic_rates(toxicity.score_documents(table(spark, d, "documents")))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_kinds, p1_routes, p2_found, p2_pieces, p3_found, p3_rates, p4_containers, p4_report, p5_found, p5_pairs,
            p8_found, p8_items, p9_mixture, p9_report, p10_found, p10_rates,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
            SELECT b.item_id
            FROM bundle_items b
            LEFT JOIN (SELECT id, max(kind) AS kind FROM symbols GROUP BY id) s ON s.id = b.symbol_id
            JOIN size_limits l ON l.kind = CASE WHEN b.symbol_id IS NULL THEN 'slice' ELSE s.kind END
            WHERE floor(length(b.content) / 4) > l.max_tokens""",
    }
