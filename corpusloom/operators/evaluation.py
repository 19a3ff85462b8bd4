"""Evaluation of bundles and searches: inputs, measures, budgets, a synthetic corpus for sweeps, and sinks."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FETCH = 20  # fixed value of the reference: hits that an evaluation asks for
SWEEP = (50, 200, 500)  # fixed values of the reference: files of the synthetic corpora
LANGUAGES = ("py", "ts", "rs")


def first_chunks(chunks: DataFrame) -> DataFrame:
    """``symbol_id, content`` of each symbol's first chunk, by line and then id, of CHUNKS (``symbol_id, start_line, chunk_id, content``)."""
    at = F.struct(F.coalesce("start_line", F.lit(0)).alias("line"), "chunk_id", "content")
    return chunks.where(F.col("symbol_id").isNotNull() & F.col("content").isNotNull()).groupBy("symbol_id").agg(F.min(at).alias("c")).select("symbol_id", "c.content")


def bundle_quality(bundles: DataFrame, firsts: DataFrame, expected: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Per request ``answer_in_bundle`` and ``bundle_clean``.

    BUNDLES is ``request_id, bundle``, FIRSTS as of :func:`first_chunks`, EXPECTED and FORBIDDEN are ``request_id,
    symbol_id``. The answer is in the bundle if the first chunk of every expected symbol is part of its text; a symbol
    without a chunk is not. ``bundle_clean`` is the share of forbidden symbols whose first chunk is no part of it; without
    a chunk a symbol counts as clean. Without expected symbols the answer is not in it, without forbidden ones it is clean.
    """
    both = expected.select("request_id", "symbol_id", F.lit(1).alias("want")).unionByName(forbidden.select("request_id", "symbol_id", F.lit(0).alias("want"))).distinct()
    judged = both.join(firsts, "symbol_id", "left").join(bundles, "request_id").select(
        "request_id", "want", F.coalesce(F.contains("bundle", "content"), F.lit(False)).alias("inside")
    )
    want = F.col("want") == 1
    marks = judged.groupBy("request_id").agg(
        F.min(F.when(want, F.col("inside").cast("int"))).alias("all_in"), F.avg(F.when(~want, 1.0 - F.col("inside").cast("int"))).alias("clean")
    )
    return bundles.select("request_id").join(marks, "request_id", "left").select(
        "request_id", (F.coalesce("all_in", F.lit(0)) == 1).alias("answer_in_bundle"), F.round(F.coalesce("clean", F.lit(1.0)), 4).alias("bundle_clean")
    )


def ranked_names(hits: DataFrame, fetch: int = FETCH) -> DataFrame:
    """The first FETCH hits of each query (``qid, rank, qualname``) without those that have no name, ranked anew."""
    w = Window.partitionBy("qid").orderBy("rank")
    named = hits.where((F.col("rank") <= fetch) & F.col("qualname").isNotNull())
    return named.select("qid", "qualname", F.row_number().over(w).alias("rank"))


def over_budget(measured: DataFrame, budgets: DataFrame) -> DataFrame:
    """Measures (``name, value``) strictly above their budget (``name, budget``): ``name, value, budget``; others are skipped."""
    return measured.join(budgets, "name").where(F.col("value") > F.col("budget")).select("name", "value", "budget")


def synthetic_files(spark: SparkSession, n: int) -> DataFrame:
    """N source files, ``id, path, content``, in Python, TypeScript and Rust by turns; each calls the function of the one before."""
    i = F.col("id")
    call = lambda text: F.when(i > 0, F.format_string(text, i - 1)).otherwise("")
    body = (
        F.when(i % 3 == 0, F.concat(F.format_string("def work_%d(x):\n", i), call("    x = work_%d(x)\n"), F.lit("    return x + 1\n")))
        .when(i % 3 == 1, F.concat(F.format_string("export function work_%d(x: number): number {\n", i), call("  x = work_%d(x);\n"), F.lit("  return x + 1;\n}\n")))
        .otherwise(F.concat(F.format_string("pub fn work_%d(x: u64) -> u64 {\n", i), call("    let x = work_%d(x);\n"), F.lit("    x + 1\n}\n")))
    )
    ext = F.element_at(F.array(*map(F.lit, LANGUAGES)), (i % 3 + 1).cast("int"))
    return spark.range(n).select("id", F.format_string("src/file_%d.%s", i, ext).alias("path"), body.alias("content"))


def sweep(spark: SparkSession, measure: Callable[[DataFrame], object], sizes: Iterable[int] = SWEEP) -> list[dict]:
    """Seconds that MEASURE takes on synthetic corpora of SIZES files: ``files, seconds, result``."""
    out = []
    for n in sizes:
        began = time.perf_counter()
        result = measure(synthetic_files(spark, n))
        out.append({"files": n, "seconds": round(time.perf_counter() - began, 3), "result": result})
    return out


# --- inputs and sinks: small files of the driver ----------------------------------------------------------------------


def read_yaml(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """The list in the YAML file at PATH, or below KEY in it, as a table of SCHEMA; missing fields are null.

    Needs a YAML parser to be installed; an ImportError says so.
    """
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading YAML needs the module yaml") from e
    data = yaml.safe_load(Path(path).read_text()) or []
    rows = data.get(key, []) if key else data
    return spark.createDataFrame([], schema) if not rows else spark.createDataFrame([{n: r.get(n) for n in spark.createDataFrame([], schema).columns} for r in rows], schema)


def write_json(path: str, value: object) -> None:
    """VALUE as the JSON file at PATH, replaced at once."""
    part = Path(path + ".part")
    part.write_text(json.dumps(value, indent=2, sort_keys=True) + "\n")
    part.replace(path)


def append_json(path: str, value: object) -> None:
    """VALUE as one more line of the file at PATH."""
    with open(path, "a") as f:
        f.write(json.dumps(value, sort_keys=True) + "\n")


def markdown_table(columns: list[str], rows: Iterable[Iterable[object]]) -> str:
    """A Markdown table; bars and line ends in cells are escaped, null is empty."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    line = lambda cells: "| " + " | ".join(map(cell, cells)) + " |\n"
    return line(columns) + line(["---"] * len(columns)) + "".join(line(r) for r in rows)


def write_markdown(path: str, title: str, tables: dict[str, tuple[list[str], list]]) -> None:
    """A report with a table under each heading."""
    Path(path).write_text(f"# {title}\n" + "".join(f"\n## {h}\n\n{markdown_table(*t)}" for h, t in tables.items()))
