"""Packing the items of a request into a token budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OVERHEAD = 20  # fixed value of the reference: tokens that an item costs beside its content


def dedupe(items: DataFrame) -> DataFrame:
    """One item per request and chunk, the one of the highest score (least ``item_id`` among equals).

    Items that are slices of a file (chunk -1) or have no chunk are all kept. A null score is the lowest.
    """
    real = F.col("chunk_id").isNotNull() & (F.col("chunk_id") != -1)
    best = Window.partitionBy("request_id", "chunk_id").orderBy(F.desc_nulls_last("score"), F.asc("item_id"))
    kept = items.where(real).withColumn("_r", F.row_number().over(best)).where(F.col("_r") == 1).drop("_r")
    return kept.unionByName(items.where(~real))


def _greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    request, used, taken = None, 0, 0
    for d in batches:
        out = []
        for r, item, tokens, budget in zip(d["request_id"], d["item_id"], d["tokens"], d["budget"]):
            if r != request:
                request, used, taken = r, 0, 0
            cost = int(tokens) + OVERHEAD
            fits = used + cost <= budget or taken == 0
            if fits:
                used, taken = used + cost, taken + 1
            out.append((r, item, fits, used))
        yield pd.DataFrame(out, columns=["request_id", "item_id", "selected", "used"])


def pack(items: DataFrame, calls: DataFrame, budget: Column) -> DataFrame:
    """Greedy choice by descending score: ``request_id, item_id, selected, used``; an item that does not fit is skipped.

    At least one item of each request is chosen. BUDGET is an expression on CALLS. Ids and sizes alone are sorted, by
    request and score, and streamed through a fold with constant memory, so a request may hold any number of items.
    """
    asked = calls.where(F.col("request_id").isNotNull()).groupBy("request_id").agg(F.max("budget_tokens").alias("budget_tokens")).select(
        "request_id", budget.alias("budget")
    )
    sized = dedupe(items).select("request_id", "item_id", F.floor(F.length("content") / 4).alias("tokens"), "score").join(asked, "request_id")
    ordered = sized.select("request_id", "item_id", F.coalesce("tokens", F.lit(0)).alias("tokens"), "budget", "score").repartition(
        "request_id"
    ).sortWithinPartitions("request_id", F.desc_nulls_last("score"), "item_id")
    return ordered.mapInPandas(_greedy, "request_id long, item_id long, selected boolean, used int")


def budget_prefix(rows: DataFrame, group: str, order: list[Column], cost: Column, budget: Column) -> DataFrame:
    """The rows of each group up to where their summed cost exceeds the budget; the first row always stays."""
    w = Window.partitionBy(group).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("spent", F.sum(cost).over(run))
        .withColumn("_n", F.row_number().over(w))
        .where((F.col("spent") <= budget) | (F.col("_n") == 1))
        .drop("_n")
    )
