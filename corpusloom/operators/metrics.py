"""Retrieval quality, pooling and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE, SLACK = 0.02, 1e-9  # fixed values of the reference


def recall_at(ranked: Column, expected: Column, k: int) -> Column:
    """Share of EXPECTED among the first K of RANKED; repeats use up ranks; 0 without expectations."""
    found = F.size(F.array_intersect(F.slice(ranked, 1, k), expected))
    return F.when(F.size(expected) > 0, found / F.size(F.array_distinct(expected))).otherwise(0.0)


def reciprocal_rank(ranked: Column, expected: Column, k: int = 10) -> Column:
    """1 / place of the first expected entry among the first K, else 0."""
    hits = F.transform(F.slice(ranked, 1, k), lambda x: F.array_contains(expected, x))
    at = F.array_position(hits, True)
    return F.when(at > 0, 1.0 / at).otherwise(0.0)


def ndcg(ranked: Column, grades: Column, k: int = 10) -> Column:
    """Discounted gain of the first K against the best order of GRADES (a map); 0 without grades."""
    gain = lambda xs: F.aggregate(
        F.transform(xs, lambda g, i: g / F.log2(i + F.lit(2.0))), F.lit(0.0), lambda a, x: a + x
    )
    got = F.transform(F.slice(ranked, 1, k), lambda x: F.coalesce(F.element_at(grades, x), F.lit(0)).cast("double"))
    ideal = F.transform(F.slice(F.sort_array(F.map_values(grades), asc=False), 1, k), lambda x: x.cast("double"))
    return F.when(gain(ideal) > 0, gain(got) / gain(ideal)).otherwise(0.0)


def clean_at(ranked: Column, forbidden: Column, k: int) -> Column:
    """Share of FORBIDDEN that is not among the first K; 1 without any."""
    return F.when(F.size(forbidden) > 0, F.size(F.array_except(forbidden, F.slice(ranked, 1, k))) / F.size(F.array_distinct(forbidden))).otherwise(1.0)


def pooled(units: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """Means per group and over all units (group null), never means of means."""
    return units.rollup(group).agg(F.count("*").alias("n"), *(F.round(F.coalesce(F.avg(m), F.lit(0.0)), 4).alias(m) for m in metrics))


def label_quality(near: DataFrame, labels: DataFrame, digits: int | None = 4) -> DataFrame:
    """Quality of ranked neighbours where every other vector of a query's label is relevant, however many there are.

    NEAR is ``qid, chunk_id, rank``, LABELS ``vec_id, label``; the query itself takes no rank. Columns ``qid, label,
    recall10, rr, ndcg10, clean5``. Labels meet the ten ranked ids and the size of the relevant set is a count, so no
    pairs are formed. A query without a label, or alone in it, has nothing to find and is left out.
    """
    w = Window.partitionBy("qid").orderBy("rank")
    top = near.where(F.col("chunk_id") != F.col("qid")).withColumn("at", F.row_number().over(w)).where(F.col("at") <= 10)
    size = labels.where(F.col("label").isNotNull()).groupBy("label").agg((F.count("*") - 1).alias("size")).where(F.col("size") > 0)
    asked = labels.select(F.col("vec_id").alias("qid"), "label").join(size, "label")
    found = labels.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("its"))
    hit = F.coalesce(F.col("its") == F.col("label"), F.lit(False))
    gain = lambda at: 1.0 / F.log2(at + F.lit(1.0))
    sums = top.join(asked, "qid").join(found, "chunk_id", "left").groupBy("qid", "label", "size").agg(
        F.sum(hit.cast("int")).alias("n10"), F.sum((hit & (F.col("at") <= 5)).cast("int")).alias("n5"),
        F.coalesce(F.max(F.when(hit, 1.0 / F.col("at"))), F.lit(0.0)).alias("rr"),
        F.coalesce(F.sum(F.when(hit, gain(F.col("at")))), F.lit(0.0)).alias("got"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("size"), F.lit(10)).cast("int")), F.lit(0.0), lambda a, x: a + gain(x))
    cols = {"recall10": F.col("n10") / F.col("size"), "rr": F.col("rr"), "ndcg10": F.col("got") / ideal, "clean5": 1 - F.col("n5") / F.col("size")}
    return sums.select("qid", "label", *((c if digits is None else F.round(c, digits)).alias(n) for n, c in cols.items()))


def edge_quality(returned: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row ``found, returned, labelled, precision, recall`` of labelled (src_id, dst_id) against returned edges."""
    r = returned.select("src_id", "dst_id").where(F.col("dst_id").isNotNull()).distinct()
    want = labelled.select("src_id", "dst_id").distinct()
    mine = r.join(want.select("src_id").distinct(), "src_id", "left_semi")
    got = want.join(r, ["src_id", "dst_id"], "left_semi")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    parts = n(got, "found").select(F.lit(1).alias("k"), "found").join(n(mine, "returned").select(F.lit(1).alias("k"), "returned"), "k").join(n(want, "labelled").select(F.lit(1).alias("k"), "labelled"), "k")
    share = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 4)
    return parts.select("found", "returned", "labelled", share("found", "returned").alias("precision"), share("found", "labelled").alias("recall"))


def ratchet(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Metrics that fell by more than TOLERANCE: ``corpus, metric, before, now``; what one side lacks is skipped."""
    b = baseline.select("corpus", "metric", F.col("value").alias("before"))
    return b.join(current.select("corpus", "metric", F.col("value").alias("now")), ["corpus", "metric"]).where(
        F.col("before") - F.col("now") > TOLERANCE + SLACK
    )


def nearest_rank(values: DataFrame, group: str, value: str, percents: list[int]) -> DataFrame:
    """Nearest-rank percentiles per group: ``group, percent, value``, rank round(p / 100 * (n - 1)).

    Equal values are counted first, then the running counts are looked up, so no group is collected.
    """
    n = values.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group).orderBy(value)
    run = n.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("c").over(Window.partitionBy(group)))
    asked = run.select("*", F.explode(F.array(*map(F.lit, percents))).alias("percent"))
    rank = F.round(F.col("percent") / 100 * (F.col("total") - 1)).cast("long")
    return asked.where((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("c"))).select(group, "percent", value)
