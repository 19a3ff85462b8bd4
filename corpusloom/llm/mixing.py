"""Mixing sources to target weights (problem 9), by Poisson replication."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SEED = 17
#: Rotations of the draws that are tried per source.
SHIFTS = 32


def canonical_source(source: Column) -> Column:
    """The name of a source in one spelling: without blanks around it, lower case, ``-`` and blanks as ``_``."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[-\s]+", "_")


def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    import public_tokenizers

    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """DOCS with ``n_tokens``, the size of ``text`` in tokens of the public tokenizer at path TOKENIZER; null counts 0."""
    kind = F.pandas_udf(_counter(tokenizer), "int")
    return docs.withColumn("n_tokens", kind("text"))


def _counter(tokenizer: str):
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoder(tokenizer)
        for s in batches:
            yield s.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int32")

    return count


def _mean_of_capped(lam: float, cap: int) -> float:
    """Mean of min(X, CAP), X being Poisson of mean LAM: the sum of P(X > k) for k below CAP."""
    p, below, mean = math.exp(-lam), 0.0, 0.0
    for k in range(cap):
        below += p
        mean += max(0.0, 1.0 - below)
        p *= lam / (k + 1)
    return mean


def replication_steps(rate: float, cap: int) -> list[float]:
    """Thresholds t: a document of uniform hash u is used as often as there are t at most u.

    The inverse distribution function of a Poisson variable cut off at CAP, its parameter chosen so that the mean is
    RATE. With CAP copies on average every document is used CAP times.
    """
    if rate <= 0 or cap <= 0:
        return []
    if rate >= cap:
        return [0.0] * cap
    lo, hi = 0.0, 1.0
    while _mean_of_capped(hi, cap) < rate and hi < 600:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _mean_of_capped(mid, cap) < rate else (lo, mid)
    p, below, out = math.exp(-hi), 0.0, []
    for k in range(cap):
        below += p
        out.append(below)
        p *= hi / (k + 1)
    return out


def plan_mixture(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None) -> dict[str, tuple[float, int]]:
    """Mean number of uses and cap per source. TOTAL tokens are aimed at, without it the most that keeps all shares.

    Shares are of the sources that have tokens at all: what is missing on either side cannot be mixed. A source whose
    cap does not reach its share at TOTAL is used as often as allowed.
    """
    usable = {s: t for s, t in targets.items() if sizes.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    whole = sum(t[0] for t in usable.values())
    if total is None:
        total_f = min((sizes[s] * c * whole / w for s, (w, c) in usable.items()), default=0.0)
    else:
        total_f = float(total)
    return {s: (min(float(c), total_f * w / whole / sizes[s]), c) for s, (w, c) in usable.items()}


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """At most 1000 sources, summed over spellings, the least cap; null or negative values count as 0."""
    rows = targets.where(F.col("source").isNotNull()).groupBy(canonical_source(F.col("source")).alias("s")).agg(
        F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("w"),
        F.min(F.coalesce("max_repeats", F.lit(0))).alias("c"),
    ).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 target sources")
    return {r["s"]: (float(r["w"]), int(r["c"])) for r in rows}


def _sizes(counted: DataFrame, names: list[str]) -> dict[str, int]:
    """Tokens of each of the sources NAMES, whose number is bounded by :func:`_targets`."""
    rows = counted.where(F.col("source").isin(names)).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    return {r["source"]: int(r["n"] or 0) for r in rows}


def _counted(docs: DataFrame, tokenizer: str) -> DataFrame:
    return with_token_counts(docs, tokenizer).withColumn("source", canonical_source(F.col("source")))


def _draw(seed: int) -> Column:
    """A uniform 30-bit number that depends on SEED and the document's id alone."""
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))


def _uses(u: Column, rates: dict[str, tuple[float, int]]) -> Column:
    """How often a document of uniform draw U is used, by its source."""
    steps = {s: replication_steps(rate, cap) for s, (rate, cap) in sorted(rates.items())}
    mine = _lookup({s: F.array(*map(F.lit, x)) if x else F.array().cast("array<double>") for s, x in steps.items()}, "array<double>")
    return F.when(mine.isNull(), 0).otherwise(F.size(F.filter(mine, lambda t: t <= u)))


def _lookup(values: dict[str, Column], kind: str) -> Column:
    """The value of a row's source, null for other sources."""
    if not values:
        return F.lit(None).cast(kind)
    return F.element_at(F.create_map(*(x for s, v in values.items() for x in (F.lit(s), v))), F.col("source"))


def _shifts(counted: DataFrame, rates: dict[str, tuple[float, int]], sizes: dict[str, int], seed: int) -> Column:
    """Per source the rotation of its draws, of SHIFTS equidistant ones, whose sum of tokens is nearest to its goal.

    A rotated uniform draw is as uniform as before; choosing among a few keeps small sources near their share.
    """
    u = F.pmod(_draw(seed) + F.col("shift") * F.lit((1 << 30) // SHIFTS), F.lit(1 << 30))
    tried = counted.where(F.col("source").isin(list(rates))).withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(SHIFTS - 1))))
    sums = tried.withColumn("k", _uses((u + 0.5) / float(1 << 30), rates)).groupBy("source", "shift").agg(
        F.sum(F.col("n_tokens") * F.col("k")).alias("n")
    )
    best: dict[str, tuple[float, int]] = {}
    for r in sums.collect():  # one row per target source and shift
        off = abs(r["n"] - rates[r["source"]][0] * sizes[r["source"]])
        best[r["source"]] = min(best.get(r["source"], (math.inf, 0)), (off, r["shift"]))
    return F.coalesce(_lookup({s: F.lit(k) for s, (_, k) in sorted(best.items())}, "int"), F.lit(0))


def _plan(docs: DataFrame, targets: DataFrame, total: int | None, seed: int, tokenizer: str) -> DataFrame:
    """Every document with ``source``, ``n_tokens`` and ``times``, how often it is used; ``text`` only where it may be.

    The one run of the tokenizer: its counts, with the texts of target sources, are kept by a checkpoint.
    """
    goals = _targets(targets)
    text = F.when(F.col("source").isin(list(goals)), F.col("text")) if goals else F.lit(None).cast("string")
    counted = cut(_counted(docs, tokenizer).select("doc_id", "source", "n_tokens", text.alias("text")))
    sizes = _sizes(counted, list(goals))
    rates = plan_mixture(sizes, goals, total)
    shift = _shifts(counted.select("doc_id", "source", "n_tokens"), rates, sizes, seed)
    u = F.pmod(_draw(seed) + shift * F.lit((1 << 30) // SHIFTS), F.lit(1 << 30))
    return counted.withColumn("times", _uses((u + 0.5) / float(1 << 30), rates))


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED, tokenizer: str = TOKENIZER) -> DataFrame:
    """The mixture: ``doc_id, copy_no, source, n_tokens, text`` in a random order that depends on SEED alone.

    How often a document is used follows from a hash of its id: the inverse of a Poisson distribution whose mean is
    the rate its source needs. Documents of null or untargeted sources are not used; empty and null texts count no
    tokens and are replicated like others. The only shuffle of texts is the last one: partitions are equal ranges of a
    uniform hash of (seed, id, copy), so nothing is sampled, and each is sorted by it. A few numbers per target source go
    to the driver.
    """
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    h = F.xxhash64("doc_id", "copy_no", F.lit(seed + 1))
    part = F.least(F.floor((h / float(1 << 64) + 0.5) * parts), F.lit(parts - 1)).cast("int")
    return (
        _plan(docs, targets, total, seed, tokenizer)
        .where(F.col("times") > 0)
        .select("doc_id", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy_no"), "source", "n_tokens", "text")
        .repartitionById(parts, part)
        .sortWithinPartitions(h, "doc_id", "copy_no")
    )


def mix_report(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED, tokenizer: str = TOKENIZER) -> DataFrame:
    """Target beside actual shares: one row per source of either side, ``share_of_usable`` being the share aimed at.

    ``target_share`` is null for sources without target; ``uses`` is the largest number of uses of one document.
    """
    planned = _plan(docs, targets, total, seed, tokenizer).select("doc_id", "source", "n_tokens", "times")
    used = F.col("times") > 0
    have = planned.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.sum("n_tokens").cast("long").alias("tokens"), F.count("*").alias("docs"),
        F.sum(F.when(used, F.col("n_tokens") * F.col("times"))).alias("mixed_tokens"),
        F.count_distinct(F.when(used, F.col("doc_id"))).alias("docs_used"), F.max(F.when(used, F.col("times"))).alias("uses"),
    )
    want = targets.where(F.col("source").isNotNull()).groupBy(canonical_source(F.col("source")).alias("source")).agg(
        F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats")
    )
    j = want.join(have, "source", "full")
    usable = j.agg(F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).alias("w"), F.sum("mixed_tokens").alias("m")).first()
    w, m = float(usable["w"] or 0) or 1.0, float(usable["m"] or 0) or 1.0
    return j.select(
        "source", "target_share", "max_repeats",
        F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.when(F.col("tokens") > 0, F.round(F.col("target_share") / w, 6)).alias("share_of_usable"),
        F.coalesce("docs_used", F.lit(0)).alias("docs_used"), F.coalesce("uses", F.lit(0)).alias("uses"),
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
        F.round(F.coalesce("mixed_tokens", F.lit(0)) / m, 6).alias("actual_share"),
    )
