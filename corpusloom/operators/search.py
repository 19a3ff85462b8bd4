"""Keyword, vector and hybrid search for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from corpusloom.functions import text as T
from corpusloom.session import cut

# Fixed values of the reference
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF_K, CANDIDATES = 60, 50
TEST_PRIOR, MODULE_PRIOR, SHORT_PRIOR, SHORT_TOKENS = 0.4, 0.7, 0.7, 32
#: Query vectors that are compared at once; larger query sets are cut into such blocks.
QUERY_BLOCK = 4096
#: Queries of keyword search that are looked up at once, and postings that a task holds.
KEYWORD_BLOCK, BLOCK_POSTINGS = 100_000, 4_000_000


def postings(chunks: DataFrame) -> DataFrame:
    """``chunk_id, term, tf, doc_len`` of CHUNKS (``chunk_id, content``)."""
    words = chunks.select("chunk_id", T.terms(F.col("content")).alias("w"))
    return words.select("chunk_id", F.size("w").alias("doc_len"), F.explode("w").alias("term")).groupBy(
        "chunk_id", "doc_len", "term"
    ).agg(F.count("*").alias("tf"))


def _top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first K rows of each query; the filter on the rank lets map tasks drop the rest before the shuffle."""
    w = Window.partitionBy("qid").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25(chunks: DataFrame, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The K best chunks of each query (``qid, query``): ``qid, chunk_id, score, rank``, ties by chunk id.

    A word of several terms (joined by ``_``) is a phrase: its terms have to follow each other. Queries are a stated set,
    cut into blocks of KEYWORD_BLOCK. For a block, each chunk becomes one row of numbers, its phrases and their counts;
    these rows are dealt by chunk id to tasks that hold about BLOCK_POSTINGS of them. A task adds up the scores of its
    chunks in memory and returns the K best per query, so what is shuffled is postings and K rows per query and task,
    never a row per query and chunk.
    """
    asked = queries.select("qid", F.explode(T.query_terms(F.col("query"))).alias("word")).select(
        "qid", F.array_join(T.terms(F.col("word")), "_").alias("phrase")
    ).where(F.col("phrase") != "").distinct()
    words = chunks.where(F.col("content").isNotNull()).select("chunk_id", T.terms(F.col("content")).alias("w"))
    blocks = max(1, -(-queries.count() // KEYWORD_BLOCK))
    parts = [_keyword(words, asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b), k) for b in range(blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _top(out, k, F.desc("score"), F.asc_nulls_last("chunk_id")).select("qid", "chunk_id", "score", "rank")


def _keyword(words: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The K best chunks of WORDS (``chunk_id, w``) in each task for each query of ASKED (``qid, phrase``): ``qid, chunk_id, score``."""
    spark, chunk_id = words.sparkSession, StructField("chunk_id", words.schema["chunk_id"].dataType)
    held = asked.toArrow()  # at most the phrases of about KEYWORD_BLOCK queries
    phrase, qid = (held.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("phrase", "qid"))
    phrases, qids = phrase.dictionary.to_pylist(), qid.dictionary
    of, has = qid.indices.to_numpy(zero_copy_only=False), phrase.indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((has, of))
    has, bounds = has[order], np.searchsorted(of[order], np.arange(len(qids) + 1))
    ints = ArrayType(IntegerType())
    rows = cut(words.mapInArrow(_numbered(phrases), StructType([chunk_id, StructField("doc_len", IntegerType()), StructField("phrases", ints), StructField("tfs", ints)])))
    stats = rows.agg(F.count("*").alias("n"), F.avg("doc_len").alias("avg_len"), F.sum(F.size("phrases")).alias("postings")).first()  # one row
    tasks = max(spark.sparkContext.defaultParallelism, -(-(stats["postings"] or 0) // BLOCK_POSTINGS))
    dealt = cut(rows.where(F.size("phrases") > 0).repartition(tasks, "chunk_id"))  # read twice
    counted = dealt.mapInArrow(_frequencies, "phrase int, df long").groupBy("phrase").agg(F.sum("df").alias("df")).toArrow()  # a row per phrase
    df = np.zeros(len(phrases))
    df[counted.column("phrase").to_numpy()] = counted.column("df").to_numpy()
    idf = np.maximum(np.log((stats["n"] - df + 0.5) / (df + 0.5)), IDF_FLOOR)
    best = _best(idf, float(stats["avg_len"] or 1.0), qids, bounds, has, k)
    return dealt.mapInArrow(best, StructType([StructField("qid", asked.schema["qid"].dataType), chunk_id, StructField("score", DoubleType())]))


def _numbered(phrases: list[str]):
    """Words of chunks to the numbers of the PHRASES in them, and how often each stands there."""
    terms: dict[str, int] = {}
    step: dict[tuple[int, int], int] = {}
    end = [-1]  # the phrase that ends in a state of the trie
    for i, p in enumerate(phrases):
        at = 0
        for t in p.split("_"):
            at = step.setdefault((at, terms.setdefault(t, len(terms))), len(end))
            if at == len(end):
                end.append(-1)
        end[at] = i
    keys = np.array([s * len(terms) + t for s, t in step], dtype=np.int64)
    order = np.argsort(keys)
    keys, to, ends, known = keys[order], np.array([*step.values()], dtype=np.int64)[order], np.array(end), pa.array([*terms], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = batch.column("w")
            sizes, flat = pc.list_value_length(w).to_numpy(zero_copy_only=False).astype(np.int64), w.flatten()
            ids = pc.fill_null(pc.index_in(flat, value_set=known.cast(flat.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            stop = np.cumsum(sizes)
            here = np.flatnonzero(ids >= 0)
            row, at = np.searchsorted(stop, here, side="right"), np.zeros(len(here), dtype=np.int64)
            found = [np.zeros(0, dtype=np.int64)]
            while len(here):
                key = at * len(terms) + ids[here]
                j = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                ok = keys[j] == key
                here, row, at = here[ok] + 1, row[ok], to[j[ok]]
                done = ends[at] >= 0
                found.append(row[done] * len(phrases) + ends[at[done]])
                ok = here < stop[row]
                here, row, at = here[ok], row[ok], at[ok]
                ok = ids[here] >= 0
                here, row, at = here[ok], row[ok], at[ok]
            codes, tf = np.unique(np.concatenate(found), return_counts=True)
            row, phrase = np.divmod(codes, max(1, len(phrases)))
            offsets = pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (phrase, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), pa.array(sizes, pa.int32()), *lists], ["chunk_id", "doc_len", "phrases", "tfs"])

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """The chunk ids of a task in order; and by phrase and chunk: phrase, number of the chunk, its length, count.

    Rows of one id and length are one chunk.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    t = pa.Table.from_batches(held).combine_chunks()
    ids, phrases, tfs = (pa.concat_arrays(t.column(c).chunks) for c in ("chunk_id", "phrases", "tfs"))
    order = pc.array_sort_indices(ids, null_placement="at_end")
    coded = ids.take(order).dictionary_encode(null_encoding="encode")
    doc = np.empty(len(ids), dtype=np.int32)
    doc[order.to_numpy()] = coded.indices.to_numpy()
    sizes = pc.list_value_length(phrases).to_numpy()
    phrase, tf = phrases.flatten().to_numpy(), tfs.flatten().to_numpy()
    doc, length = np.repeat(doc, sizes), np.repeat(t.column("doc_len").to_numpy(), sizes)
    by = np.lexsort((length, doc, phrase))
    phrase, doc, length, tf = phrase[by], doc[by], length[by], tf[by]
    first = _firsts(phrase, doc, length)
    return coded.dictionary, phrase[first], doc[first], length[first], np.add.reduceat(tf, first, dtype=np.int64)


def _firsts(*sorted_by: np.ndarray) -> np.ndarray:
    """Where a new combination begins."""
    new = np.ones(len(sorted_by[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_by])
    return np.flatnonzero(new)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many chunks of a task each phrase stands."""
    if got := _gathered(batches):
        phrase, df = np.unique(got[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(phrase, pa.int32()), pa.array(df, pa.int64())], ["phrase", "df"])


def _best(idf: np.ndarray, avg_len: float, qids: pa.Array, bounds: np.ndarray, has: np.ndarray, k: int):
    """The K best chunks of a task for each query; query q has the phrases HAS[BOUNDS[q]:BOUNDS[q + 1]]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (got := _gathered(batches)):
            return
        ids, phrase, doc, length, tf = got
        part = idf[phrase] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_len))
        first = _firsts(phrase, doc)  # one chunk id may have rows of several lengths
        phrase, doc, part = phrase[first], doc[first], np.add.reduceat(part, first)
        at = np.searchsorted(phrase, np.arange(len(idf) + 1))
        total, rows = np.zeros(len(ids)), []
        for q in range(len(qids)):
            own = [slice(at[p], at[p + 1]) for p in has[bounds[q] : bounds[q + 1]] if at[p] < at[p + 1]]
            if not own:
                continue
            if len(own) == 1:
                docs, score = doc[own[0]], part[own[0]]
            else:
                for x in own:
                    total[doc[x]] += part[x]
                hits = []
                for x in own:  # each chunk once, and TOTAL is zero again
                    d = doc[x]
                    d = d[total[d] > 0]
                    hits.append((d, total[d]))
                    total[d] = 0
                docs, score = (np.concatenate(x) for x in zip(*hits, strict=True))
            score = np.floor(score * 1e9 + 0.5) / 1e9
            if len(score) > k:
                some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                some = some[np.lexsort((docs[some], -score[some]))[:k]]
                docs, score = docs[some], score[some]
            rows.append((q, docs, score))
            if len(rows) == 1000:
                yield _hits(rows, qids, ids)
                rows = []
        if rows:
            yield _hits(rows, qids, ids)

    return run


def _hits(rows: list[tuple[int, np.ndarray, np.ndarray]], qids: pa.Array, ids: pa.Array) -> pa.RecordBatch:
    q = np.repeat([r[0] for r in rows], [len(r[1]) for r in rows])
    docs, score = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
    return pa.RecordBatch.from_arrays([qids.take(pa.array(q)), ids.take(pa.array(docs)), pa.array(score)], ["qid", "chunk_id", "score"])


def knn(vectors: DataFrame, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The K nearest vectors (``chunk_id, embedding``) of each query (``qid, embedding``) by L2 distance, exactly.

    Columns ``qid, chunk_id, distance, rank``, ties by chunk id. Queries are a stated set, cut into blocks of
    QUERY_BLOCK; each task compares its rows with a block as matrices and keeps the K best per query, so what is
    shuffled is K rows per query and batch. Vectors of another length than a query do not match it.
    """
    rows = queries.where(F.col("embedding").isNotNull()).select("qid", F.col("embedding").cast("array<double>").alias("e"))
    total = rows.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    parts = []
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        held = part.collect()  # at most about QUERY_BLOCK vectors
        by_dim: dict[int, tuple[list, np.ndarray]] = {}
        for dim in {len(r["e"]) for r in held}:
            same = [r for r in held if len(r["e"]) == dim]
            by_dim[dim] = [r["qid"] for r in same], np.array([r["e"] for r in same])
        parts.append(vectors.where(F.col("embedding").isNotNull()).select("chunk_id", F.col("embedding").cast("array<double>")).mapInPandas(_near(by_dim, k), "qid long, chunk_id long, distance double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _top(out, k, F.asc("distance"), F.asc("chunk_id")).select("qid", "chunk_id", "distance", "rank")


def _near(by_dim: dict, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for dim, (qids, q) in by_dim.items():
                mine = d[d["embedding"].map(len) == dim]
                if not len(mine):
                    continue
                ids, v = mine["chunk_id"].to_numpy(), np.stack(mine["embedding"].to_numpy())
                for a in range(0, len(qids), 8):
                    block = q[a : a + 8]
                    dist = np.round(np.sqrt(((block[:, None, :] - v[None, :, :]) ** 2).sum(axis=2)), 9)
                    for j in range(len(block)):
                        best = np.lexsort((ids, dist[j]))[:k]
                        yield pd.DataFrame({"qid": qids[a + j], "chunk_id": ids[best], "distance": dist[j][best]})

    return run


def fuse(keyword: DataFrame, near: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: ``qid, chunk_id, score``; ranks count from 0."""
    both = keyword.select("qid", "chunk_id", "rank").unionByName(near.select("qid", "chunk_id", "rank"))
    return both.groupBy("qid", "chunk_id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank") - 1)), 9).alias("score"))


def candidates(keyword: DataFrame, nearest: DataFrame, floor: float | None) -> tuple[DataFrame, DataFrame]:
    """The vector hits that count, re-ranked, and each query's outcome (``qid, outcome``).

    Hits within FLOOR count. If a query has none and no keyword hit either, all its vector hits count and the outcome
    is ``weak_vector_only``; else it is ``strong``.
    """
    close = F.lit(True) if floor is None else F.col("distance") <= floor
    state = (
        nearest.select("qid", close.cast("int").alias("near"), F.lit(0).alias("kw"))
        .unionByName(keyword.select("qid", F.lit(0).alias("near"), F.lit(1).alias("kw")))
        .groupBy("qid").agg(F.max("near").alias("near"), F.max("kw").alias("kw"))
    )
    weak = (F.col("near") == 0) & (F.col("kw") == 0)
    outcome = state.select("qid", F.when(weak, "weak_vector_only").otherwise("strong").alias("outcome"))
    kept = nearest.join(outcome, "qid").where(close | (F.col("outcome") == "weak_vector_only"))
    w = Window.partitionBy("qid").orderBy("distance", "chunk_id")
    return kept.select("qid", "chunk_id", "distance", F.row_number().over(w).alias("rank")), outcome


def prior(kind: Column, test: Column, tokens: Column, wants_tests: Column) -> Column:
    """The product of what speaks against a chunk: tests (unless wanted), module level, very short."""
    return (
        F.when(test & ~wants_tests, TEST_PRIOR).otherwise(1.0)
        * F.when(kind == "module", MODULE_PRIOR).otherwise(1.0)
        * F.when(tokens < SHORT_TOKENS, SHORT_PRIOR).otherwise(1.0)
    )


def rerank(fused: DataFrame, chunks: DataFrame, queries: DataFrame, limit: int, kinds: DataFrame | None = None) -> DataFrame:
    """Fused hits times their priors, the LIMIT best of each query: ``qid, chunk_id, score, rank``.

    CHUNKS has ``chunk_id, path, lang, kind, content, token_count``, or ``symbol_id`` in place of ``kind`` where KINDS
    (``symbol_id, kind``) are given. Priors act before the cut. What they need of a content is one flag, so no content is
    shuffled.
    """
    asked = queries.select("qid", T.seeks_tests(F.col("query")).alias("wants_tests"))
    test = T.is_test_path(F.col("path")) | F.coalesce(T.inline_tests(F.col("lang"), F.col("content")), F.lit(False))
    about = chunks.select("chunk_id", "kind" if kinds is None else "symbol_id", "token_count", test.alias("test"))
    if kinds is not None:
        about = about.join(kinds, "symbol_id", "left")
    p = prior(F.col("kind"), F.col("test"), F.col("token_count"), F.col("wants_tests"))
    scored = fused.join(about, "chunk_id").join(asked, "qid").select("qid", "chunk_id", F.round(F.col("score") * p, 9).alias("score"))
    return _top(scored, limit, F.desc("score"), F.asc("chunk_id")).select("qid", "chunk_id", "score", "rank")


def hybrid(
    chunks: DataFrame, vectors: DataFrame, queries: DataFrame, limit: int = 10, floor: float | None = None, kinds: DataFrame | None = None
) -> DataFrame:
    """Hybrid search: ``qid, chunk_id, score, rank, outcome``. QUERIES are ``qid, query, embedding`` (null: keyword only).

    Both lists are read several times, so each is made once and held, as K rows per query. KINDS as in ``rerank``.
    """
    keyword = cut(bm25(chunks.select("chunk_id", "content"), queries))
    nearest = cut(knn(vectors, queries))
    near, outcome = candidates(keyword, nearest, floor)
    hits = rerank(fuse(keyword, near), chunks, queries, limit, kinds)
    return hits.join(outcome, "qid", "left").select("qid", "chunk_id", "score", "rank", F.coalesce("outcome", F.lit("strong")).alias("outcome"))
