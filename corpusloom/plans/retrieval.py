"""Queries over the retrieval operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking, evaluation, graph, metrics, pack, resolve, search, snapshots, vectors
from corpusloom.session import table
from corpusloom.sources import extract
from corpusloom.sources import files as sources
from corpusloom.streaming import debounce

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# Relations that several statements share
_SYM = "sym AS (SELECT id, any_value(file_id) AS file_id, any_value(name) AS name, any_value(qualname) AS qualname, any_value(kind) AS kind, any_value(sig) AS sig, any_value(start_line) AS start_line, any_value(end_line) AS end_line, any_value(parent_id) AS parent_id, any_value(arity) AS arity FROM symbols GROUP BY id)"
_EDGE = "edge AS (SELECT id, any_value(src_id) AS src_id, any_value(kind) AS kind, any_value(dst_name) AS dst_name, any_value(dst_arity) AS dst_arity, any_value(dst_id) AS dst_id FROM edges GROUP BY id)"
_LAST = r"regexp_replace({}, '(?s)^.*(::|[./\\])', '')"
_TERMS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"
_TESTPATH = """(len(list_filter(string_split({0}, '/'), lambda p: lower(p) IN ('tests', 'test', '__tests__', 'spec', 'specs'))) > 0
    OR contains(regexp_extract({0}, '[^/]*$'), '.test.') OR contains(regexp_extract({0}, '[^/]*$'), '.spec.')
    OR regexp_matches(lower(regexp_extract(regexp_extract({0}, '[^/]*$'), '^[^.]*')), '^test_|_test$|_spec$')
    OR regexp_matches(regexp_extract(regexp_extract({0}, '[^/]*$'), '^[^.]*'), 'Tests?$'))"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


# --- sources ----------------------------------------------------------------------------------------------------------

_EXT_SQL = "CASE regexp_extract(path, '\\.([^./]+)$', 1) " + " ".join(
    f"WHEN '{e}' THEN '{lang}'" for lang, es in sources.EXTENSIONS.items() for e in es.split()
) + " END"


@query(f"""SELECT id, path, CASE WHEN {_EXT_SQL} IS NULL THEN 'unsupported' WHEN content IS NULL THEN 'missing'
    WHEN octet_length(content) > 1048576 OR regexp_matches(substr(hex(content), 1, 16384), '^(..)*?00') THEN 'unsupported' ELSE 'supported' END AS class FROM files""")
def classify_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("id", "path", sources.file_class(F.col("path"), F.col("content")).alias("class"))


@query(f"SELECT {_EXT_SQL} AS language, count(*) AS files, CAST(sum(octet_length(content)) AS BIGINT) AS bytes FROM files GROUP BY 1")
def files_by_language(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files")
    return f.groupBy(sources.language(F.col("path")).alias("language")).agg(F.count("*").alias("files"), F.sum(F.length("content").cast("long")).alias("bytes"))


_LATEST = r"""latest AS (SELECT path, hash FROM (SELECT hash, indexed_at,
        array_to_string(list_filter(string_split(replace(trim(path, E' \t\r\n'), '\', '/'), '/'), lambda s: s <> '' AND s <> '.'), '/') AS path,
        row_number() OVER (PARTITION BY array_to_string(list_filter(string_split(replace(trim(path, E' \t\r\n'), '\', '/'), '/'), lambda s: s <> '' AND s <> '.'), '/')
            ORDER BY indexed_at DESC NULLS LAST, hash DESC NULLS LAST) AS r
    FROM file_snapshots WHERE snapshot_no = (SELECT max(snapshot_no) FROM file_snapshots)) WHERE r = 1 AND path <> '')"""


def _latest(spark: SparkSession, d: str, which=F.max) -> DataFrame:
    snaps = table(spark, d, "file_snapshots")
    last = snaps.agg(which("snapshot_no").alias("n")).first()["n"]
    return snapshots.snapshot_states(snaps.where(F.col("snapshot_no") == last)).select("path", "hash")


@query(f"""WITH {_LATEST} SELECT path, CASE WHEN l.path IS NULL THEN 'added' WHEN f.path IS NULL THEN 'removed'
    WHEN l.hash IS DISTINCT FROM f.hash THEN 'changed' ELSE 'unchanged' END AS outcome
    FROM (SELECT path, hash FROM files) f FULL JOIN latest l USING (path)""")
def reconcile_diff(spark: SparkSession, d: str) -> DataFrame:
    now = table(spark, d, "files").select("path", F.col("hash").alias("now"), F.lit(1).alias("f"))
    was = _latest(spark, d).select("path", F.col("hash").alias("was"), F.lit(1).alias("l"))
    outcome = F.when(F.col("l").isNull(), "added").when(F.col("f").isNull(), "removed").when(~F.col("now").eqNullSafe(F.col("was")), "changed")
    return now.join(was, "path", "full").select("path", outcome.otherwise("unchanged").alias("outcome"))


@query(f"""WITH {_LATEST.replace("max(snapshot_no)", "min(snapshot_no)")} SELECT l.path FROM latest l WHERE l.path NOT IN (SELECT path FROM files)""")
def removed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of the first snapshot that are gone now."""
    return _latest(spark, d, F.min).select("path").join(table(spark, d, "files").select("path"), "path", "left_anti")


# --- scalar functions -------------------------------------------------------------------------------------------------


@query("SELECT item_id, CAST(floor(length(content) / 4) AS INTEGER) AS tokens, substr(replace(content, chr(10), ' '), 1, 120) AS excerpt FROM bundle_items")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return table(spark, d, "bundle_items").select("item_id", T.estimate_tokens(c).alias("tokens"), T.excerpt(c).alias("excerpt"))


@query(f"WITH {_EDGE} SELECT {_LAST.format('dst_name')} AS last, count(*) AS edges FROM edge GROUP BY 1")
def last_segments(spark: SparkSession, d: str) -> DataFrame:
    e = resolve.distinct_edges(table(spark, d, "edges"))
    return e.groupBy(T.last_segment(F.col("dst_name")).alias("last")).agg(F.count("*").alias("edges"))


@query(f"""WITH {_EDGE}, {_SYM}, names AS (SELECT DISTINCT name, {_LAST.format('name')} AS last FROM sym)
    SELECT e.id, n.name FROM edge e JOIN names n ON {_LAST.format('e.dst_name')} = n.last
    WHERE e.dst_name = n.name OR ends_with(e.dst_name, '.' || n.name) OR ends_with(e.dst_name, '::' || n.name) OR ends_with(e.dst_name, '/' || n.name) OR ends_with(e.dst_name, '\\' || n.name)""".replace("'\\\\'", "'\\'"))
def suffix_matches(spark: SparkSession, d: str) -> DataFrame:
    e = resolve.distinct_edges(table(spark, d, "edges")).select("id", "dst_name", T.last_segment(F.col("dst_name")).alias("last"))
    names = table(spark, d, "symbols").select("name").distinct().select("name", T.last_segment(F.col("name")).alias("last"))
    return e.join(names, "last").where(T.suffix_match(F.col("dst_name"), F.col("name"))).select("id", "name")


@query(f"SELECT path, {_TESTPATH.format('path')} AS is_test FROM files")
def test_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("path", T.is_test_path(F.col("path")).alias("is_test"))


@query("""SELECT request_id, list_has_any(string_split_regex(lower(question), '[^a-z0-9]+'), ['test', 'tests', 'spec', 'specs', 'testing']) AS seeks,
    array_to_string(list_filter(string_split_regex(question, '[^\\p{L}\\p{N}_]+'), lambda w: w <> ''), ' OR ') AS match,
    least(coalesce(budget_tokens, 8000), 20000) AS budget FROM explore_calls""")
def question_terms(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("question")
    words = F.filter(F.split(q, r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    return table(spark, d, "explore_calls").select(
        "request_id", T.seeks_tests(q).alias("seeks"), F.array_join(words, " OR ").alias("match"), T.clamp_budget(F.col("budget_tokens"), 8000).alias("budget")
    )


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS s FROM v)
    SELECT vec_id, round(CASE WHEN s > 0 THEN e[1] / s ELSE e[1] END, 5) AS first, round(CASE WHEN s > 0 THEN list_sum(e) / s ELSE list_sum(e) END, 5) AS total FROM n""")
def l2_normalized(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", T.l2_normalize(F.col("embedding")).alias("e"))
    return v.select("vec_id", F.round(F.col("e")[0], 5).alias("first"), F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("""SELECT repo, count(*) AS files, CASE WHEN count(*) < 200 THEN 'tiny' WHEN count(*) < 2000 THEN 'small' ELSE 'medium' END AS tier FROM files GROUP BY repo""")
def corpus_tiers(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "files").groupBy("repo").agg(F.count("*").alias("files"))
    return n.select("repo", "files", T.corpus_tier(F.col("files")).alias("tier"))


# --- chunks -----------------------------------------------------------------------------------------------------------


@query(r"""WITH lines AS (SELECT doc_id, line, string_split(text, chr(10))[line] AS s FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(line)),
    solid AS (SELECT doc_id, line, s, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS island FROM lines WHERE trim(translate(s, E'\r\t\f', '   ')) <> ''),
    runs AS (SELECT doc_id, min(line) AS start_line, max(line) AS end_line, string_agg(s, chr(10) ORDER BY line) AS content FROM solid GROUP BY doc_id, island)
    SELECT doc_id AS id, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, md5(content) AS content_md5, CAST(floor(length(content) / 4) AS INTEGER) AS tokens
    FROM runs WHERE regexp_matches(content, '[\p{L}\p{N}]')""")
def line_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = chunking.line_runs(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))
    return runs.select("id", "start_line", "end_line", F.md5(F.encode("content", "UTF-8")).alias("content_md5"), T.estimate_tokens(F.col("content")).alias("tokens"))


_OWNERS = f"""WITH {_SYM}, own AS (SELECT file_id, line, id AS owner_id, row_number() OVER (PARTITION BY file_id, line ORDER BY end_line - start_line, start_line DESC, id DESC) AS r
    FROM sym, unnest(range(start_line, end_line + 1)) AS u(line) WHERE kind <> 'module' AND end_line >= start_line)"""


@query(_OWNERS + " SELECT owner_id, count(*) AS lines FROM own WHERE r = 1 GROUP BY owner_id")
def lines_owned(spark: SparkSession, d: str) -> DataFrame:
    return chunking.line_owners(table(spark, d, "symbols")).groupBy("owner_id").agg(F.count("*").alias("lines"))


@query(f"""WITH {_SYM} SELECT d.id, (SELECT max_by(s.id, (s.start_line, s.id)) FROM sym s WHERE s.file_id = d.file_id AND s.start_line < d.start_line AND d.start_line <= s.end_line) AS parent_id FROM sym d""")
def enclosing_symbols(spark: SparkSession, d: str) -> DataFrame:
    return chunking.enclosing(table(spark, d, "symbols"))


@query(f"""WITH {_SYM} SELECT s.id, CASE WHEN s.kind = 'function' AND p.kind IN ('class', 'struct', 'enum', 'trait', 'interface') THEN 'method' ELSE s.kind END AS kind
    FROM sym s LEFT JOIN sym p ON p.id = s.parent_id""")
def kind_promotion(spark: SparkSession, d: str) -> DataFrame:
    s = resolve.distinct_symbols(table(spark, d, "symbols")).select("id", "kind", "parent_id")
    p = s.select(F.col("id").alias("p"), F.col("kind").alias("p_kind"))
    kind = F.when((F.col("kind") == "function") & F.col("p_kind").isin(*chunking.CONTAINERS), "method").otherwise(F.col("kind"))
    return s.join(p, F.col("parent_id") == F.col("p"), "left").select("id", kind.alias("kind"))


@query(f"""WITH {_SYM}, kids AS (SELECT parent_id, string_agg('    ' || sig || chr(10), '' ORDER BY start_line, id) AS body FROM sym WHERE sig IS NOT NULL AND parent_id IS NOT NULL GROUP BY parent_id)
    SELECT s.id, md5(coalesce(s.sig, '') || chr(10) || coalesce(k.body, '')) AS skeleton_md5 FROM sym s LEFT JOIN kids k ON k.parent_id = s.id
    WHERE s.kind IN ('class', 'struct', 'enum', 'trait', 'interface') AND trim(coalesce(s.sig, '') || chr(10) || coalesce(k.body, ''), E' \\n') <> ''
    AND floor(length(coalesce(s.sig, '') || chr(10) || coalesce(k.body, '')) / 4) <= 512""")
def container_skeletons(spark: SparkSession, d: str) -> DataFrame:
    return chunking.skeletons(table(spark, d, "symbols")).select("id", F.md5(F.encode("content", "UTF-8")).alias("skeleton_md5"))


# --- search -----------------------------------------------------------------------------------------------------------


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks; their kinds are those of their symbols."""
    return table(spark, d, "bundle_items").select(
        F.col("item_id").alias("chunk_id"), "path", sources.language(F.col("path")).alias("lang"), "content", T.estimate_tokens(F.col("content")).alias("token_count"), "symbol_id"
    )


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbols").groupBy(F.col("id").alias("symbol_id")).agg(F.max("kind").alias("kind"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: the words of the name of every symbol whose id is divisible by 100."""
    s = table(spark, d, "symbols").where(F.col("id") % 100 == 0)
    return s.select(F.col("id").alias("qid"), F.translate("name", "_", " ").alias("query")).distinct()


_BM25 = f"""chunk AS (SELECT item_id AS chunk_id, {_TERMS.format('content')} AS w FROM bundle_items WHERE content IS NOT NULL),
    stats AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM chunk),
    asked AS (SELECT DISTINCT qid, {_TERMS.format('word')} AS phrase FROM (SELECT {{0}} AS qid, unnest(list_distinct(list_filter(string_split_regex({{1}}, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> ''))) AS word FROM {{2}}) WHERE len({_TERMS.format('word')}) > 0),
    spot AS (SELECT chunk_id, len(w) AS doc_len, w, p FROM chunk, unnest(range(1, len(w) + 1)) AS u(p)),
    tf AS (SELECT chunk_id, doc_len, phrase, count(*) AS tf FROM spot JOIN (SELECT DISTINCT phrase FROM asked) ON w[p] = phrase[1] AND w[p:p + len(phrase) - 1] = phrase GROUP BY ALL),
    df AS (SELECT phrase, count(*) AS df FROM tf GROUP BY phrase),
    keyword AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (
        SELECT qid, chunk_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 9) AS score
        FROM tf JOIN df USING (phrase) JOIN asked USING (phrase), stats GROUP BY qid, chunk_id) QUALIFY rank <= 50)"""
_Q_QUESTIONS = _BM25.replace("{0}", "id").replace("{1}", "replace(name, '_', ' ')").replace("{2}", "(SELECT DISTINCT id, name FROM symbols WHERE id % 100 = 0)")
_Q_NAMES = _BM25.replace("{0}", "id").replace("{1}", "name").replace("{2}", "(SELECT DISTINCT id, name FROM symbols WHERE id % 100 = 0)")


def _round6(x: Column) -> Column:
    """X, not negative, at six decimals as SQL rounds it: by the product in binary, not by the decimal digits."""
    return F.floor(x * 1e6 + 0.5) / 1e6


@query(f"WITH {_Q_QUESTIONS} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM keyword")
def bm25_top50(spark: SparkSession, d: str) -> DataFrame:
    hits = search.bm25(_chunks(spark, d).select("chunk_id", "content"), _questions(spark, d))
    return hits.select("qid", "chunk_id", _round6(F.col("score")).alias("score"), "rank")


@query(f"WITH {_Q_NAMES} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM keyword")
def bm25_phrases(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "symbols").where(F.col("id") % 100 == 0).select(F.col("id").alias("qid"), F.col("name").alias("query")).distinct()
    hits = search.bm25(_chunks(spark, d).select("chunk_id", "content"), names)
    return hits.select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


_KNN = """near AS (SELECT q.vec_id AS qid, v.vec_id AS chunk_id, round(sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda x: (x[1] - x[2]) ** 2))), 9) AS distance,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY round(sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda x: (x[1] - x[2]) ** 2))), 9), v.vec_id) AS rank
    FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id % 100 = 0) q,
        (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) v QUALIFY rank <= {0})"""


def _nearest(spark: SparkSession, d: str, k: int) -> DataFrame:
    v = table(spark, d, "embeddings")
    q = v.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), "embedding")
    return search.knn(v.select(F.col("vec_id").alias("chunk_id"), "embedding"), q, k)


@query(f"WITH {_KNN.format(50)} SELECT qid, chunk_id, round(distance, 5) AS distance, rank FROM near")
def knn_top50(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d, 50).select("qid", "chunk_id", F.round("distance", 5).alias("distance"), "rank")


@query(f"""WITH {_KNN.format(50)}, state AS (SELECT qid, max(CASE WHEN distance <= 0.5 THEN 1 ELSE 0 END) AS close FROM near WHERE chunk_id <> qid GROUP BY qid)
    SELECT n.qid, n.chunk_id, CASE WHEN close = 0 THEN 'weak_vector_only' ELSE 'strong' END AS outcome FROM near n JOIN state USING (qid) WHERE n.chunk_id <> n.qid AND (n.distance <= 0.5 OR close = 0)""")
def knn_floor(spark: SparkSession, d: str) -> DataFrame:
    near = _nearest(spark, d, 50).where(F.col("chunk_id") != F.col("qid"))
    none = near.where(F.lit(False)).select("qid", "chunk_id", F.lit(0.0).alias("score"), "rank")
    kept, outcome = search.candidates(none, near, 0.5)
    return kept.join(outcome, "qid").select("qid", "chunk_id", "outcome")


_VEC_SQL = _KNN.format(50).replace("FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id % 100 = 0) q",
    "FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IN (SELECT id FROM symbols WHERE id % 100 = 0)) q")
_HYBRID = f"""WITH {_Q_QUESTIONS}, {_VEC_SQL},
    fused AS (SELECT qid, chunk_id, round(sum(1.0 / (59 + rank)), 9) AS score FROM (SELECT qid, chunk_id, rank FROM keyword UNION ALL SELECT qid, chunk_id, rank FROM near) GROUP BY qid, chunk_id),
    about AS (SELECT b.item_id AS chunk_id, b.path, s.kind, b.content, floor(length(b.content) / 4) AS tokens FROM bundle_items b LEFT JOIN (SELECT id, max(kind) AS kind FROM symbols GROUP BY id) s ON s.id = b.symbol_id),
    scored AS (SELECT f.qid, f.chunk_id, round(f.score
            * CASE WHEN ({_TESTPATH.format('a.path')} OR (ends_with(a.path, '.rs') AND (contains(a.content, '#[cfg(test)]') OR contains(a.content, '#[test]'))))
                AND NOT list_has_any(string_split_regex(lower(replace(q.name, '_', ' ')), '[^a-z0-9]+'), ['test', 'tests', 'spec', 'specs', 'testing']) THEN 0.4 ELSE 1.0 END
            * CASE WHEN a.kind = 'module' THEN 0.7 ELSE 1.0 END * CASE WHEN a.tokens < 32 THEN 0.7 ELSE 1.0 END, 9) AS score
        FROM fused f JOIN about a USING (chunk_id) JOIN (SELECT DISTINCT id, name FROM symbols) q ON q.id = f.qid),
    top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 10)"""


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = _questions(spark, d).join(v.select(F.col("chunk_id").alias("qid"), "embedding"), "qid", "left")
    return search.hybrid(_chunks(spark, d), v, q, kinds=_kinds(spark, d))


@query(f"""WITH {_Q_QUESTIONS}, {_VEC_SQL} SELECT qid, chunk_id, round(sum(1.0 / (59 + rank)), 6) AS score FROM (SELECT qid, chunk_id, rank FROM keyword UNION ALL SELECT qid, chunk_id, rank FROM near) GROUP BY qid, chunk_id""")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = _questions(spark, d)
    keyword = search.bm25(_chunks(spark, d).select("chunk_id", "content"), q)
    near = search.knn(v, q.join(v.select(F.col("chunk_id").alias("qid"), "embedding"), "qid"))
    return search.fuse(keyword, near).select("qid", "chunk_id", F.round("score", 6).alias("score"))


@query(_HYBRID + " SELECT qid, chunk_id, round(score, 6) AS score, rank, 'strong' AS outcome FROM top")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank", "outcome")


# --- resolution and graph ---------------------------------------------------------------------------------------------

_RESOLVED = f"""resolved AS (SELECT e.id, e.src_id, e.kind, e.dst_name, e.dst_arity,
        coalesce(xf.i, xa.i, af.i, CASE WHEN aa.n <= 5 THEN aa.i END, sf.i, CASE WHEN sa.n = 1 THEN sa.i END) AS dst_id,
        CASE WHEN coalesce(xf.i, xa.i) IS NOT NULL THEN 'exact' WHEN coalesce(af.i, CASE WHEN aa.n <= 5 THEN aa.i END) IS NOT NULL THEN 'name_arity' ELSE 'name_only' END AS confidence
    FROM (SELECT e.*, {_LAST.format('e.dst_name')} AS last, s.file_id AS f FROM edge e LEFT JOIN sym s ON s.id = e.src_id) e
    LEFT JOIN (SELECT name, qualname, file_id, min(id) AS i FROM sym GROUP BY ALL) xf ON xf.name = e.last AND xf.qualname = e.dst_name AND xf.file_id = e.f
    LEFT JOIN (SELECT name, qualname, min(id) AS i FROM sym GROUP BY ALL) xa ON xa.name = e.last AND xa.qualname = e.dst_name
    LEFT JOIN (SELECT name, arity, file_id, min(id) AS i FROM sym GROUP BY ALL) af ON af.name = e.last AND af.arity = e.dst_arity AND af.file_id = e.f
    LEFT JOIN (SELECT name, arity, min(id) AS i, count(*) AS n FROM sym GROUP BY name, arity) aa ON aa.name = e.last AND aa.arity = e.dst_arity
    LEFT JOIN (SELECT name, file_id, min(id) AS i FROM sym GROUP BY ALL) sf ON sf.name = e.last AND sf.file_id = e.f
    LEFT JOIN (SELECT name, min(id) AS i, count(*) AS n FROM sym GROUP BY name) sa ON sa.name = e.last)"""


@query(f"WITH {_SYM}, {_EDGE}, {_RESOLVED} SELECT * FROM resolved")
def resolve_edges(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve(table(spark, d, "edges"), table(spark, d, "symbols"))


@query(f"WITH {_SYM}, {_EDGE}, {_RESOLVED} SELECT kind, confidence, dst_id IS NOT NULL AS resolved, count(*) AS edges FROM resolved GROUP BY ALL")
def resolve_summary(spark: SparkSession, d: str) -> DataFrame:
    r = resolve_edges(spark, d)
    return r.groupBy("kind", "confidence", F.col("dst_id").isNotNull().alias("resolved")).agg(F.count("*").alias("edges"))


@query(f"""WITH {_SYM}, {_EDGE}, {_RESOLVED}, touched AS (SELECT DISTINCT {_LAST.format('name')} AS last FROM sym WHERE id % 100 = 0)
    SELECT r.* FROM resolved r WHERE {_LAST.format('dst_name')} IN (SELECT last FROM touched)""")
def resolve_touched(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols")
    return resolve.resolve(table(spark, d, "edges"), s, s.where(F.col("id") % 100 == 0).select("name"))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Start symbols (the stated set: ids divisible by 100), edges and symbols."""
    s = resolve.distinct_symbols(table(spark, d, "symbols"))
    return s.where(F.col("id") % 100 == 0).select(F.col("id").alias("start_id")), resolve.distinct_edges(table(spark, d, "edges")), s


def _callee_sql(depth: int) -> str:
    return f"""WITH RECURSIVE {_SYM}, {_EDGE}, calls AS (SELECT * FROM edge WHERE kind = 'calls'),
    reach AS (SELECT id AS start_id, id AS node, 0 AS depth FROM sym WHERE id % 100 = 0 UNION SELECT r.start_id, c.dst_id, r.depth + 1 FROM reach r JOIN calls c ON c.src_id = r.node WHERE c.dst_id IS NOT NULL AND r.depth + 1 < {depth}),
    hits AS (SELECT r.start_id, r.depth + 1 AS depth, c.id AS edge_id, c.src_id, c.dst_id, c.dst_name, row_number() OVER (PARTITION BY r.start_id ORDER BY r.depth, c.dst_id NULLS FIRST, c.id) AS ord FROM reach r JOIN calls c ON c.src_id = r.node QUALIFY ord <= 50)"""


@query(_callee_sql(1) + " SELECT start_id, depth, edge_id, src_id, dst_id, dst_name, ord FROM hits")
def callees_d1(spark: SparkSession, d: str) -> DataFrame:
    starts, e, _ = _graph(spark, d)
    return graph.callees(starts, e, 1).select("start_id", "depth", "edge_id", "src_id", "dst_id", "dst_name", "ord")


@query(_callee_sql(3) + " SELECT start_id, depth, edge_id, src_id, dst_id, dst_name, ord FROM hits")
def callees_d3(spark: SparkSession, d: str) -> DataFrame:
    starts, e, _ = _graph(spark, d)
    return graph.callees(starts, e, 3).select("start_id", "depth", "edge_id", "src_id", "dst_id", "dst_name", "ord")


@query(_callee_sql(3) + """ SELECT start_id, depth, dst_id, CASE WHEN dst_id IS NULL THEN dst_name END AS label, count(*) AS times, min(ord) AS ord FROM hits GROUP BY 1, 2, 3, 4""")
def callees_collapsed(spark: SparkSession, d: str) -> DataFrame:
    starts, e, _ = _graph(spark, d)
    return graph.collapse(graph.callees(starts, e, 3))


def _caller_sql(depth: int, cap: int) -> str:
    return f"""WITH RECURSIVE {_SYM}, {_EDGE}, calls AS (SELECT *, {_LAST.format('dst_name')} AS last FROM edge WHERE kind = 'calls'),
    starts AS (SELECT id, name, {_LAST.format('name')} AS last FROM sym WHERE id % 100 = 0),
    seed AS (SELECT s.id AS start_id, c.src_id, c.id AS edge_id FROM starts s JOIN calls c ON c.dst_id = s.id
        UNION ALL SELECT s.id, c.src_id, c.id FROM starts s JOIN calls c ON c.last = s.last AND c.dst_id IS NULL AND (c.dst_name = s.name OR ends_with(c.dst_name, '.' || s.name) OR ends_with(c.dst_name, '::' || s.name) OR ends_with(c.dst_name, '/' || s.name))),
    reach AS (SELECT DISTINCT start_id, src_id AS node, 1 AS depth FROM seed UNION SELECT r.start_id, c.src_id, r.depth + 1 FROM reach r JOIN calls c ON c.dst_id = r.node WHERE r.depth < {depth}),
    rows_ AS (SELECT start_id, 1 AS depth, src_id AS caller_id, min(edge_id) AS edge_id FROM seed GROUP BY 1, 3
        UNION ALL SELECT r.start_id, r.depth + 1, c.src_id, min(c.id) FROM reach r JOIN calls c ON c.dst_id = r.node WHERE r.depth < {depth} GROUP BY 1, 2, 3),
    hits AS (SELECT *, row_number() OVER (PARTITION BY start_id ORDER BY depth, caller_id) AS ord FROM rows_ QUALIFY ord <= {cap})"""


@query(_caller_sql(1, 50) + " SELECT start_id, depth, caller_id, edge_id, ord FROM hits")
def callers_d1(spark: SparkSession, d: str) -> DataFrame:
    return graph.callers(*_graph(spark, d), 1).select("start_id", "depth", "caller_id", "edge_id", "ord")


@query(_caller_sql(3, 50) + " SELECT start_id, depth, caller_id, edge_id, ord FROM hits")
def callers_d3(spark: SparkSession, d: str) -> DataFrame:
    return graph.callers(*_graph(spark, d), 3).select("start_id", "depth", "caller_id", "edge_id", "ord")


@query(_caller_sql(5, 500) + " SELECT start_id, depth, caller_id, edge_id, ord FROM hits")
def impact_d5(spark: SparkSession, d: str) -> DataFrame:
    return graph.callers(*_graph(spark, d), 5, graph.IMPACT_CAP).select("start_id", "depth", "caller_id", "edge_id", "ord")


@query(_caller_sql(5, 500) + " SELECT start_id, count(DISTINCT caller_id) AS symbols, count(DISTINCT s.file_id) AS files FROM hits JOIN sym s ON s.id = caller_id GROUP BY start_id")
def impact_summary(spark: SparkSession, d: str) -> DataFrame:
    starts, e, s = _graph(spark, d)
    return graph.impact_summary(graph.callers(starts, e, s, 5, graph.IMPACT_CAP), s)


@query(f"""WITH {_SYM}, {_EDGE}, module AS (SELECT file_id, min(id) AS module_id FROM sym WHERE kind = 'module' GROUP BY file_id),
    of_ AS (SELECT s.id AS start_id, m.module_id FROM sym s JOIN module m USING (file_id) WHERE s.id % 100 = 0)
    SELECT o.start_id, 'out' AS direction, e.id AS edge_id, e.dst_id AS other_id, e.dst_name FROM of_ o JOIN edge e ON e.src_id = o.module_id AND e.kind = 'imports'
    UNION ALL SELECT o.start_id, 'in', e.id, e.src_id, e.dst_name FROM of_ o JOIN edge e ON e.dst_id = o.module_id AND e.kind = 'imports'""")
def imports_of(spark: SparkSession, d: str) -> DataFrame:
    return graph.imports(*_graph(spark, d))


@query(f"""WITH {_SYM}, t AS (SELECT DISTINCT name AS target FROM sym WHERE id % 100 = 0),
    full_ AS (SELECT target, min(id) AS symbol_id FROM t JOIN sym ON qualname = target GROUP BY target),
    named AS (SELECT target, id AS symbol_id, qualname, row_number() OVER (PARTITION BY target ORDER BY qualname, id) AS r, count(*) OVER (PARTITION BY target) AS n FROM t JOIN sym ON name = target WHERE target NOT IN (SELECT target FROM full_))
    SELECT f.target, 'exact' AS outcome, f.symbol_id, s.qualname FROM full_ f JOIN sym s ON s.id = f.symbol_id
    UNION ALL SELECT target, CASE WHEN n = 1 THEN 'exact' ELSE 'candidate' END, symbol_id, qualname FROM named WHERE r <= 10""")
def symbol_lookup(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols")
    return graph.lookup(s, s.where(F.col("id") % 100 == 0).select(F.col("name").alias("target")))


@query(r"""WITH s AS (SELECT id, max_by(name, name || '|' || coalesce(qualname, '')) AS name, max_by(qualname, name || '|' || coalesce(qualname, '')) AS qualname FROM symbols GROUP BY id),
    t AS (SELECT DISTINCT substr(name, 1, length(name) - 1) AS target FROM s WHERE id % 100 = 0 AND regexp_matches(name, '^\w{4,}$')),
    lost AS (SELECT target FROM t WHERE target NOT IN (SELECT name FROM s) AND target NOT IN (SELECT qualname FROM s WHERE qualname IS NOT NULL)),
    n AS (SELECT name, min(struct_pack(qualname := qualname, id := id)) AS q FROM s GROUP BY name),
    near AS (SELECT target, name, q, contains(lower(name), lower(target)) AS close FROM lost JOIN n ON contains(lower(name), substr(lower(target), 1, 3))),
    kept AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY length(name), name) AS r FROM near QUALIFY close = bool_or(close) OVER (PARTITION BY target))
    SELECT target, 'suggestion' AS outcome, q.id AS symbol_id, q.qualname AS qualname FROM kept QUALIFY row_number() OVER (PARTITION BY target ORDER BY length(name), name) <= 5""")
def symbol_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Names of which the last letter is missing: what is suggested for them."""
    s = table(spark, d, "symbols")
    cut_off = s.where((F.col("id") % 100 == 0) & F.col("name").rlike(r"^\w{4,}$")).select(F.expr("substr(name, 1, length(name) - 1)").alias("target"))
    return graph.lookup(s, cut_off).where(F.col("outcome").isin("suggestion", "not_found"))


# --- packing ----------------------------------------------------------------------------------------------------------

_DEDUPED = """deduped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, chunk_id ORDER BY score DESC NULLS LAST, item_id) AS r FROM bundle_items WHERE chunk_id IS NOT NULL AND chunk_id <> -1) WHERE r = 1
    UNION ALL SELECT *, 1 FROM bundle_items WHERE chunk_id IS NULL OR chunk_id = -1)"""


@query(f"WITH {_DEDUPED} SELECT request_id, item_id FROM deduped")
def pack_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return pack.dedupe(table(spark, d, "bundle_items")).select("request_id", "item_id")


@query(f"""WITH RECURSIVE {_DEDUPED}, sized AS (SELECT request_id, item_id, CAST(floor(length(content) / 4) AS INTEGER) + 20 AS cost, least(coalesce(budget_tokens, 8000), 20000) AS budget,
        row_number() OVER (PARTITION BY request_id ORDER BY score DESC NULLS LAST, item_id) AS n FROM deduped JOIN explore_calls USING (request_id)),
    fold AS (SELECT request_id, item_id, n, TRUE AS selected, cost AS used FROM sized WHERE n = 1
        UNION ALL SELECT s.request_id, s.item_id, s.n, f.used + s.cost <= s.budget, f.used + CASE WHEN f.used + s.cost <= s.budget THEN s.cost ELSE 0 END FROM fold f JOIN sized s ON s.request_id = f.request_id AND s.n = f.n + 1)
    SELECT request_id, item_id, selected, CAST(used AS INTEGER) AS used FROM fold""")
def pack_greedy(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack(table(spark, d, "bundle_items"), table(spark, d, "explore_calls"), T.clamp_budget(F.col("budget_tokens"), 8000))


@query("""WITH c AS (SELECT request_id, item_id, CAST(sum(floor(length(content) / 4)) OVER (PARTITION BY request_id ORDER BY item_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent, row_number() OVER (PARTITION BY request_id ORDER BY item_id) AS n FROM bundle_items)
    SELECT request_id, item_id, spent FROM c WHERE spent <= 4000 OR n = 1""")
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "bundle_items").select("request_id", "item_id", T.estimate_tokens(F.col("content")).alias("t"))
    return pack.budget_prefix(rows, "request_id", [F.asc("item_id")], F.col("t"), F.lit(4000)).select("request_id", "item_id", "spent")


# --- quality ----------------------------------------------------------------------------------------------------------

_RANKED = f"""{_KNN.format(11)}, lab AS (SELECT vec_id, label FROM embeddings), ranked AS (SELECT qid, list(chunk_id ORDER BY rank) AS ranked FROM near WHERE chunk_id <> qid GROUP BY qid),
    want AS (SELECT q.vec_id AS qid, list(v.vec_id ORDER BY v.vec_id)[1:20] AS expected FROM lab q JOIN lab v ON v.label = q.label AND v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id),
    unit AS (SELECT qid, ranked[1:10] AS ranked, expected, label FROM ranked JOIN want USING (qid) JOIN lab ON vec_id = qid)"""


def _units(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "embeddings").select("vec_id", "label")
    near = _nearest(spark, d, 11).where(F.col("chunk_id") != F.col("qid"))
    ranked = near.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("ranked"))
    q = lab.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), "label")
    # the expectation is the first twenty vectors of the query's label: the least per label are numbered, then joined
    w = Window.partitionBy("label").orderBy("vec_id")
    first = lab.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 21)
    same = q.join(first, "label").where(F.col("vec_id") != F.col("qid"))
    want = same.groupBy("qid", "label").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, 20).alias("expected"))
    return ranked.select("qid", F.slice("ranked", 1, 10).alias("ranked")).join(want, "qid")


@query(f"""WITH {_RANKED} SELECT qid, round(len(list_intersect(ranked, expected)) / len(expected), 4) AS recall10,
    round(coalesce(1.0 / list_position(list_transform(ranked, lambda x: list_contains(expected, x)), TRUE), 0), 4) AS rr,
    round(list_sum([CASE WHEN list_contains(expected, ranked[i]) THEN 1.0 ELSE 0.0 END / log2(i + 1) FOR i IN range(1, 11)]) / list_sum([1.0 / log2(i + 1) FOR i IN range(1, least(len(expected), 10) + 1)]), 4) AS ndcg10,
    round(1 - len(list_intersect(ranked[1:5], expected)) / len(expected), 4) AS clean5 FROM unit""")
def retrieval_quality(spark: SparkSession, d: str) -> DataFrame:
    u = _units(spark, d)
    r, e = F.col("ranked"), F.col("expected")
    grades = F.map_from_arrays(e, F.transform(e, lambda x: F.lit(1)))
    return u.select(
        "qid", F.round(metrics.recall_at(r, e, 10), 4).alias("recall10"), F.round(metrics.reciprocal_rank(r, e), 4).alias("rr"),
        F.round(metrics.ndcg(r, grades), 4).alias("ndcg10"), F.round(metrics.clean_at(r, e, 5), 4).alias("clean5"),
    )


@query(f"""WITH {_RANKED} SELECT label, count(*) AS n, round(avg(len(list_intersect(ranked, expected)) / len(expected)), 4) AS recall10 FROM unit GROUP BY ROLLUP (label)""")
def pooled_quality(spark: SparkSession, d: str) -> DataFrame:
    u = _units(spark, d).select("label", metrics.recall_at(F.col("ranked"), F.col("expected"), 10).alias("recall10"))
    return metrics.pooled(u, "label", ["recall10"])


@query()
def retrieval_quality_all(spark: SparkSession, d: str) -> DataFrame:
    return metrics.label_quality(_nearest(spark, d, 11), table(spark, d, "embeddings").select("vec_id", "label")).drop("label")


@query()
def pooled_quality_all(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "embeddings").select("vec_id", "label")
    return metrics.pooled(metrics.label_quality(_nearest(spark, d, 11), lab, None), "label", ["recall10"])


@query(f"""WITH {_SYM}, {_EDGE}, {_RESOLVED}, want AS (SELECT DISTINCT src_id, dst_id FROM edge WHERE kind = 'calls' AND dst_id IS NOT NULL),
    ret AS (SELECT DISTINCT src_id, dst_id FROM resolved WHERE kind = 'calls' AND dst_id IS NOT NULL AND src_id IN (SELECT src_id FROM want)), got AS (SELECT * FROM want INTERSECT SELECT * FROM ret)
    SELECT f.n AS found, r.n AS returned, w.n AS labelled, round(f.n / r.n, 4) AS precision, round(f.n / w.n, 4) AS recall
    FROM (SELECT count(*) AS n FROM got) f, (SELECT count(*) AS n FROM ret) r, (SELECT count(*) AS n FROM want) w""")
def edge_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    e = resolve.distinct_edges(table(spark, d, "edges")).where((F.col("kind") == "calls") & F.col("dst_id").isNotNull())
    r = resolve_edges(spark, d).where(F.col("kind") == "calls")
    return metrics.edge_quality(r, e)


@query("""WITH v AS (SELECT is_late, CAST(user_id % 10 AS VARCHAR) AS corpus, event_type AS metric, avg(value) / 100 AS value FROM (SELECT *, row_number() OVER (ORDER BY event_id) * 2 > count(*) OVER () AS is_late FROM events) GROUP BY ALL)
    SELECT a.corpus, a.metric, round(a.value, 4) AS before, round(b.value, 4) AS now FROM v a JOIN v b USING (corpus, metric) WHERE NOT a.is_late AND b.is_late AND a.value - b.value > 0.02 + 1e-9""")
def ratchet_gate(spark: SparkSession, d: str) -> DataFrame:
    """Ten cohorts of users as corpora, the earlier half of their events as baseline of the later."""
    ev = table(spark, d, "events")
    n = ev.count()
    # event ids are consecutive from the least on
    low = ev.agg(F.min("event_id").alias("m")).first()["m"] or 0
    late = (F.col("event_id") - low + 1) * 2 > n
    v = lambda part: ev.where(part).groupBy((F.col("user_id") % 10).cast("string").alias("corpus"), F.col("event_type").alias("metric")).agg((F.avg("value") / 100).alias("value"))
    return metrics.ratchet(v(~late), v(late)).select("corpus", "metric", F.round("before", 4).alias("before"), F.round("now", 4).alias("now"))


_PACKED = f"""{_DEDUPED}, sized AS (SELECT request_id, item_id, content, CAST(floor(length(content) / 4) AS INTEGER) + 20 AS cost, least(coalesce(budget_tokens, 8000), 20000) AS budget,
        row_number() OVER (PARTITION BY request_id ORDER BY score DESC NULLS LAST, item_id) AS n FROM deduped JOIN explore_calls USING (request_id)),
    fold AS (SELECT request_id, item_id, content, n, TRUE AS selected, cost AS used FROM sized WHERE n = 1
        UNION ALL SELECT s.request_id, s.item_id, s.content, s.n, f.used + s.cost <= s.budget, f.used + CASE WHEN f.used + s.cost <= s.budget THEN s.cost ELSE 0 END FROM fold f JOIN sized s ON s.request_id = f.request_id AND s.n = f.n + 1),
    bundles AS (SELECT request_id, string_agg(content, chr(10) ORDER BY item_id) AS bundle FROM fold WHERE selected GROUP BY request_id),
    firsts AS (SELECT symbol_id, content FROM (SELECT symbol_id, content, row_number() OVER (PARTITION BY symbol_id ORDER BY start_line, item_id) AS r FROM bundle_items WHERE symbol_id IS NOT NULL AND content IS NOT NULL) WHERE r = 1),
    places AS (SELECT request_id, symbol_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC NULLS LAST, item_id) AS best, row_number() OVER (PARTITION BY request_id ORDER BY score, item_id) AS worst FROM bundle_items WHERE symbol_id IS NOT NULL AND score IS NOT NULL),
    want AS (SELECT DISTINCT request_id, symbol_id FROM places WHERE best <= 3), bar AS (SELECT DISTINCT request_id, symbol_id FROM places WHERE worst <= 3),
    a AS (SELECT w.request_id, bool_and(coalesce(contains(b.bundle, f.content), FALSE)) AS ok FROM want w JOIN bundles b USING (request_id) LEFT JOIN firsts f USING (symbol_id) GROUP BY 1),
    c AS (SELECT w.request_id, avg(CASE WHEN contains(b.bundle, f.content) THEN 0.0 ELSE 1.0 END) AS clean FROM bar w JOIN bundles b USING (request_id) LEFT JOIN firsts f USING (symbol_id) GROUP BY 1)"""


@query(f"""WITH RECURSIVE {_PACKED} SELECT b.request_id, coalesce(a.ok, FALSE) AS answer_in_bundle, round(coalesce(c.clean, 1.0), 4) AS bundle_clean
    FROM bundles b LEFT JOIN a USING (request_id) LEFT JOIN c USING (request_id)""")
def bundle_quality(spark: SparkSession, d: str) -> DataFrame:
    """The three best-scored symbols of a request as expected, the three worst as forbidden."""
    items = table(spark, d, "bundle_items")
    chosen = pack_greedy(spark, d).where("selected").select("item_id")
    parts = items.join(chosen, "item_id").groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("item_id", "content"))).alias("a"))
    bundles = parts.select("request_id", F.array_join("a.content", "\n").alias("bundle"))
    scored = items.where(F.col("symbol_id").isNotNull() & F.col("score").isNotNull())
    first = lambda *order: scored.withColumn("r", F.row_number().over(Window.partitionBy("request_id").orderBy(*order))).where("r <= 3").select("request_id", "symbol_id")
    firsts = evaluation.first_chunks(items.select("symbol_id", "start_line", F.col("item_id").alias("chunk_id"), "content"))
    return evaluation.bundle_quality(bundles, firsts, first(F.desc("score"), "item_id"), first("score", "item_id"))


@query("""WITH hits AS (SELECT request_id AS qid, qualname, row_number() OVER (PARTITION BY request_id ORDER BY score DESC NULLS LAST, item_id) AS rank FROM bundle_items)
    SELECT qid, qualname, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM hits WHERE rank <= 20 AND qualname IS NOT NULL""")
def search_eval(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("request_id").orderBy(F.desc_nulls_last("score"), "item_id")
    return evaluation.ranked_names(table(spark, d, "bundle_items").select(F.col("request_id").alias("qid"), "qualname", F.row_number().over(w).alias("rank")))


@query("""WITH m AS (SELECT kind AS name, CAST(max(floor(length(content) / 4)) AS BIGINT) AS value FROM (SELECT b.content, CASE WHEN b.symbol_id IS NULL THEN 'slice' ELSE s.kind END AS kind FROM bundle_items b LEFT JOIN (SELECT id, max(kind) AS kind FROM symbols GROUP BY id) s ON s.id = b.symbol_id) GROUP BY 1)
    SELECT name, value, CAST(max_tokens AS BIGINT) AS budget FROM m JOIN size_limits ON kind = name WHERE value > max_tokens""")
def over_budget(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of items whose largest item is above the limit of the kind."""
    kinds = table(spark, d, "symbols").groupBy(F.col("id").alias("symbol_id")).agg(F.max("kind").alias("kind"))
    named = table(spark, d, "bundle_items").join(kinds, "symbol_id", "left").withColumn("name", F.when(F.col("symbol_id").isNull(), "slice").otherwise(F.col("kind")))
    measured = named.groupBy("name").agg(F.max(T.estimate_tokens(F.col("content"))).cast("long").alias("value"))
    return evaluation.over_budget(measured, table(spark, d, "size_limits").select(F.col("kind").alias("name"), F.col("max_tokens").cast("long").alias("budget")))


@query("""SELECT id, 'src/file_' || id || '.' || ['py', 'ts', 'rs'][id % 3 + 1] AS path, CASE id % 3
    WHEN 0 THEN 'def work_' || id || '(x):' || chr(10) || CASE WHEN id > 0 THEN '    x = work_' || (id - 1) || '(x)' || chr(10) ELSE '' END || '    return x + 1' || chr(10)
    WHEN 1 THEN 'export function work_' || id || '(x: number): number {' || chr(10) || '  x = work_' || (id - 1) || '(x);' || chr(10) || '  return x + 1;' || chr(10) || '}' || chr(10)
    ELSE 'pub fn work_' || id || '(x: u64) -> u64 {' || chr(10) || '    let x = work_' || (id - 1) || '(x);' || chr(10) || '    x + 1' || chr(10) || '}' || chr(10) END AS content FROM range(500) t(id)""")
def synthetic_corpus(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.synthetic_files(spark, max(evaluation.SWEEP))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, percent, value FROM r, (VALUES (50), (99)) p(percent) WHERE k = round(percent / 100 * (n - 1))""")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.nearest_rank(table(spark, d, "events"), "event_type", "value", [50, 99])


# --- maintenance ------------------------------------------------------------------------------------------------------


@query("SELECT item_id AS chunk_id FROM bundle_items WHERE item_id NOT IN (SELECT vec_id FROM embeddings)")
def embed_backlog(spark: SparkSession, d: str) -> DataFrame:
    return vectors.backlog(table(spark, d, "bundle_items").select(F.col("item_id").alias("chunk_id")), table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id")))


@query("SELECT item_id AS chunk_id, 256 AS dims, 1.0 AS norm FROM bundle_items WHERE content IS NOT NULL")
def embed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """What holds of the vectors of any embedder: one for each content, of its length, of norm 1."""
    v = vectors.embed(table(spark, d, "bundle_items").select(F.col("item_id").alias("chunk_id"), "content"), vectors.HashEmbedder)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return v.select("chunk_id", F.size("embedding").alias("dims"), F.round(norm, 4).alias("norm"))


@query("""SELECT 'files' AS relation, (SELECT count(*) FROM files) AS rows UNION ALL SELECT 'symbols', (SELECT count(DISTINCT id) FROM symbols)
    UNION ALL SELECT 'edges', (SELECT count(DISTINCT id) FROM edges) UNION ALL SELECT 'chunks', (SELECT count(*) FROM bundle_items)""")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = [("files", "id"), ("symbols", "id"), ("edges", "id"), ("bundle_items", "item_id")]
    parts = [table(spark, d, t).select(k).distinct().agg(F.count("*").alias("rows")).select(F.lit("chunks" if t == "bundle_items" else t).alias("relation"), "rows") for t, k in rows]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(r"""WITH lines AS (SELECT doc_id, line, string_split(text, chr(10))[line] AS s FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(line))
    SELECT t.term, count(*) AS lines, CAST(sum(floor(length(source || '/' || doc_id || ':' || line || ':' || s || chr(10)) / 4)) AS BIGINT) AS tokens
    FROM lines JOIN documents USING (doc_id), (VALUES ('parser'), ('deleted in revision')) t(term) WHERE contains(s, t.term) AND source IS NOT NULL GROUP BY t.term""")
def grep_cost(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    lines = docs.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "source", F.posexplode(F.split("text", "\n")).alias("n", "s")).where(F.col("source").isNotNull())
    hits = lines.select("*", F.explode(F.array(F.lit("parser"), F.lit("deleted in revision"))).alias("term")).where(F.contains("s", "term"))
    text = F.concat("path", F.lit(":"), (F.col("n") + 1).cast("string"), F.lit(":"), "s", F.lit("\n"))
    return hits.groupBy("term").agg(F.count("*").alias("lines"), F.sum(T.estimate_tokens(text).cast("long")).alias("tokens"))


@query("""WITH e AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 3600000000 THEN 0 ELSE 1 END AS new FROM events),
    b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM e)
    SELECT CAST(user_id AS VARCHAR) AS path, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS events FROM b GROUP BY user_id, burst""")
def debounce_bursts(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    b = debounce.bursts(ev, 3600)
    return b.select("path", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "events")


@query()
def extract_symbols(spark: SparkSession, d: str) -> DataFrame:
    return extract.relations(extract.parse_files(table(spark, d, "files")))[0]


@query()
def extract_edges(spark: SparkSession, d: str) -> DataFrame:
    s, e, _ = extract.relations(extract.parse_files(table(spark, d, "files")))
    return resolve.resolve(e, s)


@query()
def extract_chunks(spark: SparkSession, d: str) -> DataFrame:
    return extract.relations(extract.parse_files(table(spark, d, "files")))[2]


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
