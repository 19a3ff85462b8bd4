from __future__ import annotations

import collections
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking, graph, metrics, pack, resolve, search, vectors
from corpusloom.plans import retrieval
from corpusloom.sources import extract
from corpusloom.sources.files import file_class

SYM = "id long, file_id long, name string, qualname string, kind string, sig string, start_line int, end_line int, parent_id long, arity int"
EDGE = "id long, src_id long, kind string, dst_name string, dst_arity int, dst_id long"


def sym(i, f, q, arity=None, kind="function"):
    return (i, f, q.rpartition(".")[2], q, kind, None, 1, 9, None, arity)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("name,last", [("std::collections::HashMap", "HashMap"), ("./utils/helper", "helper"), ("App\\Mail::send", "send"), ("a:b", "a:b"), ("<stdio.h>", "h>")])
def test_last_segment(spark, name, last):
    assert one(spark, T.last_segment(F.col("n")), n=name) == last


@pytest.mark.parametrize("path,hit", [("a/tests/x.py", True), ("Spec/x.rb", True), ("src/x.test.ts", True), ("test_x.py", True), ("x_spec.rb", True), ("FooTest.java", True), ("src/attest.rs", False), ("protests/log.md", False), ("latest.py", False)])
def test_test_paths(spark, path, hit):
    assert one(spark, T.is_test_path(F.col("p")), p=path) is hit


def test_small_functions(spark):
    assert [one(spark, T.corpus_tier(F.col("n")), n=n) for n in (0, 199, 200, 1999, 2000)] == ["tiny", "tiny", "small", "small", "medium"]
    assert one(spark, T.seeks_tests(F.col("q")), q="tests for x") and not one(spark, T.seeks_tests(F.col("q")), q="contest")
    assert one(spark, T.query_terms(F.col("q")), q='"unbalanced a*b(c) -') == ["unbalanced", "a", "b", "c"]
    assert one(spark, T.rfc3339(F.col("n")), n=0) == "1970-01-01T00:00:00Z"
    assert one(spark, T.path_slice(F.col("t")), t="a/b.py:3-7").asDict() == {"path": "a/b.py", "first": 3, "last": 7}
    assert one(spark, file_class(F.col("p"), F.col("c")), p="x.PY", c=b"x") == "unsupported"
    assert one(spark, file_class(F.col("p"), F.col("c")), p="x.py", c=b"a\x00b") == "unsupported"
    assert one(spark, file_class(F.col("p"), F.col("c")), p="x.py", c=b"a0\n00") == "supported"


def test_resolver_tiers(spark):
    s = [sym(1, 1, "a.caller"), sym(2, 2, "b.target", 2), sym(3, 3, "c.target", 1), *(sym(10 + i, 10 + i, f"m{i}.push", 1) for i in range(7)), sym(30, 1, "a.push2", 1), sym(40, 4, "lib._data")]
    s += [sym(50 + i, 50 + i, f"k{i}.push2", 1) for i in range(7)]
    e = [(1, 1, "calls", "b.target", 2, None), (2, 1, "calls", "target", 1, None), (3, 1, "calls", "target", 9, None), (4, 1, "calls", "missing", None, None), (5, 1, "calls", "push", 1, None), (6, 1, "calls", "push2", 1, None), (7, 1, "calls", "_data", None, None), (8, 1, "calls", "mod.aData", None, None)]
    sdf, edf = spark.createDataFrame(s + s[:2], SYM), spark.createDataFrame(e + e[:2], EDGE)
    got = {r.id: (r.dst_id, r.confidence) for r in resolve.resolve(edf, sdf).collect()}
    assert got == {1: (2, "exact"), 2: (3, "name_arity"), 3: (None, "name_only"), 4: (None, "name_only"), 5: (None, "name_only"), 6: (30, "name_arity"), 7: (40, "name_only"), 8: (None, "name_only")}
    some = resolve.resolve(edf, sdf, spark.createDataFrame([("x.push2",)], "name string")).collect()
    assert [r.id for r in some] == [6]


def test_walks(spark):
    s = [sym(1, 1, "m.main"), sym(2, 1, "m.helper"), sym(3, 2, "n.leaf")]
    e = [(1, 1, "calls", "helper", 0, 2), (2, 1, "calls", "leaf", 0, None), (3, 2, "calls", "leaf", 0, 3)]
    sdf, edf = spark.createDataFrame(s, SYM), spark.createDataFrame(e, EDGE)
    at = lambda i: spark.createDataFrame([(i,)], "start_id long")
    up = lambda d: sorted((r.depth, r.caller_id, r.resolved) for r in graph.callers(at(3), edf, sdf, d).collect())
    assert up(1) == [(1, 1, False), (1, 2, True)]
    assert up(2) == [(1, 1, False), (1, 2, True), (2, 1, True)]
    down = lambda d: [(r.depth, r.dst_id) for r in sorted(graph.callees(at(1), edf, d).collect(), key=lambda r: r.ord)]
    assert down(1) == [(1, None), (1, 2)] and down(2) == [(1, None), (1, 2), (2, 3)]


def test_impact_cap(spark):
    s = [sym(i, i, f"m{i}.f{i}") for i in range(1, 512)]
    e = [(i, i, "calls", "f1", 0, 1) for i in range(2, 512)]
    sdf, edf = spark.createDataFrame(s, SYM), spark.createDataFrame(e, EDGE)
    start = spark.createDataFrame([(1,)], "start_id long")
    assert graph.callers(start, edf, sdf, 1, graph.IMPACT_CAP).count() == 500
    assert graph.callers(start, edf, sdf, 1, 10).count() == 10


def test_bm25_against_brute_force(spark):
    docs = {1: "create invoice for bob", 2: "invoice create", 3: "create_invoice create_invoice now", 4: "", 5: "unrelated text"}
    df = spark.createDataFrame([*docs.items(), (6, None)], "chunk_id long, content string")
    q = spark.createDataFrame([(0, "create_invoice AND bob")], "qid long, query string")
    n, avg = 5, sum(len(T_words(t)) for t in docs.values()) / 5
    want = {}
    for words in (["create", "invoice"], ["and"], ["bob"]):
        tf = {i: sum(T_words(t)[k : k + len(words)] == words for k in range(len(T_words(t)))) for i, t in docs.items()}
        hit = [i for i in tf if tf[i]]
        idf = max(1e-6, math.log((n - len(hit) + 0.5) / (len(hit) + 0.5)))
        for i in hit:
            want[i] = want.get(i, 0) + idf * tf[i] * 2.2 / (tf[i] + 1.2 * (0.25 + 0.75 * len(T_words(docs[i])) / avg))
    got = {r.chunk_id: r.score for r in search.bm25(df, q).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_bm25_compares_whole_phrases(spark):
    a, b = "a b c d e f g h i".split(), "a b c d e f g h j k".split()
    df = spark.createDataFrame([(1, "_".join(a)), (2, " ".join(b)), (3, "_".join(a[:8]))], "chunk_id long, content string")
    q = spark.createDataFrame([(0, "_".join(a)), (1, "_".join(b))], "qid long, query string")
    assert sorted((r.qid, r.chunk_id) for r in search.bm25(df, q).collect()) == [(0, 1), (1, 2)]


def shuffled_rows(spark):
    """Rows that all stages so far have written to a shuffle."""
    sc, jvm = spark.sparkContext, spark._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_bm25_shuffles_no_row_per_query_and_chunk(spark):
    df = spark.range(4000).select(F.col("id").alias("chunk_id"), F.lit("alpha beta").alias("content"))
    q = spark.range(100).select(F.col("id").alias("qid"), F.lit("alpha beta").alias("query"))
    before = shuffled_rows(spark)
    got = search.bm25(df, q).collect()
    assert len(got) == 5000 and {r.chunk_id for r in got} == set(range(50))
    assert shuffled_rows(spark) - before < 100_000  # 400,000 hits


def test_bm25_in_blocks_with_repeated_and_missing_ids(spark, monkeypatch):
    monkeypatch.setattr(search, "KEYWORD_BLOCK", 4)
    monkeypatch.setattr(search, "BLOCK_POSTINGS", 5)
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(25)]), " ".join(rng.choices("abcd", k=rng.randint(0, 6)))) for _ in range(60)]
    asks = [(i, " ".join(rng.choice(["a", "b", "a_b", "b_c_d", "d", "zz"]) for _ in range(rng.randint(0, 3)))) for i in range(12)]
    tf = collections.Counter()
    for i, t in rows:
        w = t.split()
        for p in ("a", "b", "d", "a_b", "b_c_d"):
            tf[i, len(w), p] += sum(w[j : j + len(p.split("_"))] == p.split("_") for j in range(len(w)))
    tf = {x: n for x, n in tf.items() if n}
    df = collections.Counter(p for _, _, p in tf)
    avg = sum(len(t.split()) for _, t in rows) / len(rows)
    want = set()
    for q, ask in asks:
        total = collections.Counter()
        for (i, size, p), n in tf.items():
            if p in ask.split():
                total[i] += max(1e-6, math.log((len(rows) - df[p] + 0.5) / (df[p] + 0.5))) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size / avg))
        best = sorted(total, key=lambda i: (-round(total[i], 9), i is None, i))[:7]
        want |= {(q, i, round(total[i], 6), rank) for rank, i in enumerate(best, 1)}
    chunks = spark.createDataFrame(rows, "chunk_id long, content string")
    got = search.bm25(chunks, spark.createDataFrame(asks, "qid long, query string"), 7)
    assert {(r.qid, r.chunk_id, round(r.score, 6), r.rank) for r in got.collect()} == want


def test_scores_are_rounded_as_in_sql(spark):
    x = spark.createDataFrame([(16.2627395,), (0.0,), (1.5,)], "x double").select(retrieval._round6(F.col("x")).alias("y"))
    assert [r.y for r in x.collect()] == [16.262739, 0.0, 1.5]


def test_rrf_fuse_shuffles_no_row_per_query_and_chunk(spark, tmp_path):
    items = spark.range(4000).select(F.col("id").alias("item_id"), F.lit(0).alias("symbol_id"), F.lit("a.py").alias("path"), F.lit("alpha beta").alias("content"))
    symbols = spark.range(100).select((F.col("id") * 100).alias("id"), F.lit("alpha_beta").alias("name"), F.lit("function").alias("kind"))
    vectors = spark.createDataFrame([(0, [1.0]), (9000, [0.5])], "vec_id long, embedding array<float>")
    for name, df in (("bundle_items", items), ("symbols", symbols), ("embeddings", vectors)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    before = shuffled_rows(spark)
    got = {(r.qid, r.chunk_id): r.score for r in retrieval.rrf_fuse(spark, str(tmp_path)).collect()}
    assert len(got) == 5002 and got[0, 0] == round(2 / 60, 6) and got[9000, 9000] == round(1 / 60, 6) and got[100, 49] == round(1 / 109, 6)
    assert shuffled_rows(spark) - before < 100_000  # 400,000 hits


def test_hybrid_makes_each_list_once(spark, monkeypatch):
    made, cut = [], search.cut
    monkeypatch.setattr(search, "cut", lambda df: made.append(df.columns) or cut(df))
    chunks = spark.createDataFrame(
        [(1, "tests/a.py", "python", "alpha", 90, 7), (2, "b.py", "python", "alpha", 90, 7), (3, "c.py", "python", "alpha", 90, 8)],
        "chunk_id long, path string, lang string, content string, token_count int, symbol_id long",
    )
    kinds = spark.createDataFrame([(7, "function"), (8, "module")], "symbol_id long, kind string")
    v = spark.createDataFrame([(3, [1.0])], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(0, "alpha", [1.0]), (1, "alpha tests", None)], "qid long, query string, embedding array<float>")
    got = search.hybrid(chunks, v, q, kinds=kinds)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "MapInArrow" not in plan
    assert ["qid", "chunk_id", "score", "rank"] in made and ["qid", "chunk_id", "distance", "rank"] in made
    want = {(0, 1, round(0.4 / 60, 9)), (0, 2, round(1 / 61, 9)), (0, 3, round(0.7 * round(1 / 62 + 1 / 60, 9), 9))}
    want |= {(1, 1, round(1 / 60, 9)), (1, 2, round(1 / 61, 9)), (1, 3, round(0.7 * round(1 / 62, 9), 9))}
    assert {(r.qid, r.chunk_id, r.score) for r in got.collect()} == want


def T_words(t):
    return [w for w in t.replace("_", " ").split() if w]


def test_knn_floor_and_fusion(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0])], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.1]), (9, [-1.0, -1.0])], "qid long, embedding array<float>")
    near = search.knn(v, q)
    none = near.where(F.lit(False)).select("qid", "chunk_id", F.lit(0.0).alias("score"), "rank")
    kept, outcome = search.candidates(none, near, 0.5)
    assert {tuple(r) for r in outcome.collect()} == {(0, "strong"), (9, "weak_vector_only")}
    assert sorted((r.qid, r.chunk_id) for r in kept.collect()) == [(0, 1), (9, 1), (9, 2)]
    kw = spark.createDataFrame([(0, 5, 1), (0, 7, 2)], "qid long, chunk_id long, rank int")
    nn = spark.createDataFrame([(0, 6, 1), (0, 7, 2)], "qid long, chunk_id long, rank int")
    assert search.fuse(kw, nn).orderBy(F.desc("score")).first().chunk_id == 7


def test_pack(spark):
    item = "request_id long, item_id long, chunk_id long, score double, content string"
    calls = spark.createDataFrame([(1, 700), (2, 100), (3, 50), (4, 1000)], "request_id long, budget_tokens int")
    rows = [(1, i, i, float(i), "x" * 1200) for i in (1, 2, 3)]
    rows += [(2, 10, 10, 9.0, "x" * 8000), (2, 11, 11, 2.0, "x" * 80), (2, 12, 12, 1.0, "x" * 80), (3, 20, 20, None, "x" * 40000)]
    rows += [(4, 30, 5, 1.0, "a"), (4, 31, 5, 2.0, "b"), (4, 32, -1, 1.0, "c"), (4, 33, -1, 1.0, None)]
    got = {r.item_id: r.selected for r in pack.pack(spark.createDataFrame(rows, item), calls, F.col("budget_tokens")).collect()}
    assert got == {3: True, 2: True, 1: False, 10: True, 11: False, 12: False, 20: True, 31: True, 32: True, 33: True}


def test_metrics(spark):
    ranked, grades = F.array(*map(F.lit, ["u", "b", "a", "c"])), F.create_map(*map(F.lit, ["a", 3, "b", 2, "c", 1]))
    want = (2 / math.log2(3) + 3 / 2 + 1 / math.log2(5)) / (3 + 2 / math.log2(3) + 1 / 2)
    assert one(spark, metrics.ndcg(ranked, grades), k=1) == pytest.approx(want)
    e = F.array(F.lit("a"), F.lit("z"))
    assert one(spark, metrics.recall_at(ranked, e, 3), k=1) == 0.5 and one(spark, metrics.reciprocal_rank(ranked, e), k=1) == pytest.approx(1 / 3)
    assert one(spark, metrics.clean_at(ranked, e, 2), k=1) == 1.0
    p = {r.percent: r.v for r in metrics.nearest_rank(spark.createDataFrame([("g", i) for i in range(101)], "g string, v int"), "g", "v", [50, 99]).collect()}
    assert p == {50: 50, 99: 99}
    b = spark.createDataFrame([("c", "m", 0.5), ("c", "n", 0.5)], "corpus string, metric string, value double")
    c = spark.createDataFrame([("c", "m", 0.48), ("c", "n", 0.4799)], "corpus string, metric string, value double")
    assert [r.metric for r in metrics.ratchet(b, c).collect()] == ["n"]


def test_label_quality_counts_the_whole_label(spark):
    rnd = random.Random(3)
    label = {i: rnd.choice("aab") for i in range(1, 91)} | {91: "alone", 92: None}
    near = {q: rnd.sample([i for i in label if i != q], 12) for q in (1, 2, 3, 91, 92)}
    for q in near:
        near[q].insert(rnd.randint(0, 4), q)
    want = {}
    for q in (1, 2, 3):
        relevant = {i for i in label if label[i] == label[q] and i != q}
        assert len(relevant) > 20
        hits = [i in relevant for i in near[q] if i != q][:10]
        gain = lambda hs: sum(h / math.log2(k + 2) for k, h in enumerate(hs))
        want[q] = (sum(hits) / len(relevant), next((1 / (k + 1) for k, h in enumerate(hits) if h), 0.0), gain(hits) / gain([1] * min(10, len(relevant))), 1 - sum(hits[:5]) / len(relevant))
    ranked = spark.createDataFrame([(q, i, k + 1) for q, ids in near.items() for k, i in enumerate(ids)], "qid long, chunk_id long, rank int")
    got = metrics.label_quality(ranked, spark.createDataFrame(list(label.items()), "vec_id long, label string"), None).collect()
    assert {r.qid: (r.recall10, r.rr, r.ndcg10, r.clean5) for r in got} == {q: pytest.approx(v) for q, v in want.items()}


def test_chunking(spark):
    df = spark.createDataFrame([(1, "a\nb\n\n}\n \nc"), (2, ""), (3, None)], "id long, content string")
    assert sorted(tuple(r) for r in chunking.line_runs(df).collect()) == [(1, 1, 2, "a\nb"), (1, 6, 6, "c")]
    capped = one(spark, chunking.cap(F.col("c")), c="const x = 1;\n" * 600)
    assert capped.endswith(chunking.MARK) and len(capped) // 4 <= 520
    assert one(spark, chunking.cap(F.col("c")), c="y" * 3000) == "y" * 2048 + "\n" + chunking.MARK
    parts = chunking.split_lines("def f():\n" + "    x = 1  # comment\n" * 300, "def f():")
    assert len(parts) >= 2 and all(p.startswith("def f():\n") for p in parts[1:])


def test_container_skeletons_keep_large_classes(spark, tmp_path):
    names = {2: 3, 3: 120, 4: 900}
    rows = [(i, 1, f"C{i}", f"a.C{i}", "class", f"class C{i}:", i, i, None, None) for i in names]
    rows += [(i * 1000 + k, 1, f"f{k}", f"a.C{i}.f{k}", "method", f"def f{k}(self, value):", k, k, i, 1) for i, n in names.items() for k in range(n)]
    rows += [(5, 1, "D", "a.D", "struct", "struct D" + "<T>" * 900, 1, 1, None, None), (6, 1, "E", "a.E", "trait", "x" * 2040, 1, 1, None, None)]
    rows += [(6000 + k, 1, "f", "a.E.f", "method", "f" * (k % 9), k, k, 6, 0) for k in range(40)]
    rows += [(7, 1, "G", "a.G", "enum", "enum G {", 1, 1, None, None), *((7000 + k, 1, "f", "a.G.f", "method", "f" * (k % 3), k, k, 7, 0) for k in range(700))]
    spark.createDataFrame(rows, SYM).write.parquet(f"{tmp_path}/symbols.parquet")
    want = {}
    for i in range(2, 8):
        text = next(r[5] for r in rows if r[0] == i) + "\n" + "".join(f"    {r[5]}\n" for r in sorted(rows, key=lambda r: (r[6], r[0])) if r[8] == i)
        if len(text) // 4 > 512:
            kept = ""
            for line in text.splitlines():
                if len(kept) // 4 + len(line) // 4 > 508:
                    kept = kept or line[:2048] + "\n"
                    break
                kept += line + "\n"
            text = kept + "… (truncated)\n"
        want[i] = hashlib.md5(text.encode()).hexdigest()
    got = {r.id: r.skeleton_md5 for r in retrieval.container_skeletons(spark, str(tmp_path)).collect()}
    assert got == want


def test_embedding(spark):
    c = spark.createDataFrame([(i, f"text {i}") for i in range(70)] + [(99, None)], "chunk_id long, content string")
    rows = vectors.embed(c, vectors.HashEmbedder).collect()
    assert len(rows) == 70 and all(abs(sum(x * x for x in r.embedding) - 1) < 1e-4 for r in rows)
    done = spark.createDataFrame([(1,), (2,)], "chunk_id long")
    assert vectors.backlog(c, done).count() == 69


PY = '''import os
from utils.text import slugify

LIMIT = 3

# adds
def top_level(a, b):
    return helper(a)


def helper(name):
    return slugify(name)


class Greeter:
    def __init__(self, name):
        self.name = name

    def greet(self, other):
        return other
'''


def test_extract_python():
    ix = extract.extract("pkg/sample.py", "python", PY)
    got = [(s["kind"], s["qualname"], s["start_line"], s["end_line"], s["arity"]) for s in ix.symbols]
    assert got == [("module", "pkg.sample", 1, 20, None), ("function", "pkg.sample.top_level", 7, 8, 2), ("function", "pkg.sample.helper", 11, 12, 1), ("class", "pkg.sample.Greeter", 15, 20, None), ("method", "pkg.sample.Greeter.__init__", 16, 17, 1), ("method", "pkg.sample.Greeter.greet", 19, 20, 1)]
    assert [(e["kind"], e["dst_name"], e["dst_arity"]) for e in ix.edges if e["kind"] == "imports"] == [("imports", "os", None), ("imports", "utils.text", None)]
    assert ("calls", "helper", 1) in [(e["kind"], e["dst_name"], e["dst_arity"]) for e in ix.edges]
    assert [(c["symbol"], c["start_line"], c["end_line"]) for c in ix.chunks if c["symbol"] == 0] == [(0, 1, 2), (0, 4, 4)]


@pytest.mark.parametrize("path,lang,text,want", [
    ("a.go", "go", 'package a\n\nimport "fmt"\n\ntype T struct {\n\tA int\n}\n\nfunc (t *T) Run(a int, b string) int {\n\treturn fmt.Len(a)\n}\n', {("struct", "T"), ("method", "Run")}),
    ("a.rs", "rust", "use a::b;\npub trait T {\n    fn f(&self, x: u32) -> u32 {\n        g(x)\n    }\n}\n", {("trait", "T"), ("method", "f")}),
    ("a.java", "java", "package a;\npublic class C {\n    public int f(int x) {\n        return g(x);\n    }\n}\n", {("class", "C"), ("method", "f")}),
    ("a.rb", "ruby", "class C\n  def f(x)\n    if x\n      g(x)\n    end\n  end\nend\n", {("class", "C"), ("method", "f")}),
    ("a.ts", "typescript", "export class C {\n  f(x: number): number {\n    return g(x);\n  }\n}\nexport const h = (a: number) => a;\n", {("class", "C"), ("method", "f"), ("function", "h")}),
    ("a.kt", "kotlin", "class C {\n    fun f(x: Int): Int {\n        return g(x)\n    }\n}\n", {("class", "C"), ("method", "f")}),
    ("a.lua", "lua", "function M.f(x)\n  return g(x)\nend\n", {("method", "f")}),
    ("a.sh", "bash", "go() {\n  run it\n}\n", {("function", "go")}),
])
def test_extract_others(path, lang, text, want):
    ix = extract.extract(path, lang, text)
    assert {(s["kind"], s["name"]) for s in ix.symbols[1:]} == want
