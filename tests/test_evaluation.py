from __future__ import annotations

import json

import pytest

from corpusloom.operators import evaluation as E
from corpusloom.sources import extract as X


def test_bundle_quality(spark):
    bundles = spark.createDataFrame([(1, "aa bb"), (2, "cc"), (3, "x")], "request_id long, bundle string")
    chunks = spark.createDataFrame([(10, 5, 2, "zz"), (10, 1, 3, "aa"), (11, None, 1, "bb"), (12, 1, 4, None), (13, 1, 5, "cc")], "symbol_id long, start_line int, chunk_id long, content string")
    firsts = E.first_chunks(chunks)
    assert {r.symbol_id: r.content for r in firsts.collect()} == {10: "aa", 11: "bb", 13: "cc"}
    pairs = lambda *rows: spark.createDataFrame(list(rows), "request_id long, symbol_id long")
    got = {r.request_id: (r.answer_in_bundle, r.bundle_clean) for r in E.bundle_quality(bundles, firsts, pairs((1, 10), (1, 11), (1, 11), (2, 12)), pairs((1, 13), (1, 10), (2, 12), (2, 13))).collect()}
    assert got == {1: (True, 0.5), 2: (False, 0.5), 3: (False, 1.0)}
    assert E.bundle_quality(bundles.limit(0), firsts, pairs((1, 10)), pairs((1, 10))).count() == 0


def test_names_and_budgets(spark):
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "b"), (1, 21, "c")], "qid long, rank int, qualname string")
    assert [tuple(r) for r in E.ranked_names(hits).collect()] == [(1, "a", 1), (1, "b", 2)]
    measured = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 9.0)], "name string, value double")
    budgets = spark.createDataFrame([("a", 1.5), ("b", 1.0), ("d", 0.0)], "name string, budget double")
    assert [tuple(r) for r in E.over_budget(measured, budgets).collect()] == [("a", 2.0, 1.5)]


def test_synthetic_corpus_and_sweep(spark):
    files = {r.id: (r.path, r.content) for r in E.synthetic_files(spark, 7).collect()}
    assert files[0] == ("src/file_0.py", "def work_0(x):\n    return x + 1\n") and files[4][0] == "src/file_4.ts" and "work_4(" in files[5][1]
    for path, text in files.values():
        lang = {"py": "python", "ts": "typescript", "rs": "rust"}[path[-2:]]
        ix = X.extract(path, lang, text)
        assert [s["kind"] for s in ix.symbols] == ["module", "function"] and len([e for e in ix.edges if e["kind"] == "calls"]) == (path != "src/file_0.py")
    assert [(r["files"], r["result"]) for r in E.sweep(spark, lambda df: df.count(), (2, 5))] == [(2, 2), (5, 5)]


def test_inputs_and_sinks(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    p = tmp_path / "q.yaml"
    p.write_text(yaml.safe_dump({"queries": [{"query": "a", "expected": ["x"]}, {"query": "b"}]}))
    got = [tuple(r) for r in E.read_yaml(spark, str(p), "query string, expected array<string>", "queries").collect()]
    assert got == [("a", ["x"]), ("b", None)]
    p.write_text("")
    assert E.read_yaml(spark, str(p), "query string").count() == 0
    out = str(tmp_path / "last.json")
    E.write_json(out, {"b": 1})
    E.write_json(out, {"b": 2})
    assert json.load(open(out)) == {"b": 2}
    E.append_json(str(tmp_path / "h.jsonl"), {"n": 1})
    E.append_json(str(tmp_path / "h.jsonl"), {"n": 2})
    assert [json.loads(x)["n"] for x in open(tmp_path / "h.jsonl")] == [1, 2]
    E.write_markdown(str(tmp_path / "b.md"), "Runs", {"all": (["a", "b"], [(1, None), ("x|y", "p\nq")])})
    assert (tmp_path / "b.md").read_text() == "# Runs\n\n## all\n\n| a | b |\n| --- | --- |\n| 1 |  |\n| x\\|y | p q |\n"
