from __future__ import annotations

import hashlib
from datetime import datetime, timedelta

import pytest

from corpusloom.api import Loom, fence
from corpusloom.operators.index import Manifest, Store
from corpusloom.operators.vectors import HashEmbedder
from corpusloom.streaming import debounce

FILES = "id long, path string, hash binary, content binary"


def files(spark, texts):
    return spark.createDataFrame([(i, p, hashlib.sha256(t.encode()).digest(), t.encode()) for i, (p, t) in texts.items()], FILES)


def content(store, name, *cols):
    return sorted(tuple(r) for r in store.read(name).select(*cols).collect())


def test_incremental_equals_rebuild(spark, tmp_path):
    one = {1: ("a.py", "def f(x):\n    return g(x)\n"), 2: ("b.py", "def g(x):\n    return x\n"), 3: ("c.py", "import a\n\ndef h():\n    return f(1)\n"), 4: ("d.txt", "no")}
    two = {1: one[1], 2: ("b.py", "def gg(x):\n    return x\n"), 5: ("e.py", "def g(x):\n    return 2\n"), 3: one[3]}
    s, fresh = Store(spark, str(tmp_path / "s"), 8), Store(spark, str(tmp_path / "f"), 8)
    assert s.build(files(spark, one)) == 1
    assert s.read("files").count() == 3
    assert s.update(files(spark, two)) == 2
    fresh.build(files(spark, two))
    for name, cols in (("files", ("id", "path")), ("symbols", ("id", "qualname", "kind")), ("edges", ("id", "dst_name", "dst_id", "confidence")), ("chunks", ("id", "content"))):
        assert content(s, name, *cols) == content(fresh, name, *cols)
    s.remove(spark.createDataFrame([("e.py",)], "path string"))
    assert [r for r in content(s, "edges", "dst_name", "dst_id") if r[0] == "g"] == [("g", None)]
    with s.lock() as mine, s.lock() as other:
        assert mine and not other
    assert s.set_model("m", 4) and not s.set_model("m", 4)


def test_only_touched_buckets_are_written(spark, tmp_path):
    texts = {k: (f"m{k}.py", f"def f{k}(x):\n    return f{k + 1}(x)\n") for k in range(1, 30)}
    s = Store(spark, str(tmp_path), 8)
    s.build(files(spark, texts))
    was = s.manifest().at["chunks"]
    assert s.update(files(spark, texts)) == 1  # nothing changed, nothing is written
    texts[3] = ("m3.py", "def other(x):\n    return x\n")
    assert s.update(files(spark, texts)) == 2
    now = s.manifest().at["chunks"]
    assert sum(now[b] != was[b] for b in was) == 1 and set(now) == set(was)
    assert [r for r in content(s, "edges", "dst_name", "dst_id") if r[0] == "f3"] == [("f3", None)]
    assert s.vacuum() == []


def test_update_of_paths_equals_rebuild_and_repeats(spark, tmp_path):
    one = {1: ("a.py", "def f(x):\n    return g(x)\n"), 2: ("b.py", "def g(x):\n    return x\n"), 3: ("c.py", "def h():\n    return f(1)\n")}
    two = {1: ("a.py", "def f(x, y):\n    return g(x)\n"), 3: one[3], 4: ("d.py", "def g(x):\n    return 2\n")}
    s, fresh = Store(spark, str(tmp_path / "s"), 8), Store(spark, str(tmp_path / "f"), 8)
    s.build(files(spark, one))
    paths = spark.createDataFrame([("a.py",), ("b.py",), ("d.py",), ("a.py",)], "path string")
    n = s.update_paths(paths, files(spark, two))
    assert s.update_paths(paths, files(spark, two)) == n
    fresh.build(files(spark, two))
    for name, cols in (("files", ("id", "path")), ("symbols", ("id", "qualname", "kind")), ("edges", ("id", "dst_name", "dst_id", "confidence")), ("chunks", ("id", "content"))):
        assert content(s, name, *cols) == content(fresh, name, *cols)


def test_stream_of_changes_reaches_the_index(spark, tmp_path):
    one = {1: ("a.py", "def f(x):\n    return x\n")}
    two = {1: ("a.py", "def g(x):\n    return x\n"), 2: ("b.py", "def h():\n    return g(1)\n")}
    s = Store(spark, str(tmp_path / "s"), 8)
    s.build(files(spark, one))
    t0 = datetime(2024, 1, 1)
    src = tmp_path / "in"
    spark.createDataFrame([("a.py", t0), ("b.py", t0), ("z", t0 + timedelta(minutes=5))], "path string, ts timestamp").coalesce(1).write.parquet(str(src))
    events = spark.readStream.schema("path string, ts timestamp").parquet(str(src))
    q = debounce.apply_stream(debounce.debounce_stream(events), lambda df, n: s.update_paths(df, files(spark, two)), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert [r[0] for r in content(s, "symbols", "qualname")] == ["a", "a.g", "b", "b.h"]


def test_vectors(spark, tmp_path):
    texts = {1: ("a.py", "def f(x):\n    return x\n"), 2: ("b.py", "def g(x):\n    return f(x)\n")}
    s = Store(spark, str(tmp_path), 8)
    s.build(files(spark, texts))
    assert s.backlog().count() == 2 and s.read("vectors").count() == 0
    with pytest.raises(ValueError):
        s.put_vectors(spark.createDataFrame([(1, [1.0])], "chunk_id long, embedding array<float>"))
    assert s.embed(HashEmbedder) == 2 and s.embed(HashEmbedder) == 0
    n = s.manifest().generation
    texts[2] = ("b.py", "def g(x):\n    return 3\n")
    s.update(files(spark, texts))
    assert s.read("vectors").count() == 1 and s.backlog().count() == 1  # the vector of the unchanged file stays
    assert s.embed(HashEmbedder) == 1
    k = s.read("chunks").first()["id"]
    s.put_vectors(spark.createDataFrame([(k, [0.5] * 256), (k, [0.5] * 256)], "chunk_id long, embedding array<float>"))
    assert s.read("vectors").where(f"chunk_id = {k}").first()["embedding"][0] == 0.5 and s.read("vectors").count() == 2
    assert s.set_model("other", 3) and s.read("vectors").count() == 0 and s.manifest().generation > n
    with pytest.raises(ValueError):  # a length that is not the model's
        s.put_vectors(spark.createDataFrame([(k, [1.0, 2.0])], "chunk_id long, embedding array<float>"))


def test_one_writer(spark, tmp_path):
    s = Store(spark, str(tmp_path), 8)
    with s.lock() as mine:
        assert mine
        with pytest.raises(RuntimeError):
            s.build(files(spark, {1: ("a.py", "x = 1\n")}))
    assert s.build(files(spark, {1: ("a.py", "x = 1\n")})) == 1
    s.folder.create("writer.lock", "0.0")  # a writer that died long ago
    assert s.build(files(spark, {1: ("a.py", "x = 1\n")})) == 2
    assert s.vacuum() == ["gen-1"]


def test_search_reads_stored_vectors(spark, tmp_path):
    class Words:
        """An embedder that knows two words."""

        id, dim, distance_floor = "words", 2, 0.5

        def embed(self, texts):
            import numpy as np

            return np.array([[float("split" in t), float("parse" in t)] for t in texts], dtype=np.float32)

    texts = {1: ("app/a.py", "def parse_line(x):\n    return split_words(x)\n"), 2: ("app/b.py", "def split_words(x):\n    return x.split()\n"), 3: ("app/c.py", "def other(x):\n    return x\n")}
    s = Store(spark, str(tmp_path), 8)
    s.build(files(spark, texts))
    loom = Loom(spark, str(tmp_path), Words())
    assert loom.search("zsplitz") == "No match.\n"  # no vectors yet
    s.embed(Words)
    assert "app.b.split_words" in loom.search("zsplitz")
    assert Loom(spark, str(tmp_path), HashEmbedder()).search("zsplitz") == "No match.\n"  # another model


def test_explore_takes_neighbours_in_order(spark, tmp_path):
    calls = "".join(f"    helper_{k}(x)\n" for k in range(30))
    texts = {1: ("app/a.py", f"def parse_line(x):\n{calls}"), 2: ("app/b.py", "".join(f"def helper_{k}(x):\n    return {k}\n\n" for k in range(30)))}
    Store(spark, str(tmp_path), 8).build(files(spark, texts))
    loom = Loom(spark, str(tmp_path))
    one = loom.explore("parse_line")
    assert one == loom.explore("parse_line")
    shown = [k for k in range(30) if f"def helper_{k}(" in one]
    assert shown == list(range(10))  # ten callees, the first by id


def test_operations(spark, tmp_path):
    texts = {1: ("app/a.py", "def parse_line(x):\n    return split_words(x)\n"), 2: ("app/b.py", "def split_words(x):\n    return x.split()\n"), 3: ("tests/test_a.py", "def test_parse():\n    assert parse_line('a')\n")}
    Store(spark, str(tmp_path), 8).build(files(spark, texts))
    loom = Loom(spark, str(tmp_path))
    assert "app.a.parse_line" in loom.search("parse_line").splitlines()[0]
    assert loom.search("zzz") == "No match.\n"
    assert "app.a.parse_line" in loom.callers("split_words") and "app.b.split_words" in loom.callees("app.a.parse_line")
    assert "affected: 2 symbols in 2 files" in loom.impact("split_words")
    sliced = Loom(spark, str(tmp_path), files=files(spark, texts))
    assert sliced.open("app/a.py:2-2") == fence("    return split_words(x)\n") and "not found" in sliced.open("../app/a.py:1-2")
    assert "return x.split()" in loom.open("split_words") and "was not found" in loom.open("nope")
    assert "split_words" in loom.explore("where is parse_line")
    assert "files: 3" in loom.status()


def test_manifest():
    m = Manifest(freshness="degraded", since=0.0)
    assert m.state(300) == "degraded" and m.state(301) == "stale" and Manifest(freshness="odd", since=0.0).state(1) == "degraded"
    assert fence("a ``` b").startswith("````\n")
    assert HashEmbedder().embed(["a", "a"]).tolist()[0] == HashEmbedder().embed(["a"]).tolist()[0]


def test_bursts(spark):
    t0 = datetime(2024, 1, 1)
    at = lambda ms: t0 + timedelta(milliseconds=ms)
    rows = [(1, "a", at(0)), (2, "b", at(50)), (3, "a", at(100)), (4, "c", at(150)), (5, "a", at(600)), (6, None, at(1)), (7, "a", None)]
    got = sorted((r.path, r.events) for r in debounce.bursts(spark.createDataFrame(rows, "event_id long, path string, ts timestamp"), 0.5).collect())
    assert got == [("a", 1), ("a", 2), ("b", 1), ("c", 1)]


def test_stream(spark, tmp_path):
    src, t0 = tmp_path / "in", datetime(2024, 1, 1)
    rows = [("a", t0), ("a", t0 + timedelta(milliseconds=200)), ("b", t0), ("z", t0 + timedelta(minutes=5))]
    spark.createDataFrame(rows, "path string, ts timestamp").coalesce(1).write.parquet(str(src))
    events = spark.readStream.schema("path string, ts timestamp").parquet(str(src))
    seen = []
    q = debounce.apply_stream(debounce.debounce_stream(events), lambda df, n: seen.extend(r.path for r in df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == ["a", "b"]
