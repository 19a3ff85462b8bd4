from __future__ import annotations

import random

import pytest

from corpusloom.operators import hierarchy as H

SCHEMA = "id long, parent_id long, name string, up string, low string"


def brute(parents: dict, i: int):
    seen, x = [], i
    while x in parents and x not in seen:
        seen.append(x)
        if parents[x] is None or parents[x] not in parents:
            return "root", x, seen
        x = parents[x]
    return "cycle", min(seen[seen.index(x) :]), seen


@pytest.mark.parametrize("one_task,block", [(10**6, 10**6), (10**6, 12), (20, 30), (4, 12)])
def test_against_brute_force(spark, monkeypatch, one_task, block):
    monkeypatch.setattr(H, "NEIGHBOURS", 5)
    rnd = random.Random(one_task)
    rows = [(i, rnd.choice([None, 999, *(rnd.randint(max(1, i - 6), min(120, i + 3)) for _ in range(9))]), f"n{i}") for i in range(1, 121)]
    parents = {i: p for i, p, _ in rows}
    df = spark.createDataFrame([(*r, "x", "y") for r in rows + rows[:9]], SCHEMA)
    ends = {i: brute(parents, i) for i in parents}
    got = {r[0]: r[1] for r in H.cycle_members(df, one_task, block).collect()}
    assert got == {i: e[1] for i, e in ends.items() if e[0] == "cycle"}
    tree = {r.symbol_id: r for r in H.hierarchy(df, one_task, block).collect()}
    assert set(tree) == {i for i, e in ends.items() if e[0] == "root"}
    for i, r in tree.items():
        chain = ends[i][2]
        assert (r.root_id, r.depth) == (ends[i][1], len(chain) - 1)
        assert r.names == [f"n{x}" for x in reversed(chain)]
        assert r.ancestors == chain[:0:-1]


def test_defined_cases(spark):
    rows = [(1, None, None, "", ""), (2, 1, "b", "", ""), (3, 3, "self", "", ""), (4, 3, "below", "", ""), (None, 1, "no id", "", ""), (5, 77, "dangling", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, H.cycle_members(df).collect())) == [(3, 3), (4, 3)]
    assert {r.symbol_id: r.names for r in H.hierarchy(df).collect()} == {1: [""], 2: ["", "b"], 5: ["dangling"]}
    assert [tuple(r) for r in H.descendants(df).collect()] == [(1, 2, 1)]
    empty = spark.createDataFrame([], SCHEMA)
    assert H.cycle_members(empty).count() == 0 and H.hierarchy(empty).count() == 0
