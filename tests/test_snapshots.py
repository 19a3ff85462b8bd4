from __future__ import annotations

from datetime import datetime as D

from corpusloom.operators import snapshots as S

SCHEMA = "snapshot_no int, delivered_at timestamp, path string, hash binary, indexed_at timestamp, at int, change_type string"


def rows(*r):
    return [(n, D(2024, 1, 1), p, h, t, 1, "x") for n, p, h, t in r]


def test_changes(spark):
    a, b = D(2024, 1, 2), D(2024, 1, 3)
    df = spark.createDataFrame(
        rows(
            (1, "r/a", b"1", a), (1, "./r//a", b"0", None), (1, "r/b", None, a), (1, "r/gone", b"1", a), (1, "r/null", b"1", a),
            (4, " r\\a ", b"1", a), (4, "r/b", b"2", a), (4, "r/b", b"2", a), (4, "r/new", b"1", a), (4, "r/null", None, a), (4, "r/null", b"1", None),
            (9, "r/a", b"9", a), (9, "r/a", b"8", b), (9, "r/gone", b"1", a), (9, "r/b", b"2", b), (9, "", b"1", a), (9, None, b"1", a), (None, "r/z", b"1", a),
        ),
        SCHEMA,
    )
    got = sorted(map(tuple, S.snapshot_changes(df).collect()))
    assert got == sorted([
        (4, "r/b", "changed"), (4, "r/gone", "removed"), (4, "r/new", "added"), (4, "r/null", "changed"),
        (9, "r/a", "changed"), (9, "r/gone", "added"), (9, "r/new", "removed"), (9, "r/null", "removed"),
    ])


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.snapshot_changes(empty).count() == 0
    assert S.snapshot_changes(spark.createDataFrame(rows((1, "a", b"1", None)), SCHEMA)).count() == 0
