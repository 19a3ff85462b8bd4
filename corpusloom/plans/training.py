"""Queries over the general training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import hierarchy, snapshots
from corpusloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "file_snapshots"))


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.change_summary(table(spark, d, "file_snapshots"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.cycle_members(table(spark, d, "symbols"))


def p7_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy.hierarchy(table(spark, d, "symbols"))
    return h.select("symbol_id", "root_id", "depth", F.array_join("names", "/").alias("path"))


def p7_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(table(spark, d, "symbols"))


_CHANGES = r"""
    WITH named AS (
        SELECT snapshot_no, hash, indexed_at,
            array_to_string(list_filter(string_split(replace(trim(path, E' \t\r\n'), '\', '/'), '/'), lambda s: s <> '' AND s <> '.'), '/') AS path
        FROM file_snapshots WHERE snapshot_no IS NOT NULL
    ), states AS (
        SELECT snapshot_no, path, hash FROM (
            SELECT *, row_number() OVER (PARTITION BY snapshot_no, path ORDER BY indexed_at DESC NULLS LAST, hash DESC NULLS LAST) AS r
            FROM named WHERE path <> '') WHERE r = 1
    ), numbers AS (
        SELECT snapshot_no, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS next_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS prev_no
        FROM (SELECT DISTINCT snapshot_no FROM file_snapshots WHERE snapshot_no IS NOT NULL)
    ), changes AS (
        SELECT s.snapshot_no, s.path, CASE WHEN p.path IS NULL THEN 'added' ELSE 'changed' END AS change_type
        FROM states s JOIN numbers n USING (snapshot_no)
        LEFT JOIN states p ON p.snapshot_no = n.prev_no AND p.path = s.path
        WHERE n.prev_no IS NOT NULL AND (p.path IS NULL OR p.hash IS DISTINCT FROM s.hash)
        UNION ALL
        SELECT n.next_no, s.path, 'removed'
        FROM states s JOIN numbers n USING (snapshot_no)
        LEFT JOIN states q ON q.snapshot_no = n.next_no AND q.path = s.path
        WHERE n.next_no IS NOT NULL AND q.path IS NULL
    )"""

_TREE = """
    WITH RECURSIVE links AS (SELECT id, max(parent_id) AS parent_id, max(name) AS name FROM symbols GROUP BY id),
    tree AS (
        SELECT id AS symbol_id, id AS root_id, 0 AS depth, name AS path, [id] AS chain FROM links l
        WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM links)
        UNION ALL
        SELECT l.id, t.root_id, t.depth + 1, t.path || '/' || l.name, list_append(t.chain, l.id) FROM tree t JOIN links l ON l.parent_id = t.symbol_id
    )"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p6_found, p6_summary, p7_found, p7_hierarchy, p7_descendants)}


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": _CHANGES + " SELECT snapshot_no, path, change_type FROM changes",
        "p6_summary": _CHANGES + " SELECT snapshot_no, change_type, count(*) AS files FROM changes GROUP BY 1, 2",
        "p7_found": """
            WITH RECURSIVE links AS (SELECT id, max(parent_id) AS parent_id FROM symbols GROUP BY id),
            bad AS (
                SELECT id, parent_id FROM links WHERE id NOT IN (
                    WITH RECURSIVE good AS (
                        SELECT id FROM links WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM links)
                        UNION ALL
                        SELECT l.id FROM good g JOIN links l ON l.parent_id = g.id)
                    SELECT id FROM good)
            ), up AS (
                SELECT id, parent_id AS above FROM bad
                UNION
                SELECT u.id, b.parent_id FROM up u JOIN bad b ON b.id = u.above
            )
            SELECT u.id AS symbol_id, min(u.above) AS cycle_id
            FROM up u JOIN up r ON r.id = u.above AND r.above = u.above GROUP BY u.id""",
        "p7_hierarchy": _TREE + " SELECT symbol_id, root_id, depth, path FROM tree",
        "p7_descendants": _TREE
        + """ SELECT chain[k] AS symbol_id, symbol_id AS below_id, CAST(depth - k + 1 AS INTEGER) AS distance
            FROM tree, unnest(range(1, len(chain))) AS u(k)""",
    }
