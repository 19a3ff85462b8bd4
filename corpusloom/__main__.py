"""Command line: ``python -m corpusloom COMMAND --index FOLDER ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.api import Loom
from corpusloom.operators import vectors
from corpusloom.operators.index import Store
from corpusloom.sources.files import read_tree

ASK = {"search": "limit", "explore": None, "open": None, "callers": "depth", "callees": "depth", "impact": "depth"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("corpusloom")
    p.add_argument("--index", required=True, help="folder of the index, shared by all executors")
    p.add_argument("--embedder", default="none", choices=["none", "mock"])
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "update"):
        sub.add_parser(name).add_argument("tree", help="folder of source files")
    sub.add_parser("status")
    for name, number in ASK.items():
        c = sub.add_parser(name)
        c.add_argument("target")
        c.add_argument("--budget", type=int)
        if number:
            c.add_argument(f"--{number}", type=int)
    return p


def tree_files(spark: SparkSession, tree: str) -> DataFrame:
    """The tracked files of TREE with ids that depend on their path alone, of 43 bits, as ids of symbols begin with them."""
    return read_tree(spark, tree, tracked=True).withColumn("id", F.shiftrightunsigned(F.xxhash64("path"), 21))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("corpusloom").getOrCreate()
    factory = vectors.embedder(a.embedder)
    store = Store(spark, a.index)
    if a.command in ("index", "update"):
        files = tree_files(spark, a.tree)
        n = store.build(files) if a.command == "index" else store.update(files)
        if factory:
            store.embed(factory)
        print(f"generation {n}, {store.read('files').count()} files")
        return 0
    loom = Loom(spark, a.index, factory() if factory else None)
    if a.command == "status":
        print(loom.status(), end="")
        return 0
    more = {"budget_tokens": a.budget} if a.budget is not None else {}
    number = ASK[a.command]
    if number and getattr(a, number) is not None:
        more["max_depth" if a.command == "impact" else number] = getattr(a, number)
    print(getattr(loom, a.command)(a.target, **more), end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
