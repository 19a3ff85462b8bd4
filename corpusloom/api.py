"""The seven operations over an index."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import graph, pack, search, vectors
from corpusloom.operators.index import Store
from corpusloom.sources.files import read_slice

# Fixed values of the reference: (entries, entry symbols, neighbours, default budget) by size class
TIERS = {"tiny": (8, 6, 12, 4000), "small": (8, 6, 16, 4000), "medium": (12, 8, 24, 8000)}
NEIGHBOUR_SHARE, MOST_LABELS = 0.5, 15


def fence(content: str) -> str:
    """CONTENT in a code fence longer than any run of backticks in it."""
    marks = "`" * max(3, 1 + max((len(m) for m in re.findall(r"`+", content)), default=0))
    return f"{marks}\n{content.rstrip()}\n{marks}"


class Loom:
    """Questions to the index below ROOT. EMBEDDER, if any, has to match the model of the index.

    FILES (``path, content``), if given, are what lines of a path are opened from; else its chunks are.
    """

    def __init__(self, spark: SparkSession, root: str, embedder: vectors.Embedder | None = None, files: DataFrame | None = None):
        self.spark, self.store, self.embedder, self.files = spark, Store(spark, root), embedder, files

    def _chunks(self) -> DataFrame:
        f = self.store.read("files").select(F.col("id").alias("file_id"), "path", "lang")
        k = self.store.read("symbols").select(F.col("id").alias("symbol_id"), "kind", "qualname")
        c = self.store.read("chunks").withColumnRenamed("id", "chunk_id")
        return c.join(f, "file_id").join(k, "symbol_id", "left").withColumn("token_count", T.estimate_tokens(F.col("content")))

    def _hits(self, query: str, limit: int) -> DataFrame:
        chunks = self._chunks()
        vec = None
        m = self.store.manifest()
        v = chunks.select("chunk_id").where(F.lit(False)).withColumn("embedding", F.array().cast("array<float>"))
        if self.embedder and (m.model_id, m.model_dim) == (self.embedder.id, self.embedder.dim):
            vec = self.embedder.embed([query])[0].tolist()
            v = self.store.read("vectors")  # chunks that have none yet are found by words alone
        q = self.spark.createDataFrame([(0, query, vec)], "qid long, query string, embedding array<float>")
        floor = self.embedder.distance_floor if self.embedder else None
        return search.hybrid(chunks, v, q, limit, floor).join(chunks, "chunk_id")

    def search(self, query: str, limit: int = 10, budget_tokens: int = 4000) -> str:
        """Hits as lines, best first, as far as the budget goes; the first is always shown."""
        rows = self._hits(query, min(max(limit, 1), 100)).orderBy("rank").select("rank", "qualname", "path", "start_line", "end_line", "score", T.excerpt(F.col("content")).alias("x"), "outcome").collect()
        out, used = [], 0
        for r in rows:
            s = f"{r['rank']}. {r['qualname'] or '(preamble)'}  {r['path']}:{r['start_line']}-{r['end_line']}  score {r['score']:.3f}\n   {r['x']}\n"
            if out and used + len(s) // 4 > budget_tokens:
                break
            out.append(s)
            used += len(s) // 4
        weak = "No strong match; nearest by meaning:\n" if rows and rows[0]["outcome"] != "strong" else ""
        return weak + "".join(out) if out else "No match.\n"

    def open(self, target: str, budget_tokens: int = 6000) -> str:
        """The lines PATH:FIRST-LAST, or the source of a symbol, cut at the budget but never empty."""
        m = re.fullmatch(r"(.*[/.].*):(\d+)-(\d+)", target)
        chunks = self._chunks()
        if m and self.files is not None:
            rows = read_slice(self.files, m[1], int(m[2]), int(m[3])).select(F.col("line").alias("start_line"), F.concat("text", F.lit("\n")).alias("content"), F.lit(m[1]).alias("path"))
        elif m:
            rows = chunks.where((F.col("path") == m[1]) & (F.col("end_line") >= int(m[2])) & (F.col("start_line") <= int(m[3])))
        else:
            found = self._one(target)
            if isinstance(found, str):
                return found
            rows = chunks.where(F.col("symbol_id") == found)
        text, used = [], 0
        for r in rows.orderBy("start_line").select("path", "start_line", "content").toLocalIterator():
            for line in r["content"].splitlines(keepends=True):
                if text and used + len(line) // 4 > budget_tokens:
                    return fence("".join(text)) + "\n(truncated)\n"
                text.append(line)
                used += len(line) // 4
        return fence("".join(text)) if text else f"{target} was not found.\n"

    def _one(self, target: str) -> int | str:
        t = self.spark.createDataFrame([(target,)], "target string")
        rows = graph.lookup(self.store.read("symbols"), t).orderBy("qualname").collect()
        if rows and rows[0]["outcome"] == "exact":
            return rows[0]["symbol_id"]
        names = "".join(f"  {r['qualname']}\n" for r in rows if r["qualname"])
        head = "is ambiguous:" if rows and rows[0]["outcome"] == "candidate" else "was not found."
        return f"{target} {head}\n{names}"

    def _tree(self, target: str, depth: int, what: str, budget: int) -> str:
        start = self._one(target)
        if isinstance(start, str):
            return start
        s = self.store.read("symbols")
        starts = self.spark.createDataFrame([(start,)], "start_id long")
        name = s.select(F.col("id").alias("k"), "qualname")
        if what == "callees":
            rows = graph.collapse(graph.callees(starts, self.store.read("edges"), depth)).join(name, F.col("dst_id") == F.col("k"), "left").select(
                "depth", F.col("dst_id").isNull().alias("open"), F.coalesce("qualname", "label").alias("label"), "times", "ord"
            )
        else:
            cap = graph.IMPACT_CAP if what == "impact" else graph.CALLERS_CAP
            rows = graph.callers(starts, self.store.read("edges"), s, depth, cap).join(name, F.col("caller_id") == F.col("k")).select(
                "depth", (~F.col("resolved")).alias("open"), F.col("qualname").alias("label"), F.lit(1).alias("times"), "ord", "caller_id"
            )
        out, used = [], 0
        got = rows.orderBy("depth", "open", "ord").collect()  # capped above
        full = what == "impact" and len(got) >= graph.IMPACT_CAP or what != "impact" and len(got) >= graph.CALLERS_CAP
        for r in got:
            line = f"{'  ' * r['depth']}{r['label']}{' ×' + str(r['times']) if r['times'] > 1 else ''}{' (unresolved)' if r['open'] else ''}\n"
            if out and used + len(line) // 4 > budget:
                break
            out.append(line)
            used += len(line) // 4
        foot = self._foot(starts, rows.select("caller_id")) if what == "impact" else ""
        return f"{what} of {target}: {sum(r['times'] for r in got)}\n" + "".join(out) + ("(more were left out)\n" if full or len(out) < len(got) else "") + foot

    def _foot(self, starts: DataFrame, callers: DataFrame) -> str:
        """How many symbols and files calls reach, and which modules import the file of the start."""
        s = self.store.read("symbols")
        n = callers.join(s.select(F.col("id").alias("caller_id"), "file_id"), "caller_id").agg(F.count_distinct("caller_id").alias("s"), F.count_distinct("file_id").alias("f")).first()
        into = graph.imports(starts, self.store.read("edges"), s).where(F.col("direction") == "in").select(F.col("other_id").alias("k")).distinct()
        names = [r["qualname"] for r in into.join(s.select(F.col("id").alias("k"), "qualname"), "k").orderBy("qualname").limit(MOST_LABELS + 1).collect()]
        more = " and more" if len(names) > MOST_LABELS else ""
        imported = f"imported by: {', '.join(names[:MOST_LABELS])}{more}\n" if names else ""
        return f"affected: {n['s']} symbols in {n['f']} files\n{imported}"

    def callers(self, symbol: str, depth: int = 1, budget_tokens: int = 4000) -> str:
        return self._tree(symbol, min(max(depth, 1), 3), "callers", budget_tokens)

    def callees(self, symbol: str, depth: int = 1, budget_tokens: int = 4000) -> str:
        return self._tree(symbol, min(max(depth, 1), 3), "callees", budget_tokens)

    def impact(self, symbol: str, max_depth: int = 5, budget_tokens: int = 4000) -> str:
        return self._tree(symbol, min(max(max_depth, 1), 5), "impact", budget_tokens)

    def explore(self, question: str, budget_tokens: int | None = None) -> str:
        """Entry hits and the neighbours of their symbols, packed into the budget."""
        chunks = self._chunks()
        n = self.store.read("chunks").count()
        tier = "tiny" if n < 200 else "small" if n < 2000 else "medium"
        entries, symbols, neighbours, default = TIERS[tier]
        budget = min(budget_tokens or default, 20000)
        hits = self._hits(question, entries).select("chunk_id", "symbol_id", "score", "outcome").collect()
        score = {r["chunk_id"]: r["score"] for r in hits}
        near: dict[int, float] = {}
        if hits and hits[0]["outcome"] == "strong":
            seeds = list(dict.fromkeys(r["symbol_id"] for r in sorted(hits, key=lambda r: -r["score"]) if r["symbol_id"] is not None))[:symbols]
            if seeds:
                starts = self.spark.createDataFrame([(s,) for s in seeds], "start_id long")
                e, s = self.store.read("edges"), self.store.read("symbols")
                best = {r["symbol_id"]: r["score"] for r in sorted(hits, key=lambda r: r["score"])}
                found = (
                    graph.callers(starts, e, s, 1, 10).select("start_id", F.col("caller_id").alias("other"), F.lit(0).alias("way"), F.col("ord").cast("long"))
                    .unionByName(graph.callees(starts, e, 1, 10).select("start_id", F.col("dst_id").alias("other"), F.lit(1).alias("way"), F.col("ord").cast("long")))
                    .unionByName(graph.imports(starts, e, s).select("start_id", F.col("other_id").alias("other"), F.when(F.col("direction") == "out", 2).otherwise(3).alias("way"), F.col("edge_id").alias("ord")))
                )
                rank = self.spark.createDataFrame([(x, k) for k, x in enumerate(seeds)], "start_id long, seed int")
                near_first = Window.partitionBy("start_id").orderBy("way", "ord")
                # each seed brings at most as many neighbours as are wanted in all
                ordered = found.where(F.col("other").isNotNull() & (F.col("other") != -1)).join(rank, "start_id").withColumn("n", F.row_number().over(near_first)).where(F.col("n") <= neighbours)
                for r in ordered.orderBy("seed", "n").collect():
                    if len(near) < neighbours or r["other"] in near:
                        near[r["other"]] = max(near.get(r["other"], 0.0), NEIGHBOUR_SHARE * best[r["start_id"]])
        s_map = self.spark.createDataFrame([(0, 0.0), *near.items()], "symbol_id long, near double")
        c_map = self.spark.createDataFrame([(-1, 0.0), *score.items()], "chunk_id long, hit double")
        items = chunks.join(c_map, "chunk_id", "left").join(s_map, "symbol_id", "left").where(F.coalesce("hit", "near").isNotNull()).select(
            F.lit(0).cast("long").alias("request_id"), F.col("chunk_id").alias("item_id"), "chunk_id", "content", "path", "start_line", "qualname",
            F.greatest(F.coalesce("hit", F.lit(0.0)), F.coalesce("near", F.lit(0.0))).alias("score"),
        )
        calls = self.spark.createDataFrame([(0, budget)], "request_id long, budget_tokens int")
        chosen = pack.pack(items, calls, F.col("budget_tokens")).select("item_id", "selected")
        rows = items.join(chosen, "item_id").orderBy("path", "start_line").collect()
        body = "".join(f"{r['path']}:{r['start_line']} {r['qualname'] or ''}\n{fence(r['content'])}\n" for r in rows if r["selected"])
        left = list(dict.fromkeys(r["qualname"] for r in sorted(rows, key=lambda r: -r["score"]) if not r["selected"] and r["qualname"]))[:MOST_LABELS]
        return body + (f"Related: {', '.join(left)}\n" if left else "")

    def status(self) -> str:
        m = self.store.manifest()
        counts = "".join(f"{n}: {self.store.read(n).count()}\n" for n in ("files", "symbols", "edges", "chunks"))
        return f"generation {m.generation}, {m.state(time.time())}\n{counts}"
