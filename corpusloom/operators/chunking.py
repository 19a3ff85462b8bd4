"""Chunks of files and texts: runs of lines, owners of lines, skeletons, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# Fixed values of the reference, in tokens and characters
LIMIT, KEEP, HARD_CUT, MARK = 512, 508, 2048, "… (truncated)\n"
CONTAINERS = ("class", "struct", "enum", "trait", "interface")


def line_runs(texts: DataFrame) -> DataFrame:
    """Runs of neighbouring lines that are not blank: ``id, start_line, end_line, content``.

    Runs without any letter or digit are left out. Texts are split in place and grouped by their own lines only.
    """
    lines = F.split("content", "\n")
    blank = lambda s: F.trim(F.translate(s, "\r\t\f", "   ")) == ""
    # a run is cut where a line is blank: fold the lines of one text into its runs without a shuffle
    zero = F.struct(
        F.array().cast("array<struct<s:int,e:int,t:string>>").alias("runs"), F.lit(0).alias("at"), F.lit(0).alias("s"),
        F.lit("").alias("t"),
    )
    step = lambda a, x: F.struct(
        F.when(blank(x) & (a["s"] > 0), F.concat(a["runs"], F.array(F.struct(a["s"].alias("s"), a["at"].alias("e"), a["t"].alias("t"))))).otherwise(a["runs"]).alias("runs"),
        (a["at"] + 1).alias("at"),
        F.when(blank(x), 0).when(a["s"] > 0, a["s"]).otherwise(a["at"] + 1).alias("s"),
        F.when(blank(x), "").when(a["s"] > 0, F.concat(a["t"], F.lit("\n"), x)).otherwise(x).alias("t"),
    )
    done = lambda a: F.when(a["s"] > 0, F.concat(a["runs"], F.array(F.struct(a["s"].alias("s"), a["at"].alias("e"), a["t"].alias("t"))))).otherwise(a["runs"])
    runs = texts.where(F.col("content").isNotNull()).select("id", F.explode(F.aggregate(lines, zero, step, done)).alias("r"))
    return runs.where(F.col("r.t").rlike(r"[\p{L}\p{N}]")).select(
        "id", F.col("r.s").alias("start_line"), F.col("r.e").alias("end_line"), F.col("r.t").alias("content")
    )


def line_owners(symbols: DataFrame) -> DataFrame:
    """The innermost symbol, modules aside, of each line: ``file_id, line, owner_id``.

    Of equally long symbols the one that starts later owns the line, then the one of greater id.
    """
    s = symbols.groupBy("id").agg(F.max(F.struct("file_id", "kind", "start_line", "end_line")).alias("s")).select("id", "s.*")
    inner = s.where((F.col("kind") != "module") & (F.col("end_line") >= F.col("start_line")))
    lines = inner.select("file_id", "id", "start_line", (F.col("end_line") - F.col("start_line")).alias("size"), F.explode(F.sequence("start_line", "end_line")).alias("line"))
    first = F.min(F.struct("size", (-F.col("start_line")).alias("a"), (-F.col("id")).alias("b")))
    return lines.groupBy("file_id", "line").agg(first.alias("m")).select("file_id", "line", (-F.col("m.b")).alias("owner_id"))


def enclosing(symbols: DataFrame) -> DataFrame:
    """The innermost symbol around each symbol's first line, not starting on it: ``id, parent_id``.

    Lines carry the candidates, so a file's symbols are matched without comparing all pairs.
    """
    s = symbols.groupBy("id").agg(F.max(F.struct("file_id", "start_line", "end_line")).alias("s")).select("id", "s.*")
    held = s.where(F.col("end_line") > F.col("start_line")).select(
        "file_id", F.col("id").alias("p"), F.col("start_line").alias("p_start"),
        F.explode(F.sequence(F.col("start_line") + 1, F.col("end_line"))).alias("line"),
    )
    best = held.groupBy("file_id", "line").agg(F.max(F.struct("p_start", "p")).alias("m"))
    return s.join(best, (s["file_id"] == best["file_id"]) & (s["start_line"] == best["line"]), "left").select("id", F.col("m.p").alias("parent_id"))


def skeletons(symbols: DataFrame) -> DataFrame:
    """Containers as their own signature and those of their direct children, indented: ``id, content, token_count``.

    Beyond LIMIT tokens whole lines are kept up to KEEP and a mark is added. Children are numbered before they are
    collected, so that at most as many as can fit are held for one container.
    """
    s = symbols.groupBy("id").agg(F.max(F.struct("kind", "sig", "start_line", "parent_id")).alias("s")).select("id", "s.*")
    heads = s.where(F.col("kind").isin(*CONTAINERS)).select("id", F.coalesce("sig", F.lit("")).alias("head"))
    order = Window.partitionBy("parent_id").orderBy("start_line", "id")
    # a child's line has at least five characters with its indent and end
    kids = s.where(F.col("sig").isNotNull() & F.col("parent_id").isNotNull()).withColumn("n", F.row_number().over(order)).where(F.col("n") <= LIMIT)
    listed = kids.groupBy("parent_id").agg(F.sort_array(F.collect_list(F.struct("n", "sig"))).alias("k"))
    body = F.concat("head", F.lit("\n"), F.array_join(F.transform(F.coalesce("k", F.array().cast("array<struct<n:int,sig:string>>")), lambda x: F.concat(F.lit("    "), x["sig"], F.lit("\n"))), ""))
    return heads.join(listed, F.col("id") == F.col("parent_id"), "left").select("id", cap(body).alias("content")).where(
        F.trim("content") != ""
    ).withColumn("token_count", T.estimate_tokens(F.col("content")))


def cap(text: Column) -> Column:
    """TEXT up to LIMIT tokens: longer ones keep whole lines, at least a cut first line, and end with a mark."""
    lines = F.transform(
        F.filter(F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+$"), F.lit(0)), lambda x: x != ""), lambda x: F.regexp_replace(x, r"\r?\n\z", "")
    )
    zero = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))
    size = lambda c: F.floor(F.length(c) / 4)
    step = lambda a, x: F.when(
        ~a["full"] & (size(a["out"]) + size(x) <= KEEP), F.struct(F.concat(a["out"], x, F.lit("\n")).alias("out"), F.lit(False).alias("full"))
    ).otherwise(F.struct(a["out"].alias("out"), F.lit(True).alias("full")))
    kept = F.aggregate(lines, zero, step, lambda a: a["out"])
    short = F.when(kept == "", F.concat(F.substring(F.get(lines, F.lit(0)), 1, HARD_CUT), F.lit("\n"))).otherwise(kept)
    return F.when(size(text) <= LIMIT, text).otherwise(F.concat(short, F.lit(MARK)))


def split_lines(content: str, sig: str | None, limit: int = LIMIT) -> list[str]:
    """CONTENT cut between lines into pieces of at most LIMIT tokens; later ones begin with the signature.

    Blank pieces are dropped; a line longer than the limit stays whole.
    """
    pieces: list[str] = []
    head = f"{sig}\n" if sig else ""
    now, size = "", 0
    for line in content.splitlines(keepends=True):
        if now.strip() and size + len(line) // 4 > limit:
            pieces.append(now)
            now, size = head, len(head) // 4
        now += line
        size += len(line) // 4
    return [p for p in [*pieces, now] if p.strip() and p != head]
