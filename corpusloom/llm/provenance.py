"""Generated, minified or vendored source files (problem 1).

What repositories declare in attribute files decides first: glob patterns, per kind the deepest folder and there the
last line. Then patterns are mined that nearly always go with such files - folders, ends of names, and runs of words in
leading comments - from files that are declared, whose content is plain, or whose path follows a convention; these
equivalents of declarations are applied to every file that no declaration decides. What no pattern reaches falls back
on its content, then on conventions of paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut

EVIDENCE = "file_id long, repo string, lang string, path string, kind string, reason string, heads array<string>"
ATTRIBUTES = ".gitattributes"
#: A mined path pattern holds if it is seen at this many plain files and at least this share of all files that have it.
LEAST_FILES, LEAST_SHARE = 5, 0.9
#: Runs of so many words of leading comments are patterns too; these have to hold nearly always, and in two repositories.
HEAD_WORDS, HEAD_SHARE = 4, 0.98
#: Kinds that a declaration of the attribute covers, or rules out where it is unset.
COVERS = {"generated": ("generated", "minified", "data"), "vendored": ("vendored",)}

# Words that mark a tool's output in a leading comment, in the languages of the comments
MARKERS = re.compile(
    r"^[\s/*#;-]*@generated\b|<auto-?generated|\bcode generated by\b|\bgenerated (?:code|file)\b|\bauto-?generated (?:by|from|file)\b"
    r"|\bfile (?:was|is|has been) (?:auto\w*[ -])?(?:produced|generated|created) (?:from|by)\b|\b(?:auto\w*[ -])(?:produced|generated) (?:from|by|file)\b"
    r"|\bgenerated (?:on|at) .{4,40}? by\b|\b(?:changes|edits|modifications) (?:will be|get|are) (?:lost|overwritten)\b|\bhand edits vanish\b"
    r"|\bdo not (?:edit|modify)(?: (?:by hand|manually|this file|directly))?\s*[.!*/-]*\s*$"
    r"|\b(?:erzeugt|generiert)\b.*\bnicht (?:ändern|bearbeiten|editieren)|\bgénéré(?:e)?\b.*\bne pas (?:modifier|éditer)|\bgenerado\b.*\bno (?:modificar|editar|lo edite)",
    re.I | re.M,
)
# Words that mark another project's file in a leading comment
UPSTREAM = re.compile(
    r"\b(?:fetched|copied|taken|imported|vendored) (?:unchanged |verbatim )?from (?:upstream|https?:)|\bpart of [\w-]+, version \d"
    r"|\bcopyright \(c\) (?:\d{4} )?the [\w-]+ (?:contributors|authors)|\bv?\d+\.\d+(?:\.\d+)? \| \(c\) [\w -]+ (?:authors|contributors)",
    re.I,
)
BELONGS = re.compile(r"\bfile belongs to ([\w.-]{2,}\w)\. See LICEN[CS]E")
# Folders of copied packages, which hold one folder per package, and names of generated files
PACKAGE_DIRS = re.compile(r"/(?:vendor|third[-_]?party|node_modules|bower_components|deps|external|_upstream|Godeps)/[^/]+/")
GENERATED_NAMES = re.compile(r"(?:\.g|\.gen|\.generated|\.pb|\.designer|_generated|_pb2|_pb2_grpc|zz_generated[\w.]*)\.\w+$", re.I)
GENERATED_DIRS = re.compile(r"/(?:gen|generated|autogen|__generated__)/", re.I)
MINIFIED_NAMES = re.compile(r"[.-]min\.m?js$", re.I)

_COMMENT = re.compile(r"(\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|/\*.*?\*/|//[^\n]*|#(?!include|define|if|endif|pragma|\[|!\[)[^\n]*", re.S)
_LITERAL = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`|(?<![\w])0?[xX]?[\da-fA-F]*\d[\da-fA-F_.]*|\b(?:true|false|null|None|True|False|nil)\b", re.S)
_SERIAL = re.compile(r"\b(?:def|fn|func|function|int|void|double|long|String)\s+(?:\([^)]*\)\s*)?([A-Za-z_]*?[A-Za-z_])0*(\d+)\s*\(")
_NUMBERED = re.compile(r"[A-Za-z_]\d+ ?\(")
_ANY_DEF = re.compile(r"\b(?:def|fn|func|function)\s+(?:\([^)]*\)\s*)?\w+|\b(?:int|void|double|long|String)\s+\w+\s*\([^;{)]*\)\s*\{")
_LEAD = re.compile(r"\A(?:\s*(?:/\*.*?\*/|//[^\n]*|#(?!include|define|\[)[^\n]*|\"\"\".*?\"\"\"|'''.*?'''|--[^\n]*)[ \t]*(?:\n|\Z))+", re.S)


def content_evidence(path: str, repo: str | None, text: str) -> tuple[str, str] | None:
    """What the content of a file shows it to be, as (kind, reason); None where it shows nothing.

    Comments count only before the first code, so that code which mentions or writes such marks is not taken for it.
    """
    lead = _LEAD.match(text)
    head = lead[0] if lead else ""
    if m := MARKERS.search(head):
        return "generated", f"header: {m[0].strip()[:60]}"
    if m := UPSTREAM.search(head):
        return "vendored", f"header: {m[0].strip()[:60]}"
    if (m := BELONGS.search(head)) and m[1].lower() != (repo or "").lower():
        return "vendored", f"belongs to {m[1]}"
    lines = [x for x in text.split("\n") if x.strip()]
    if len(text) >= 300 and lines:
        longest = max(map(len, lines))
        if longest >= 250 and len(text) / len(lines) >= 120:
            # long lines throughout: code without blanks is minified, else it is data if literals make it up
            bare = _LITERAL.sub("", text)
            names = re.findall(r"[^\W\d]\w*", bare)
            if len(bare) < 0.35 * len(text):
                return "data", "literals on long lines"
            blanks = sum(c in " \t\n" for c in bare) / max(1, len(bare))
            if blanks < 0.12 and names:
                return "minified", "long lines without blanks"
    if len(text) >= 500 and len(_NUMBERED.findall(text)) >= 8:
        serial = _SERIAL.findall(text)
        if len(serial) >= 8:
            numbers = [int(n) for _, n in serial]
            steps = sum(b - a == 1 for a, b in zip(numbers, numbers[1:]))
            if steps >= 0.8 * (len(numbers) - 1) and len(serial) >= 0.7 * max(1, len(_ANY_DEF.findall(text))):
                return "generated", "functions numbered in series"
    if len(text) >= 500 and (sum(map(text.count, '0123456789",')) > 0.2 * len(text) or text.count(" ") < 0.08 * len(text)):
        # quotes, digits and commas, or hardly any blanks: measure how much is not literal
        code = _COMMENT.sub(r"\1", text)
        if len(code) >= 400:
            words = re.sub(r"[\s,;:\[\]{}()=+|&-]+", "", re.sub(r"[A-Za-z_]\w*(?=\s*:)", "", _LITERAL.sub("", code)))
            if len(words) < 0.12 * len(re.sub(r"\s+", "", code)):
                return "data", "almost all literals"
    return None


_HEAD_WORD = re.compile(r"[^\W\d_]+")


def head_patterns(text: str) -> list[str]:
    """Runs of HEAD_WORDS words of the comments before the first code; numbers and marks between them do not count."""
    lead = _LEAD.match(text)
    ws = _HEAD_WORD.findall(lead[0].lower()) if lead else []
    return sorted({" ".join(ws[k : k + HEAD_WORDS]) for k in range(len(ws) - HEAD_WORDS + 1)})


def path_evidence(path: str) -> tuple[str, str] | None:
    """What common conventions for paths say, as (kind, reason)."""
    if MINIFIED_NAMES.search(path):
        return "minified", "name"
    if GENERATED_NAMES.search(path):
        return "generated", "name"
    if GENERATED_DIRS.search(path):
        return "generated", "folder"
    if PACKAGE_DIRS.search("/" + path):
        return "vendored", "folder of a package"
    return None


def _look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in batches:
        found = []
        for path, repo, content in zip(d["path"], d["repo"], d["content"]):
            text = "" if content is None else bytes(content).decode("utf-8", "replace").replace("\r\n", "\n")
            found.append((*(content_evidence(path or "", repo, text) or (None, None)), head_patterns(text)))
        out = d[["file_id", "repo", "lang", "path"]].copy()
        out["kind"], out["reason"], out["heads"] = [k for k, _, _ in found], [r for _, r, _ in found], [h for *_, h in found]
        yield out


def _patterns(path: Column, heads: Column) -> Column:
    """Patterns of a file: each folder below the repository, the end of the name after its first dot or underscore, ``#`` and runs of words."""
    parts = F.split(path, "/")
    dirs = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: F.concat(F.lit("/"), x, F.lit("/")))
    name = F.element_at(parts, -1)
    ends = F.array(F.regexp_extract(name, r"(\.[^.]+\.[^.]+)$", 1), F.regexp_extract(name, r"(_[a-z]+\.[^.]+)$", 1))
    of_path = F.coalesce(F.filter(F.array_distinct(F.concat(dirs, ends)), lambda x: x != ""), F.array().cast("array<string>"))
    return F.concat(of_path, F.transform(F.coalesce(heads, F.array().cast("array<string>")), lambda x: F.concat(F.lit("# "), x)))


def mine_patterns(seen: DataFrame, least_files: int = LEAST_FILES, least_share: float = LEAST_SHARE, head_share: float = HEAD_SHARE) -> DataFrame:
    """Patterns that nearly always go with files of a kind: ``pattern, kind, files, share``.

    SEEN is ``repo, path, heads, kind, declared, declaring``: the kind that anything speaks for, whether a declaration gives
    it, and whether the repository declares anything. A pattern holds if it has its share among the files of declaring
    repositories, where what is not declared speaks against it, or among the files of all. All files count; counts are
    aggregated per task before the shuffle, so a pattern that a third of the files have is no hot key.
    """
    each = seen.select("repo", "kind", "declared", "declaring", F.explode(_patterns(F.col("path"), F.col("heads"))).alias("pattern"))
    n = each.groupBy("pattern", "kind", "declared", "declaring").agg(F.count("*").alias("n"), F.min("repo").alias("r0"), F.max("repo").alias("r1"))
    known = F.col("kind").isNotNull()
    share = F.when(F.startswith("pattern", F.lit("# ")), head_share).otherwise(least_share)
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    sums = n.groupBy("pattern", "kind").agg(
        F.sum("n").alias("n"), count(F.col("declared")).alias("d"), count(F.col("declaring") & ~known).alias("against"),
        F.min("r0").alias("r0"), F.max("r1").alias("r1"),
    ).groupBy("pattern").agg(
        F.max(F.when(known, F.struct("n", "kind"))).alias("top"), count(known).alias("files"), F.sum("n").alias("all"),
        F.sum("d").alias("d"), F.sum("against").alias("against"), F.min(F.when(known, F.col("r0"))).alias("r0"), F.max(F.when(known, F.col("r1"))).alias("r1"),
    )
    by_all = F.when((F.col("files") >= least_files) & (F.col("files") >= share * F.col("all")), F.col("files") / F.col("all"))
    by_declared = F.when((F.col("d") >= least_files) & (F.col("d") >= share * (F.col("d") + F.col("against"))), F.col("d") / (F.col("d") + F.col("against")))
    path = ~F.startswith("pattern", F.lit("# "))
    return sums.withColumn("share", F.greatest(by_all, by_declared)).where(F.col("share").isNotNull()).where(
        path | (F.col("r0") != F.col("r1")) & (F.col("top.n") >= head_share * F.col("files"))
    ).select("pattern", F.col("top.kind").alias("kind"), "files", F.round("share", 6).alias("share"))


# --- attribute files --------------------------------------------------------------------------------------------------


def glob_regex(pattern: str) -> str:
    """An attribute file's glob as a regular expression on the path below the attribute file's folder."""
    anchored = "/" in pattern.rstrip("/")[:-1] or pattern.startswith("/")
    body, out, i = pattern.strip("/"), "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and (j := body.find("]", i + 2)) > 0:
            out, i = out + "[" + body[i + 1 : j].replace("\\", "").replace("!", "^", 1 if body[i + 1] == "!" else 0) + "]", j + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("(?:/.*)?$" if pattern.endswith("/") else "$")


_QUOTED = re.compile(r'"((?:\\.|[^"\\])*)"\s*(.*)')
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


def parse_attributes(path: str, text: str) -> list[tuple[str, int, str, str, bool | None]]:
    """Rules of the attribute file at PATH: (folder, line, regex, kind, set, unset or, after ``!``, unspecified).

    A pattern that holds blanks stands in double quotes; in these a backslash escapes as in C.
    """
    folder, rules = path.rpartition("/")[0], []
    for no, line in enumerate(text.splitlines()):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if m := _QUOTED.match(line):
            pattern, words = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), m[1]), m[2].split()
        else:
            pattern, *words = line.split()
        for w in words:
            m = re.fullmatch(r"([-!]?)(?:linguist-)?(generated|vendored)(?:=(\w+))?", w)
            if m:
                on = None if m[1] == "!" else not m[1] and (m[3] or "true").lower() not in ("false", "unset", "0")
                rules.append((folder, no, glob_regex(pattern), m[2], on))
    return rules


def declared(files: DataFrame) -> DataFrame:
    """What attribute files among FILES declare: ``file_id, declared_kind, denied``.

    A file is matched with the attribute files of the folders above it, from its repository down, by an equality join on
    the folder. For each kind apart the deepest folder wins, within it the last line that matches. ``declared_kind`` is a
    kind that is set, ``denied`` the kinds that are unset; a kind that is unspecified again says nothing.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            rows = [r for p, c in zip(d["path"], d["content"]) if c is not None for r in parse_attributes(p, bytes(c).decode("utf-8", "replace"))]
            yield pd.DataFrame(rows, columns=["folder", "line", "regex", "rule_kind", "on"]).astype({"on": "boolean"})

    rules = (
        files.where(F.element_at(F.split("path", "/"), -1) == ATTRIBUTES)
        .select("path", "content")
        .mapInPandas(parse, "folder string, line int, regex string, rule_kind string, on boolean")
    )
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    places = files.where(F.contains("path", F.lit("/"))).select(F.col("id").alias("file_id"), "path", F.explode(above).alias("folder"))
    below = F.expr("substring(path, length(folder) + 2)")
    covered = F.create_map(*(x for k, v in COVERS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return (
        places.join(rules, "folder")
        .where(F.regexp_like(below, F.col("regex")))
        .groupBy("file_id", "rule_kind")
        .agg(F.max(F.struct(F.length("folder").alias("depth"), "line", "on")).alias("last"))
        .where(F.col("last.on").isNotNull())
        .groupBy("file_id")
        .agg(
            F.min(F.when(F.col("last.on"), F.col("rule_kind"))).alias("declared_kind"),
            F.flatten(F.collect_set(F.when(~F.col("last.on"), F.element_at(covered, F.col("rule_kind"))))).alias("denied"),
        )
    )


def classify_files(files: DataFrame) -> DataFrame:
    """Every row of FILES with ``kind`` generated, minified, vendored or data, null for hand-written, ``reason`` and ``route``.

    The routes, in order: ``declared``; ``mined``, a pattern of :func:`mine_patterns`, several of them by the highest
    share; ``content``; ``convention``, names and folders. A kind that is declared unset is not given by a later route. Null and
    empty content shows nothing; a null path has no pattern. One pass reads the content where it lies; what is joined
    and counted afterwards are paths and leading comments. The evidence of the pass is kept by a checkpoint, since it is
    used twice.
    """
    looked = files.select(F.col("id").alias("file_id"), "repo", "lang", "path", "content").mapInPandas(_look, EVIDENCE)
    if files.where(F.element_at(F.split("path", "/"), -1) == ATTRIBUTES).select("path").take(1):
        having = files.where(F.element_at(F.split("path", "/"), -1) == ATTRIBUTES).select("repo").distinct().withColumn("declaring", F.lit(True))
        looked = looked.join(declared(files), "file_id", "left").join(having, "repo", "left")
    else:
        none = {"declared_kind": "string", "denied": "array<string>", "declaring": "boolean"}
        looked = looked.withColumns({n: F.lit(None).cast(t) for n, t in none.items()})
    by_path = _by_path(F.col("path"))
    allowed = lambda k: ~F.coalesce(F.array_contains("denied", k), F.lit(False))
    looked = cut(looked.select(
        F.monotonically_increasing_id().alias("row"), "*", by_path["kind"].alias("p_kind"), by_path["reason"].alias("p_reason")
    ).withColumn("kind", F.when(allowed(F.col("kind")), F.col("kind"))).withColumn("p_kind", F.when(allowed(F.col("p_kind")), F.col("p_kind"))))
    rules = mine_patterns(looked.select(
        "repo", "path", "heads", F.coalesce("declared_kind", "kind", "p_kind").alias("kind"),
        F.col("declared_kind").isNotNull().alias("declared"), F.coalesce("declaring", F.lit(False)).alias("declaring"),
    ))
    mined = (
        looked.where(F.col("declared_kind").isNull())
        .select("row", "denied", F.explode(_patterns(F.col("path"), F.col("heads"))).alias("pattern"))
        .join(rules.select("pattern", F.col("kind").alias("rule_kind"), "files", "share"), "pattern")
        .where(allowed(F.col("rule_kind")))
        .groupBy("row")
        .agg(F.max(F.struct("share", "files", "rule_kind", "pattern")).alias("m"))
    )
    hit = lambda route, k, r: F.when(k.isNotNull(), F.struct(k.alias("kind"), r.alias("reason"), F.lit(route).alias("route")))
    verdict = F.coalesce(
        hit("declared", F.col("declared_kind"), F.lit("declared")),
        hit("mined", F.col("m.rule_kind"), F.concat(F.lit("pattern "), F.col("m.pattern"))),
        hit("content", F.col("kind"), F.col("reason")),
        hit("convention", F.col("p_kind"), F.col("p_reason")),
    )
    return looked.join(mined, "row", "left").select("file_id", "repo", "lang", "path", verdict.alias("v")).select(
        "file_id", "repo", "lang", "path", "v.kind", "v.reason", "v.route"
    )


def _by_path(path: Column) -> Column:
    """:func:`path_evidence` as an expression."""
    below = F.concat(F.lit("/"), path)
    hit = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))
    return (
        F.when(path.rlike("(?i)" + MINIFIED_NAMES.pattern), hit("minified", "name"))
        .when(path.rlike("(?i)" + GENERATED_NAMES.pattern), hit("generated", "name"))
        .when(path.rlike("(?i)" + GENERATED_DIRS.pattern), hit("generated", "folder"))
        .when(below.rlike(PACKAGE_DIRS.pattern), hit("vendored", "folder of a package"))
    )
