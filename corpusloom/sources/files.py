"""Reading source files and telling which can be indexed."""

from __future__ import annotations

import fnmatch
import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES, SNIFF_BYTES = 1 << 20, 8192  # fixed values of the reference
# Extensions of the languages
EXTENSIONS = {
    "python": "py", "typescript": "ts tsx", "rust": "rs", "javascript": "js jsx mjs cjs", "go": "go", "java": "java", "c": "c h",
    "cpp": "cpp cc cxx hpp hh", "c_sharp": "cs", "kotlin": "kt kts", "swift": "swift", "ruby": "rb", "php": "php", "scala": "scala sc",
    "elixir": "ex exs", "dart": "dart", "lua": "lua", "bash": "sh bash",
}
_LANG = {e: lang for lang, es in EXTENSIONS.items() for e in es.split()}


def extension(path: Column) -> Column:
    """What follows the last dot of the last segment, as spelled; empty without one."""
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def language(path: Column) -> Column:
    """The language of a path by its extension, case-sensitively; null if there is none."""
    table = F.create_map(*(F.lit(x) for kv in sorted(_LANG.items()) for x in kv))
    return F.element_at(table, extension(path))


def file_class(path: Column, content: Column) -> Column:
    """``unsupported`` by extension, size or a zero byte near the start, ``missing`` without content, else ``supported``."""
    head = F.substring(content, 1, SNIFF_BYTES)
    return (
        F.when(language(path).isNull(), "unsupported")
        .when(content.isNull(), "missing")
        .when(F.length(content) > MAX_BYTES, "unsupported")
        .when(F.hex(head).rlike("^(?:..)*?00"), "unsupported")
        .otherwise("supported")
    )


def read_tree(spark: SparkSession, root: str, tracked: bool = False) -> DataFrame:
    """The regular files below ROOT with ``path`` (relative), ``content`` and ``hash``, without version control data.

    TRACKED leaves out what is ignored (:func:`tracked_paths`, a walk of the driver over a local tree): contents of other
    files are not read on.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = Path(root).resolve().as_uri().rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "file:///"), "^" + base.replace(".", r"\."), "")
    files = df.select(path.alias("path"), "content").where(~F.concat(F.lit("/"), F.col("path")).rlike(r"/\.git/"))
    if tracked:
        files = files.join(spark.createDataFrame([(p,) for p in tracked_paths(root)], "path string"), "path", "left_semi")
    return files.select("path", "content", F.unhex(F.sha2("content", 256)).alias("hash"))


def tracked_paths(root: str) -> list[str]:
    """Paths below ROOT that version control lists or does not ignore; without it, all but those an ignore file names."""
    if (Path(root) / ".git").exists():
        r = subprocess.run(
            ["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, text=True
        )
        if r.returncode == 0:
            return sorted(p for p in r.stdout.split("\0") if p)
    return sorted(p for p in _walk(Path(root), Path(root), []) if p)


def _walk(root: Path, at: Path, rules: list[tuple[str, str, bool]]) -> list[str]:
    ignore = at / ".gitignore"
    here = at.relative_to(root).as_posix()
    if ignore.is_file():
        for line in ignore.read_text(errors="replace").splitlines():
            s = line.strip()
            if s and not s.startswith("#"):
                rules = [*rules, ("" if here == "." else here, s.lstrip("!"), not s.startswith("!"))]
    out = []
    for p in sorted(at.iterdir()):
        rel = p.relative_to(root).as_posix()
        if p.name == ".git" or _ignored(rel, p.is_dir(), rules):
            continue
        if p.is_dir():
            out += _walk(root, p, rules)
        elif p.is_file():
            out.append(rel)
    return out


def _ignored(rel: str, is_dir: bool, rules: list[tuple[str, str, bool]]) -> bool:
    hit = False
    for base, pattern, drop in rules:
        if base and not rel.startswith(base + "/"):
            continue
        below = rel[len(base) + 1 :] if base else rel
        body = pattern.rstrip("/")
        if pattern.endswith("/") and not is_dir:
            continue
        name = below if "/" in body else below.rpartition("/")[2]
        if fnmatch.fnmatchcase(name, body.lstrip("/")):
            hit = drop
    return hit


def read_slice(files: DataFrame, path: str, first: int, last: int) -> DataFrame:
    """Lines FIRST to LAST of the file at PATH: ``line, text``; nothing for a path that leaves the root."""
    if path.startswith(("/", "\\")) or ".." in path.replace("\\", "/").split("/"):
        return files.sparkSession.createDataFrame([], "line int, text string")
    text = F.decode("content", "UTF-8")
    lines = files.where(F.col("path") == path).select(F.posexplode(F.split(text, "\n")).alias("n", "text"))
    return lines.where(F.col("n").between(first - 1, last - 1)).select((F.col("n") + 1).alias("line"), "text")
