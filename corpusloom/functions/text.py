"""Scalar functions on names, paths and texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4
# Parts of a path, and words of a query, that mean tests
TEST_DIRS = ("tests", "test", "__tests__", "spec", "specs")
TEST_WORDS = ("test", "tests", "spec", "specs", "testing")
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / CHARS_PER_TOKEN).cast("int")


def fold(text: Column) -> Column:
    """TEXT in lower case without accents on Latin letters."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def terms(text: Column) -> Column:
    """The search terms of TEXT in order: runs of letters and digits, folded; ``_`` separates."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(query: Column) -> Column:
    """The distinct words of a query, joined by ``_`` or not, that keyword search looks for; empty if it has none."""
    return F.array_distinct(F.filter(F.split(query, r"[^\p{L}\p{N}_]+"), lambda w: w != ""))


def excerpt(text: Column, size: int = 120) -> Column:
    """The first SIZE characters of TEXT on one line."""
    return F.substring(F.translate(text, "\n", " "), 1, size)


def last_segment(name: Column) -> Column:
    """What follows the last ``::``, ``.``, ``/`` or backslash of a name."""
    return F.regexp_replace(name, r"(?s)^.*(::|[./\\])", "")


def suffix_match(dst: Column, name: Column) -> Column:
    """Whether DST is NAME or ends with it after a separator; no wildcards."""
    ends = [F.endswith(dst, F.concat(F.lit(s), name)) for s in (".", "::", "/", "\\")]
    return (dst == name) | ends[0] | ends[1] | ends[2] | ends[3]


def is_test_path(path: Column) -> Column:
    """Whether a path looks like test code, by its folders, the middle of its name, or the name's ends."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    stem = F.regexp_extract(name, r"^([^.]*)", 1)
    return (
        F.exists(parts, lambda p: F.lower(p).isin(*TEST_DIRS))
        | name.contains(".test.")
        | name.contains(".spec.")
        | F.lower(stem).rlike("^test_|_test$|_spec$")
        | stem.rlike("Tests?$")
    )


def seeks_tests(query: Column) -> Column:
    """Whether a query asks for tests."""
    return F.arrays_overlap(F.split(F.lower(query), "[^a-z0-9]+"), F.array(*map(F.lit, TEST_WORDS)))


def inline_tests(lang: Column, text: Column) -> Column:
    """Whether Rust code carries its tests inline."""
    return (lang == "rust") & (text.contains("#[cfg(test)]") | text.contains("#[test]"))


def clamp_budget(budget: Column, default: int, cap: int = 20000) -> Column:
    return F.least(F.coalesce(budget, F.lit(default)), F.lit(cap))


def corpus_tier(chunks: Column) -> Column:
    """Size class of a corpus by its number of chunks."""
    return F.when(chunks < 200, "tiny").when(chunks < 2000, "small").otherwise("medium")


def path_slice(target: Column) -> Column:
    """PATH:FIRST-LAST as a struct, null where TARGET has another form."""
    pattern = r"^(.*[/.].*):(\d+)-(\d+)$"
    part = lambda k: F.regexp_extract(target, pattern, k)
    return F.when(
        target.rlike(pattern),
        F.struct(part(1).alias("path"), part(2).cast("int").alias("first"), part(3).cast("int").alias("last")),
    )


def l2_normalize(vector: Column) -> Column:
    """VECTOR at length 1; a zero vector stays."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def rfc3339(seconds: Column) -> Column:
    """Unix seconds in UTC, the session's time zone being UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def round4(x: Column) -> Column:
    """X at four decimals, half away from zero."""
    return F.round(x, 4)
