"""Functions paired with their documentation (problem 5)."""

from __future__ import annotations

import ast
import re
import textwrap
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import functions

PAIRS = "item_id long, symbol_id long, qualname string, doc string, code string, doc_first int, doc_last int, code_first int, code_last int"

#: A description has at least so many words that are not in the function's name.
LEAST_WORDS = 3

# Tags, and texts that stand for missing documentation
_RULER = re.compile(r"[-=*#~_/\s.]{3,}")
_TAG = re.compile(r"^(?:[@\\](?:param(?:eter)?|arg|tparam|property|throws|exception)\b\s*(?:\{[^}]*\}\s*)?\[?[\w$.]*\]?|:(?:param|arg|type|raises?|rtype|throws)\b[^:]*:|[@\\](?:returns?|yields?|since|see|author|version|deprecated)\b(?:\s*\{[^}]*\})?|:(?:returns?|yields?):)\s*[-–:]?\s*")
_PARAM = re.compile(r"^(?:[@\\](?:param|arg|tparam|property)\b|:(?:param|arg|type|rtype)\b)")
_EMPTY = re.compile(
    r"^(?:\(?undocumented\)?|n/?a|none|tbd|see above|see below|constructor|destructor|getter|setter|\{@inheritdoc\}|inheritdoc"
    r"|(?:todo|fixme|xxx|hack)\b.{0,40}|no(?:qa|lint)\b.*|eslint-.*|nosonar|type: ?ignore.*|pylint:.*|(?:added|created|changed|modified|updated) (?:on |at |by )?[\d\W]*\w{0,12}"
    r"|write docs|document(?: this| me)?|rename|auto-?generated.*|description|summary)$",
    re.I,
)
_CODE = re.compile(r"[;{}]\s*$|^\w[\w.\[\]]*\s*[-+*/|&]?=\s*\S|^(?:return|if|for|while|else|elif|import|from|def|fn|func|function|class|let|const|var|print|end)\b[^a-z]*\W.*[(\[{:;=]|^[\w.]+\([^()]*(?:\([^()]*\)[^()]*)*\)[;:]?\s*$")
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def name_words(name: str) -> set[str]:
    """The words of an identifier, lower case, without common endings."""
    return {_stem(w) for w in _CAMEL.findall(name)}


def _stem(w: str) -> str:
    w = w.lower()
    for end in ("ies", "es", "s", "ing", "ed", "e"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: -len(end)] + ("y" if end == "ies" else "")
    return w


_FILLER = {_stem(w) for w in "a an the this that function method procedure routine helper does do to of for and or in it its is".split()}


def meaningful(lines: list[str], name: str) -> bool:
    """Whether documentation tells anything about a function beyond its NAME.

    Rulers, commented-out code, placeholders and bare tags tell nothing. What follows a tag counts like other text,
    save that the mere noun of a parameter tells about the parameter, not the function.
    """
    own = name_words(name) | _FILLER
    told: set[str] = set()
    words = 0
    in_code = False
    for raw in lines:
        s = raw.strip()
        if s.startswith("```"):
            in_code = not in_code
            continue
        if in_code or not s or _RULER.fullmatch(s) or _CODE.search(s):
            continue
        if re.match(r"^[-=*#~_/]{3,}.*[-=*#~_/]{3,}$", s):
            continue
        if _PARAM.match(s):
            continue
        s = _TAG.sub("", s).strip()
        if not s or _EMPTY.match(s.rstrip(".! ")):
            continue
        ws = [w for w in _WORD.findall(s)]
        new = {_stem(w) for part in ws for w in (_CAMEL.findall(part) or [part])} - own
        told |= new
        words += len(ws)
    return len(told) >= LEAST_WORDS or (len(told) >= 2 and words >= 6)


def _uncomment(block: list[str]) -> list[str]:
    """The text of comment lines without their marks."""
    out = []
    for x in block:
        s = x.strip()
        s = re.sub(r"^(?:/\*[*!]?|//[/!]?|#+|--+|=begin|=end)\s?", "", s)
        s = re.sub(r"\s*\*/$", "", s)
        s = re.sub(r"^\*+\s?(?!\w*\()", "", s) if not s.startswith("**") else s
        out.append(s.strip())
    return out


def _python_doc(lines: list[str], at: int) -> tuple[int, int, str] | None:
    """The string that is the first statement of the function at line AT: (first, end, text).

    From the syntax tree of the definition; where the text around it does not parse, from the first tokens of its body.
    """
    source = textwrap.dedent("\n".join(lines[at:]))
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
        node = tree.body[0]
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            doc = ast.get_docstring(node)
            if doc is None:
                return None
            return at + node.body[0].lineno - 1, at + node.body[0].end_lineno, doc
    except (SyntaxError, ValueError, RecursionError, MemoryError, IndexError):
        pass
    k, depth = at, 0
    while k < len(lines):
        depth += sum(lines[k].count(c) for c in "([{") - sum(lines[k].count(c) for c in ")]}")
        if depth <= 0 and re.search(r":\s*(?:#.*)?$", lines[k]):
            break
        k += 1
    k += 1
    while k < len(lines) and not lines[k].strip():
        k += 1
    if k >= len(lines):
        return None
    m = re.match(r"\s*[rRuU]?(\"\"\"|'''|\"|')", lines[k])
    if not m:
        return None
    rest = "\n".join(lines[k:])[m.end() :]
    e = rest.find(m[1])
    body = rest if e < 0 else rest[:e]
    return k, k + 1 + body.count("\n"), body


def pair_of(content: str, name: str | None, lang: str | None) -> tuple[str, str, int, int, int, int] | None:
    """Documentation and code of the function NAME in CONTENT: (doc, code, doc lines, code lines), None without any.

    Line ranges are half open and count from 0. The documentation is the comment block directly above the definition
    and, in Python, the string that is the first statement. Without a name the first definition is taken.
    """
    text = content.replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    if lang == "python":
        return _python_pair(lines, name)
    if lang is None:
        return None
    for f in functions.functions(text, lang):
        if name is None or f.name.rstrip("?!") == name.rstrip("?!="):
            line = lambda at: text.count("\n", 0, at)
            if f.doc[0] == f.doc[1]:
                return None
            doc = _uncomment("\n".join(text[a:e] for a, e in f.comments).split("\n"))
            first, end = line(f.head), line(f.end) + 1
            return "\n".join(doc).strip(), "\n".join(lines[first:end]).rstrip(), line(f.doc[0]), line(max(f.doc[0], f.doc[1] - 1)) + 1, first, end
    return None


def _python_pair(lines: list[str], name: str | None) -> tuple[str, str, int, int, int, int] | None:
    head = re.compile(rf"^\s*(?:async\s+)?def\s+{re.escape(name) if name else '[^\\W\\d]\\w*'}\s*[(\[]")
    at = next((k for k, x in enumerate(lines) if head.match(x)), None)
    if at is None:
        return None
    up = at
    # decorators, which may go on over lines, stand between the comment and the definition
    while up and (re.match(r"^\s*@[^\W\d]", lines[up - 1]) or _closes_decorator(lines, up - 1)):
        up -= 1
        while not re.match(r"^\s*@[^\W\d]", lines[up]):
            up -= 1
    first = up
    while first and re.match(r"\s*#", lines[first - 1]):
        first -= 1
    doc, span, code = _uncomment(lines[first:up]), (first, up), lines[at:]
    if inner := _python_doc(lines, at):
        a, b, text = inner
        doc += text.split("\n")
        code = lines[at:a] + lines[b:]
        span = (a, b) if up == first else (first, b)
    if not doc:
        return None
    return "\n".join(doc).strip(), "\n".join(code).rstrip(), span[0], span[1], at, len(lines)


def _closes_decorator(lines: list[str], k: int) -> bool:
    """Whether line K ends the arguments of a decorator that began on a line above."""
    depth = 0
    for j in range(k, -1, -1):
        depth += sum(lines[j].count(c) for c in ")]}") - sum(lines[j].count(c) for c in "([{")
        if depth <= 0:
            return j < k and re.match(r"^\s*@[^\W\d]", lines[j]) is not None
    return False


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in PAIRS.split(", ")]
    for d in batches:
        rows = []
        for item, symbol, path, qual, start, content in zip(d["item_id"], d["symbol_id"], d["path"], d["qualname"], d["start_line"], d["content"]):
            name = re.split(r"\.|::|#", qual)[-1] if qual else None
            ending = path.rpartition(".")[2].lower() if path else ""
            found = pair_of(content, name, "python" if ending in ("py", "pyi") else functions.LANGUAGES.get(ending))
            if found and meaningful(found[0].split("\n"), name or ""):
                doc, code, a, b, c, e = found
                s = 1 if pd.isna(start) else int(start)
                rows.append((item, symbol, qual, doc, code, s + a, s + b - 1, s + c, s + e - 1))
        if rows:
            yield pd.DataFrame(rows, columns=names)


def doc_pairs(items: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row per function or method with meaningful documentation: its code, documentation and their lines.

    Columns ``symbol_id, item_id, qualname, kind, sig, doc, code, doc_first, doc_last, code_first, code_last``; lines
    count in the file. Of several documented items of a symbol the one with the least id stands. Items without symbol,
    with null content, of a path whose ending tells no known language, or of a symbol that does not exist or is of another
    kind yield nothing. The definition is the function node of the syntax tree (:mod:`functions`, :mod:`ast`) that is named by
    the last part of ``qualname``, or, where that is null, the first.

    Contents are read where they lie; only documented pairs are shuffled, to meet the kind of their symbol. A symbol
    that holds a third of the items is reduced to one row per task before the shuffle.
    """
    known = items.where(F.col("symbol_id").isNotNull() & F.col("content").isNotNull())
    pairs = known.select("item_id", "symbol_id", "path", "qualname", "start_line", "content").mapInPandas(_read, PAIRS)
    one = pairs.groupBy("symbol_id").agg(F.min(F.struct("item_id", *[c.split()[0] for c in PAIRS.split(", ") if c.split()[0] not in ("item_id", "symbol_id")])).alias("p"))
    kinds = (
        symbols.where(F.col("kind").isin("function", "method"))
        .groupBy(F.col("id").alias("symbol_id"))
        .agg(F.max(F.struct("kind", "sig")).alias("s"))
    )
    return one.join(kinds, "symbol_id").select(
        "symbol_id", "p.item_id", "p.qualname", "s.kind", "s.sig", "p.doc", "p.code", "p.doc_first", "p.doc_last", "p.code_first", "p.code_last"
    )
