"""Symbols, references and chunks of source files.

Python is read from its syntax tree. The other languages have a table of definition and import patterns and one scan
for calls; blocks end by brackets, or by ``end`` where a language closes blocks with words.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.chunking import CONTAINERS, LIMIT, split_lines
from corpusloom.sources.files import language

# Per language the patterns of definitions (kind, pattern with the name as group 1 and, where a language
# has them, parameters as group 2) and of imports (target as group 1), as the languages spell them
_FN = r"\s*(?:<[^>()]*>)?\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)"
_C_TYPE = r"(?:[A-Za-z_][\w:<>,*&\[\]?. ]*?[\s*&])"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|async|sealed|open|inline|extern|suspend|partial|readonly)\s+)*"
DEFINITIONS: dict[str, list[tuple[str, str]]] = {
    "typescript": [
        ("module", r"^\s*(?:export\s+)?namespace\s+(\w+)\s*\{"), ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"),
        ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+(\w+)" + _FN),
        ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:function\s*\w*\s*)?\(([^()]*)\)\s*(?::[^={]+)?(?:=>|\{)"),
        ("function", r"^\s+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(\w+)" + _FN + r"\s*(?::[^{;]+)?\{"),
    ],
    "rust": [
        ("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"),
        ("trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)"), ("module", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*\{"),
        ("const", r"^\s*(?:pub(?:\([^)]*\))?\s+)?const\s+(\w+)\s*:"), ("type", r"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+(\w+)"),
        ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)" + _FN),
    ],
    "go": [
        ("function", r"^func\s+(\w+)" + _FN), ("method", r"^func\s+\([^)]*\)\s*(\w+)" + _FN), ("struct", r"^type\s+(\w+)\s+struct\b"),
        ("interface", r"^type\s+(\w+)\s+interface\b"), ("type", r"^type\s+(\w+)\s+(?!struct\b|interface\b)"), ("const", r"^const\s+(\w+)"),
    ],
    "java": [
        ("class", rf"^\s*{_MODS}(?:class|record)\s+(\w+)"), ("interface", rf"^\s*{_MODS}interface\s+(\w+)"), ("enum", rf"^\s*{_MODS}enum\s+(\w+)"),
        ("function", rf"^\s+{_MODS}(?!return\b|new\b|else\b|throw\b){_C_TYPE}?(?!if\b|for\b|while\b|switch\b|catch\b)(\w+){_FN}\s*(?:throws\s[\w., ]+)?\{{"),
    ],
    "c": [
        ("struct", r"^\s*(?:typedef\s+)?struct\s+(\w+)\s*\{"), ("enum", r"^\s*(?:typedef\s+)?enum\s+(\w+)\s*\{"),
        ("function", rf"^(?!\s*(?:return|else|typedef)\b){_C_TYPE}(\w+){_FN}\s*(?:\{{|;)"),
    ],
    "kotlin": [("class", rf"^\s*{_MODS}(?:data\s+)?(?:class|object)\s+(\w+)"), ("function", rf"^\s*{_MODS}fun\s+(\w+){_FN}"), ("const", r"^\s*const\s+val\s+(\w+)")],
    "swift": [("class", rf"^\s*{_MODS}(?:class|extension)\s+(\w+)"), ("struct", rf"^\s*{_MODS}struct\s+(\w+)"), ("interface", rf"^\s*{_MODS}protocol\s+(\w+)"), ("function", rf"^\s*{_MODS}func\s+(\w+)")],
    "ruby": [("module", r"^\s*module\s+([\w:]+)"), ("class", r"^\s*class\s+([\w:]+)"), ("method", r"^\s*def\s+self\.(\w+[?!=]?)(?:\(([^)]*)\))?"), ("function", r"^\s*def\s+(\w+[?!=]?)(?:\(([^)]*)\))?")],
    "php": [("module", r"^\s*namespace\s+([\w\\]+)"), ("class", rf"^\s*{_MODS}class\s+(\w+)"), ("interface", r"^\s*interface\s+(\w+)"), ("trait", r"^\s*trait\s+(\w+)"), ("function", rf"^\s*{_MODS}function\s+(\w+){_FN}")],
    "scala": [("class", rf"^\s*{_MODS}(?:case\s+)?(?:class|object)\s+(\w+)"), ("trait", r"^\s*trait\s+(\w+)"), ("function", rf"^\s*{_MODS}def\s+(\w+)(?:{_FN})?")],
    "elixir": [("module", r"^\s*defmodule\s+([\w.]+)"), ("function", r"^\s*def(?:p|macrop?)?\s+(\w+[?!]?)(?:\(([^)]*)\))?")],
    "dart": [("class", rf"^\s*{_MODS}(?:class|extension)\s+(\w+)"), ("trait", r"^\s*mixin\s+(\w+)"), ("enum", r"^\s*enum\s+(\w+)"), ("function", rf"^\s*{_C_TYPE}(\w+){_FN}\s*(?:async\s*)?(?:\{{|=>)")],
    "lua": [("method", rf"^\s*function\s+\w+[.:](\w+){_FN}"), ("function", rf"^\s*(?:local\s+)?function\s+(\w+){_FN}")],
    "bash": [("function", r"^\s*(?:function\s+)?(\w+)\s*\(\)\s*\{?"), ("function", r"^\s*function\s+(\w+)\s*\{")],
}
DEFINITIONS["javascript"] = [d for d in DEFINITIONS["typescript"] if d[0] != "interface"]
DEFINITIONS["cpp"] = [("module", r"^\s*namespace\s+(\w+)"), ("class", r"^\s*class\s+(\w+)[^;]*\{"), *DEFINITIONS["c"]]
DEFINITIONS["c_sharp"] = [("module", r"^\s*namespace\s+([\w.]+)"), ("struct", rf"^\s*{_MODS}struct\s+(\w+)"), *DEFINITIONS["java"]]
IMPORTS = {
    "typescript": r"^\s*import\b[^'\"]*['\"]([^'\"]+)['\"]", "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)\s*;", "go": r"^\s*(?:import\s+)?(?:\w+\s+)?(\"[\w./-]+\")\s*$",
    "java": r"^\s*import\s+(?:static\s+)?([\w.]+)", "c": r"^\s*#\s*include\s*([<\"][^>\"]+[>\"])", "ruby": r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]",
    "c_sharp": r"^\s*using\s+([\w.]+)\s*;", "kotlin": r"^\s*import\s+([\w.]+)", "swift": r"^\s*import\s+(\w+)", "php": r"^\s*use\s+([\w\\]+)",
    "scala": r"^\s*import\s+([\w.]+)", "elixir": r"^\s*(?:import|alias|require|use)\s+([\w.]+)", "dart": r"^\s*import\s+('[^']+')", "lua": r"require\s*\(?\s*['\"]([^'\"]+)['\"]", "bash": r"^\s*(?:source|\.)\s+(\S+)",
}
IMPORTS["javascript"], IMPORTS["cpp"] = IMPORTS["typescript"], IMPORTS["c"]
_NO_CALL = set(
    "if for while switch catch return function def fn func elif else class new sizeof match loop with in and or not is lambda do until unless when case typeof await yield super print echo".split()
)
_CALL = re.compile(r"((?:[A-Za-z_$][\w$]*(?:::|\.|->))*)([A-Za-z_$][\w$]*[?!]?)\s*\(")
_BLANK = re.compile(r"/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`", re.S)
_BLANK_HASH = re.compile(r"#[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", re.S)
_DOC = re.compile(r"^\s*(?:#|//|/\*|\*|@|--)")


@dataclass
class Index:
    """What a file yields; parents, sources and owners are positions in ``symbols``."""

    symbols: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    chunks: list[dict] = field(default_factory=list)


def _add(ix: Index, kind: str, name: str, sig: str | None, start: int, end: int, arity: int | None) -> None:
    parent, best = 0, -1
    for i, s in enumerate(ix.symbols):
        if s["start_line"] < start <= s["end_line"] and s["start_line"] >= best:
            parent, best = i, s["start_line"]
    p = ix.symbols[parent]
    if kind == "function" and p["kind"] in CONTAINERS:
        kind = "method"
    ix.symbols.append({"name": name, "qualname": f"{p['qualname']}.{name}", "kind": kind, "sig": sig, "start_line": start, "end_line": end, "parent": parent, "arity": arity})


def _arity(params: str | None) -> int | None:
    if params is None:
        return None
    depth, parts = 0, [""]
    for c in params:
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth <= 0:
            parts.append("")
        else:
            parts[-1] += c
    names = [p.strip() for p in parts if p.strip()]
    return len([n for n in names if not re.match(r"^&?(?:'\w+\s+)?(?:mut\s+)?(?:self|cls)\b", n) and n not in ("void", "*", "/")])


def _owners(ix: Index, n: int) -> list[int]:
    """For each of N lines the symbol of greatest first line that holds it."""
    own = [0] * (n + 2)
    for i in sorted(range(len(ix.symbols)), key=lambda i: (ix.symbols[i]["start_line"], i)):
        s = ix.symbols[i]
        for k in range(s["start_line"], min(n, s["end_line"]) + 1):
            own[k] = i
    return own


def _python(ix: Index, text: str, lines: list[str]) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    nodes = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    for n in sorted(nodes, key=lambda n: (n.lineno, n.col_offset)):
        arity = None
        if not isinstance(n, ast.ClassDef):
            a = n.args
            every = [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]
            arity = len([x for x in every if x.arg not in ("self", "cls")])
        _add(ix, "class" if isinstance(n, ast.ClassDef) else "function", n.name, lines[n.lineno - 1].strip(), n.lineno, n.end_lineno, arity)
    own = _owners(ix, len(lines))
    for n in ast.walk(tree):
        if isinstance(n, ast.Call):
            f = n.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            if name:
                ix.edges.append({"src": own[n.lineno], "kind": "calls", "dst_name": name, "dst_arity": len(n.args) + len(n.keywords), "line": n.lineno})
        elif isinstance(n, ast.Import):
            ix.edges += [{"src": 0, "kind": "imports", "dst_name": a.name, "dst_arity": None, "line": n.lineno} for a in n.names]
        elif isinstance(n, ast.ImportFrom) and n.module and not n.level:
            ix.edges.append({"src": 0, "kind": "imports", "dst_name": n.module, "dst_arity": None, "line": n.lineno})
    return True


def _block_end(bare: list[str], start: int, lang: str) -> int:
    """The line (from 1) on which the block that begins on line START ends."""
    if lang in ("ruby", "elixir", "lua"):
        depth = 0
        for i in range(start - 1, len(bare)):
            s = bare[i]
            depth += len(re.findall(r"(?:^|[;=(]|\breturn)\s*(?:def|class|module|if|unless|while|until|case|begin|for|defmodule|defp?|function)\b|\bdo\b|\bfunction\b(?=\s*\()|(?<=\s)function\b", s))
            depth -= len(re.findall(r"\bend\b", s))
            if depth <= 0 and i >= start - 1:
                return i + 1
        return len(bare)
    depth, seen = 0, False
    for i in range(start - 1, len(bare)):
        for c in bare[i]:
            if c == "{":
                depth, seen = depth + 1, True
            elif c == "}":
                depth -= 1
            elif c == ";" and not seen and depth == 0:
                return i + 1
        if seen and depth <= 0:
            return i + 1
        if not seen and i - start > 8:
            return start
    return len(bare) if seen else start


def _generic(ix: Index, lang: str, text: str, lines: list[str]) -> None:
    blank = _BLANK_HASH if lang in ("ruby", "elixir", "bash") else _BLANK
    keep = lambda m: re.sub(r"[^\n]", " ", m[0])
    bare = blank.sub(keep, text).split("\n")
    taken = set()
    found = []
    for kind, pattern in DEFINITIONS.get(lang, ()):
        p = re.compile(pattern)
        for i, s in enumerate(bare, 1):
            if i not in taken and (m := p.match(s)):
                taken.add(i)
                found.append((i, kind, m[1], m[2] if p.groups > 1 else None))
    for i, kind, name, params in sorted(found):
        _add(ix, kind, name, lines[i - 1].strip(), i, _block_end(bare, i, lang), _arity(params) if kind in ("function", "method") else None)
    imp = re.compile(IMPORTS[lang]) if lang in IMPORTS else None
    for i, s in enumerate(lines, 1):
        if imp and (m := imp.search(s)):
            ix.edges.append({"src": 0, "kind": "imports", "dst_name": m[1], "dst_arity": None, "line": i})
    own = _owners(ix, len(lines) + 1)
    for i, s in enumerate(bare, 1):
        if i in taken and lang != "bash":
            continue
        for m in _CALL.finditer(s):
            if m[2] in _NO_CALL:
                continue
            depth, k, inside = 1, m.end(), ""
            while k < len(s) and depth:
                depth += (s[k] in "([{") - (s[k] in ")]}")
                inside += s[k]
                k += 1
            name = m[1] + m[2] if m[1].endswith("::") else m[2]
            ix.edges.append({"src": own[i], "kind": "calls", "dst_name": name, "dst_arity": _arity(lines[i - 1][m.end() : k - 1] if k <= len(lines[i - 1]) else inside[:-1]), "line": i})


def _chunks(ix: Index, lines: list[str]) -> None:
    n = len(lines)
    owner = [0] * (n + 1)
    for i in sorted(range(1, len(ix.symbols)), key=lambda i: ix.symbols[i]["start_line"] - ix.symbols[i]["end_line"]):
        for k in range(ix.symbols[i]["start_line"], min(n, ix.symbols[i]["end_line"]) + 1):
            owner[k] = i
    covered = [o > 0 for o in owner]
    put = lambda s, a, b, text: ix.chunks.append({"symbol": s, "start_line": a, "end_line": b, "content": text})
    for i, s in enumerate(ix.symbols[1:], 1):
        a = s["start_line"]
        up = {0, i, s["parent"]}
        while a > 1 and _DOC.match(lines[a - 2]) and owner[a - 1] in up and s["kind"] != "module":
            a -= 1
            covered[a] = True
        text = "".join(x + "\n" for x in lines[a - 1 : s["end_line"]])
        if s["kind"] in CONTAINERS:
            kids = [k["sig"] for k in ix.symbols[1:] if k["parent"] == i and k["sig"]]
            doc = "".join(x + "\n" for x in lines[a - 1 : s["start_line"] - 1])
            put(i, a, s["end_line"], doc + f"{s['sig']}\n" + "".join(f"    {k}\n" for k in kids))
        elif s["kind"] != "module":
            for piece in split_lines(text, s["sig"]) if len(text) // 4 > LIMIT else [text]:
                put(i, a, s["end_line"], piece)
    run: list[int] = []
    for k in range(1, n + 2):
        if k <= n and not covered[k] and lines[k - 1].strip():
            run.append(k)
        elif run:
            text = "".join(lines[j - 1] + "\n" for j in run)
            if any(c.isalnum() for c in text):
                put(0, run[0], run[-1], text)
            run = []


def extract(path: str, lang: str | None, text: str) -> Index:
    """Symbols, references and chunks of one file; the module comes first. What cannot be read yields the module alone."""
    lines = text.replace("\r\n", "\n").split("\n")
    if lines and not lines[-1]:
        lines.pop()
    stem = re.sub(r"\.[^./]+$", "", path)
    ix = Index([{"name": stem.rpartition("/")[2], "qualname": stem.replace("/", "."), "kind": "module", "sig": None, "start_line": 1, "end_line": max(1, len(lines)), "parent": None, "arity": None}])
    if lang == "python":
        _python(ix, text, lines)
    elif lang in DEFINITIONS:
        _generic(ix, lang, text.replace("\r\n", "\n"), lines)
    _chunks(ix, lines)
    return ix


_SYMBOL = "array<struct<name:string,qualname:string,kind:string,sig:string,start_line:int,end_line:int,parent:int,arity:int>>"
_EDGE = "array<struct<src:int,kind:string,dst_name:string,dst_arity:int,line:int>>"
_CHUNK = "array<struct<symbol:int,start_line:int,end_line:int,content:string>>"


def parse_files(files: DataFrame) -> DataFrame:
    """``file_id, path, lang, symbols, edges, chunks`` of FILES (``id, path, content``), each file where it lies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            found = [extract(p or "", x, "" if c is None else bytes(c).decode("utf-8", "replace")) for p, x, c in zip(d["path"], d["lang"], d["content"])]
            yield pd.DataFrame({"file_id": d["file_id"], "path": d["path"], "lang": d["lang"], "symbols": [f.symbols for f in found], "edges": [f.edges for f in found], "chunks": [f.chunks for f in found]})

    chosen = files.select(F.col("id").alias("file_id"), "path", language(F.col("path")).alias("lang"), "content")
    return chosen.mapInPandas(run, f"file_id long, path string, lang string, symbols {_SYMBOL}, edges {_EDGE}, chunks {_CHUNK}")


def relations(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, edges and chunks with ids that depend on (file, position) alone, so a rebuild gives the same ids."""
    key = lambda n: F.col("file_id") * (1 << 20) + F.col(n)
    s = parsed.select("file_id", F.posexplode("symbols").alias("n", "s")).select(
        key("n").alias("id"), "file_id", "s.name", "s.qualname", "s.kind", "s.sig", "s.start_line", "s.end_line",
        (F.col("file_id") * (1 << 20) + F.col("s.parent")).alias("parent_id"), "s.arity",
    )
    e = parsed.select("file_id", F.posexplode("edges").alias("n", "e")).select(
        key("n").alias("id"), (F.col("file_id") * (1 << 20) + F.col("e.src")).alias("src_id"), "e.kind", "e.dst_name", "e.dst_arity"
    )
    c = parsed.select("file_id", F.posexplode("chunks").alias("n", "c")).select(
        key("n").alias("id"), "file_id", (F.col("file_id") * (1 << 20) + F.col("c.symbol")).alias("symbol_id"), "c.start_line", "c.end_line", "c.content"
    )
    return s, e, c
