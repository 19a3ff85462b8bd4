"""Source files that do not parse (problem 3).

A file is cut into chunks at line ends. Each chunk is summarised by a lexer-state map (for every state in which it may
be entered, the state in which it is left) and, once its entry state is known, by the brackets it leaves open; both
kinds of summary are combined associatively. Statements of balanced text are then parsed line by line with local
grammars: a line acts on a small state (what may follow, and the innermost open constructs), and what a line shape does
in a state is computed once and remembered. Python has an exact parser at hand, which decides there.
"""

from __future__ import annotations

import ast
import re
import uuid
import warnings
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut

#: Characters of a chunk.
CHUNK = 1 << 16

VERDICTS = "file_id long, repo string, lang string, path string, valid boolean, reason string"


class Bad(Exception):
    """The text is not valid; the message says why."""


# --- lexer: comments and strings become one mark, names and numbers another ------------------------------------------

_STR = r'"(?:\\.|[^"\\\n])*"'
_CHR = r"'(?:\\.|[^'\\\n])*'"
_TICK = r"`(?:\\.|[^`\\])*`"
_SLASH = r"//[^\n]*|/\*.*?\*/"
_REGEX = r"(?P<rx>[=(,:;!&|?]\s*)/(?![*/\s])(?:\\.|\[(?:\\.|[^\]\n])*\]|[^/\\\n])+/[a-z]*"
_OPEN = r'(?P<bad>/\*|"|`)'
_LEX = {
    "javascript": rf"(?P<c>{_SLASH}|\A#![^\n]*)|{_STR}|{_CHR}|{_TICK}|{_REGEX}|{_OPEN[:-1]}|')",
    "java": rf'(?P<c>{_SLASH})|""".*?"""|{_STR}|{_CHR}|{_OPEN[:-1]}|\')',
    "go": rf"(?P<c>{_SLASH})|{_STR}|{_CHR}|`[^`]*`|{_OPEN[:-1]}|')",
    "c": rf"(?P<c>{_SLASH}|^[ \t]*#(?:\\\n|[^\n])*)|{_STR}|{_CHR}|{_OPEN[:-1]}|')",
    "rust": rf"(?P<c>{_SLASH})|b?r(?P<h>#*)\".*?\"(?P=h)|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\[^\n']*?|[^'\\\n])'|'[A-Za-z_]\w*|{_OPEN[:-1]}|')",
    "ruby": rf"(?P<c>^=begin\b.*?^=end\b[^\n]*|#(?!\{{)[^\n]*)|<<[~-]?[\"']?(?P<h>[A-Z]\w*+)[\"']?[^\n]*\n(?:.*?\n)??[ \t]*(?P=h)\b"
    rf"|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`[^`\n]*`|%[wiqQ]?[\[({{][^\])}}]*[\])}}]|(?P<bad>^=begin\b|\"|')",
}
_LEX["typescript"] = _LEX["javascript"]
_LEXERS = {k: re.compile(v, re.S | re.M) for k, v in _LEX.items()}

_WORDS = {
    "javascript": "import export from as default const let var function class extends if else for while do switch case return throw try "
    "catch finally break continue new typeof void delete await yield in of instanceof async static get set with debugger",
    "java": "package import class interface enum record extends implements throws public private protected static final abstract native "
    "synchronized transient volatile strictfp default if else for while do switch case return throw try catch finally break continue new "
    "instanceof assert const goto yield",
    "c": "struct union enum typedef static const extern inline volatile register unsigned signed int long char short double float void "
    "bool size_t if else for while do switch case default return break continue goto sizeof",
    "go": "package import func type struct interface map chan var const if else for range switch case default select return go defer "
    "break continue goto fallthrough",
    "rust": "use mod fn struct enum trait impl const static type pub extern crate let mut ref if else for in while loop match return "
    "break continue as unsafe async await move dyn where union",
    "ruby": "def end class module if elsif else unless while until for in case when then do begin rescue ensure return yield break next "
    "redo retry not and or alias undef super",
}
_WORDS["typescript"] = _WORDS["javascript"] + " interface type enum implements abstract declare namespace readonly public private protected override satisfies keyof is infer unique asserts module"
_SOFT = {"javascript": "from as of get set static async default", "typescript": "from as of get set static async default type declare abstract readonly namespace override satisfies keyof public private protected is infer unique asserts module"}
_NAMES = {k: re.compile(rf"(?<![\w$])(?!(?:{'|'.join(v.split())})(?![\w$]))[^\W\d][\w$]*[?!]?(?<!\s)" if k == "ruby" else rf"(?<![\w$])(?!(?:{'|'.join(v.split())})(?![\w$]))(?:[^\W\d]|\$)[\w$]*") for k, v in _WORDS.items()}
_NUMBER = re.compile(r"(?<![\w@])(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)[uUlLfFdDn]*(?:[iu](?:8|16|32|64|128|size)|f32|f64)?(?!\w)")
_CONFLICT = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?:\s|$)", re.M)
_TOKEN = re.compile(r"[a-zA-Z_]+|@|\.\.[.=]?|::|=>|->|:=|<-|\?\.|\?\?=?|&&=?|\|\|=?|\+\+|--|===?|!==?|<<=?|>>>?=?|[-+*/%&|^<>!=]=|\*\*|[^\s]")
_BLANKS = re.compile(r"[ \t\r\f\v]+")

#: Lexer states in which a chunk of any language may be entered. Others are named by what ends them: "raw ##", "here TAG".
STATES = ("code", "block", "tick", "string")
_ENDS = {
    "block": re.compile(r"\*/"), "tick": re.compile(r"\A(?:\\.|[^`\\])*`", re.S), "string": re.compile(r'\A(?:\\.|[^"\\])*"', re.S),
    "char": re.compile(r"\A(?:\\.|[^'\\])*'", re.S), "text": re.compile('"""'), "go": re.compile("`"),
    "percent": re.compile(r"[\])}]"), "begin": re.compile(r"^=end\b[^\n]*", re.M),
}
# what opens a construct that its chunk does not close, where the lexer would read on at something shorter
_UNCLOSED = {
    "java": r'(?P<open>"""(?!.*?"""))|',
    "rust": r'(?P<open>b?r(?P<end>#*)"(?!.*?"(?P=end)))|',
    "ruby": r"(?P<open><<[~-]?[\"']?(?P<end>[A-Z]\w*+)[\"']?[^\n]*\n(?!(?:.*?\n)?[ \t]*(?P=end)\b)|%[wiqQ]?[\[({](?![^\])}]*[\])}]))|",
}
_SCANNERS = {k: re.compile(_UNCLOSED.get(k, "") + v, re.S | re.M) for k, v in _LEX.items()}
_OPENED = {
    "javascript": {"/*": "block", "`": "tick"}, "typescript": {"/*": "block", "`": "tick"}, "java": {"/*": "block"}, "c": {"/*": "block"},
    "go": {"/*": "block", "`": "go"}, "rust": {"/*": "block", '"': "string"}, "ruby": {"=begin": "begin", '"': "string", "'": "char"},
}


def _end(state: str) -> re.Pattern:
    """What ends STATE in a chunk that is entered in it."""
    kind, _, tag = state.partition(" ")
    if kind == "raw":
        return re.compile(re.escape('"' + tag))
    return re.compile(rf"^[ \t]*{tag}\b", re.M) if kind == "here" else _ENDS[state]


def _opened(m: re.Match, lang: str) -> str:
    """The state that the match M of a scanner leaves the lexer in."""
    if _UNCLOSED.get(lang) and m["open"]:
        if lang == "java":
            return "text"
        if lang == "rust":
            return "raw " + m["end"]
        return "here " + m["end"] if m["end"] else "percent"
    return _OPENED[lang].get(m[0], "code") if m.lastgroup == "bad" else "code"


def _flat(m: re.Match) -> str:
    kind = m.lastgroup
    if kind == "c":
        return "\n" if "\n" in m[0] else " "
    if kind == "bad":
        return "\x00"
    if kind == "rx":
        return m["rx"] + '"'
    if m[0][0] == "'" and m[0][-1] != "'":
        return "'"  # a lifetime
    return '"'


def chunk_map(text: str, lang: str, states: Iterable[str] = STATES) -> dict[str, tuple[str, int]]:
    """For each of STATES in which the chunk TEXT may be entered: the state after it, and where code begins in it."""
    out = {}
    for state in states:
        at = 0
        if state != "code":
            m = _end(state).search(text)
            if m is None:
                out[state] = (state, len(text))
                continue
            at = m.end()
        left = "code"
        for m in _SCANNERS[lang].finditer(text, at):
            left = _opened(m, lang)
            if left != "code":
                break
        out[state] = (left, at)
    return out


def chunk_maps(parts: list[str], lang: str) -> list[dict[str, tuple[str, int]]]:
    """The map of each of PARTS over all states in which one of them can be left."""
    maps, known, new = [{} for _ in parts], set(), {"code"}
    while new:
        for m, p in zip(maps, parts):
            m |= chunk_map(p, lang, new)
        known |= new
        new = {t for m in maps for t, _ in m.values()} - known
    return maps


def compose(a: dict[str, tuple[str, int]], b: dict[str, tuple[str, int]]) -> dict[str, tuple[str, int]]:
    """The map of one chunk followed by another; associative."""
    return {s: (b[t][0], at) for s, (t, at) in a.items()}


_PAIR = {")": "(", "]": "[", "}": "{"}


def bracket_summary(code: str) -> tuple[str, str]:
    """Brackets of CODE that close something before it, and those it leaves open."""
    close, stack = [], []
    for c in re.findall(r"[()\[\]{}]", code):
        if c in "([{":
            stack.append(c)
        elif stack:
            if stack.pop() != _PAIR[c]:
                raise Bad(f"{c} closes another bracket")
        else:
            close.append(c)
    return "".join(close), "".join(stack)


def join_brackets(a: tuple[str, str], b: tuple[str, str]) -> tuple[str, str]:
    """The summary of one chunk followed by another; associative."""
    n = min(len(a[1]), len(b[0]))
    for x, y in zip(reversed(a[1]), b[0][:n]):
        if _PAIR[y] != x:
            raise Bad(f"{y} closes another bracket")
    return a[0] + b[0][n:], a[1][: len(a[1]) - n] + b[1]


_SLASHED = re.compile(r"\s*/(?![*/\s])")


def chunks(text: str, size: int = CHUNK) -> list[str]:
    """TEXT cut at line ends into parts of about SIZE characters.

    No cut follows a backslash, which continues strings and directives, or stands before a slash, which may begin a
    regular expression only because of what is before it.
    """
    out, at = [], 0
    while len(text) - at > size:
        end = text.find("\n", at + size)
        while end >= 0:
            if text[end - 1] == "\\":
                end = text.find("\n", end + 1)
            elif m := _SLASHED.match(text, end + 1):
                end = text.find("\n", m.end())
            else:
                break
        if end < 0:
            break
        out.append(text[at : end + 1])
        at = end + 1
    return [*out, text[at:]]


def whole_pieces(parts: list[str], maps: list[dict[str, tuple[str, int]]]) -> list[int]:
    """For each of PARTS the number of the piece it belongs to. A construct open at a part's end runs into the next.

    What is open at the end of the text stays one piece from where it was opened, for the lexer to say whether it is an error.
    """
    out, no, state = [], 0, "code"
    for m in maps:
        out.append(no)
        state = m[state][0]
        no += state == "code"
    return out


def _entered(parts: list[str]) -> list[str]:
    """PARTS as a lexer reads them: the line end before a later one tells that it is not at the start of the text."""
    return [parts[0], *("\n" + p for p in parts[1:])]


def piece(text: str, lang: str) -> tuple[str | None, str, str, str]:
    """What the piece TEXT contributes: (error, brackets it closes, brackets it opens, its lines as shapes)."""
    code = _LEXERS[lang].sub(_flat, text)
    if "\x00" in code:
        return "a comment or string is not closed", "", "", ""
    if _CONFLICT.search(code):
        return "conflict markers", "", "", ""
    try:
        close, open_ = bracket_summary(code)
    except Bad as e:
        return str(e), "", "", ""
    return None, close, open_, shapes(code, lang)


# --- local grammars ---------------------------------------------------------------------------------------------------
# A state is what may come next; the stack holds open constructs as bracket + context + state after it.
# S statement start, E operand needed, e operand or closing bracket, O after an operand, N the same on a later line.

_BINARY = set("+ - * / % & | ^ < > <= >= == != === !== && || ?? << >> >>> ** = += -= *= /= %= &= |= ^= <<= >>= >>>= ??= &&= ||= := <- .. ..= instanceof in as".split())
_PREFIX = set("! ~ - + * & && ++ -- ... <- ..".split())
_TYPES_C = set("unsigned signed int long char short double float void bool size_t struct union enum".split())
_MODS_C = set("static const extern inline volatile register typedef".split())
_MODS_JAVA = set("public private protected static final abstract native synchronized transient volatile strictfp default".split())


class Machine:
    """Runs the tokens of one line; ``memo`` remembers what a line shape does in a state."""

    def __init__(self, lang: str):
        self.lang, self.memo = lang, {}
        self.ts = lang == "typescript"

    def line(self, shape: str, st: str, stack: list[str]) -> str:
        key = (shape, st, tuple(stack[-4:]))
        if key in self.memo:
            hit = self.memo[key]
            if hit is None:
                raise Bad(f"unexpected text: {shape[:60]}")
            keep, push, end = hit
            if keep < 0 and len(stack) + keep < 0:
                raise Bad("too many closing brackets")
            if keep:
                del stack[keep:]
            stack += push
            return end
        view = list(stack[-4:])
        base = len(view)
        self.low, self.deep = base, len(stack) > 4
        try:
            end = self.run(_TOKEN.findall(shape), st, view)
        except IndexError:
            if not self.deep:
                self.memo[key] = None
                raise Bad("too many closing brackets") from None
            self.low = 0
            return self.run(_TOKEN.findall(shape), st, stack)  # it closes more than the memo looks at
        except Bad:
            self.memo[key] = None
            raise
        low = min(self.low, len(view))
        self.memo[key] = (low - base, view[low:], end)
        if low - base:
            del stack[low - base :]
        stack += view[low:]
        return end

    def pop(self, stack: list[str], bracket: str) -> str:
        top = stack.pop()
        if len(stack) < self.low:
            self.low = len(stack)
        if top[0] != bracket:
            raise Bad("brackets cross")
        return top

    def run(self, tokens: list[str], st: str, stack: list[str]) -> str:
        for t in tokens:
            st = self.step(t, st, stack)
        return self.eol(st, stack)

    def eol(self, st: str, stack: list[str]) -> str:
        return st

    def finish(self, st: str, stack: list[str]) -> None:
        if stack:
            raise Bad("brackets are not closed")
        if st not in self.final:
            raise Bad("the last statement is not complete")

    final = ("S", "N", "O")

    # expressions, shared by all
    def expr(self, t: str, st: str, stack: list[str]) -> str:
        ctx = stack[-1][1] if stack else "f"
        if st in ("E", "e", "e0"):
            if t in ("i", "n", '"'):
                return "O"
            if t in _PREFIX:
                return "E"
            if t == "(":
                stack.append("(pO")
                return "e"
            if t == "[":
                stack.append("[xO")
                return "e"
            if t in (")", "]", "}") and st == "e":
                return self.pop(stack, _PAIR[t])[2:]
            if t == "," and ctx == "x" and st == "e" and self.lang in ("javascript", "typescript"):
                return "e"
            raise Bad(f"{t} where a value is needed")
        if st == "O":
            if t in _BINARY:
                return "E"
            if t in (".", "?.", "::"):
                return "M"
            if t == "(":
                stack.append("(pO")
                return "e"
            if t == "[":
                stack.append("[xO")
                return "e"
            if t in ("++", "--"):
                return "O"
            if t in (")", "]"):
                return self.pop(stack, _PAIR[t])[2:]
            if t == "," and ctx in "pxo":
                return "e"
            raise Bad(f"{t} after a value")
        if st == "M":
            if t == "i" or t.isalpha() and t != "n":
                return "O"
            if t == "(" and self.lang in ("java", "javascript", "typescript", "go"):
                stack.append("(pO")
                return "e"
            if t in ("<", "*", "n", "{", "[") and self.lang in ("rust", "javascript", "typescript"):
                return "T" if t == "<" else "O"
            raise Bad("no name after a dot")
        raise Bad(f"{t} is out of place")


class Script(Machine):
    """JavaScript and TypeScript."""

    final = ("S", "N", "O", "B", "e0", "L")

    def eol(self, st, stack):
        ctx = stack[-1][1] if stack else "f"
        if ctx in "fbc":
            if st in ("O", "T1", "L"):
                return "N"
            if st in ("B", "e0"):
                return "S"
            if st == "mem" or (st == "decl1" and self.ts):
                return "N" if st == "decl1" else "S"
        if ctx == "c" and st == "T":
            raise Bad("no type")
        return st

    def step(self, t, st, stack):
        ctx = stack[-1][1] if stack else "f"
        ts = self.ts
        if st == "N":
            if ctx == "c" or (t not in _BINARY and t not in (".", "?.", "(", "[", ",", ";", "?", ":", "=>", ")", "]", "}")):
                st = "S"
            else:
                st = "O"
        if t == "i" or t not in (_SOFT.get(self.lang, "")).split():
            soft = t
        else:
            soft = "i"
        if st == "S":
            if ctx == "c":
                return self.member(t, soft, stack)
            return self.statement(t, soft, stack, ctx)
        if st == "L":  # a name at statement start: a label, or a value
            if t == ":":
                return "S"
            st = "O"
        if st == "SD":  # what is exported by default
            if t == "{":
                stack.append("{oO")
                return "K"
            return "fn" if t == "function" else self.step(t, "S" if t in ("class", "abstract", "interface", "async") else "E", stack)
        if st == "fn0":
            if t == "*" or soft == "i":
                return "fn0" if t == "*" else "fn"
            raise Bad("a function without name")
        if st == "stat":
            if t == "{":
                stack.append("{bS")
                return "S"
            if t in ("=", ";", "(", ":", "?"):
                return self.step(t, "mem", stack)
            return self.member(t, soft, stack)
        if st == "en":
            return "en1" if soft == "i" else self.expr(t, "M", stack)
        if st == "en1":
            if t == "{":
                stack.append("{eS")
                return "em"
            raise Bad("odd enum")
        if st == "em":
            if soft in ("i", '"') or t.isalpha() and t != "n":
                return "em1"
            if t == "}":
                return self.pop(stack, "{")[2:]
            raise Bad("odd enum")
        if st == "em1":
            if t == "=":
                return "E"
            return self.step(t, "O", stack) if t in (",", "}") else self.expr(t, "M", stack)
        if st == "ta":
            if soft == "i":
                return "ta1"
            if t in ("{", "*"):
                return "exports"
            return self.step(t, "O", stack)
        if st == "ta1":
            if t == "<":
                stack.append("<gta1")
                return "T"
            if t == "=":
                return "T"
            return self.step(t, "O", stack)
        if st == "mod":
            if soft == "i":
                return "mod" if t != "i" else "O"
            if t in ("{", "["):
                return self.step(t, "E", stack)
            raise Bad("no parameter after its modifier")
        if st == "modl":
            return "ns" if t == '"' or soft == "i" else self.step(t, "O", stack)
        if st == "fromx":
            return "O" if t == '"' else self.step(t, "exports", stack)
        if st == "mem":
            if t == "(":
                stack.append("(qFb")
                return "e"
            if t == "=":
                return "E"
            if t == ";":
                return "S"
            if t == "}":
                return self.pop(stack, "{")[2:]
            if ts and t in ("?", "!"):
                return "mem"
            if ts and t == ":":
                return "T"
            if ts and t == "<":
                stack.append("<gmem")
                return "T"
            if soft == "i" or t in ("*", '"', "n"):
                return "mem"
            if t == "[":
                stack.append("[kmem" if ts else "[xmem")
                return "e"
            raise Bad(f"{t} in a class body")
        if st[0] == "F":  # after parameters
            if t == "{":
                stack.append("{bS" if st == "Fb" else "{bO")
                return "S"
            if ts and t == ":":
                stack.append("rr" + st)
                return "T"
            if ts and t == ";" and st == "Fb":
                return "S"
            if ts and ctx == "c" and t == "}":
                return self.pop(stack, "{")[2:]
            raise Bad("no body after parameters")
        if st in ("T", "T1", "T2", "Tq"):
            return self.type(t, st, stack)
        if st == "import":
            if t == '"':
                return "O"
            if t in ("i", "*", ",", "{", "}", "as", "default") or soft == "i" and t != "from":
                return "import"
            if t == "from":
                return "from"
            if t in ("(", "."):
                return self.step(t, "O", stack)
            raise Bad("import names nothing")
        if st == "from":
            if t == '"':
                return "O"
            raise Bad("import from nothing")
        if st == "export":
            if t == "default":
                return "SD"
            if t in ("const", "let", "var", "function", "class", "async", "interface", "type", "enum", "abstract", "declare", "namespace"):
                return self.statement(t, t, stack, ctx)
            if t in ("{", "*"):
                return "exports"
            raise Bad("export of nothing")
        if st == "exports":
            if t == "from":
                return "fromx"
            if t in ("i", ",", "as", "}", "default") or soft == "i":
                return "exports" if t != "}" else "O1"
            if t == "from":
                return "from"
            raise Bad("odd export")
        if st == "O1":
            if t == "from":
                return "from"
            return self.step(t, "N", stack)
        if st == "decl":
            if ts and t == "enum":
                return "en"
            if soft == "i":
                return "decl1"
            if t in ("{", "["):
                stack.append(t + "odecl1" if t == "{" else "[xdecl1")
                return "K" if t == "{" else "e"
            raise Bad("declaration without name")
        if st == "decl1":
            if t == "=":
                return "E"
            if t == ",":
                return "decl"
            if t == ";":
                return "S"
            if t in ("of", "in") and ctx == "p":
                return "E"
            if ts and t == ":":
                return "T"
            if ts and t == "!":
                return "decl1"
            if ts and ctx in "fb" and t == "}":
                return self.pop(stack, "{")[2:]
            raise Bad(f"{t} in a declaration")
        if st in ("fn", "fnx"):
            if t == "*" or soft == "i":
                return st
            if t == "(":
                stack.append("(qFb" if st == "fn" else "(qFx")
                return "e"
            if ts and t == "<":
                stack.append("<g" + st)
                return "T"
            raise Bad("odd function head")
        if st in ("cls", "clsx"):
            if soft == "i" or t in ("extends", "implements", ",", "."):
                return st
            if ts and t == "<":
                stack.append("<g" + st)
                return "T"
            if t == "{":
                stack.append("{cS" if st == "cls" else "{cO")
                return "S"
            raise Bad("odd class head")
        if st == "ns":
            if t == "{":
                stack.append("{bS")
                return "S"
            if soft == "i" or t in (".", '"'):
                return "ns"
            raise Bad("odd namespace")
        if st == "cond":
            if t == "(":
                stack.append("(pS")
                return "e"
            if t == "await":
                return "cond"
            raise Bad("no condition")
        if st == "catch":
            if t == "{":
                stack.append("{bS")
                return "S"
            return self.step(t, "cond", stack)
        if st == "B":
            if soft == "i":
                return "B"
            if t == ";":
                return "S"
            if t == "}":
                return self.pop(stack, "{")[2:]
            raise Bad("odd jump")
        if st == "async":
            if t == "function":
                return "fn"
            return self.step(t, "O" if t == "=>" else "E", stack)
        if st == "K":  # a key of an object
            if t == "*":
                return "K"
            if soft in ("i", '"', "n") or t.isalpha():
                return "k"
            if t == "...":
                return "E"
            if t == "[":
                stack.append("[xk")
                return "e"
            if t == "}":
                return self.pop(stack, "{")[2:]
            raise Bad("odd key")
        if st == "k":
            if t == ":":
                return "E"
            if t == ",":
                return "K"
            if t == "=":
                return "E"
            if t == "(":
                stack.append("(qFo")
                return "e"
            if t == "}":
                return self.pop(stack, "{")[2:]
            if soft in ("i", '"', "n") or t == "*" or t.isalpha():
                return "k"
            if t == "[":
                stack.append("[xk")
                return "e"
            raise Bad("odd key")
        if st == "arrow":
            if t == "{":
                stack.append("{bO")
                return "S"
            st = "E"
        if st in ("E", "e", "e0"):
            if st == "e0" and t == ";":
                return "S"
            if st == "e0" and t == "}":
                return self.pop(stack, "{")[2:]
            if t in ("new", "typeof", "void", "delete", "await", "yield"):
                return "E"
            if t == "function":
                return "fnx"
            if t == "class":
                return "clsx"
            if t == "async":
                return "async"
            if t == "{":
                stack.append("{oO")
                return "K"
            if t in ("const", "let", "var") and ctx == "p":
                return "decl"
            if t == ";" and ctx == "p" and stack[-1] == "(pS":
                return "e"
            if ts and ctx == "q" and t in ("public", "private", "protected", "readonly", "override"):
                return "mod"
            if soft == "i":
                return "O"
            if ts and t == "<":
                stack.append("<gE")
                return "T"
            return self.expr(t, st, stack)
        if st == "O":
            if t == "=>":
                return "arrow"
            if t == "?":
                if ts and ctx == "q":
                    return "O"
                stack.append("?tE")
                return "E"
            if t == ":":
                if ctx == "t":
                    self.pop(stack, "?")
                    return "E"
                if ctx == "s":
                    self.pop(stack, "?")
                    return "S"
                if ts and ctx in "qpk":
                    return "T"
                if ts and ctx in "fbo":
                    stack.append("aaarrow")
                    return "T"
                raise Bad(": after a value")
            if ts and t in ("as", "satisfies"):
                return "T"
            if ts and t == "!":
                return "O"
            if t == ";":
                if ctx in "fbc":
                    return "S"
                if ctx == "p" and stack[-1] == "(pS":
                    return "e"
                raise Bad("; inside brackets")
            if t == "of" and ctx == "p":
                return "E"
            if ctx == "e" and t == ",":
                return "em"
            if t == "}":
                if ctx in "bce":
                    return self.pop(stack, "{")[2:]
                if ctx == "o":
                    return self.pop(stack, "{")[2:]
                raise Bad("} inside brackets")
            if t == ",":
                if ctx == "o":
                    return "K"
                if ctx in "fb":
                    return "E"
                if ctx == "q":
                    return "e"
            if t == '"':
                raise Bad("a string after a value")
            if t in (")", "]") and ctx == "q":
                return self.pop(stack, _PAIR[t])[2:]
            return self.expr(t, st, stack)
        if st == "M" and t == "[":
            stack.append("[xO")
            return "e"
        if st == "M" and t == "#":
            return "M"
        return self.expr(t if soft != "i" else "i", st, stack)

    def type(self, t, st, stack):
        ctx = stack[-1][1] if stack else "f"
        if st == "T1":
            if t in ("is", "as", "satisfies"):
                return "T"
            if t == "?":
                return "Tq"
            if t == ":" and ctx == "T":
                self.pop(stack, "?")
                return "T"
            if t == "=>" and ctx == "a":
                self.pop(stack, "a")
                return "arrow"
            if t in ("-", "+"):
                return "T2"
        if st == "T2":  # -? or +? of a mapped type
            if t == "?":
                return "T1"
            st = "T1"
        if st == "Tq":
            if t in (":", ",", "]", ")", ";", "}", "="):
                st = "T1"
            else:
                stack.append("?TT")
                return self.type(t, "T", stack)
        if t == "=" and ctx == "g":
            return "T"
        if st == "T" and t in ("infer", "unique", "asserts"):
            return "T"
        if t in ("i", '"', "n", "void", "typeof", "keyof", "new", "readonly", "in", "extends", "const", "null") or t in _SOFT["typescript"].split():
            if st == "T1" and t == "i":
                raise Bad("two types in a row")
            return "T1" if t not in ("typeof", "keyof", "readonly", "in", "extends", "new") else "T"
        if t in ("|", "&", ".", "=>", "?", "-", "..."):
            return "T"
        if t == "[":
            stack.append("[yT1")
            return "T"
        if t == "]":
            return self.pop(stack, "[")[2:]
        if t == "<":
            stack.append("<gT1")
            return "T"
        if t in (">", ">>"):
            for _ in t:
                end = self.pop(stack, "<")[2:]
            return end
        if t == "(":
            stack.append("(yT1")
            return "T"
        if t == ")":
            return self.pop(stack, "(")[2:]
        if t == "{":
            if ctx == "r":
                st0 = self.pop(stack, "r")[2:]
                stack.append("{bS" if st0 == "Fb" else "{bO")
                return "S"
            stack.append("{yT1")
            return "T"
        if t == "}":
            return self.pop(stack, "{")[2:]
        if t in (",", ":", ";") and ctx in "gy":
            return "T"
        if ctx == "r" and t in (";",):
            self.pop(stack, "r")
            return "S"
        if t == "=" and st == "T1":
            return "E"
        if st == "T1":
            return self.step(t, "O", stack)
        raise Bad(f"{t} in a type")

    def member(self, t, soft, stack):
        if t == "}":
            return self.pop(stack, "{")[2:]
        if t == ";":
            return "S"
        if t == "static":
            return "stat"
        if soft in ("i", '"', "n") or t in ("*", "#", "delete", "new", "default", "import", "return"):
            return "mem"
        if t == "[":
            stack.append("[kmem" if self.ts else "[xmem")
            return "e"
        if t in ("(", "<") and self.ts:
            return self.step(t, "mem", stack)
        if t == "@" and self.ts:
            return "E"
        if t == ",":
            return "S"
        raise Bad(f"{t} in a class body")

    def statement(self, t, soft, stack, ctx):
        if t == ";":
            return "S"
        if t == "}":
            if ctx not in "b":
                raise Bad("} closes nothing")
            return self.pop(stack, "{")[2:]
        if t == "{":
            stack.append("{bS")
            return "S"
        if t == "import":
            return "import"
        if t == "export":
            return "export"
        if t in ("const", "let", "var"):
            return "decl"
        if t == "function":
            return "fn0"
        if t == "class" or self.ts and t == "interface":
            return "cls"
        if self.ts and t == "enum":
            return "en"
        if self.ts and t == "module":
            return "modl"
        if self.ts and t in ("abstract", "declare"):
            return "S"
        if self.ts and t in ("type", "namespace"):
            return "ta" if t == "type" else "ns"
        if t in ("if", "while", "for", "switch", "with"):
            return "cond"
        if t == "catch":
            return "catch"
        if t in ("else", "do", "try", "finally"):
            return "S"
        if t in ("return",):
            return "e0"
        if t == "throw":
            return "E"
        if t in ("break", "continue", "debugger"):
            return "B"
        if t == "case":
            stack.append("?sS")
            return "E"
        if t == "default":
            stack.append("?sS")
            return "O"
        if t == "async":
            return "async"
        if t == "@" and self.ts:
            return "E"
        if t == "i":
            return "L"
        return self.step(t, "E", stack)


class Curly(Machine):
    """Java and C: declarations of a type and a name, statements end with a semicolon."""

    final = ("S",)

    def step(self, t, st, stack):
        ctx = stack[-1][1] if stack else "f"
        java = self.lang == "java"
        if java and t == "record" and st != "S":
            t = "i"
        if java and t == "yield" and st != "S":
            t = "i"
        if st == "S" and java and ctx == "b" and t in ("default", "yield", "record"):
            if t == "default":
                stack.append("?sS")
                return "O"
            return t
        if st == "yield":  # a value of a switch, or a name
            return self.step(t, "x1" if t in ("=", ".", "++", "--", "[") else "E", stack)
        if st == "record":
            return "rc" if t == "i" else self.step(t, "x1", stack)
        if st == "rc":
            return self.step(t, "cls" if t in ("(", "<") else "d2", stack)
        if st == "Oc":  # after parentheses: a cast, or a value
            if t in ("i", "n", '"', "!", "~"):
                return self.step(t, "E", stack)
            st = "O"
        if st == "case":  # after the arrow of a case
            if t == ";":
                raise Bad("a case without body")
            return self.step(t, "S", stack)
        if java and st == "S" and ctx == "b" and t == "synchronized":
            return "cond"
        if java and st in ("E", "e", "e0", "Ei") and t == "(":
            stack.append("(pOc")
            return "e"
        if st == "seal":
            return self.step(t, "S", stack) if t in _MODS_JAVA or t in ("class", "interface", "record", "i", "-") else self.expr(t, "M", stack)
        if st == "S":
            if t == ";":
                return "S"
            if t == "}":
                if ctx not in "bcn":
                    raise Bad("} closes nothing")
                return self.pop(stack, "{")[2:]
            if java and t == "@":
                return "at"
            if java and ctx == "f":
                if t in ("package", "import"):
                    return "path"
                if t in _MODS_JAVA:
                    return "S"
                if t in ("class", "interface", "enum", "record"):
                    return "cls" if t != "enum" else "enum"
                if t == "i":
                    return "seal"
                raise Bad(f"{t} outside a class")
            if t in _MODS_JAVA and java or not java and t in _MODS_C:
                return "S"
            if t in ("class", "interface", "enum", "record") and java:
                return "cls" if t != "enum" else "enum"
            if not java and t in ("struct", "union", "enum"):
                return "tag" if t != "enum" else "etag"
            if not java and t in _TYPES_C:
                return "ty"
            if ctx in "fc":
                if t == "i":
                    return "d1"
                if t == "<" and java:
                    stack.append("<gS")
                    return "G"
                if t == "{" and ctx == "c" and java:
                    stack.append("{bS")
                    return "S"
                raise Bad(f"{t} is no declaration")
            if t == "{":
                stack.append("{bS")
                return "S"
            if t == "catch" and java:
                return "catch"
            if t in ("if", "while", "for", "switch", "synchronized", "catch"):
                return "cond"
            if t in ("else", "do", "finally"):
                return "S"
            if t == "try":
                return "try"
            if t == "return":
                return "e0"
            if t == "assert" and java:
                stack.append("?AS")
                return "E"
            if t in ("throw", "goto"):
                return "E"
            if t in ("break", "continue"):
                return "B"
            if t == "case":
                stack.append("?sS")
                return "E"
            if t == "default":
                stack.append("?sS")
                return "O"
            if t == "i":
                return "x1"
            return self.step(t, "E", stack)
        if st == "at":
            if t == "i":
                return "at1"
            if t == "interface":
                return "cls"
            raise Bad("odd annotation")
        if st == "at1":
            if t == ".":
                return "at"
            if t == "(":
                stack.append("(pS")
                return "e"
            return self.step(t, "S", stack)
        if st == "path":
            if t in ("i", ".", "*", "static"):
                return "path1" if t in "i*" else "path"
            raise Bad("odd path")
        if st == "path1":
            if t == ".":
                return "path"
            if t == ";":
                return "S"
            raise Bad("odd path")
        if st in ("cls", "enum"):
            if t in ("i", ".", ",", "extends", "implements"):
                return st
            if t == "<":
                stack.append("<g" + st)
                return "G"
            if t == "(":
                stack.append("(q" + st)
                return "q"
            if t == "{":
                stack.append("{cS" if st == "cls" else "{nS")
                return "S" if st == "cls" else "e"
            raise Bad("odd class head")
        if st in ("tag", "etag"):
            if t == "i":
                return st + "1"
            if t == "{":
                stack.append("{cty2" if st == "tag" else "{oty2")
                return "S" if st == "tag" else "e"
            raise Bad("odd struct")
        if st in ("tag1", "etag1"):
            if t == "{":
                stack.append("{cty2" if st == "tag1" else "{oty2")
                return "S" if st == "tag1" else "e"
            if t == ";":
                return "S"
            return self.step(t, "ty", stack)
        if st == "G":
            if t in ("i", ",", ".", "?", "&", "extends", "[", "]", "super"):
                return "G"
            if t == "<":
                stack.append("<gG")
                return "G"
            if t in (">", ">>"):
                for _ in t:
                    end = self.pop(stack, "<")[2:]
                return end
            raise Bad("odd type arguments")
        if st == "ty2":  # after the body of a type
            return self.step(t, "ty" if t == "*" or t == "i" else "d2", stack)
        if st == "ty":
            if t in _TYPES_C or t in _MODS_C or t == "*":
                return "ty"
            if t == "i":
                return "d2"
            if t == "(":
                stack.append("(qd2")
                return "q"
            raise Bad("type without name")
        if st == "d1":  # a type at the place of a declaration
            if t == ".":
                return "S1"
            if t == "<" and java:
                stack.append("<gd1")
                return "G"
            if t == "[" and java:
                stack.append("[xd1")
                return "e"
            if t == "*" and not java or not java and t in _MODS_C:
                return "ty"
            if t == "i":
                return "d2"
            if t == "(" and java:
                stack.append("(qh")
                return "q"
            if t == "{" and java and ctx == "c":  # the short constructor of a record
                stack.append("{bS")
                return "S"
            raise Bad(f"{t} after a type")
        if st == "S1":
            if t == "i":
                return "d1"
            raise Bad("odd type")
        if st == "d2":  # after the name
            if t == "(":
                stack.append("(qh")
                return "q"
            if t == "=":
                return "Ei"
            if t == ";":
                return "S"
            if t == ",":
                return "ty" if not java else "S1x"
            if t == "[":
                stack.append("[xd2")
                return "e"
            if t == ":" and ctx == "p":
                return "E"
            if t == ":" and not java and ctx == "c":
                return "E"
            raise Bad(f"{t} after a name")
        if st == "S1x":
            if t == "i":
                return "d2"
            raise Bad("odd declaration")
        if st == "h":  # after parameters
            if t == "{":
                stack.append("{bS")
                return "S"
            if t == ";":
                return "S"
            if java and t in ("throws", "i", ",", "."):
                return "h"
            if java and t == "default" or not java and t == "=":
                return "Ei"
            if not java and (t == "i" or t in _TYPES_C):
                return "kr"
            raise Bad("no body after parameters")
        if st == "kr":  # declarations of parameters between their names and the body
            if t in ("i", "*", ",", ";") or t in _TYPES_C or t in _MODS_C:
                return "kr" if t != ";" else "kr1"
            raise Bad("odd parameter")
        if st == "kr1":
            return self.step(t, "h", stack)
        if st == "q":  # parameters
            if java and t == "|":
                return "q"
            if t in ("i", ",", "*", "[", "]", "...", "<", ">", "?", ".", "&", "n", "@") or t in _MODS_C or t in _TYPES_C or t in _MODS_JAVA:
                return "q1" if t == "i" else "q"
            if t == "(":
                stack.append("(qq")
                return "q"
            if t == ")":
                return self.pop(stack, "(")[2:]
            raise Bad("odd parameter")
        if st == "q1":
            if t == "i":
                return "q2"
            return self.step(t, "q", stack)
        if st == "q2":
            if t == "i":
                raise Bad("three names in a row")
            return self.step(t, "q", stack)
        if st == "cond":
            if t == "(":
                stack.append("(pS")
                return "pe"
            raise Bad("no condition")
        if st == "catch":
            if t == "(":
                stack.append("(qS")
                return "q"
            raise Bad("catch of nothing")
        if st == "pe":
            if t in _TYPES_C and not java or t in _MODS_C and not java or java and t == "final":
                return "ty" if not java else "pe"
            if t == "i":
                return "x1"
            return self.step(t, "e", stack)
        if st == "try":
            if t == "{":
                stack.append("{bS")
                return "S"
            if t == "(":
                stack.append("(pS")
                return "pe"
            raise Bad("odd try")
        if st == "B":
            if t == "i":
                return "B"
            if t == ";":
                return "S"
            raise Bad("odd jump")
        if st == "x1":  # a name at statement start: value or type
            if t == "i":
                return "d2"
            if t == ":" and ctx == "b":
                return "S"
            if t == "<" and java and ctx != "p":
                stack.append("<gd1")
                return "G"
            if t == "<" and java:
                return "x2"
            if t == "[" and java:
                stack.append("[xx1")
                return "e"
            st = "O"
        if st == "x2":
            return self.step(t, "E", stack) if t != ">" else "d1"
        if st == "dia":  # after < : the empty arguments of new, a wildcard, or a comparison
            return "O" if t == ">" else self.step(t, "E", stack)
        if st == "io":
            return "io1" if t == "i" else "io" if t in ("final", "@") else self.expr(t, "M", stack)
        if st == "io1":
            if t == ".":
                return "io"
            if t == "<":
                stack.append("<gio1")
                return "G"
            if t == "(":
                stack.append("(qO")
                return "q"
            return "O" if t == "i" else self.step(t, "O", stack)
        if st in ("E", "e", "e0", "Ei"):
            if t == ";" and (st == "e0" or ctx == "p" and stack[-1] == "(pS"):
                return "S" if st == "e0" else "e"
            if (st == "Ei" or st == "E" and ctx == "o") and t == "{":
                stack.append("{oO")
                return "e"
            if ctx == "n" and t == ";":
                top = self.pop(stack, "{")
                stack.append("{c" + top[2:])
                return "S"
            if st == "e" and t == "{" and ctx == "o":
                stack.append("{oO")
                return "e"
            if st == "e" and t == "." and ctx == "o" and not java:
                return "M"
            if st == "Ei":
                st = "E"
            if t == "new" and java or t == "sizeof":
                return "E"
            if t in _TYPES_C and not java or java and t == "switch":
                return "cast" if not java else "cond"
            return self.expr(t, st, stack)
        if st == "cast":
            if t in _TYPES_C or t in ("*", "const"):
                return "cast"
            if t == ")":
                self.pop(stack, "(")
                return "E1"
            raise Bad("odd cast")
        if st == "E1":
            if t in ("i", "n", '"', "(", "-", "&", "*", "!", "~"):
                return self.expr(t, "E", stack)
            return self.step(t, "O", stack)
        if st == "O":
            if t == "?":
                stack.append("?tE")
                return "E"
            if t == ":":
                if ctx == "t":
                    self.pop(stack, "?")
                    return "E"
                if ctx == "s":
                    self.pop(stack, "?")
                    return "S"
                if ctx == "A":
                    return "E"
                raise Bad(": after a value")
            if t == ";" and ctx == "A":
                self.pop(stack, "?")
                return "S"
            if t == ";" and ctx == "n":
                top = self.pop(stack, "{")
                stack.append("{c" + top[2:])
                return "S"
            if t == ";":
                if ctx in "fbc":
                    return "S"
                if ctx == "p" and stack[-1] == "(pS":
                    return "e"
                raise Bad("; inside brackets")
            if java and t == "<":
                return "dia"
            if java and t == "instanceof":
                return "io"
            if t == "," and ctx == "s":
                return "E"
            if t == "," and ctx in "fbcn":
                return "E" if ctx != "n" else "e"
            if t == "}":
                if ctx in "on":
                    return self.pop(stack, "{")[2:]
                raise Bad("} before the end of a statement")
            if t == "->" and (java or self.lang == "c"):
                if not java:
                    return "M"
                if ctx == "s":
                    self.pop(stack, "?")
                    return "case"
                return "arrow"
            if t == "{" and java and ctx == "n":
                stack.append("{cO")
                return "S"
            if t == "{" and java:
                stack.append("{oO")
                return "e"
            if t == '"' and self.lang == "c":
                return "O"
            return self.expr(t, st, stack)
        if st == "arrow":
            if t == "{":
                stack.append("{bO")
                return "S"
            return self.step(t, "E", stack)
        return self.expr(t, st, stack)


class Go(Machine):
    final = ("S", "N", "O")

    def eol(self, st, stack):
        ctx = stack[-1][1] if stack else "f"
        if ctx in "fbcgi":
            if st in ("O", "e0", "B", "spec", "spec1", "fld", "fld1", "fld2", "imp1", "res", "T1"):
                return "S"
            if st in ("M", "E") or st == "S":
                return st
        if ctx == "h" and st in ("O",):
            raise Bad("a block must open on the same line")
        if ctx in "pxoq" and st == "O":
            raise Bad("a line inside brackets must end with a comma") if ctx != "q" else Bad("odd parameters")
        return st

    def step(self, t, st, stack):
        ctx = stack[-1][1] if stack else "f"
        if st == "S":
            if t == ";":
                return "S"
            if t in ("}", ")"):
                if t == "}" and ctx in "bc" or t == ")" and ctx in "gi":
                    return self.pop(stack, _PAIR[t])[2:]
                raise Bad(f"{t} closes nothing")
            if ctx == "g":
                return "spec" if t == "i" else self.bad(t)
            if ctx == "i":
                return self.step(t, "imp", stack)
            if ctx == "c":
                if t in ("i", "*"):
                    return "fld" if t == "*" else "fld1"
                raise Bad("odd field")
            if t == "package" and ctx == "f":
                return "pkg"
            if t == "import" and ctx == "f":
                return "imp"
            if t == "func" and ctx == "f":
                return "func"
            if t in ("var", "const", "type"):
                return "spec0" if t != "type" else "typ"
            if ctx == "f":
                raise Bad(f"{t} outside a function")
            if t in ("if", "for", "switch", "select"):
                stack.append("hhS")
                return "e"
            if t == "else":
                return "else"
            if t == "return":
                return "e0"
            if t in ("go", "defer"):
                return "E"
            if t in ("break", "continue", "goto", "fallthrough"):
                return "B"
            if t == "case":
                stack.append("?sS")
                return "E"
            if t == "default":
                stack.append("?sS")
                return "O"
            if t == "{":
                stack.append("{bS")
                return "S"
            return self.step(t, "E", stack)
        if st == "else":
            if t == "{":
                stack.append("{bS")
                return "S"
            if t == "if":
                stack.append("hhS")
                return "e"
            raise Bad("odd else")
        if st == "pkg":
            return "O" if t == "i" else self.bad(t)
        if st == "imp":
            if t == "(":
                stack.append("(iO")
                return "S"
            if t in ("i", ".", "_"):
                return "imp2"
            return "imp1" if t == '"' else self.bad(t)
        if st == "imp2":
            return "imp1" if t == '"' else self.bad(t)
        if st == "imp1":
            return "S" if t == ";" else self.bad(t)
        if st == "func":
            if t == "i":
                return "func1"
            if t == "(":
                stack.append("(qfunc")
                return "q"
            raise Bad("odd func")
        if st == "funct":  # a function as the element type of a map
            if t == "(":
                stack.append("(qrest")
                return "q"
            raise Bad("odd func")
        if st == "rest":
            if t in ("i", "*", ".", "["):
                if t == "[":
                    stack.append("[qrest")
                    return "q"
                return "rest"
            return self.step(t, "O", stack)
        if st in ("func1", "funcx"):
            if t == "(":
                stack.append("(qres" if st == "func1" else "(qresx")
                return "q"
            if t == "[":
                stack.append("[q" + st)
                return "q"
            raise Bad("odd func")
        if st in ("res", "resx"):
            if t == "{":
                stack.append("{bS" if st == "res" else "{bO")
                return "S"
            if t in ("i", "*", ".", "map", "chan", "interface", "func"):
                return st
            if t in ("(", "["):
                stack.append(t + "q" + st)
                return "q"
            raise Bad("odd result")
        if st == "q":
            if t in ("i", ",", "*", ".", "...", "map", "chan", "func", "interface", "struct", "<-", "n", "{", "}", "~", "|"):
                return "q1" if t == "i" else "q"
            if t in ("(", "["):
                stack.append(t + "qq")
                return "q"
            if t in (")", "]"):
                return self.pop(stack, _PAIR[t])[2:]
            raise Bad("odd parameter")
        if st == "q1":
            if t == "i":
                return "q2"
            return self.step(t, "q", stack)
        if st == "q2":
            if t == "i":
                raise Bad("three names in a row")
            return self.step(t, "q", stack)
        if st == "spec0":
            if t == "(":
                stack.append("(gO")
                return "S"
            return "spec" if t == "i" else self.bad(t)
        if st == "spec":
            if t == "=":
                return "E"
            if t == ",":
                return "spec0"
            if t in ("i", "*", "[", "map", "chan", "func"):
                if t == "[":
                    stack.append("[qspec")
                    return "q"
                return "spec1" if t == "i" else "spec"
            if t == ";":
                return "S"
            raise Bad("odd declaration")
        if st == "spec1":
            if t == "=":
                return "E"
            if t == ".":
                return "spec"
            if t == ";":
                return "S"
            raise Bad("odd declaration")
        if st == "typ":
            return "typ1" if t == "i" else self.bad(t)
        if st == "typ1":
            if t in ("struct", "interface"):
                return "typ2"
            if t in ("i", "*", ".", "map", "func", "chan", "="):
                return "T1" if t == "i" else "typ1"
            if t in ("(", "["):
                stack.append(t + "qtyp1")
                return "q"
            raise Bad("odd type")
        if st == "T1":
            if t == ".":
                return "typ1"
            return "S" if t == ";" else self.bad(t)
        if st == "typ2":
            if t == "{":
                stack.append("{cO")
                return "S"
            raise Bad("odd type")
        if st in ("fld", "fld1"):
            if t in ("i", "*", ".", ",", "map", "chan", "func", '"', "interface", "struct"):
                if t == "i" and st == "fld1":
                    return "fld2"
                return "fld1" if t in ("i", '"') else "fld"
            if t in ("(", "["):
                stack.append(t + "qfld")
                return "q"
            if t == "}":
                return self.pop(stack, "{")[2:]
            if t == ";":
                return "S"
            raise Bad("odd field")
        if st == "fld2":
            if t in (".", '"', "}", ";", "{"):
                return self.step(t, "fld", stack)
            raise Bad("odd field")
        if st == "B":
            return "B" if t == "i" else "S" if t == ";" else self.step(t, "O", stack)
        if st in ("E", "e", "e0"):
            if st == "e0" and t == ";":
                return "S"
            if st == "e0" and t == "}":
                return self.pop(stack, "{")[2:]
            if ctx == "h" and t == "{":
                self.pop(stack, "h")
                stack.append("{bS")
                return "S"
            if ctx == "h" and t == ";":
                return "e"
            if t == "range":
                return "E"
            if t == "type" and ctx == "p":
                return "O"
            if t == "func":
                return "funcx"
            if t in ("map", "chan", "struct", "interface"):
                return "O"
            if t == "{" and ctx == "o":
                stack.append("{oO")
                return "e"
            if t == "[":
                stack.append("[xA")
                return "e"
            return self.expr(t, st, stack)
        if st == "A":  # after [ ] where a value is needed: the element type
            if t in ("i", "*", "[", "map"):
                if t == "[":
                    stack.append("[xA")
                    return "e"
                return "O" if t == "i" else "A"
            raise Bad("no element type")
        if st == "O":
            if t == ";":
                if ctx in "fbcgi":
                    return "S"
                if ctx == "h":
                    return "e"
                raise Bad("; inside brackets")
            if t == "{":
                if ctx == "h":
                    self.pop(stack, "h")
                    stack.append("{bS")
                    return "S"
                stack.append("{oO")
                return "e"
            if t == "}":
                if ctx in "bo":
                    return self.pop(stack, "{")[2:]
                raise Bad("} inside brackets")
            if t == ":":
                if ctx == "s":
                    self.pop(stack, "?")
                    return "S"
                if ctx in "ox":
                    return "e"
                if ctx == "b":
                    return "S"
                raise Bad(": after a value")
            if t == ",":
                return "e" if ctx in "pxo" else "E"
            if t == "func":
                return "funct"
            if t == "else" and not stack:
                raise Bad("else outside")
            if t == "else":
                return "else"
            return self.expr(t, st, stack)
        return self.expr(t, st, stack)

    def bad(self, t):
        raise Bad(f"{t} is out of place")


class Rust(Machine):
    final = ("S",)

    def step(self, t, st, stack):
        ctx = stack[-1][1] if stack else "f"
        if st == "S":
            if t == ";":
                return "S"
            if t == "}":
                if ctx not in "bc":
                    raise Bad("} closes nothing")
                return self.pop(stack, "{")[2:]
            if t == "#":
                return "at"
            if t == "pub":
                return "pub"
            if t in ("unsafe", "async", "extern", "default"):
                return "mod"
            if t in ("use", "mod", "crate"):
                return "path"
            if t == "fn":
                return "fn"
            if t in ("struct", "enum", "union"):
                return "st"
            if t in ("trait", "impl"):
                return "impl"
            if t in ("const", "static", "type"):
                return "let"
            if ctx in "fc":
                if t == "i":
                    return "mac"
                raise Bad(f"{t} is no item")
            if t == "let":
                return "let"
            if t == "'":
                return "life"
            if t == "{":
                stack.append("{bS")
                return "S"
            if t in ("if", "while", "for", "match", "loop"):
                stack.append("hhS")
                return "h1" if t == "for" else "e"
            if t == "else":
                return "else"
            if t in ("return", "break", "continue"):
                return "e0"
            if t in (".", "?"):
                return self.step(t, "O", stack)
            if t == "," and ctx == "b":  # after the block of an arm
                return "S"
            return self.step(t, "E", stack)
        if st == "mod":
            if t == '"':
                return "mod"
            if t == "{":
                stack.append("{bS")
                return "S"
            return self.step(t, "S", stack)
        if st == "pub":
            if t == "(":
                stack.append("(pS")
                return "e"
            if t == "i" and ctx == "c":
                return "fld"
            return self.step(t, "S", stack)
        if st == "mac":  # a macro, or a field or variant
            if t == "!":
                return "mac1"
            if ctx == "c" and t in (":", ",", "(", "{", "=", "}"):
                return self.step(t, "fld", stack)
            raise Bad("odd item")
        if st == "mac1":
            if t in ("(", "[", "{"):
                stack.append(t + "zS")
                return "z"
            if t == "i":
                return "mac1"
            raise Bad("odd macro")
        if st == "z":  # inside a macro: anything balanced
            if t in ("(", "[", "{"):
                stack.append(t + "zz")
                return "z"
            if t in (")", "]", "}"):
                return self.pop(stack, _PAIR[t])[2:]
            return "z"
        if st == "fld":
            if t == ":":
                return "T"
            if t == ",":
                return "S"
            if t in ("(", "{"):
                stack.append("(qfld" if t == "(" else "{cfld")
                return "q" if t == "(" else "S"
            if t == "=":
                return "E"
            if t == "}":
                return self.pop(stack, "{")[2:]
            raise Bad("odd field")
        if st == "at":
            if t == "!":
                return "at"
            if t == "[":
                stack.append("[zS")
                return "z"
            raise Bad("odd attribute")
        if st == "path":
            if t in ("i", "::", "*", "as", "crate"):
                return "path"
            if t == "{":
                stack.append("{bS")
                return "S"
            if t == ";":
                return "S"
            raise Bad("odd path")
        if st == "fn":
            if t == "i":
                return "fn1"
            raise Bad("fn without name")
        if st == "fn1":
            if t == "(":
                stack.append("(qh")
                return "q"
            if t == "<":
                stack.append("<gfn1")
                return "T"
            raise Bad("odd fn")
        if st == "h":
            if t == "->":
                return "R"
            if t == "where":
                return "R"
            if t == "{":
                stack.append("{bS")
                return "S"
            if t == ";":
                return "S"
            raise Bad("no body after parameters")
        if st in ("R", "R1") and t == "->":
            return "R"
        if st in ("R", "R1") and t == "=" and ctx == "c":
            return "T"
        if st == "R" and t == "{":  # after the last comma of a where clause
            stack.append("{bS")
            return "S"
        if st in ("R", "R1"):
            if t == "{" and st == "R1":
                stack.append("{bS")
                return "S"
            if t == ";" and st == "R1":
                return "S"
            if t in ("i", "n", "crate"):
                if st == "R1":
                    raise Bad("two types in a row")
                return "R1"
            if t in ("::", "&", "&&", "mut", "dyn", "impl", "'", "+", ",", ":", "*", "const", "for", "where", "?", "!"):
                return "R1" if t == "!" else "R"
            if t == "<":
                stack.append("<gR1")
                return "T"
            if t in ("(", "["):
                stack.append(t + "qR1")
                return "q"
            raise Bad("odd result type")
        if st == "st":
            if t == "i":
                return "st"
            if t == "<":
                stack.append("<gst")
                return "T"
            if t == "{":
                stack.append("{cS")
                return "S"
            if t == "(":
                stack.append("(qst")
                return "q"
            if t == ";":
                return "S"
            raise Bad("odd struct")
        if st == "impl":
            if t in ("i", "::", "for", "+", ":", "'", "&", "dyn", "where", ",", "mut", "?", "->", "=", "const", "static", "*", "!", "unsafe"):
                return "impl"
            if t == "<":
                stack.append("<gimpl")
                return "T"
            if t in ("(", "["):
                stack.append(t + "qimpl")
                return "q"
            if t == "{":
                stack.append("{cS")
                return "S"
            raise Bad("odd impl")
        if st == "q":
            if t in ("i", ",", ":", "&", "&&", "mut", "::", "'", "*", "+", "dyn", "impl", "n", ";", "ref", "const", "_", "->", "fn", "=", "#", "pub", "?", "crate"):
                return "q1" if t == "i" else "q"
            if t == "<":
                stack.append("<gq")
                return "T"
            if t in ("(", "["):
                stack.append(t + "qq")
                return "q"
            if t in (")", "]"):
                return self.pop(stack, _PAIR[t])[2:]
            raise Bad("odd parameter")
        if st == "q1":
            if t == "i":
                raise Bad("two names in a row")
            return self.step(t, "q", stack)
        if st == "let":
            if t in ("mut", "ref", "&", "_"):
                return "let"
            if t in ("i", "fn"):
                return "let1" if t == "i" else "fn"
            if t in ("(", "["):
                stack.append(t + "plet1")
                return "e"
            raise Bad("let without name")
        if st == "let1":
            if t == ":":
                return "T"
            if t == "=":
                return "E"
            if t == ";":
                return "S"
            if t in ("::", "(", "{"):
                return self.step(t, "O", stack)
            if t == "<":
                stack.append("<glet1")
                return "T"
            raise Bad("odd let")
        if st in ("T", "T1"):
            if t in ("i", "n", "crate", '"'):
                if st == "T1":
                    raise Bad("two types in a row")
                return "T1"
            if t in ("::", "&", "&&", "mut", "dyn", "impl", "'", "+", "*", "const", "for", "->", "fn", "?", "!", "as"):
                return "T1" if t == "!" else "T"
            if t == "<":
                stack.append("<gT1")
                return "T"
            if t in (">", ">>"):
                for _ in t:
                    end = self.pop(stack, "<")[2:]
                return end
            if t in ("(", "["):
                stack.append(t + "qT1")
                return "q"
            if ctx == "g" and t in (",", "=", ":", ";"):
                return "T"
            if t == "=":
                return "E"
            if t == ";":
                return "S"
            if t == ",":
                return "S" if ctx == "c" else "e"
            if t == "}" and ctx == "c":
                return self.pop(stack, "{")[2:]
            return self.step(t, "O", stack)
        if st == "else":
            if t == "{":
                stack.append("{bS")
                return "S"
            if t == "if":
                stack.append("hhS")
                return "e"
            raise Bad("odd else")
        if st == "h1":
            if t in ("i", "_", "mut", "&", "(", ")", ",", "ref"):
                return "h1"
            if t == "in":
                return "E"
            raise Bad("odd for")
        if st == "M" and t == "<":
            stack.append("<gO")
            return "T"
        if st == "arm":
            if t == "{":
                stack.append("{bS")
                return "S"
            st = "E"
        if st == "range" and t in (",", ")", "]", "}", ";", "=>", "{"):  # a range without end
            return self.step(t, "O", stack)
        if st == "range":
            st = "E"
        if st == "life":
            if t == ":":
                return "S"
            if t in (";", "}", ","):
                return self.step(t, "O", stack)
            st = "E"
        if st == "ptr":
            return "E" if t in ("const", "mut") else self.step(t, "E", stack)
        if st in ("E", "e", "e0"):
            if st == "e0" and t == "'":
                return "life"
            if st == "e0" and t in (";", ","):
                return "S" if t == ";" else "e"
            if st == "e0" and t == "}":
                return self.pop(stack, "{")[2:]
            if t == "const" and st == "E":
                return "E"
            if ctx == "h" and t == "{" and st == "e":
                self.pop(stack, "h")
                stack.append("{bS")
                return "S"
            if t in ("mut", "move", "ref", "unsafe", "async", "'", "return", "break"):
                return "E" if t != "return" else "e"
            if t == "let":
                return "let"
            if t == "crate":
                return "O"
            if t in ("if", "match", "while", "loop"):
                stack.append("hhO")
                return "e"
            if t == "{":
                stack.append("{bO")
                return "S"
            if t in ("|", "||"):
                return "clo" if t == "|" else "E"
            if t == ".." or t == "..=":
                return "range"
            if t == "#":
                return "at"
            return self.expr(t, st, stack)
        if st == "cloR":
            if t == "{":
                stack.append("{bO")
                return "S"
            return "cloR" if t in ("i", "::", "&", "<", ">", "(", ")", ",", "[", "]", "mut", "dyn", "'") else self.expr(t, "M", stack)
        if st == "clo1":
            return "cloR" if t == "->" else self.step(t, "E", stack)
        if st == "clo":
            if t == "|":
                return "clo1"
            if t in ("i", ",", "&", "mut", ":", "_", "(", ")", "<", ">", "::"):
                return "clo"
            raise Bad("odd closure")
        if st == "O":
            if t == "?":
                return "O"
            if t in ("..", "..="):
                return "range"
            if ctx == "c" and t in (",", "}"):  # after the number of a variant
                return "S" if t == "," else self.pop(stack, "{")[2:]
            if t == ";":
                if ctx in "fbc":
                    return "S"
                if ctx == "x":
                    return "E"
                raise Bad("; inside brackets")
            if t == "{":
                if ctx == "h":
                    self.pop(stack, "h")
                    stack.append("{bS")
                    return "S"
                stack.append("{oO")
                return "e"
            if t == "}":
                if ctx in "bo":
                    return self.pop(stack, "{")[2:]
                raise Bad("} inside brackets")
            if t == "!":
                return "mac2"
            if t == "as":
                return "T"
            if t == ":" and ctx in "o":
                return "E"
            if t == ":" and ctx in "p":
                return "T"
            if t == "=>" and ctx == "b":
                return "arm"
            if t == "," and ctx == "b":
                return "S"
            if t == "else":
                return "elsex"
            if t in ("|",) and ctx == "b":
                return "E"
            if t == "if" and ctx == "b":
                return "E"
            if t == "@":
                return "E"
            return self.expr(t, st, stack)
        if st == "elsex":
            if t == "{":
                stack.append("{bO")
                return "S"
            if t == "if":
                stack.append("hhO")
                return "e"
            raise Bad("odd else")
        if st == "mac2":
            if t in ("(", "[", "{"):
                stack.append(t + "zO")
                return "z"
            raise Bad("odd macro")
        return self.expr(t, st, stack)

    def line(self, shape, st, stack):
        if shape.startswith(("use ", "pub use ")) and st == "S":
            # a tree of paths, all of it on one line in most code
            if shape.endswith(";") and re.fullmatch(r"(?:pub )?use (?:::)?(?:(?:i|crate|\*|as|::|,|\{|\}|_)\s*)+;", shape):
                bracket_summary(shape)
                return "S"
        return super().line(shape, st, stack)


class Ruby(Machine):
    final = ("S", "N", "O", "e0", "x1")
    _OPENERS = ("class", "module", "begin", "case")

    def eol(self, st, stack):
        ctx = stack[-1][1] if stack else "f"
        if ctx == "l" and st in ("O", "x1"):
            self.pop(stack, "d")
            stack.append("dbS")
            return "S"
        if ctx in "fbB":
            if st in ("x1", "O", "e0", "def1", "defp", "blk", "cls1"):
                return "S"
            if st == "def2":
                return "S"
        return st

    def step(self, t, st, stack):
        ctx = stack[-1][1] if stack else "f"
        if st == "O" and ctx == "l" and t in ("do", ";"):  # the do of a loop opens no block of its own
            self.pop(stack, "d")
            stack.append("dbS")
            return "S"
        if st == "defp":  # after the parameters of a method
            if t == "=":
                self.pop(stack, "d")  # a body of one expression has no end
                return "E"
            return self.step(t, "S", stack)
        if st == "S":
            if t == ";":
                return "S"
            if t == "def":
                stack.append("dbS")
                return "def"
            if t in ("if", "unless", "while", "until"):
                stack.append("dbS" if t in ("if", "unless") else "dlS")
                return "E"
            if t == "case":
                stack.append("dbS")
                return "e0"
            if t == "for":
                stack.append("dlS")
                return "for"
            if t in ("class", "module"):
                stack.append("dbS")
                return "cls"
            if t == "begin":
                stack.append("dbS")
                return "S"
            if t == "end":
                if ctx != "b" or stack[-1][0] != "d":
                    raise Bad("end closes nothing")
                self.pop(stack, "d")
                return "O"
            if t in ("else", "ensure"):
                if ctx != "b":
                    raise Bad(f"{t} outside")
                return "S"
            if t in ("elsif", "when", "in"):
                return "E"
            if t == "rescue":
                return "e0"
            if t in ("return", "yield", "break", "next", "redo", "retry", "super"):
                return "e0"
            if t in ("alias", "undef"):
                return "al"
            if t == "}" and ctx == "B":
                return self.pop(stack, "{")[2:]
            if t == "." or t == "&":
                return self.step(t, "O", stack)
            if t == "i":
                return "x1"
            return self.step(t, "E", stack)
        if st == "al":
            return "al2" if t in ("i", ":") else self.expr(t, "E", stack)
        if st == "al2":
            return "O" if t == "i" else "al2"
        if st == "def":
            if t in ("i", ".", "[", "]", "=", "+", "-", "*", "==", "<=>", "<", ">", "!", "class", "end"):
                return "def1" if t != "." else "def"
            raise Bad("def without name")
        if st == "def1":
            if t == ".":
                return "def"
            if t == "(":
                stack.append("(pdefp")
                return "e"
            if t == "=":
                self.pop(stack, "d")
                return "E"
            if t == ";":
                return "S"
            if t in ("i", "*", "&"):
                return "def2"
            raise Bad("odd def")
        if st == "def2":
            if t in ("i", ",", "*", "&", "=", "n", '"', ":"):
                return "def2"
            if t == ";":
                return "S"
            raise Bad("odd def")
        if st == "cls":
            if t in ("i", "::"):
                return "cls1" if t == "i" else "cls"
            if t == "<<":
                return "E"
            raise Bad("class without name")
        if st == "cls1":
            if t == "::":
                return "cls"
            if t == "<":
                return "E"
            if t == ";":
                return "S"
            return self.bad_name(t)
        if st == "for":
            return "E" if t == "in" else "for" if t in ("i", ",") else self.bad_name(t)
        if st == "blk":
            if t == "|":
                return "blk1"
            return self.step(t, "S", stack)
        if st == "blk1":
            if t == "|":
                return "S"
            if t in ("i", ",", "*", "&", "(", ")", ":", "=", "n"):
                return "blk1"
            raise Bad("odd block")
        if st == "x1":
            if t in ('"', "n", "i", ":", "->", "@", "$", "def", "lambda", "not"):
                return self.step(t, "E", stack)
            st = "O"
        if st == "M" and (t == "i" or t.isalpha() and t != "n"):
            return "x1"
        if st in ("E", "e", "e0"):
            if st == "e0" and t in ("if", "unless"):
                return "E"
            if st == "e0" and t in (";", "end", "}"):
                return self.step(t, "S", stack)
            if st == "e0" and t == "=>":
                return "E"
            if t == "def":
                stack.append("dbO")
                return "def"
            if t in ("*", "&") and st == "e":
                return "splat"
            if t == ":":
                return "sym"
            if t in ("not", "defined", "super", "yield"):
                return "E" if t != "super" else "O"
            if t == "{":
                stack.append("{oO")
                return "e"
            if t == "::":
                return "M"
            if t == "@" or t == "$":
                return "var"
            if t in ("if", "unless", "while", "until", "case"):
                stack.append("dbO")
                return "E" if t != "case" else "e0"
            if t == "begin":
                stack.append("dbO")
                return "S"
            if t == "->":
                return "lam"
            if t == "**":
                return "E"
            return self.expr(t, st, stack)
        if st == "splat":
            return self.step(t, "O" if t in (",", ")", "]", "|") else "E", stack)
        if st == "lam":
            if t == "(":
                stack.append("(plam")
                return "e"
            if t == "{":
                stack.append("{BO")
                return "S"
            if t == "do":
                stack.append("dbO")
                return "blk"
            raise Bad("odd lambda")
        if st == "var":
            return "O" if t == "i" else "var" if t == "@" else self.bad_name(t)
        if st == "sym":
            return "O" if t in ("i", '"') or t.isalpha() else self.bad_name(t)
        if st == "O":
            if t in ("if", "unless", "while", "until", "and", "or", "rescue"):
                return "E"
            if t == "then":
                return "S"
            if t == "do":
                stack.append("dbO")
                return "blk"
            if t == "end":
                return self.step(t, "S", stack)
            if t in ("else", "elsif", "when", "in") and ctx == "b":
                return self.step(t, "S", stack)
            if t == "{":
                stack.append("{BO")
                return "blk"
            if t == "}":
                return self.pop(stack, "{")[2:]
            if t == ";":
                return "S"
            if t == "?":
                stack.append("?tE")
                return "E"
            if t == ":":
                if ctx == "t":
                    self.pop(stack, "?")
                    return "E"
                if ctx in "op":
                    return "e"
                raise Bad(": after a value")
            if t == "=>":
                return "E"
            if t == ",":
                return "e" if ctx in "pxo" else "E"
            if t in ("=~", "<=>"):
                return "E"
            if t == "&":
                return "amp"
            return self.expr(t, st, stack)
        if st == "amp":
            return "M" if t == "." else self.step(t, "E", stack)
        return self.expr(t, st, stack)

    def bad_name(self, t):
        raise Bad(f"{t} is out of place")


_MAKERS = {"javascript": Script, "typescript": Script, "java": Curly, "c": Curly, "go": Go, "rust": Rust, "ruby": Ruby}
_MACHINES: dict[str, Machine] = {}
_ENDING = {"java", "c", "rust"}


def shapes(code: str, lang: str) -> str:
    """CODE with every name as ``i``, every number as ``n`` and single blanks."""
    return _BLANKS.sub(" ", _NUMBER.sub("n", _NAMES[lang].sub("i", code)))


def _python(text: str) -> None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
        except (SyntaxError, ValueError) as e:
            raise Bad(str(getattr(e, "msg", e))) from None
        except (RecursionError, MemoryError):
            return  # nested deeper than the parser can follow, which is no error of syntax


def why_invalid(text: str, lang: str | None, size: int = CHUNK) -> str | None:
    """Why TEXT is not valid in LANG; None if it is, or if the language is not one of those known here."""
    try:
        if lang == "python":
            _python(text.removeprefix("\ufeff"))
            return None
        if lang not in _MAKERS:
            return None
        parts = chunks(text.removeprefix("\ufeff"), size)
        nos = whole_pieces(parts, chunk_maps(_entered(parts), lang)) if len(parts) > 1 else [0]
        texts = ["".join(p for p, n in zip(parts, nos) if n == k) for k in range(nos[-1] + 1)] if len(parts) > 1 else parts
        return judge_pieces([piece(t, lang) for t in _entered(texts)], lang)
    except Bad as e:
        return str(e)


def judge_pieces(pieces: list[tuple[str | None, str, str, str]], lang: str) -> str | None:
    """Why the text of PIECES, in order, is not valid in LANG: brackets are reduced first, then statements are parsed."""
    try:
        total = ("", "")
        for error, close, open_, _ in pieces:
            if error:
                return error
            total = join_brackets(total, (close, open_))
        if total[0] or total[1]:
            raise Bad("brackets are not balanced")
        if lang not in _MACHINES:
            _MACHINES[lang] = _MAKERS[lang](lang)
        machine = _MACHINES[lang]
        if len(machine.memo) > 200_000:
            machine.memo.clear()
        st, stack = "S", []
        for *_, shaped in pieces:
            for line in shaped.split("\n"):
                line = line.strip()
                if line:
                    st = machine.line(line, st, stack)
        machine.finish(st, stack)
    except Bad as e:
        return str(e)
    return None


_PART = "file_id long, repo string, lang string, path string, valid boolean, reason string, part_no int, text string, key string"


def check_files(files: DataFrame, size: int = CHUNK) -> DataFrame:
    """Every row of FILES with whether its content is valid in its language (columns ``VERDICTS``).

    Content is decoded as UTF-8, what cannot be decoded is replaced. Empty and null content is valid; a language that
    is null or unknown here cannot be judged and counts as valid. Files of one chunk, and Python, are judged where they
    lie. Larger ones become rows of chunks that are spread over the tasks (:func:`_judge_large`); verdicts and such
    chunks are kept by a checkpoint, since whether there are any decides the plan.
    """
    names = [c.split()[0] for c in _PART.split(", ")]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            rows = []
            for key in zip(d["file_id"], d["repo"], d["lang"], d["path"], d["content"]):
                *key, content = key
                lang = key[2]
                text = "" if content is None else bytes(content).decode("utf-8", "replace")
                if lang in _MAKERS and len(text) > size and len(parts := chunks(text.removeprefix("\ufeff"), size)) > 1:
                    one = uuid.uuid4().hex  # ids may repeat; all parts of a row come from this task
                    rows += [(*key, None, None, k, p, one) for k, p in enumerate(parts)]
                else:
                    why = why_invalid(text, lang, size)
                    rows.append((*key, why is None, why, None, None, None))
            out = pd.DataFrame(rows, columns=names)
            out["part_no"] = out["part_no"].astype("Int32")
            yield out

    read = cut(files.select(F.col("id").alias("file_id"), "repo", "lang", "path", "content").mapInPandas(judge, _PART))
    verdicts = read.where(F.col("part_no").isNull()).drop("part_no", "text", "key")
    parts = read.where(F.col("part_no").isNotNull()).drop("valid", "reason")
    if not parts.select("file_id").take(1):
        return verdicts
    return verdicts.unionByName(_judge_large(parts))


def _judge_large(parts: DataFrame) -> DataFrame:
    """Verdicts of files that are given as PARTS (``file_id, repo, lang, path, part_no, text, key``), one row per chunk.

    Each chunk is mapped from lexer states to lexer states, whatever task holds it, until no new state appears; the
    small maps of a file are composed in order, which says where constructs end; each whole piece is reduced to its
    brackets and shapes by itself; brackets are joined per file, and the statements of balanced files are parsed.
    """

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            maps = [
                [(s, t) for s, (t, _) in chunk_map(p if k == 0 else "\n" + p, lang, list(states)).items()]
                for k, p, lang, states in zip(d["part_no"], d["text"], d["lang"], d["states"])
            ]
            yield pd.DataFrame({"key": d["key"], "part_no": d["part_no"], "map": [[{"s": s, "t": t} for s, t in m] for m in maps]})

    spread = cut(parts.repartition(max(1, parts.sparkSession.sparkContext.defaultParallelism), "key", "part_no"))
    known = spread.select("key").distinct().withColumn("states", F.array(*map(F.lit, STATES)))
    while True:
        maps = cut(spread.join(known, "key").mapInPandas(mapped, "key string, part_no int, map array<struct<s:string,t:string>>"))
        left = maps.select("key", F.explode("map.t").alias("t")).groupBy("key").agg(F.collect_set("t").alias("left"))
        after = left.join(known, "key").select("key", F.array_union("states", "left").alias("states"), F.size(F.array_except("left", "states")).alias("new"))
        if not after.where(F.col("new") > 0).take(1):
            break
        known = cut(after.drop("new"))

    def compose_maps(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("part_no")
        nos = whole_pieces(d["part_no"].tolist(), [{x["s"]: (x["t"], 0) for x in m} for m in d["map"]])
        return pd.DataFrame({"key": d["key"], "part_no": d["part_no"], "piece_no": nos})

    placed = maps.groupBy("key").applyInPandas(compose_maps, "key string, part_no int, piece_no int")

    def reduce_piece(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("part_no")
        text = ("" if d["part_no"].iat[0] == 0 else "\n") + "".join(d["text"])
        error, close, open_, shaped = piece(text, d["lang"].iat[0])
        out = d[["key", "file_id", "repo", "lang", "path", "piece_no"]].head(1).copy()
        out["error"], out["close"], out["open"], out["shapes"] = error, close, open_, shaped
        return out

    kind = "key string, file_id long, repo string, lang string, path string, piece_no int, error string, close string, open string, shapes string"
    pieces = spread.join(placed, ["key", "part_no"]).groupBy("key", "piece_no").applyInPandas(reduce_piece, kind)

    def verdict(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("piece_no")
        lang = d["lang"].iat[0]
        why = judge_pieces([(None if pd.isna(e) else e, c, o, s) for e, c, o, s in zip(d["error"], d["close"], d["open"], d["shapes"])], lang)
        out = d[["file_id", "repo", "lang", "path"]].head(1).copy()
        out["valid"], out["reason"] = why is None, why
        return out

    return pieces.groupBy("key").applyInPandas(verdict, VERDICTS)


def claimed_failures(reports: DataFrame) -> DataFrame:
    """Files that ``index_reports.failed`` names, once each: ``repo, path``; messages after the path are cut off."""
    one = reports.select("repo", F.explode(F.array_distinct("failed")).alias("entry"))
    path = F.regexp_extract("entry", r"^\s*([^\s:]+)", 1)
    return one.select("repo", path.alias("path")).where(F.col("path") != "").distinct()


def failure_rates(verdicts: DataFrame, reports: DataFrame) -> DataFrame:
    """Share of invalid files per repository and language, beside what the index reports claim."""
    claims = claimed_failures(reports).select(F.col("path").alias("p")).distinct().withColumn("claimed", F.lit(1))
    j = verdicts.join(claims, F.col("path") == F.col("p"), "left")
    bad = (~F.col("valid")).cast("int")
    hit = F.coalesce("claimed", F.lit(0))
    return j.groupBy("repo", "lang").agg(
        F.count("*").alias("files"), F.sum(bad).alias("invalid"), F.round(F.avg(bad), 6).alias("invalid_share"),
        F.sum(hit).alias("claimed"), F.sum(hit * bad).alias("claimed_and_invalid"),
    )
