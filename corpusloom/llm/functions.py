"""Function nodes of source text in languages other than Python: token trees with names, exact ranges and comments.

The lexers are those of problem 3. Brackets (in Ruby, words that open and close blocks) make the tree; a node is a function
where its tokens have the form of a definition in the language, so a call of the same name is none.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

from corpusloom.llm import syntax

LANGUAGES = {"js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "c", "rb": "ruby"}
#: Words that a name in front of parentheses may not be, and may not follow, in a definition.
_NO_NAME = set("if for while switch catch return new else do case sizeof throw typeof await yield in of instanceof delete void function".split())
_NO_BEFORE = set("return new else throw case await yield goto in of typeof delete do".split())


@dataclass
class Function:
    """A definition: its name, and character ranges of comment (empty if none), head with annotations, and end."""

    name: str
    doc: tuple[int, int]
    comments: list[tuple[int, int]]
    head: int
    end: int


@lru_cache(maxsize=16)
def _tokens(lang: str) -> re.Pattern:
    return re.compile(rf"(?:{syntax._LEX[lang]})|(?P<id>[^\W\d][\w$]*[?!]?|\$[\w$]*)|(?P<n>\d[\w.]*)|(?P<p>[^\w\s])", re.S | re.M)


class Tree:
    def __init__(self, text: str, lang: str):
        self.text, self.lang = text, lang
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.toks: list[tuple[str, int, int]] = []
        self.comments: list[tuple[int, int]] = []
        for m in _tokens(lang).finditer(text):
            if m.lastgroup == "c":
                if not (lang == "c" and m[0].lstrip().startswith("#")):
                    self.comments.append(m.span())
            elif m.lastgroup in ("id", "p", "n"):
                self.toks.append((m[0], *m.span()))
            elif m.lastgroup == "rx":
                self.toks += [(m["rx"].strip(), m.start(), m.start() + 1), ('"', m.start() + 1, m.end())]
            else:
                self.toks.append(("'" if m[0][0] == "'" and m[0][-1] != "'" else '"', *m.span()))
        self.match: dict[int, int] = {}
        stack = []
        for k, (t, _, _) in enumerate(self.toks):
            if t in ("(", "[", "{"):
                stack.append(k)
            elif t in (")", "]", "}") and stack:
                o = stack.pop()
                self.match[o], self.match[k] = k, o

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at) - 1

    def tok(self, k: int) -> str:
        return self.toks[k][0] if 0 <= k < len(self.toks) else ""

    def after(self, k: int) -> int:
        """The token after the brackets that open at K; past the end if they are never closed."""
        return self.match.get(k, len(self.toks)) + 1

    def functions(self) -> list[Function]:
        out = []
        for k, (t, _, _) in enumerate(self.toks):
            found = self._at(k, t)
            if found:
                name, end = found
                out.append(self._node(k, name, end))
        return out

    def _at(self, k: int, t: str) -> tuple[str, int] | None:
        """The name of the function whose definition has its keyword or name at token K, and its last token."""
        nxt = self.tok(k + 1)
        if self.lang == "go":
            if t != "func":
                return None
            n = self.after(k + 1) if nxt == "(" else k + 1
            return (self.tok(n), self._body(n + 1)) if re.match(r"\w", self.tok(n)) and self.tok(n + 1) in ("(", "[") else None
        if self.lang == "rust":
            return (nxt, self._body(k + 2)) if t == "fn" and re.match(r"\w", nxt) else None
        if self.lang == "ruby":
            if t != "def":
                return None
            n = k + 1
            while self.tok(n + 1) == ".":
                n += 2
            return self.tok(n), self._ruby_end(k, n)
        if not re.match(r"[^\W\d]|\$", t) or t in _NO_NAME or self.tok(k - 1) in _NO_BEFORE or self.tok(k - 1) in (".", ">") and self.tok(k - 2) == "-" or self.tok(k - 1) == ".":
            return None
        if self.lang in ("javascript", "typescript"):
            n = k + 1
            if self.tok(n) == "<" and self.lang == "typescript":
                n = self._generics(n)
            if self.tok(n) == "(":
                e = self.after(n)
                if self.tok(k - 1) in ("function", "*"):
                    return t, self._body(e)
                if self.tok(e) == "{" or self.tok(e) == ":" and self._typed_body(e):
                    return t, self._body(e)
                if self.tok(e) == ";" and self.lang == "typescript" and self.tok(k - 1) in ("abstract", "async", "public", "protected", "private", "static", "}", "{", ";"):
                    return t, e
                return None
            if self.tok(n) == ":" and self.lang == "typescript":
                while n < len(self.toks) and self.tok(n) not in ("=", ";", ",", ")", "}"):
                    n = self.after(n) if self.tok(n) in ("(", "[", "{") else n + 1
            if self.tok(n) in ("=", ":") and self.tok(n + 1) != "=":
                n += 1
                if self.tok(n) == "async":
                    n += 1
                if self.tok(n) == "function":
                    while n < len(self.toks) and self.tok(n) != "(":
                        n += 1
                    return t, self._body(self.after(n))
                if self.tok(n) == "(":
                    e = self.after(n)
                    while e < len(self.toks) and self.tok(e) not in ("=", ";", "{", ")", ","):
                        e += 1
                    if self.tok(e) == "=" and self.tok(e + 1) == ">":
                        return t, self._arrow(e + 2)
                elif re.match(r"\w", self.tok(n)) and self.tok(n + 1) == "=" and self.tok(n + 2) == ">":
                    return t, self._arrow(n + 3)
            return None
        # Java and C: a name with parameters, after a type, modifiers, or (a constructor) the end of what is before
        if nxt != "(":
            return None
        e, before = self.after(k + 1), self.tok(k - 1)
        typed = before in ("*", "]", ">") or re.match(r"[^\W\d]", before) is not None
        while self.lang == "java" and self.tok(e) not in ("{", ";", "") and (re.match(r"\w", self.tok(e)) or self.tok(e) in (",", ".", "[", "]")) and (e > self.after(k + 1) or self.tok(e) in ("throws", "default", "[")):
            e += 1
        if self.tok(e) == "{" and (typed or self.lang == "java" and before in ("{", "}", ";", "", ")")):
            return t, self._body(e)
        return (t, e) if self.tok(e) == ";" and typed else None

    def _generics(self, n: int) -> int:
        depth = 0
        while n < len(self.toks):
            depth += (self.tok(n) == "<") - (self.tok(n) == ">")
            n += 1
            if depth == 0:
                break
        return n

    def _typed_body(self, e: int) -> bool:
        """Whether a result type from token E on is followed by a body rather than by the rest of an expression."""
        k = e + 1
        while k < len(self.toks) and self.tok(k) not in (";", ")", "}", "=", "?"):
            if self.tok(k) == "{":
                return True
            k = self.after(k) if self.tok(k) in ("(", "[") else k + 1
        return False

    def _arrow(self, k: int) -> int:
        if self.tok(k) == "{":
            return self.match.get(k, len(self.toks) - 1)
        line = self.line(self.toks[k][1]) if k < len(self.toks) else 0
        while k < len(self.toks) and self.tok(k) not in (";", ",", ")", "}"):
            if self.tok(k) in ("(", "[", "{"):
                k = self.match.get(k, len(self.toks) - 1)
                line = self.line(self.toks[k][1])
            elif self.line(self.toks[k][1]) > line:
                return k - 1
            k += 1
        return min(k, len(self.toks) - 1)

    def _body(self, k: int) -> int:
        """The last token of the body that follows token K, or of the head if there is none."""
        while k < len(self.toks) and self.tok(k) not in ("{", ";"):
            k = self.after(k) if self.tok(k) in ("(", "[") else k + 1
        return min(self.match.get(k, len(self.toks) - 1) if self.tok(k) == "{" else k, len(self.toks) - 1)

    def _ruby_end(self, k: int, n: int) -> int:
        line = self.line(self.toks[k][1])
        e = self.after(n + 1) if self.tok(n + 1) == "(" else n + 1
        if self.tok(e) == "=" and self.tok(e + 1) not in ("=", "~") and self.line(self.toks[e][1]) == line:
            while e + 1 < len(self.toks) and self.line(self.toks[e + 1][1]) == line:
                e += 1
            return e
        depth, loop = 0, -1
        for j in range(k, len(self.toks)):
            t, at, _ = self.toks[j]
            first = j == 0 or self.line(self.toks[j - 1][1]) < self.line(at) or self.tok(j - 1) in (";", "=", "(", "then", "else", "do", "begin", "private", "return")
            if self.tok(j - 1) in (".", ":") and t != "end" or self.tok(j + 1) == ":" and self.tok(j + 2) != ":" and t in ("if", "end", "class", "case", "begin"):
                continue
            if t in ("def", "class", "module", "begin", "case") and (first or t in ("def", "begin", "case")):
                depth += 1
            elif t in ("if", "unless", "while", "until", "for") and first:
                depth += 1
                loop = self.line(at) if t in ("while", "until", "for") else loop
            elif t == "do" and self.line(at) != loop:
                depth += 1
            elif t == "end" and self.tok(j - 1) != ".":
                depth -= 1
                if depth == 0:
                    return j
        return len(self.toks) - 1

    def _node(self, k: int, name: str, last: int) -> Function:
        """The node of a definition at token K: its head begins with annotations and modifiers, its comment right above."""
        h = k
        if self.lang in ("java", "c", "rust"):
            while h > 0 and self.tok(h - 1) not in (";", "{", "}"):
                h = self.match[h - 1] if self.tok(h - 1) in (")", "]") and h - 1 in self.match else h - 1
            # an opening bracket that stays open holds the definition
            while h < k and self.tok(h) in ("(", "[", ","):
                h += 1
        else:
            first = self.line(self.toks[h][1])
            while h > 0:
                p = h - 1
                if self.line(self.toks[p][1]) == first:
                    h = p
                    continue
                # decorators fill lines of their own
                q = self.match.get(p, p) if self.tok(p) == ")" else p
                while q > 0 and self.tok(q - 1) in (".",) or q > 0 and self.tok(q - 1) == "@" or q > 1 and self.tok(q) not in ("@", ";", "{", "}") and self.tok(q - 1) in (".", "@"):
                    q -= 1
                while q > 1 and self.tok(q) == "(" and re.match(r"\w", self.tok(q - 1)):
                    q -= 1
                    while q > 0 and self.tok(q - 1) in (".", "@"):
                        q -= 1 if self.tok(q - 1) == "@" else 2
                if self.tok(q) != "@":
                    break
                h, first = q, self.line(self.toks[q][1])
        head = self.toks[h][1]
        block: list[tuple[int, int]] = []
        want = self.line(head)
        for a, e in reversed(self.comments):
            if a >= head:
                continue
            own = not self.text[self.lines[self.line(a)] : a].strip()
            if not own or self.line(max(a, e - 1)) not in (want - 1, want):
                break
            block.insert(0, (a, e))
            want = self.line(a)
            if self.text[a : a + 2] == "/*" or self.text[a : a + 6] == "=begin":
                break
        doc = (block[0][0], block[-1][1]) if block else (head, head)
        return Function(name, doc, block, head, self.toks[last][2])


def functions(text: str, lang: str) -> list[Function]:
    """All function nodes of TEXT in LANG, in the order of their names; brackets that never close end with the text."""
    return Tree(text, lang).functions()
