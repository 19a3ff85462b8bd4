from __future__ import annotations

import itertools
import random
import re
import unicodedata

import pytest
import toxic_cases_r02
import toxic_cases_r03
from pyspark.sql import functions as F
from syntax_cases import CONSTRUCTS, REJECTED
from toxic_cases import ABUSIVE, CLEAN

from corpusloom.llm import docpairs, leakage, mixing, packing, provenance, splitting, syntax, toxic_rows, toxicity

FILES = "id long, path string, lang string, repo string, content binary, kind string, reason string, valid boolean"
ITEM = "item_id long, request_id long, path string, qualname string, start_line int, end_line int, content string, symbol_id long, kind string, size int"
SYM = "id long, kind string, file_id long, sig string, start_line int, end_line int, name string"


def files(spark, *rows):
    return spark.createDataFrame([(i, p, lang, "repo", None if t is None else t.encode(), "x", "y", None) for i, (p, lang, t) in enumerate(rows, 1)], FILES)


# --- 1 ----------------------------------------------------------------------------------------------------------------

STUBS = "".join(f"def get_x_f{k}(buf):\n    return raw_get(buf, {k * 4})\n\n" for k in range(20))
HAND = "# Code that writes '@generated' marks\nMARK = '// Code generated by x. DO NOT EDIT.'\n\ndef f(a):\n    return a + 1\n" * 3


@pytest.mark.parametrize("path,text,kind", [
    ("a/x.py", "# @generated\nx = 1\n", "generated"), ("a/x.go", "// Code generated by tool. DO NOT EDIT.\npackage a\n", "generated"),
    ("a/x.c", "/* Diese Datei wurde von tool erzeugt, bitte nicht ändern. */\nint x;\n", "generated"), ("a/x.py", STUBS, "generated"), ("a/x.py", HAND, None),
    ("a/x.js", "// lokstep 1.2.3\n// Copyright (c) the lokstep contributors. Terms.\nf();\n", "vendored"), ("a/x.js", "// This file belongs to other. See LICENCE in the root folder.\n", "vendored"),
    ("a/x.js", "// This file belongs to repo. See LICENCE in the root folder.\nf();\n", None), ("a/x.js", "var a=function(b){return b+c};d=a(e);" * 30, "minified"),
    ("a/x.py", "T = [\n" + "    12, 250, 3, 99, 41, 17,\n" * 40 + "]\n", "data"), ("a/x.py", "# Do not edit the ledger table while a run is open.\nx = 1\n", None),
    ("a/x.py", "", None), ("a/x.py", "x = 1\n" * 5000, None),
])
def test_content_evidence(path, text, kind):
    found = provenance.content_evidence(path, "repo", text)
    assert (found and found[0]) == kind


def test_globs_and_precedence(spark):
    rows = [
        ("repo/.gitattributes", None, "*.pb linguist-generated\nlib/** linguist-vendored\nlib/own.js -linguist-vendored\n"), ("repo/lib/.gitattributes", None, "deep/*.js !vendored\n# note\n"),
        ("repo/a.pb", "c", ""), ("repo/lib/x.js", "javascript", ""), ("repo/lib/own.js", "javascript", ""), ("repo/lib/deep/y.js", "javascript", ""), ("repo/b.js", "javascript", None), (None, None, "x"),
    ]
    kinds = {r.file_id: r.kind for r in provenance.classify_files(files(spark, *rows)).collect()}
    assert [kinds[k] for k in (3, 4, 5, 6, 7, 8)] == ["generated", "vendored", None, None, None, None]
    assert provenance.classify_files(files(spark).limit(0)).count() == 0


def test_mined_patterns(spark):
    rows = [(f"repo/src{k}/stubs/f{k}.py", "python", "# @generated\n") for k in range(6)] + [("repo/z/stubs/q.py", "python", "x = 1\n"), ("repo/z/own/q.py", "python", "x = 1\n")]
    kinds = {r.file_id: r.kind for r in provenance.classify_files(files(spark, *rows)).collect()}
    assert kinds[7] is None and kinds[8] is None  # six of seven are no nine tenths
    rows += [(f"repo/t{k}/stubs/f{k}.py", "python", "# @generated\n") for k in range(6)]
    kinds = {r.file_id: r.kind for r in provenance.classify_files(files(spark, *rows)).collect()}
    assert kinds[7] == "generated" and kinds[8] is None


def test_patterns_are_mined_from_declarations(spark):
    a = [("a/.gitattributes", None, "stubs/** linguist-generated\nlib/** linguist-vendored\nmade/** -linguist-generated\n")]
    a += [(f"a/stubs/f{k}.py", "python", "x = 1\n") for k in range(12)] + [(f"a/made/f{k}.py", "python", "# @generated\n") for k in range(2)]
    b = [("b/stubs/q.py", "python", "x = 1\n"), ("b/lib/q.py", "python", "x = 1\n")] + [(f"b/made/f{k}.py", "python", "# @generated\n") for k in range(9)] + [("b/made/q.py", "python", "x = 1\n")]
    got = {r.path: (r.kind, r.reason) for r in provenance.classify_files(files(spark, *a, *b)).collect()}
    assert got["a/stubs/f0.py"] == ("generated", "declared") and got["a/made/f0.py"] == (None, None)
    assert got["b/stubs/q.py"] == ("generated", "pattern /stubs/")
    assert got["b/lib/q.py"] == (None, None)  # nothing is there in the declared folder
    assert got["b/made/f0.py"][0] == "generated" and got["b/made/q.py"] == (None, None)  # two of twelve are declared hand-written
    assert len(got) == len(a + b)


GENERATED = "// Code generated by tool. DO NOT EDIT.\npackage a\n"


def test_kinds_are_declared_apart(spark):
    rows = [
        ("a/.gitattributes", None, "src/* -linguist-vendored\nlib/** linguist-vendored\n\"my docs/*.js\" linguist-generated=true\nout/* linguist-generated\nout/own.go -linguist-generated\n"),
        ("a/lib/x/.gitattributes", None, "*.js !linguist-vendored\n"), ("a/src/g.go", "go", GENERATED), ("a/lib/x/y.js", "javascript", "f();\n"), ("a/lib/x/y.c", "c", "int x;\n"),
        ("a/my docs/m.js", "javascript", "f();\n"), ("a/out/own.go", "go", GENERATED), ("a/out/b.go", "go", "package a\n"), ("a/lib/x/z.js", "javascript", "// copied from upstream\nf();\n"),
    ]
    got = {r.path: (r.kind, r.route) for r in provenance.classify_files(files(spark, *rows)).collect()}
    assert got["a/src/g.go"] == ("generated", "content")  # what is unset there is another kind
    assert got["a/lib/x/y.js"] == (None, None) and got["a/lib/x/y.c"] == ("vendored", "declared")  # ! means unspecified
    assert got["a/lib/x/z.js"] == ("vendored", "content")
    assert got["a/my docs/m.js"] == ("generated", "declared") and got["a/out/b.go"] == ("generated", "declared") and got["a/out/own.go"] == (None, None)


def test_routes_over_declared_negated_and_undeclared_repositories(spark):
    """Twelve repositories declare, two negate, twelve declare nothing: how many files each route gives."""
    head = "// made with the frobnicate tool, see its manual\n"
    rows = []
    for k in range(12):
        rows += [(f"d{k}/.gitattributes", None, "stubs/** linguist-generated\nforeign/** linguist-vendored\n"), (f"d{k}/stubs/f.js", "javascript", head + f"f({k});\n"), (f"d{k}/foreign/g.js", "javascript", "g();\n")]
        rows += [(f"u{k}/stubs/f.js", "javascript", "f();\n"), (f"u{k}/src/made.js", "javascript", head + "h();\n"), (f"u{k}/src/own.js", "javascript", "// a hand-written file of ours, read it\nh();\n")]
    for k in range(2):
        rows += [(f"n{k}/.gitattributes", None, "* -linguist-generated -linguist-vendored\n"), (f"n{k}/made/f.js", "javascript", GENERATED)]
    rows += [("u0/src/g.go", "go", GENERATED), ("u1/x/a.min.js", "javascript", "a()\n")]
    spread = [(i, p, lang, p.split("/")[0], t.encode(), "x", "y", None) for i, (p, lang, t) in enumerate(rows, 1)]
    df = provenance.classify_files(spark.createDataFrame(spread, FILES))
    got = {r.path: (r.kind, r.route, r.reason) for r in df.collect()}
    assert got["u3/stubs/f.js"] == ("generated", "mined", "pattern /stubs/")
    assert got["u3/src/made.js"][:2] == ("generated", "mined")  # these words nearly always go with declared files
    assert got["u3/src/own.js"][:2] == (None, None)
    assert got["n0/made/f.js"] == (None, None, None)
    routes = {r.route: r["count"] for r in df.groupBy("route").count().collect()}
    assert routes == {"declared": 24, "mined": 24, "content": 1, "convention": 1, None: len(rows) - 50}


# --- 2 ----------------------------------------------------------------------------------------------------------------


def test_split_text_properties():
    rnd = random.Random(1)
    for _ in range(150):
        text = "".join("w" * rnd.choice([0, 3, 20, 60, 300]) + rnd.choice(["\n", "\n\n", "\r\n", " "]) for _ in range(rnd.randint(0, 80)))
        limit, overlap = rnd.choice([5, 20, 64]), rnd.choice([0, 2, 5])
        at = 0
        for k, (a, b, _, _) in enumerate(pieces := splitting.split_text(text, limit, overlap, {3, 9})):
            assert (b - a) // 4 <= limit and a <= at < b or not text
            if k:
                assert text[a:at].count("\n") <= overlap
            at = b
        assert at == len(text)
        assert len(pieces) == 1 or len(text) // 4 > limit


def test_split_prefers_boundaries():
    lines = [f"alpha beta {k}\n" for k in range(20)] + ["\n"] + [f"gamma delta {k}\n" for k in range(20)]
    text = "".join(lines)
    (_, end, _, _), *rest = splitting.split_text(text, len(text) // 6, 0, set())
    assert text[end - 2 : end] == "\n\n" or text[end:].startswith("\ngamma")
    end = splitting.split_text("".join(f"word{k} x\n" for k in range(60)), 100, 0, {33})[0][1]
    assert end == len("".join(f"word{k} x\n" for k in range(34)))


def test_split_oversized(spark):
    long = "x = 1\n" * 60
    rows = [
        (1, 1, "r/a.py", "a.f", 1, 60, long, 7, "k", 1), (2, 1, "r/a.py", None, 1, 60, long, None, "k", 1), (3, 1, "r/a.py", "a.f", 1, 1, "short", 7, "k", 1), (4, 1, None, None, None, None, None, None, "k", 1),
        (5, 1, "r/a.py", "a.q", 1, 60, long, 99, "k", 1), (6, 1, "r/b.py", "a.C", 1, 60, "y" * 5000, 8, "k", 1), (7, 1, "r/none.py", None, None, None, long, None, "k", 1),
    ]
    symbols = spark.createDataFrame([(7, "function", 1, None, 1, 60, "f"), (7, "function", 1, None, 1, 60, "f"), (8, "class", 2, None, 1, 60, "C"), (9, "function", 1, None, 2, 20, "g")], SYM)
    fs = spark.createDataFrame([(1, "r/a.py"), (2, "r/b.py")], "id long, path string")
    limits = spark.createDataFrame([("function", 40, 2), ("slice", 50, 3), ("class", 100, None), ("none", None, 1)], "kind string, max_tokens int, overlap_lines int")
    items = spark.createDataFrame(rows, ITEM)
    out = splitting.split_oversized(items, symbols, fs, limits).collect()
    assert {r.item_id for r in out} == {1, 2, 6, 7}
    first = min((r for r in out if r.item_id == 1), key=lambda r: r.piece_no)
    assert first.last_line == 20  # where the nested symbol ends
    for i, o in ((1, 2), (2, 3)):
        ps = sorted((r for r in out if r.item_id == i), key=lambda r: r.piece_no)
        assert all(q.first_line == p.last_line - o + 1 and r_ok(q) for p, q in itertools.pairwise(ps))
    assert splitting.split_oversized(items.limit(0), symbols, fs, limits).count() == 0
    assert splitting.split_oversized(items, symbols, fs, limits.limit(0)).count() == 0


def r_ok(r):
    return r.n_tokens <= r.max_tokens and r.end_char - r.start_char == len(r.content)


# --- 3 ----------------------------------------------------------------------------------------------------------------

VALID = [
    ("python", "def f():\n    return f'{1}'\n"), ("python", "# only\n"), ("javascript", "import { a } from './b';\nconst f = async (x) => { return x?.y ?? `t ${x}`; };\nexport class C { static m(a, b = 2) { for (const x of a) { if (x) { f(); } else { break; } } return { a, b: 2, ...c }; } }\n"),
    ("javascript", "/* <<<<<<< HEAD */\n// if (\nvar s = \"} (\";\nswitch (s) { case 'a': f(); break; default: g(); }\n"), ("javascript", "!function(t,n){a=b?c:d;e(f,1)}(1,2);"),
    ("typescript", "export function f(a: string[], b?: number): Map<string, number> {\n    const x: any = a as any;\n    return g<number>(x)!;\n}\ninterface I { a: string; f(x: number): void; }\n"),
    ("java", "package a.b;\n\nimport a.C;\n\n@Deprecated\npublic class C<T> extends D implements E {\n    private final int[] a = { 1, 2 };\n    @Override\n    public int f(String x, long y) throws E {\n        for (var z : x) { f(z, 1); }\n        int i = a[0] + (x == y ? 1 : 2);\n        return i;\n    }\n}\n"),
    ("c", "#include <a.h>\n#define X(a) \\\n  ((a)\n/* ( */\nstatic int x = 1;\nstruct s { int a; char *b; };\nint f(const char *a, long b) {\n    for (int i = 0; i < b; i++) { g(a->x, &b); }\n    if (!a) return -1;\n    return (int)b * 2;\n}\n"),
    ("go", "package a\n\nimport \"b\"\n\ntype T struct {\n\tA int\n\tB []string\n}\n\nfunc (t *T) F(a int, b []byte) (int, error) {\n\tx := []int{1, 2}\n\tfor _, v := range x {\n\t\tif v > 1 && t.A != 2 {\n\t\t\tg(v)\n\t\t} else {\n\t\t\treturn 1, nil\n\t\t}\n\t}\n\treturn len(b), nil\n}\n"),
    ("rust", "use a::b;\n#[derive(Debug)]\npub struct S<'a> {\n    pub a: &'a str,\n    b: Vec<u32>,\n}\nimpl S<'_> {\n    pub fn f(&mut self, x: u32) -> Option<u32> {\n        let mut y = if x > 1 { 2 } else { 3 };\n        for i in 0..x { y += i; }\n        match y { 1 => g(), _ => {} }\n        println!(\"{}\", y);\n        Some(y)\n    }\n}\n"),
    ("ruby", "require \"a\"\n\nclass A < B\n  attr_reader :x\n  def f(a, b = 1)\n    return a if b\n    a.each do |x|\n      g(x) unless x == 1\n    end\n  end\nend\n"), ("ruby", "=begin\nend end (\n=end\nx = 1\n"),
]
BROKEN = [
    ("python", "def f(:\n"), ("python", "print 'x'\n"), ("javascript", "function f() {\n  if (a \n}\n"), ("javascript", "<<<<<<< HEAD\na();\n=======\nb();\n>>>>>>> x\n"), ("javascript", "def f(a):\n    return a\n"), ("javascript", "const a = \"open;\n"),
    ("javascript", "function f(a: number) { return a; }\n"), ("javascript", "/* never closed\n"), ("typescript", "{% if x %}\nconst a = 1;\n"), ("typescript", "Please ask the team.\n"), ("java", "public class A {\n    int f() {\n        return 1\n    }\n}\n"),
    ("java", "int f() { return 1; }\n"), ("java", "package a\npublic class A { }\n"), ("c", "int f(int a) {\n    int x = 1\n    return x;\n}\n"), ("c", "f(1);\n"), ("c", "int f(int a) {\n"), ("go", "package a\nfunc f() {\n\tint x = 1\n}\n"),
    ("go", "package a\n\nx := 1\n"), ("go", "package a\nfunc F(a int int {\n}\n"), ("rust", "fn f() {\n    let a = b\n    let c = 1;\n}\n"), ("rust", "<html></html>\n"), ("rust", "fn f() { g(1; }\n"), ("ruby", "def f\n  x = 1\n"), ("ruby", "class A\nend\nend\n"),
]


@pytest.mark.parametrize("lang,text", VALID)
def test_valid(lang, text):
    assert syntax.why_invalid(text, lang) is None
    assert syntax.why_invalid(text, lang, size=40) is None
    assert syntax.why_invalid("﻿" + text.replace("\n", "\r\n") if lang != "c" else text, lang) is None


@pytest.mark.parametrize("lang,text", BROKEN)
def test_broken(lang, text):
    assert syntax.why_invalid(text, lang) is not None
    assert syntax.why_invalid(text, lang, size=20) is not None


STRADDLING = [
    ("ruby", "x = 1\n=begin\nit's */ end end (\n\"\n=end\ny = 2\n"), ("ruby", "a = <<~EOS\n  it's (\n  E\n  \"\nEOS\nb = 1\n"), ("ruby", "a = 'it (\n\" end\n'\nb = %w[a\n\" (\nc]\nc = 2\n"), ("ruby", "a = <<E\nE\nb = 'x'\nE.f(1)\n"), ("ruby", "a = b <<LIMIT\nc = 1\nd = 2\n"),
    ("java", 'class A {\n    String s = """\n        it\'s "x" (\n        { "\n        """;\n    int i = 1;\n}\n'), ("c", "#define F(a) \\\n  do { (a); \\\n  \" \\\n  x(\nint x = 1;\nchar *s = \"a \\\n(b\";\n"),
    ("go", "package a\n\nvar s = `a \\\n( \" \\`\n\nvar x = 1\n"), ("rust", 'fn f() {\n    let s = r#"a\n "quoted" (\n \\"#;\n    let t = "b\n( \\" {";\n    let u = r"c\n\\";\n}\n'),
    ("javascript", "const a =\n/[\"'`(]/;\nconst s = 'a \\\n(b';\nf(`x\n\\` ( \n`);\n/* '\n( */\n"), ("javascript", "a();\n#!b (\nc();\n"), ("java", 'class A {\n    String s = """\n    (\n}\n'), ("ruby", "x = 1\n=begin\nend\n"), ("rust", 'fn f() {\n    g(r#"a\n");\n}\n'),
]


@pytest.mark.parametrize("lang,text", STRADDLING + [x for x in VALID + BROKEN if x[0] != "python"])
def test_verdict_is_the_same_for_all_chunk_sizes(lang, text):
    whole = syntax.why_invalid(text, lang, size=len(text)) is None
    if (lang, text) in STRADDLING[:10]:
        assert whole
    assert [n for n in range(1, len(text)) if (syntax.why_invalid(text, lang, size=n) is None) != whole] == []


@pytest.mark.parametrize("lang,text", STRADDLING)
def test_maps_of_all_states_are_associative(lang, text):
    maps = syntax.chunk_maps(syntax.chunks(text, 9), lang)
    for a, b, c in zip(maps, maps[1:], maps[2:]):
        assert syntax.compose(syntax.compose(a, b), c) == syntax.compose(a, syntax.compose(b, c))


def test_chunk_summaries_are_associative():
    text = "a = 1; /* x\n y */ b = \"q\";\n`t\nu` c(\n[d]\n);\n// e\n" * 5
    parts = syntax.chunks(text, 7)
    maps = [syntax.chunk_map(p, "javascript") for p in parts]
    for a, b, c in zip(maps, maps[1:], maps[2:]):
        assert syntax.compose(syntax.compose(a, b), c) == syntax.compose(a, syntax.compose(b, c))
    s = [syntax.bracket_summary(x) for x in ("([", "]{", "})(")]
    assert syntax.join_brackets(syntax.join_brackets(*s[:2]), s[2]) == syntax.join_brackets(s[0], syntax.join_brackets(*s[1:])) == ("", "(")


def test_check_files_and_rates(spark):
    rows = [("r/a.py", "python", "x = 1\n"), ("r/b.py", "python", "x = (\n"), ("r/c.py", "python", ""), ("r/d.py", "python", None), ("r/e.xx", None, "(("), ("r/f.py", "python", "x = 1\n" * 50000)]
    v = syntax.check_files(files(spark, *rows))
    assert {r.file_id: r.valid for r in v.collect()} == {1: True, 2: False, 3: True, 4: True, 5: True, 6: True}
    reports = spark.createDataFrame([("repo", ["r/a.py: cannot read", "r/b.py"]), ("repo", ["r/b.py"]), ("repo", None)], "repo string, failed array<string>")
    got = {r.lang: (r.files, r.invalid, r.claimed, r.claimed_and_invalid) for r in syntax.failure_rates(v, reports).collect()}
    assert got["python"] == (5, 1, 2, 1) and got[None] == (1, 0, 0, 0)


def test_large_files_are_judged_over_tasks_as_in_one(spark):
    rows = [(f"r/f{k}", lang, text) for k, (lang, text) in enumerate(STRADDLING + [v for v in VALID + BROKEN + CONSTRUCTS + REJECTED if v[0] != "python"])]
    got = {r.file_id: r.valid for r in syntax.check_files(files(spark, *rows), size=15).collect()}
    assert got == {k: syntax.why_invalid(text, lang, size=len(text) + 1) is None for k, (_, lang, text) in enumerate(rows, 1)}
    big = "".join(f"function f{k}(a) {{ return a + {k}; }}\n" for k in range(9000))
    verdicts = syntax.check_files(files(spark, ("r/a.js", "javascript", big), ("r/b.js", "javascript", big + "}\n"), ("r/c.js", "javascript", "x = (\n")))
    assert {r.file_id: r.valid for r in verdicts.collect()} == {1: True, 2: False, 3: False}
    twice = files(spark, ("r/a.js", "javascript", big))
    assert [r.valid for r in syntax.check_files(twice.unionByName(twice)).collect()] == [True, True]


@pytest.mark.parametrize("lang,text", CONSTRUCTS)
def test_constructs_of_the_languages_are_valid(lang, text):
    assert syntax.why_invalid(text, lang) is None


@pytest.mark.parametrize("lang,text", REJECTED)
def test_errors_of_the_languages_are_found(lang, text):
    assert syntax.why_invalid(text, lang) is not None


# --- 4 ----------------------------------------------------------------------------------------------------------------


def optimum(sizes, cap):
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= cap and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


def test_packing_against_optimum():
    rnd = random.Random(5)
    worse = 0
    for round_ in range(600):
        cap = rnd.choice([10, 17, 20, 30])
        most = cap if round_ % 2 else cap * 2 // 3
        sizes = sorted((rnd.randint(1, most) for _ in range(rnd.randint(1, 9))), reverse=True)
        counts = {s: sizes.count(s) for s in sizes}
        got = packing.pack_sizes(dict(counts), cap)
        assert all(sum(s * c for s, c in b.items()) <= cap for b, _ in got)
        assert sorted(x for b, n in got for _ in range(n) for s, c in b.items() for x in [s] * c) == sorted(sizes)
        n, best = sum(n for _, n in got), optimum(sizes, cap)
        assert n <= best + 1
        worse += n > best
        fixed = packing.reduce_dominated(left := dict(counts), cap)
        rest = [s for s, k in left.items() for _ in range(k)]
        assert sum(n for _, n in fixed) + optimum(sorted(rest, reverse=True), cap) == best  # what is fixed is optimal
    assert worse < 36


def naive_best_fit(sizes, cap):
    bins = []
    for s in sorted((s for s, n in sizes.items() for _ in range(n)), reverse=True):
        fits = [b for b in bins if sum(b) + s <= cap]
        if fits:
            max(fits, key=sum).append(s)
        else:
            bins.append([s])
    return bins


def test_best_fit_of_sizes_is_that_of_items():
    rnd = random.Random(6)
    for _ in range(300):
        cap = rnd.choice([12, 40, 100])
        sizes = {rnd.randint(1, cap): rnd.randint(1, 9) for _ in range(rnd.randint(1, 12))}
        got = packing.best_fit(dict(sizes), cap)
        rooms = sorted(sum(s * c for s, c in p.items()) for p, n in got for _ in range(n))
        assert rooms == sorted(map(sum, naive_best_fit(sizes, cap)))


def test_a_hot_request_is_packed_as_sizes():
    got = packing.pack_sizes({7: 3_000_000, 3: 5_000_001, 2: 10**7, 1: 10**6}, 8000)
    assert len(got) < 50 and sum(n * c for p, n in got for c in p.values()) == 19_000_001
    assert packing.reduce_dominated({11: 1, 10: 1, 7: 1, 3: 4}, 20) == []  # {11, 3, 3, 3} and {10, 7, 3} are two


def test_pack_items(spark):
    calls = spark.createDataFrame([(1, 10, "x"), (2, None, "x"), (3, 0, "x"), (4, 50000, "x"), (1, 10, "x"), (None, 5, "x")], "request_id long, budget_tokens int, size string")
    rows = [(1, 1, None, None, 1, 1, "a" * 95, None, "k", 1), (2, 1, None, None, 1, 1, "b" * 20, None, "k", 1), (3, 1, None, None, 1, 1, "c" * 20, None, "k", 1), (4, 2, None, None, 1, 1, None, None, "k", 1), (5, 3, None, None, 1, 1, "", None, "k", 1), (6, 9, None, None, 1, 1, "lost", None, "k", 1), (7, 4, None, None, 1, 1, "d" * 80004, None, "k", 1)]
    got = packing.pack_items(calls, spark.createDataFrame(rows, ITEM)).collect()
    assert {r.item_id for r in got} == {1, 2, 3, 4, 5, 7}
    assert [(r.start_char, r.end_char, r.n_tokens) for r in sorted(got, key=lambda r: r.part_no) if r.item_id == 1] == [(0, 40, 10), (40, 80, 10), (80, 95, 3)]
    assert {r.request_id: r.capacity for r in got} == {1: 10, 2: 8000, 3: 8000, 4: 20000}
    used = {}
    for r in got:
        used[r.request_id, r.container_no] = used.get((r.request_id, r.container_no), 0) + r.n_tokens
    assert all(v <= 10 for (q, _), v in used.items() if q == 1) and max(c for q, c in used if q == 1) == 4
    rep = {r.request_id: r for r in packing.packing_report(packing.pack_items(calls, spark.createDataFrame(rows, ITEM))).collect()}
    assert rep[2].unused == 1.0 and rep[1].least_containers == 4
    assert packing.pack_items(calls, spark.createDataFrame([], ITEM)).count() == 0


# --- 5 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("doc,name,ok", [
    ("Returns -1 when no marker is left, so callers need not test it.", "f", True), ("TODO: document", "f", False), ("", "f", False), ("Pick walker signal.", "pick_walker_signal", False),
    ("Copies the inbox.", "copyInbox", False), ("------\n======== helpers ========", "f", False), ("vendor = sort_tenant(vault);", "f", False), ("@param a\n@returns", "f", False),
    ("@return how many stale anchors were dropped by the last mirror", "f", True), ("TODO: rename\n\nKeeps only the sorted rows and drops the rest.", "f", True), ("added 2020-01-02", "f", False), ("{@inheritDoc}", "f", False),
])
def test_meaningful(doc, name, ok):
    assert docpairs.meaningful(doc.split("\n"), name) is ok


@pytest.mark.parametrize("content,name,lang,doc", [
    ("/**\n * Keeps rows.\n */\n@Override\npublic int f(int a) {\n}\n", "f", "java", "Keeps rows."), ("/// Keeps.\n/// More.\n#[inline]\npub fn f() {}\n", "f", "rust", "Keeps.\nMore."),
    ("@cached\ndef f(a,\n      b):\n    '''Keeps rows.'''\n    return 1\n", "f", "python", "Keeps rows."), ("# Above.\ndef f():\n    x = 'no doc'\n", "f", "python", "Above."), ("    def f(self):\n        r\"\"\"Doc\n        two\"\"\"\n", "f", "python", "Doc\ntwo"),
    ("# Above.\n@retry(\n    times=3,\n)\nasync def f():\n    pass\n", "f", "python", "Above."), ("# of g\ng(f(1))\n\n# of f\ndef f():\n    pass\n", "f", "python", "of f"),
    ("def f(self):\n    \"\"\"Cut off here", "f", "python", "Cut off here"), ("x = 1\n\ndef f():\n    pass\n", "f", "python", None), ("// far\n\nfunc f() {}\n", "f", "go", None), ("", "f", "python", None), ("# a\n", None, "ruby", None), ("// a\nf();\n", "f", None, None),
    # a call of the name comes first, or stands in a comment
    ("// calls f\nvoid g(void) {\n    f(1);\n    return f(2);\n}\n\n/* Adds. */\nstatic int\nf(int a)\n{\n    return a;\n}\n", "f", "c", "Adds."), ("// of g\nfunc g() { f() }\n\n// Of f.\nfunc (t *T) f(a []int) (int, error) {\n\treturn 0, nil\n}\n", "f", "go", "Of f."),
    ("/** Of g. */\nvoid g() { this.f(1); f(2); }\n/** Of f. */\n@Inject(\n    name = \"f(\"\n)\npublic <T extends A> Map<T, int[]> f(T a) throws E {\n}\n", "f", "java", "Of f."),
    ("// of g\nfunction g() { return f(1) }\n// Of f.\nexport const f = async (a, b = {}) => {\n  g();\n};\n", "f", "javascript", "Of f."), ("class A {\n  // not\n  x = f(1);\n\n  /** Of f. */\n  @dec({ a: 1 })\n  private async f(a: string): Promise<void> {\n  }\n}\n", "f", "typescript", "Of f."),
    ("# of g\ndef g\n  f(1) if x\nend\n\n# Of f.\ndef self.f(a)\n  a\nend\n", "f", "ruby", "Of f."), ("=begin\nOf f.\n=end\ndef f? = true\n", "f?", "ruby", "Of f."), ("let x = f(1);\n// Of f.\n#[cfg(test)]\npub(crate) unsafe fn f<'a>(x: &'a str) -> u8\nwhere\n    A: B,\n{\n    1\n}\n", "f", "rust", "Of f."),
])
def test_pair_of(content, name, lang, doc):
    found = docpairs.pair_of(content, name, lang)
    assert (found and "\n".join(x.strip() for x in found[0].split("\n")).strip()) == doc


@pytest.mark.parametrize("lang,text,first,end", [
    ("javascript", "// a\nfunction f() {\n  if (x) { y(); }\n}\ng();\n", 1, 4), ("ruby", "# a\ndef f(x)\n  while x do\n    y if x\n  end\n  z = if x then 1 else 2 end\n  xs.each do |y|\n  end\nend\ng\n", 1, 9),
    ("go", "// a\nfunc f() {\n\tg(func() { h() })\n}\n\nfunc k() {}\n", 1, 4), ("rust", "// a\n#[x]\nfn f() {\n    m!{ } \n}\nfn k() {}\n", 1, 5), ("java", "// a\n@X\nint f() {\n  String s = \"}\";\n}\nint k;\n", 1, 5),
    ("c", "// a\nint f(int a) {\n  char c = '}';\n}\nint k;\n", 1, 4), ("typescript", "// a\nexport function f<T>(a: T): a is B {\n  return { a };\n}\nlet k;\n", 1, 4),
])
def test_exact_ranges(lang, text, first, end):
    found = docpairs.pair_of(text, "f", lang)
    assert found[4:] == (first, end) and found[1] == "\n".join(text.split("\n")[first:end])


def test_triviality_of_other_documentation():
    """Forty descriptions that were written apart from the filter: at least nine in ten are judged as a reader would."""
    told = """Opens the valve as soon as the pressure drops below two bar.|Must be called with the lock held.|Rounds half to even, unlike the built-in.|Walks the tree depth first and stops at the first leaf.|Not safe for concurrent use.
Liefert die kleinste Zahl, die noch frei ist.|Renvoie faux si le tampon est déjà plein.|Devuelve cero cuando la lista está vacía.|@return the offset in bytes, or -1 at the end|Falls back to polling where inotify is missing.
Costs one allocation per row.|Only used by the migration from version two.|The caller owns the result and has to free it.|Retries three times with growing pauses.|See RFC 3986, section 5.2, for the algorithm.
Ignores hidden files and broken links.|:returns: seconds since the last heartbeat|Splits at commas that stand outside of quotes.|Kept for scripts that parse our old output.|Blocks until the worker has drained its inbox."""
    empty = """TODO|FIXME: write this|Constructor.|getter|load file|The load file function.|@param x|@param x the x\n@return|n/a|-----------
Function to load a file.|load_file(path)|x = load_file(y)|Loads the file.|***|return file;|TODO(anna): describe|{@inheritDoc}|=== loading ===|None"""
    good = sum(docpairs.meaningful([x], "load_file") for x in told.replace("\n", "|").split("|"))
    bad = sum(not docpairs.meaningful(x.split("\\n"), "load_file") for x in empty.replace("\n", "|").split("|"))
    assert good >= 18 and bad >= 18


def test_doc_pairs(spark):
    text = "# Returns the number of rows that are left.\ndef f(a):\n    return a\n"
    rows = [(2, 1, "a.py", "m.f", 10, 12, text, 1, "k", 1), (1, 1, "a.py", "m.f", 10, 12, text, 1, "k", 1), (3, 1, "a.py", "m.C", 1, 1, text, 2, "k", 1), (4, 1, "a.py", None, 1, 3, text, 3, "k", 1), (5, 1, None, "m.f", None, None, None, 4, "k", 1), (6, 1, "a.py", None, 1, 3, text, None, "k", 1), (7, 1, "a.py", "m.f", 1, 1, text, 9, "k", 1), (8, 1, "a.py", "m.f", 1, 1, "def f(a):\n    pass\n", 5, "k", 1)]
    symbols = spark.createDataFrame([(1, "function", 1, "def f(a):", 1, 2, "f")] * 2 + [(2, "class", 1, None, 1, 2, "C"), (3, "method", 1, None, 1, 2, "f"), (4, "function", 1, None, 1, 2, "f"), (5, "function", 1, None, 1, 2, "f")], SYM)
    got = {r.symbol_id: r for r in docpairs.doc_pairs(spark.createDataFrame(rows, ITEM), symbols).collect()}
    assert set(got) == {1, 3}
    r = got[1]
    assert (r.item_id, r.sig, r.doc_first, r.doc_last, r.code_first, r.code_last) == (1, "def f(a):", 10, 10, 11, 13)
    assert docpairs.doc_pairs(spark.createDataFrame([], ITEM), symbols).count() == 0


# --- 8 ----------------------------------------------------------------------------------------------------------------

WORDS = [f"w{k}" for k in range(400)]


def dp(a, b, whole=True):
    """Edit distance of A and B, or of A and the best part of B."""
    row = list(range(len(b) + 1)) if whole else [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1] if whole else min(row)


def test_bit_parallel_distance():
    rnd = random.Random(2)
    for _ in range(200):
        a, b = [rnd.randint(1, 5) for _ in range(rnd.randint(1, 20))], [rnd.randint(0, 5) for _ in range(rnd.randint(0, 30))]
        peq = {}
        for k, c in enumerate(a):
            peq[c] = peq.get(c, 0) | 1 << k
        assert min(leakage.distance(peq, len(a), b, len(a))[0], len(a)) == dp(a, b, False)


def test_find_leaks(spark):
    rnd = random.Random(3)
    one, two = [rnd.choice(WORDS) for _ in range(50)], [rnd.choice(WORDS) for _ in range(50)]
    shared = "answer with one word and nothing else but please do so in the language of the question as it was put to you here."
    items = [(1, "s", " ".join(one) + ". " + shared), (2, "s", " ".join(two) + ". " + shared), (3, "t", "just five words in all"), (4, "t", None), (5, "t", "")]
    noisy = one[10:40]
    noisy[4], noisy[15] = "changed", "other"
    docs = [
        (1, "text before " + " ".join(one) + " after"), (2, "// " + "\n// ".join(" ".join(noisy[k : k + 5]) for k in range(0, 30, 5))), (3, " ".join(one[:9])), (4, shared), (5, None), (6, ""),
        (7, "x " + " ".join(two[5:30]).upper().replace(" ", "&#44; ") + " y"), (8, "so Just five words, in all."), (9, "filler " * 50000 + " ".join(two)), (1, "text before " + " ".join(one) + " after"),
    ]
    ddf = spark.createDataFrame([(i, t, "q", 0) for i, t in docs], "doc_id long, text string, suite string, edits int")
    idf = spark.createDataFrame(items + items[:1], "item_id int, suite string, text string")
    found = leakage.find_leaks(ddf, idf)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(1, 1), (1, 1), (2, 1), (7, 2), (8, 3), (9, 2)]
    joined = leakage.find_leaks(ddf, idf, most_items=1)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, found.collect()))
    assert leakage.find_leaks(ddf.limit(0), idf, most_items=0).count() == 0
    assert {r.item_id: r.docs for r in leakage.leak_report(found, idf).collect()} == {1: 2, 2: 2, 3: 1, 4: 0, 5: 0}
    assert leakage.find_leaks(ddf.limit(0), idf).count() == 0 and leakage.find_leaks(ddf, idf.limit(0)).count() == 0


def test_every_stretch_within_the_budget_is_found():
    """Against all windows: a document holds an item if any of its stretches is within the budget of a part of it."""
    rnd = random.Random(8)
    for _ in range(120):
        item = [rnd.choice(WORDS[:60]) for _ in range(rnd.choice([5, 9, 16, 20, 33]))]
        a = rnd.randrange(max(1, len(item) - 20))
        part = item[a : a + 20]
        for _ in range(rnd.randint(0, 6)):
            k = rnd.randrange(len(part) + 1)
            part[k : k + rnd.randint(0, 1)] = [rnd.choice(WORDS)] * rnd.randint(0, 1)
        doc = [rnd.choice(WORDS) for _ in range(rnd.randint(0, 9))] + part + [rnd.choice(WORDS) for _ in range(9)]
        size = min(20, len(item))
        most = size * 4 // 20
        want = any(dp(item[s : s + size], doc[x:y]) <= most for s in range(len(item) - size + 1) for x in range(len(doc)) for y in range(x + size - most, min(len(doc), x + size + most) + 1))
        assert bool(leakage.Matcher({1: [item]}).find(" ".join(doc))) is want


def test_claims_that_lose_are_flagged():
    one = [f"a{k}" for k in range(20)]
    two = [*one[:17], "x", "y", "z"]
    got = {r[0]: r[1:] for r in leakage.Matcher({1: [one], 2: [two]}).find(" ".join(one))}
    assert got[1][0] == 0 and got[1][-1] and got[2][0] == 3 and not got[2][-1]


# --- 9 ----------------------------------------------------------------------------------------------------------------


def test_replication_steps():
    for rate, cap in ((0.3, 1), (0.9, 2), (1.7, 3), (3.9, 4), (5.0, 5), (0.0, 3)):
        steps = mixing.replication_steps(rate, cap)
        n = 20000
        mean = sum(sum((k + 0.5) / n >= t for t in steps) for k in range(n)) / n
        assert mean == pytest.approx(rate, abs=2e-3) and len(steps) <= cap


def test_mix(spark):
    docs = [(i, "word " * (5 + i % 7), "Big-Source" if i % 4 else " small ", 1, 2) for i in range(1, 801)] + [(900, None, "small", 1, 2), (901, "", "small", 1, 2), (902, "x", None, 1, 2), (903, "x", "other", 1, 2)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, times int, n_tokens int")
    t = spark.createDataFrame([("big_source", 0.5, 1), ("small", 0.5, 3), ("absent", 0.2, 2), ("none", None, None)], "source string, target_share double, max_repeats int")
    m = mixing.mix(d, t).collect()
    assert m == mixing.mix(d, t).collect()
    assert [(r.doc_id, r.copy_no) for r in m] != sorted((r.doc_id, r.copy_no) for r in m)
    keys = [tuple(r) for r in spark.createDataFrame(m).select(F.xxhash64("doc_id", F.col("copy_no").cast("int"), F.lit(mixing.SEED + 1))).collect()]
    assert keys == sorted(keys)  # the order of the partitions and within them is that of the hash
    assert {r.source for r in m} == {"big_source", "small"} and max(r.copy_no for r in m if r.source == "big_source") == 1 and max(r.copy_no for r in m) <= 3
    rep = {r.source: r for r in mixing.mix_report(d, t).collect()}
    assert rep["small"].actual_share == pytest.approx(0.5, abs=0.02) and rep["absent"].docs == 0 and rep["other"].target_share is None
    assert mixing.mix(d.limit(0), t).count() == 0 and mixing.mix(d, t.limit(0)).count() == 0


# --- 10 ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def field():
    return toxicity.trained_field()


def test_recall_and_precision_on_sentences_not_trained_on(field):
    """At least 0.75 of the abusive sentences are found and at most 0.05 of the clean ones; neither set is trained on."""
    scorer = toxicity.Scorer(field)
    assert len(ABUSIVE) >= 100 and len(CLEAN) >= 100
    trained = {t.lower() for t, _ in toxic_rows.labelled_rows(toxicity.SEED, toxicity.PER_PATTERN)}
    assert not trained & {x.lower().rstrip(".") for x in ABUSIVE + CLEAN}
    found = sum(scorer.document(x)[0] >= 0.5 for x in ABUSIVE)
    wrong = sum(scorer.document(x)[0] >= 0.5 for x in CLEAN)
    assert found >= 0.75 * len(ABUSIVE) and wrong <= 0.05 * len(CLEAN)


def test_wider_kinds_of_abuse_are_covered(field):
    """The rows cover texts of many kinds; before they were widened 34 were found, and 6 clean ones were flagged."""
    scorer = toxicity.Scorer(field)
    assert sum(scorer.document(x)[0] >= 0.5 for x in toxic_cases_r02.ABUSIVE) >= 85
    assert sum(scorer.document(x)[0] >= 0.5 for x in toxic_cases_r02.CLEAN) <= 8


def test_kinds_missed_in_round_2_are_covered(field):
    """Before the rows of these kinds 12 of 28 were found."""
    scorer = toxicity.Scorer(field)
    trained = {t.lower() for t, _ in toxic_rows.labelled_rows(toxicity.SEED, toxicity.PER_PATTERN)}
    assert not trained & {x.lower().rstrip(".") for x in toxic_cases_r03.ABUSIVE + toxic_cases_r03.CLEAN}
    assert sum(scorer.document(x)[0] >= 0.5 for x in toxic_cases_r03.ABUSIVE) >= 24
    assert sum(scorer.document(x)[0] >= 0.5 for x in toxic_cases_r03.CLEAN) <= 2


@pytest.mark.parametrize("text", [
    "There is no test for a pinned extent.", "pack pinned graph", "names = ['lama', 'cow', 'lama', 'beetle']",
])
def test_technical_words_are_clean(field, text):
    assert toxicity.Scorer(field).document(text)[0] < 0.5


@pytest.mark.parametrize("text,word", [
    ("you p***e of s**t", "piece"), ("you p***e of s**t", "shit"), ("go f--- yourself", "fuck"), ("tom is a m***n and that is all", "moron"), ("what a c****n", "cretin"),
])
def test_masked_words_are_the_likeliest(text, word):
    assert word in toxicity.words(text)


def test_numbers_hide_no_words():
    assert toxicity.words("At sketch.rs:745 m0r0n 745, 451 or 455?") == ["at", "sketch", "rs", ":", "moron", ",", "or", "?"]


@pytest.mark.parametrize("text", [
    "you f a t p i g, go home", "you f.a.t p.i.g, go home", "y o u   s t u p i d   m o r o n", "you &#105;di&#111;t, go home", "you &#x69;diot, go home",
    unicodedata.normalize("NFD", "du bist ein erbärmlicher Trottel"), "you \uff49\uff44\uff49\uff4f\uff54, go home", "you worthless mo-\nron, go home", "you wor<b>thl</b>ess idiot",
    "du bist ein erbaermlicher Trottel", "you \U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d, go home",
])
def test_disguised_words_are_restored(field, text):
    got = [w for w in toxicity.words(text) if len(w) > 2]
    assert set(got) & {"pig", "moron", "idiot", "erbärmlicher", "erbaermlicher"}, got
    assert toxicity.Scorer(field).document(text)[0] >= 0.5
    assert all(0 <= a < b <= len(text) for a, b, _ in toxicity.words_at(text))


@pytest.mark.parametrize("text,bad", [
    ("What a m o r o n, go away", True), ("Honestly, you are a p13c3 0f $h1t", True), ("get lost, you i***t", True), ("YOU ARE A STUPID IDIOT.", True), ("your boss is a fucking bаstаrd", True), ("you are a mo\u200bron", True),
    ("My own dumb mistake: I swapped two rows.", False), ("You have to kill the child process first.", False), ('The filter flags "idiot" and "moron" in comments.', False), ("Die Suche findet den Test nicht.", False), ("", False), (None, False),
])
def test_examples(field, text, bad):
    assert (toxicity.Scorer(field).document(text)[0] >= 0.5) is bad


def test_disguises_of_any_kind_are_seen():
    was = re.compile(r"[^\W\d_][@$*013457!]+[^\W\d_]|[@$013457][^\W\d_]|(?<!\w)\w(?:[ .*_-]{1,3}\w){3,}(?!\w)|([^\W\d_])\1\1|[Ѐ-ӿԁһɡѕі]|[a-zA-Z](?:\*{2,}|-{3,})|[a-zA-Z][@$!](?!\w)")
    for text in ("you m_o_r_o_n", "you are an idiot! go", "scheiß ééé", "i d i o t"):
        assert was.search(text) and toxicity.disguised(text)
    rnd = random.Random(2)
    for _ in range(20000):
        text = "".join(rnd.choice("ab1@$!*-_. éßСA") for _ in range(rnd.randint(1, 12)))
        assert toxicity.disguised(text) or not was.search(text), text


def test_marginals_by_enumeration(field):
    import numpy as np

    words = ["you", "idiot", "read", "it"]
    u = np.zeros(5)
    for column in field._columns(np.array([field.look[w] for w in words] + [-1])):
        u += field.weights[column]
    total, p = 0.0, [0.0] * 4
    for y in itertools.product((0, 1), repeat=4):
        s = np.exp(sum(u[k] * y[k] for k in range(4)) + sum(field.trans[y[k], y[k + 1]] for k in range(3)))
        total += s
        for k in range(4):
            p[k] += s * y[k]
    assert field.marginals(words) == pytest.approx([x / total for x in p])
    real = np.ones((1, 4), dtype=bool)
    pairs = toxicity._forward_backward(u[None, :4], field.trans, real, True)[1]
    assert pairs.sum() == pytest.approx(3) and pairs[1].sum() == pytest.approx(sum(p[:3]) / total)


def test_words_and_places():
    for text in ("Get lost, you i***t!", "you m o r o n, go", "Fine \u200bword &amp; <b>bold</b> text.\n\nYou\u2019re it?", "a p13c3 0f $h1t"):
        assert all(0 <= a < b <= len(text) for a, b, _ in toxicity.words_at(text))
        assert toxicity.words(text) == [w for _, _, w in toxicity.words_at(text)]
    assert "moron" in toxicity.words("you m o r o n, go") and "idiot" in toxicity.words("Get lost, you i***t!") and "shit" in toxicity.words("$h1t")


def test_batches_do_not_change_scores(field, monkeypatch):
    texts = [*ABUSIVE[:30], None, "", *CLEAN[:30], "word " * 700]
    whole = toxicity.Scorer(field).documents(texts)
    monkeypatch.setattr(toxicity, "BATCH_WORDS", 25)
    parts = toxicity.Scorer(field).documents(texts)
    assert [x for _, x in whole] == [x for _, x in parts]
    assert [x for x, _ in whole] == pytest.approx([x for x, _ in parts], abs=2e-6)


def test_labelled_table(spark):
    rows = [("you zork zork", [(0, 13)]), ("the zork runs", []), (None, None), ("you mig mig", [(0, 11)]), ("the mig runs", None)] * 20
    t = spark.createDataFrame(rows, "text string, spans array<struct<first:int,last:int>>")
    s = toxicity.Scorer(toxicity.fit_field(t))
    assert s.document("you zork zork")[0] > 0.5 > s.document("the zork runs")[0]


def test_score_documents(spark, field):
    rows = [(1, "Fine. You are a lying idiot, Greg. Fine.", "Chat-Log", 9.0), (2, None, None, 9.0), (3, "", "chat_log", 9.0), (4, "good text " * 30000, "chat_log", 9.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    got = {r.doc_id: r for r in toxicity.score_documents(df, field).collect()}
    assert got[1].score >= 0.5 and "lying idiot" in rows[0][1][got[1].spans[0].first : got[1].spans[0].last] and got[1].spans[-1].last < 38
    assert [got[k].score for k in (2, 3)] == [0.0, 0.0] and got[4].score < 0.1 and not got[4].spans
    rates = {r.source: (r.docs, r.toxic) for r in toxicity.toxic_rates(toxicity.score_documents(df, field)).collect()}
    assert rates == {"chat_log": (3, 1), None: (1, 0)}
    assert toxicity.score_documents(df.limit(0), field).count() == 0
