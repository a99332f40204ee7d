import re
import time

import pytest
from conftest import plan_of
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from hunkwise.functions.unified_diff import MODIFIERS
from hunkwise.operators import diffs as ops
from hunkwise.schemas import SNIPPET_COLUMNS

# One file with two hunks: a Python function between other lines, and a removal only.
SIMPLE = """diff --git a/tools/grid.py b/tools/grid.py
--- a/tools/grid.py
+++ b/tools/grid.py
@@ -20,2 +22,7 @@ class Grid:
 WIDTH = 9
+HEIGHT = 4
+def cells(rows, shift=0):
+    for row in rows:
+        yield [c << shift for c in row]
-WIDTH = 8
@@ -80,3 +85,1 @@
-def unused():
-    pass
 end = True
"""

# Two functions in different languages' forms and a third after a gap of context.
THREE = """diff --git a/web/total.js b/web/total.js
index 1..2 100644
--- a/web/total.js
+++ b/web/total.js
@@ -5,0 +6,9 @@
+export async function total(cart) {
+  return cart.reduce((sum, item) => sum + item.price, 0);
+}
 // context
+fn main_loop(state: State) -> bool {
+    state.tick()
+}
+func (c *Cart) Clear(force bool) {
+	c.items = nil
+}
"""


def extract(spark, *texts):
    """(path, start, end, code) of each diff, in order."""
    rows = [(f"r{i}", "9c41d07be25f6a83", text) for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "repo string, commit_sha string, diff string")
    out = [[] for _ in texts]
    for row in ops.function_snippets(df, 5).collect():
        assert row.commit_sha == "9c41d07be25f6a83" and row.timestamp == 5
        out[int(row.repo[1:])].append((row.file_path, row.start_line, row.end_line, row.code))
    return out


def hunk(*lines, path="x.c", start=1):
    return f"+++ b/{path}\n@@ -1,2 +{start},3 @@\n" + "\n".join(lines) + "\n"


# A plain restatement of the rules, for comparison. It tries the function forms
# word by word instead of with one pattern.
SPACE = "\t\n\f\r "
WORD = re.compile(r"[A-Za-z0-9_]+")


def skip_space(s, i):
    while i < len(s) and s[i] in SPACE:
        i += 1
    return i


def word_at(s, i):
    m = WORD.match(s, i)
    return (m.group(), m.end()) if m else (None, i)


def words_then_paren(s, i):
    """End of "mod* word word (" at ``i``, or None."""
    words = []
    while True:
        w, j = word_at(s, i)
        if w is None:
            return None
        words.append(w)
        k = skip_space(s, j)
        if k < len(s) and s[k] == "(":
            break
        if k == j:
            return None
        i = k
    if len(words) < 2 or any(w not in MODIFIERS for w in words[:-2]):
        return None
    return k + 1


def keyword(s, i, name):
    """Position after ``name`` and white space, or None."""
    if not s.startswith(name, i):
        return None
    j = skip_space(s, i + len(name))
    return j if j > i + len(name) else None


def name_then_paren(s, i):
    w, j = word_at(s, i)
    if w is None:
        return None
    k = skip_space(s, j)
    return k + 1 if k < len(s) and s[k] == "(" else None


def start_at(s, i):
    end = words_then_paren(s, i)
    if end:
        return end
    j = keyword(s, i, "func")
    if j is not None:
        if j < len(s) and s[j] == "(":
            close = s.find(")", j)
            if close >= 0:
                end = name_then_paren(s, skip_space(s, close + 1))
        else:
            end = name_then_paren(s, j)
        if end:
            return end
    for first, last, ends in (("pub", "fn", "name"), (None, "def", "paren"), ("export", "function", "paren")):
        j = i
        if first:
            j = keyword(s, j, first) or j
            j = keyword(s, j, "async") or j
        j = keyword(s, j, last)
        if j is None:
            continue
        if ends == "paren":
            end = name_then_paren(s, j)
        else:
            w, e = word_at(s, j)
            end = e if w else None
        if end:
            return end
    return None


def reference(diff):
    out, chunks = [], []
    for line in diff.split("\n"):
        if line.startswith("diff --git") or not chunks:
            chunks.append([])
        chunks[-1].append(line)
    for chunk in chunks:
        path = next((line[4:].removeprefix("b/") for line in chunk if line.startswith("+++ ")), "")
        if not path:
            continue
        hunks = []
        for line in chunk:
            header = re.match(r"@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,[0-9]+)? @@", line)
            if header:
                hunks.append((int(header.group(1)), []))
            elif hunks and line.startswith("+") and not line.startswith("+++"):
                hunks[-1][1].append(line[1:])
        for base, added in hunks:
            if not added:
                continue
            code = "\n".join(added)
            starts, i = [], 0
            while True:
                end = start_at(code, i)
                if end:
                    starts.append(i)
                nxt = code.find("\n", end or i)
                if nxt < 0:
                    break
                i = nxt + 1
            found = []
            for s, e in zip(starts, starts[1:] + [len(code)]):
                piece = code[s:e].strip()
                if len(piece.encode()) >= 10:
                    at = base + code[:s].count("\n")
                    found.append((path, at, at + piece.count("\n"), piece))
            out += found or [(path, base, base + len(added) - 1, code)]
    return out


def test_simple_diff(spark):
    assert extract(spark, SIMPLE) == [
        [("tools/grid.py", 23, 25, "def cells(rows, shift=0):\n    for row in rows:\n        yield [c << shift for c in row]")]
    ]


def test_three_functions(spark):
    (rows,) = extract(spark, THREE)
    assert [r[:3] for r in rows] == [("web/total.js", 6, 8), ("web/total.js", 9, 11), ("web/total.js", 12, 14)]
    assert rows[2][3] == "func (c *Cart) Clear(force bool) {\n\tc.items = nil\n}"


def test_empty_and_missing_diff(spark):
    df = spark.createDataFrame([("r", "s", ""), ("r", "s", None)], "repo string, commit_sha string, diff string")
    assert ops.function_snippets(df, 1).collect() == []


EDGES = {
    "no file line": hunk("+x = 1"),
    "text first": "From: someone\nSubject: x\n" + SIMPLE,
    "two files, two hunks": THREE + SIMPLE + "@@ -9 +40 @@ void f()\n ctx\n+tail line\n",
    "dev null": "diff --git a/x b/x\n--- a/x\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone\n+odd\n",
    "double plus": hunk("+++i;", "+a;", "++b"),
    "carriage return": hunk("+int f(int a) {\r", "+  return 1;\r", "+}\r"),
    "small pieces": hunk("+int f()"),
    "wide characters": hunk("+int f(é)"),
    "exactly ten bytes": hunk("+int f(ab);"),
    "over two lines": hunk("+static", "+int f(int a) {", "+}"),
    "else if": hunk("+else if (abcdef) {"),
    "indented": hunk("+  int f(int a) {", "+}"),
    "pointer": hunk("+char *f(int a) {", "+}"),
    "public": hunk("+public static void main(String[] a) {"),
    "async def": hunk("+async def f(a):", "+def g(a, b):", "+  pass"),
    "go method": hunk("+func (s *Store) Get(id int) {", "+}", "+func Put(a) {", "+}"),
    "rust": hunk("+pub async fn run", "+fn other<T>() {", "+}", "+pub fn x"),
    "script": hunk("+export async function f(a) {", "+}", "+function g (b) {", "+const h = (a) => 1"),
    "control": hunk("+int f(int a) {", "+\x01\x02\x03 x\x01", "+\x01\x03int g(int b) {", "+\x01", "+}"),
    "line separators": hunk("+a b( int f(int a)", "+x\x85int g(b)", "+\x0bint h(int a)"),
    "white space ends": hunk("+int f(int a) {", "+}　 ", "+\xa0", "+"),
    "header in context": "+++ x.c\n@@ -1 +1 @@\n+a\n @@ -1 +7 @@\n+b\n@@ bad @@\n+c\n@@ -1,2 +9 @@ f\n+d",
    "huge number": "+++ x.c\n@@ -1 +99999999999 @@\n+a",
    "beyond 64 bits": "+++ x.c\n@@ -1 +99999999999999999999 @@\n+a",
    "dead receivers": hunk("+func (", "+func (a", "+int f(b) {", "+func (c", "+) x(d) {", "+func (e", "+static int g(h"),
    "word before a receiver": hunk("+int", "+func (a", "+func (b", "+) named (c) {", "+}"),
    "no path": "@@ -1 +1 @@\n+a",
    "blank path": "+++ b/\n@@ -1 +1 @@\n+a",
    "only removed": hunk("-a", " b"),
    "one empty line": hunk("+"),
    "receiver over lines": hunk("+func (", "+  a int,", "+) name (x) {", "+}"),
    "modifier then newline run": hunk("+static const", "+unsigned", "+long f (int a)", "+void int (x) { return; }"),
}


def test_edge_cases(spark):
    texts = list(EDGES.values())
    expected = [reference(t) for t in texts]
    expected[list(EDGES).index("beyond 64 bits")] = [("x.c", (1 << 63) - 1, (1 << 63) - 1, "a")]
    for name, got, want in zip(EDGES, extract(spark, *texts), expected):
        assert got == want, name


def test_many_open_receivers(spark):
    """Takes seconds: no receiver is searched to the end of the hunk."""
    began = time.monotonic()
    (whole,) = extract(spark, hunk(*["+func ("] * 200_000))[0]
    assert whole[3].count("func (") == 200_000
    assert time.monotonic() - began < 30


LINES = st.sampled_from(
    [
        "int f(int a) {", "static", "static inline", "const unsigned long x (", "foo bar(", "else if (x) {", "}", "",
        "  return 1;", "def g(x):", "async def h(x):", "func (r *T) M(a) {", "func N(", "func (", ") name (", "pub fn q",
        "async fn z()", "export function e(", "function  k (", "a b c(", "++i", "static void", "f(", "(", "int", "é è(",
        "word", "\x01", "\x01\x03x", "\t", "struct s { int a; };", "\r", "pub", "fn", "export", "async", "function",
    ]
)
PREFIX = st.sampled_from(["+", "+", "+", "+", " ", "-"])
HEADERS = st.sampled_from(
    ["@@ -1 +1 @@", "@@ -3,4 +7,9 @@ ctx", "diff --git a/y.go b/y.go", "+++ b/y.go", "+++ z.py", "--- a/y", "@@ odd"]
)


@st.composite
def random_diff(draw):
    parts = ["+++ b/a.c", "@@ -1 +5,2 @@"] if draw(st.booleans()) else []
    for _ in range(draw(st.integers(0, 25))):
        parts.append(draw(HEADERS) if draw(st.integers(0, 9)) == 0 else draw(PREFIX) + draw(LINES))
    return "\n".join(parts)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(random_diff(), min_size=80, max_size=80))
def test_random_diffs(spark, texts):
    assert extract(spark, *texts) == [reference(t) for t in texts]


@pytest.mark.parametrize("gap", [" ", "\n"])
@pytest.mark.parametrize("tail", ["", "f(int a)", "a b c(", "(", "int f(x)\nfn abcdefghij"])
@pytest.mark.parametrize("count", [2, 63, 64, 65, 66, 130])
def test_runs_of_modifiers(spark, gap, tail, count):
    text = hunk(*("+" + line for line in (("static" + gap) * count + tail).split("\n")))
    assert extract(spark, text) == [reference(text)]


def test_hostile_modifier_run(spark):
    words = ("static\n" * 200_000 + "a b c(\nfn abcdefghij").split("\n")
    (rows,) = extract(spark, hunk(*("+" + w for w in words)))
    assert rows == [("x.c", 200_002, 200_002, "fn abcdefghij")]


def test_many_functions_in_one_hunk(spark):
    lines = [f"+int f{i}(int a) {{\n+  return {i};\n+}}" for i in range(20_000)]
    (rows,) = extract(spark, hunk(*lines))
    assert len(rows) == 20_000 and rows[-1][:3] == ("x.c", 59_998, 60_000)


def test_snippet_id(spark):
    rows = [("team/tool", "0123456789abcdef", "src/a b.rs", 7), ("r", "abc", "x", 1)]
    df = spark.createDataFrame(rows, "repo string, commit_sha string, file_path string, start_line int")
    assert [r.id for r in ops.with_snippet_id(df).collect()] == ["team/tool/01234567/src/a b.rs#L7", "r/abc/x#L1"]


def test_snippet_lines(spark):
    df = spark.createDataFrame([("a\n\nb", 7), ("", 1)], "code string, start_line int")
    rows = ops.snippet_lines(df).select("line_number", "content").collect()
    assert [tuple(r) for r in rows] == [(7, "a"), (8, ""), (9, "b")]


def test_plan_is_narrow(spark):
    df = spark.createDataFrame([("r", "s", THREE)], "repo string, commit_sha string, diff string")
    out = ops.function_snippets(df, F.lit(1))
    assert out.columns == SNIPPET_COLUMNS
    plan = plan_of(out)
    assert "Exchange" not in plan and "Python" not in plan
