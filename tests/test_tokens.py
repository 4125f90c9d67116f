"""Token facts against a plain character-by-character scanner."""

from __future__ import annotations

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patchlens.functions import tokens as K

OPERATORS = [
    "&^=", "<<=", ">>=", ":=", "<-", "++", "--", "&&", "||", "==", "!=", "<=", ">=", "+=", "-=",
    "*=", "/=", "%=", "&=", "|=", "^=", "=",
]


def quoted_end(s, i, q):
    j = i + 1
    while j < len(s) and s[j] != q:
        j += 2 if s[j] == "\\" and q != "`" and j + 1 < len(s) else 1
    return min(j + 1, len(s))


def number_end(s, i):
    j = i
    if s[i : i + 2].lower() == "0x":
        j += 2
        hexes = "0123456789abcdefABCDEF_"
        while j < len(s) and s[j] in hexes:
            j += 1
        if s[j : j + 1] == ".":
            j += 1
            while j < len(s) and s[j] in hexes:
                j += 1
        return j
    while j < len(s) and s[j] in "0123456789_":
        j += 1
    if j < len(s) and s[j] == "." :
        j += 1
        while j < len(s) and s[j] in "0123456789_":
            j += 1
    if j < len(s) and s[j] in "eE":
        j += 1
        if j < len(s) and s[j] in "+-":
            j += 1
        while j < len(s) and s[j] in "0123456789_":
            j += 1
    return j


def scan(s):
    out, i = [], 0
    while i < len(s):
        c = s[i]
        if s.startswith("//", i):
            out.append(("comment", s[i:]))
            return out
        if s.startswith("/*", i):
            end = s.find("*/", i + 2)
            end = len(s) if end < 0 else end + 2
            out.append(("comment", s[i:end]))
            i = end
        elif c in "\"`'":
            end = quoted_end(s, i, c)
            if c != "'":
                out.append(("string_literal", s[i:end]))
            i = end
        elif c == "_" or c.isalpha():
            end = i
            while end < len(s) and (s[end] == "_" or s[end].isalnum()):
                end += 1
            word = s[i:end]
            if word in K.FACT_KEYWORDS:
                out.append((word, word))
            elif word not in K.SILENT_KEYWORDS:
                out.append(("identifier", word))
            i = end
        elif c.isdigit() or (c == "." and s[i + 1 : i + 2].isdigit()):
            end = number_end(s, i)
            if end < len(s) and s[end] == "i":
                end += 1
            else:
                out.append(("int_literal", s[i:end]))
            i = end
        else:
            op = next((o for o in OPERATORS if s.startswith(o, i)), c)
            if op in ("=", ":="):
                out.append(("assignment", op))
            i += len(op)
    return out


PIECES = st.sampled_from(
    ['"', "`", "'", "\\", " ", "=", ":=", "==", "<-", "/", "*", "//", "/*", "*/", "a", "x1", "_",
     "defer", "go", "func", "12", "0x1f", "3.5e2", ".", "(", ")", "&", "^", "+", "é", '"s"', "7i"]
)


@settings(
    max_examples=6, deadline=None, phases=[Phase.generate],
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=60, max_size=60))
def test_facts_agree_with_a_scanner(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "s string")
    for row in df.select("s", K.facts(F.col("s")).alias("f")).collect():
        assert [(f.kind, f.value) for f in row.f] == scan(row.s), row.s


def test_long_literals_do_not_overflow(spark):
    lines = ['x = "' + "\\a" * 40000 + '"', "/*" + "* " * 40000, "'" + "\\'" * 40000]
    df = spark.createDataFrame([(x,) for x in lines], "s string")
    sizes = [r[0] for r in df.select(F.size(K.facts(F.col("s")))).collect()]
    assert sorted(sizes) == [0, 1, 3]


def test_assigned_value(spark):
    cases = {
        'name := "v"': ("name", '"v"'),
        'APIKey string = "v"': ("APIKey", '"v"'),
        'string = "v"': ("string", '"v"'),
        '= "v"': None,
        'a = f("v")': None,
        'a, b = ("v")': ("b", '"v"'),
        'a == "v"': None,
        'x(y) = 1; z = "v"': ("z", '"v"'),
    }
    df = spark.createDataFrame([(x,) for x in cases], "s string")
    got = df.select("s", K.assigned_value(K.facts(F.col("s"))).alias("a")).collect()
    for row in got:
        assert (tuple(row.a) if row.a else None) == cases[row.s], row.s
