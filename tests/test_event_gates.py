"""Gates of a pass over lines are compiled, and names are found by their borders."""

from __future__ import annotations

import re

from patchlens.operators.events import emitted
from patchlens.operators.pair_rules import EMITTERS, NAME_KINDS, TEST_EMITTERS
from patchlens.plans.review import NOLINT, OWN_RULES
from patchlens.sources import lines as L


def codes(df) -> list:
    """(size of the largest method, text) of the generated code of each stage."""
    debug = getattr(df.sparkSession._jvm.org.apache.spark.sql.execution.debug, "package$")
    parts = getattr(debug, "MODULE$").codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return [(p._3().maxMethodCodeSize(), p._2()) for p in (parts.apply(n) for n in range(parts.size()))]


def test_gates_are_compiled(spark, tmp_path):
    """Java leaves a method of more than 8,000 bytes to its interpreter."""
    path = str(tmp_path / "lines")
    spark.createDataFrame([], L.LINE_SCHEMA).write.parquet(path)
    lines = spark.read.parquet(path)
    chosen = [*OWN_RULES, *EMITTERS, NOLINT]
    for part in ([e for e in chosen if e.kind not in NAME_KINDS],
                 [e for e in chosen if e.kind in NAME_KINDS]):
        sizes = [size for size, _ in codes(emitted(lines, part))]
        assert sizes and max(sizes) < 8000


def test_names_of_lines(file_lines):
    """Names by their borders: beside accents, digits, underscores and inside calls."""
    texts = ["Load(x)", "aLoad(x)", "é.Load", "Äb Größe Ära Straße_9 xGröße", "_Save 9Save Save_", "newRealThing(",
             "a.NewThing (b)", "// Load", "func   ", "func", "\tfunc Test_x(", "} {", "} x", "{ ", "a(b(Cd(",
             "t.Skip()", " ", "", "Größé Größe1 É Éa", "func TestSave_empty_now(t) {"]
    lines = file_lines({"a_test.go": "\n".join(texts)})
    name = [e for e in TEST_EMITTERS if e.kind == "name"]
    got = {(r.line, r.check, r.key) for r in emitted(lines, name).collect()}
    words = r"(?<![A-Za-z0-9_])([A-Z][A-Za-z0-9_]*)"
    accents = (r"(?<![A-Za-z0-9_])([A-Z][A-Za-z0-9_]*(?![A-Za-z0-9_])[^\x00-\x7f]\w*[A-Za-z0-9_])(?![A-Za-z0-9_])")
    for n, text in enumerate(texts, 1):
        t = text.strip()
        want = set()
        if not t.startswith(("//", "func ")):
            want |= set(re.findall(words, text)) | set(re.findall(accents, text))
        if not t.startswith("//"):
            for w in re.findall(r"func Test([A-Z][A-Za-z0-9_]*_)", text):
                parts = w.split("_")
                want |= {"_".join(parts[:k]) for k in range(1, len(parts))}
        assert {k for at, use, k in got if at == n and use == "named"} == want, text
        works = t != "" and not t.startswith(("//", "/*")) and t not in ("}", "{", "} {", "}{") and "t.Skip" not in t
        assert ((n, "works", "") in got) == works, text
