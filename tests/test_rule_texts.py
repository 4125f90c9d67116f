"""Rules of tokens are met by texts, and only keys of rules are cut out of lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlens.operators import rule_index as RI
from patchlens.operators import user_rules as U
from patchlens.operators.line_rules import line_hits


def rule(name: str, **more) -> U.UserRule:
    return U.UserRule(name, name, **more)


def test_rules_of_tokens_are_met_by_their_texts():
    port = rule("P", token_facts=[{"kind": "identifier", "value_contains": ["Port", "addr"]},
                                  {"kind": "string_literal", "value_pattern": "8"}])
    exact = rule("E", token_facts=[{"kind": "identifier", "value_exact": "Timer"}])
    sigma = rule("S", token_facts=[{"kind": "identifier", "value_contains": ["ας"]}])
    by_text, by_path = RI.rule_rows([port, exact, sigma])
    assert [(r[3], r[5][r[1]]) for r in by_text] == [("P", "port"), ("P", "addr"), ("E", "timer")]
    assert [r[3] for r in by_path] == ["S"]


def test_only_keys_are_cut_out(spark, monkeypatch):
    keys = ["todo", "tods", "fixm", "a.b*", "[]^-", "é日😀x", "x=", "\\", "#\t"]
    texts = ["todo fixme todos", "a.b*c axb*", "[]^-]", "é日😀xé日😀", "x=x=", "a\\b", "#\t", "", "toto"]
    df = spark.createDataFrame([(t,) for t in texts], "low string")
    want = [sorted({k for k in keys if k in t}) for t in texts]
    got = [sorted(r[0]) for r in df.select(RI.pieces(F.col("low"), keys)).collect()]
    assert got == want
    # a line without a key isn't copied once for each of its pieces
    assert RI._cut(df, [(k,) for k in keys]).count() == sum(map(len, want))
    monkeypatch.setattr(RI, "PATTERN_KEYS", 1)
    wide = [set(r[0]) for r in df.select(RI.pieces(F.col("low"), keys)).collect()]
    assert all(set(w) <= g for w, g in zip(want, wide))


def test_rules_of_tokens_equal_compiled_ones(file_lines, monkeypatch):
    rules = [
        rule("A", token_facts=[{"kind": "identifier", "value_contains": ["port", "addr"]},
                               {"kind": "string_literal", "value_pattern": "\\d"}]),
        rule("B", token_facts=[{"kind": "comment", "value_contains": ["port"]}], file_extension=[".go"]),
        rule("C", token_facts=[{"kind": "identifier", "value_contains": ["ας"]}]),
        rule("D", token_facts=[{"kind": "assignment"}], line_not_contains=["skip"]),
        rule("E", token_facts=[{"kind": "identifier", "value_exact": "Timer"}, {"kind": "for"}]),
    ]
    text = "\n".join(['myPort := "80"', 'port "x"', '"port 80"', "// port", "x /* PORT */", "ΑΣ.Β := 1", "skip = 1",
                      "for Timer {", "for timer {", "report 8 `1`", "addr, port = `8`", "plain"])
    lines = file_lines({"a.go": text, "b.py": text})
    want = sorted((r["check"], r["new_path"], r["line"]) for one in rules
                  for r in line_hits(lines, rules=[U.compile_rule(one)]).collect())
    for limit in (2000, 1):
        monkeypatch.setattr(RI, "PATTERN_KEYS", limit)
        got = sorted((r["check"], r["new_path"], r["line"]) for r in RI.indexed_hits(lines, rules).collect())
        assert got == want and {x[0] for x in want} == set("ABCDE")
