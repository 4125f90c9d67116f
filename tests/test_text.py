from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from patchlens.functions import masking as M
from patchlens.functions import paths as P
from patchlens.functions import text as X
from patchlens.functions.sql_names import register_functions

KEY = "pass" + "word"


def values(spark, items, make):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("s"))).collect()]


SAMPLES = {
    "id AK" + "IA" + "A1" * 8: "id AKIA***REDACTED***",
    "gh" + "p_" + "a" * 36: "***REDACTED***",
    "gl" + "pat-" + "a" * 20: "glpat-***REDACTED***",
    "np" + "m_" + "a" * 36: "npm_***REDACTED***",
    "authorization: bearer " + "a" * 25: "authorization: Bearer ***REDACTED***",
    "sk" + "_live_" + "a" * 20: "sk_live_***REDACTED***",
    "ey" + "J" + "a" * 10 + ".b" * 1 + "b" * 10 + "." + "c" * 10: "eyJ***REDACTED***",
    "postgres://u:" + "pw@h/d": "postgres://u:***REDACTED***@h/d",
    "https://u:" + "pw@h/d": "https://u:***REDACTED***@h/d",
    "0123abcd" * 8: "0123abcd***REDACTED***",
    f"{KEY}=hunter2 rest": f"{KEY}=***REDACTED*** rest",
    f"{KEY}: hunter2": f"{KEY}: ***REDACTED***",
    f"{KEY}:hunter2": f"{KEY}:***REDACTED***",
    f"a\n{KEY} =\nb": f"a\n{KEY} =\nb",
    "plain text": "plain text",
}


def test_masks(spark):
    got = values(spark, SAMPLES, M.mask_sensitive)
    assert got == list(SAMPLES.values())
    assert values(spark, got, M.mask_sensitive) == got


def test_hinted_masking_equals_full_masking(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "s string")
    out = M.mask_column(df, "s", "m").withColumn("full", M.mask_sensitive(F.col("s")))
    assert out.filter("m <> full").count() == 0


def test_shorten_and_hint(spark):
    df = spark.createDataFrame(
        [("x = abcdefghij!", "abcdefghij"), ("x = short", "short"), ("none", "abcdefghij")],
        "c string, s string",
    )
    got = [r[0] for r in df.select(M.shorten_secret(F.col("c"), F.col("s"))).collect()]
    assert got == ["x = abcd***REDACTED***!", "x = short", "none"]
    assert values(spark, ["", "12345678", "abcdefghijkl"], M.key_hint) == [
        "", "••••", "abcd••••ijkl"
    ]


def test_output_is_masked_before_it_is_cut(spark):
    make = lambda s: M.masked_output(s, F.lit(12))
    got = values(spark, ["short", f"{KEY}=verylongsecret", "éééééééé"], make)
    assert [tuple(g) for g in got][0] == ("short", False)
    assert "verylong" not in got[1].output and got[1].truncated
    assert got[2].output.startswith("éééééé\n")


@pytest.mark.parametrize(
    "path,language,role,directory",
    [
        ("a/b.go", "go", "production", "a"), ("b_test.go", "go", "test", "."),
        (".env.local", "dotenv", "production", "."), ("x/prod.env", "dotenv", "production", "x"),
        ("Makefile", "text", "production", "."), ("a//b/c.TSX", "typescript", "production", "a/b"),
        ("src/test/A.java", "java", "test", "src/test"), ("README.md", "markdown", "example", "."),
        ("examples/a.rs", "rs", "example", "examples"), ("/x.py", "python", "production", "/"),
        ("test_a.py", "python", "test", "."), ("changelog.go", "go", "example", "."),
    ],
)
def test_paths(spark, path, language, role, directory):
    make = lambda s: F.array(P.language(s), P.code_role(s), P.directory(s))
    assert values(spark, [path], make) == [[language, role, directory]]


def test_links(spark):
    links = {
        "https://github.com/o/r.git": ("o", "r"), "o/r": ("o", "r"), "github.com/o/r": ("o", "r"),
        "o/..": None, "o/r/x": None, "https://gitlab.com/o/r": None,
    }
    got = values(spark, links, P.repository_ref)
    assert [tuple(g) if g else None for g in got] == list(links.values())
    changes = {
        "o/r#7": ("o", "r", "7"), "https://github.com/o/r/pull/7": ("o", "r", "7"),
        "www.github.com/o/r/pull/7/": ("o", "r", "7"), "https://evil.com/o/r/pull/7": None,
        "https://github.com/o/r/issues/7": None, "": None,
    }
    got = values(spark, changes, P.change_ref)
    assert [tuple(g) if g else None for g in got] == list(changes.values())
    canonical = {
        "o/r": "https://github.com/o/r", "http://github.com/o/r.git": "https://github.com/o/r",
        "/srv/x.git": "/srv/x.git", "file:///srv/x": "file:///srv/x", "../x": "../x",
    }
    assert values(spark, canonical, P.canonical_repository) == list(canonical.values())
    assert values(spark, ["a\nfatal x-access-token:abc@h \n\n", " "], P.last_error_line) == [
        "fatal x-access-token:***@h", "no stderr"
    ]


def test_literals_survive_as_text(spark):
    odd = ["${x}", "it's", "back\\slash \\u0041", 'two\nlines "q"', "é§", "%{a}"]
    row = spark.range(1).select(X.literal_array(odd), X.lookup({o: o for o in odd}, F.lit(odd[0]))).first()
    assert row[0] == odd and row[1] == odd[0]
    assert spark.range(1).select(X.lookup({1: 0.5}, F.lit(1))).first()[0] == 0.5


def test_small_helpers(spark):
    assert values(spark, [" \t x\n"], X.trimmed) == ["x"]
    assert values(spark, ["ab", "éé", "abcdef"], lambda s: X.cut_bytes(s, 3, "…")) == ["ab", "é…", "abc…"]
    assert values(spark, ["/a/./b/../c", "x//y/", "/../a"], P.normal_path) == ["/a/c", "/x/y", "/a"]
    assert values(spark, [" a\nb\r" + "c" * 100], P.task_name) == ["a b " + "c" * 76]
    assert values(spark, ["/r/x/a.go", "/other"], lambda s: P.relative_to(s, "/r/x")) == ["a.go", "/other"]
    labels = values(spark, ["pr_url", "odd"], P.input_type_label)
    assert labels == ["pull request", "odd"]


def test_sql_functions(spark):
    register_functions(spark)
    df = spark.createDataFrame([(s,) for s in SAMPLES], "s string")
    df.createOrReplaceTempView("samples")
    out = spark.sql("SELECT s, mask_sensitive(s) AS m FROM samples").withColumn(
        "same", F.col("m") == M.mask_sensitive(F.col("s"))
    )
    assert out.filter("NOT same").count() == 0
    paths = ["a/b.go", ".env.x", "Makefile", "x.rs", "p/q.YML"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    df.createOrReplaceTempView("paths")
    out = spark.sql("SELECT p, detect_language(p) AS l FROM paths").withColumn("x", P.language(F.col("p")))
    assert out.filter("l <> x").count() == 0 and out.count() == 5


def test_addresses_are_masked_like_the_patterns_and_in_one_pass(spark):
    import random
    import re
    import time

    from pyspark.sql import functions as F

    from patchlens.functions import masking as M

    rng = random.Random(7)
    bits = ["redis://", "https://", "http://", "MySQL://", "a", "b1", ":", "@", "/", " ", "\n", "é", "xhttp:"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(3000)]
    want = []
    for t in texts:
        for pattern in (M.DATABASE_ADDRESS, M.WEB_ADDRESS):
            t = re.sub(pattern, lambda m: m[1] + M.MARK + "@", t, flags=re.ASCII)
        want.append(t)
    c = F.col("text")
    for mask in M._ADDRESSES.values():
        c = M._in_addresses(c, mask)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = [r[0] for r in df.select(c.alias("m"), "id").orderBy("id").collect()]
    assert got == want
    long = spark.createDataFrame([("redis://" + "a:" * 500_000,), ("https://u:p@" + ":" * 500_000,)], "text string")
    start = time.perf_counter()
    rows = [r[0] for r in long.select(M.mask_sensitive(F.col("text"))).collect()]
    assert time.perf_counter() - start < 20
    assert rows[1].startswith("https://u:" + M.MARK + "@")
