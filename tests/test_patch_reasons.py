"""Patches are judged by searches in their text, with the results of a walk over its lines."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from patchlens.functions import text as T
from patchlens.sources import lines as L


def reason(text: str | None) -> str | None:
    """Why a patch can't be reviewed, line by line."""
    if text is None or not text.strip():
        return "empty"
    lines, seen = text.replace("\r\n", "\n").split("\n"), 0
    if any(x.startswith("@@ ") and not re.match(r"@@ .\d+(?:,\d+)? .\d+(?:,\d+)? @@", x) for x in lines):
        return "bad_hunk_header"
    for x in lines:
        if seen == 0 and x.startswith("--- "):
            seen = 1
        elif seen == 1 and x.startswith("@@ "):
            seen = 2
        elif seen == 2 and x.startswith("+") and not x.startswith("+++ "):
            return None
    return "no_added_lines"


def test_reasons_of_patches(spark):
    rng = random.Random(7)
    pieces = ["--- a", "--- ", "+++ b", "@@ -1 +1 @@", "@@ -1,2 +3,4 @@ f", "@@ x", "+", "+a", "+++ ", "++ c", "-a",
              " a", "", "x @@ -1", "é", "@@", "\r", "+é@@ x"]
    texts = ["\n".join(rng.choices(pieces, k=rng.randint(0, 7))) for _ in range(500)]
    texts += [t.replace("\n", "\r\n") for t in texts[:150]] + [t + "\n" for t in texts[:100]] + [None]
    df = spark.createDataFrame([(str(n), t) for n, t in enumerate(texts)], "task_id string, diff_text string")
    good, bad = L.split_patches(df)
    got = {r.task_id: None for r in good.collect()} | {r.task_id: r.reason for r in bad.collect()}
    want = {str(n): reason(t) for n, t in enumerate(texts)}
    assert got == want and {None, "empty", "bad_hunk_header", "no_added_lines"} == set(want.values())
    # a search that ends at the first added line; no patch is cut into lines to be judged
    assert "aggregate" not in good._jdf.queryExecution().optimizedPlan().toString()


def test_first_character_and_shared_signs(spark):
    texts = ["", "a", "+a", "é", "éa", "😀 x", " ", "日本", "+日本", "\x7fa", "\x80a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.without_first(F.col("t"))).collect()] == [t[1:] for t in texts]
    words = ["os.Open(", ".Conn(", "net.Dial("]
    df = spark.createDataFrame([(t,) for t in ["x os.Open(y", "os.Open", "a.Conn((", "(", ""]], "t string")
    assert [r[0] for r in df.select(T.contains_any(F.col("t"), words)).collect()] == [True, False, True, False, False]
