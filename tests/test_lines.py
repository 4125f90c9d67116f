from __future__ import annotations

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patchlens.sources import lines as L

PATCH = """diff --git a/x.go b/x.go
index 1..2
--- a/x.go
+++ b/x.go
@@ -10,4 +10,3 @@ func main()
 same
-old
--- a comment
+new
 tail

\\ No newline at end of file
diff --git a/y.py b/y.py
--- /dev/null
+++ b/y.py
@@ -0,0 +1 @@
+hello
"""


def rows(df):
    picked = df.orderBy("file_seq", "hunk_seq", "pos").select(
        "new_path", "line_type", "content", "old_line", "new_line"
    )
    return [tuple(r) for r in picked.collect()]


def test_patch_numbers_and_remarks(patch_lines):
    assert rows(patch_lines(PATCH)) == [
        ("x.go", "context", "same", 10, 10),
        ("x.go", "deleted", "old", 11, 0),
        ("x.go", "deleted", "-- a comment", 12, 0),
        ("x.go", "added", "new", 0, 11),
        ("x.go", "context", "tail", 13, 12),
        ("y.py", "added", "hello", 0, 1),
    ]


def test_strict_mode_takes_every_header(patch_lines):
    got = rows(patch_lines(PATCH, strict=True))
    assert got == [
        ("x.go", "context", "same", 10, 10),
        ("x.go", "deleted", "old", 11, 0),
        ("y.py", "added", "hello", 0, 1),
    ]


def test_blank_line_is_context(patch_lines):
    text = "--- a/x\n+++ b/x\n@@ -1,3 +1,3 @@\n a\n\n+b\n-c\n"
    assert rows(patch_lines(text))[1] == ("x", "context", "", 2, 2)


def test_wrong_counts_keep_changes(patch_lines):
    text = "--- a/x\n+++ b/x\n@@ -1 +1 @@\n+a\n+b\n+c\n"
    assert [r[4] for r in rows(patch_lines(text))] == [1, 2, 3]


def test_rejected_patches(spark):
    patches = [
        ("empty", " \n"),
        ("header", "--- a/x\n+++ b/x\n@@ broken @@\n+a\n"),
        ("deleted", "--- a/x\n+++ b/x\n@@ -1 +0,0 @@\n-a\n"),
        ("good", "--- a/x\n+++ b/x\n@@ -1 +1 @@\n+a\n"),
    ]
    df = spark.createDataFrame(patches, "task_id string, diff_text string")
    good, bad = L.split_patches(df)
    assert [r.task_id for r in good.collect()] == ["good"]
    assert {r.task_id: r.reason for r in bad.collect()} == {
        "empty": "empty", "header": "bad_hunk_header", "deleted": "no_added_lines"
    }


def expected_rows(kinds):
    old, new, out = 5, 9, []
    for i, k in enumerate(kinds):
        out.append((k, f"l{i}", old if k != "+" else 0, new if k != "-" else 0))
        old += k != "+"
        new += k != "-"
    return out


@settings(
    max_examples=8, deadline=None, phases=[Phase.generate],
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)
@given(st.lists(st.sampled_from(" +-"), min_size=1, max_size=400))
def test_parse_is_the_inverse_of_render(patch_lines, kinds):
    """Also for hunks longer than one block of line numbers."""
    n_old, n_new = sum(k != "+" for k in kinds), sum(k != "-" for k in kinds)
    body = "\n".join(f"{k}l{i}" for i, k in enumerate(kinds))
    text = f"--- a/p\n+++ b/p\n@@ -5,{n_old} +9,{n_new} @@\n{body}\n"
    names = {"added": "+", "deleted": "-", "context": " "}
    got = [(names[t], c, o, n) for _, t, c, o, n in rows(patch_lines(text))]
    assert got == expected_rows(kinds)


def test_long_hunk_is_exact(patch_lines):
    kinds = [" +-+"[i * i % 4] for i in range(9000)]
    text = "--- a/p\n+++ b/p\n@@ -5,9000 +9,9000 @@\n" + "\n".join(
        f"{k}l{i}" for i, k in enumerate(kinds)
    )
    names = {"added": "+", "deleted": "-", "context": " "}
    got = [(names[t], c, o, n) for _, t, c, o, n in rows(patch_lines(text))]
    assert got == expected_rows(kinds)


def test_whole_files(file_lines):
    got = file_lines({"a.txt": "x\n\ny\n", "b.txt": "", "c.txt": "\n"})
    assert [(r[0], r[2], r[4]) for r in sorted(rows(got))] == [
        ("a.txt", "", 2), ("a.txt", "x", 1), ("a.txt", "y", 3), ("c.txt", "", 1)
    ]


def test_no_shuffle_before_the_rules(patch_lines, file_lines):
    for df in (patch_lines(PATCH), file_lines({"a.go": "x"})):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan


def test_generated_files(file_lines):
    mark = "// Code generated by x. DO NOT EDIT."
    files = {
        "a.go": f"\n\n{mark}\nx", "b.go": "\n".join(["l"] * 10 + [mark]), "c.pb.go": "x",
        "d.go": "\n".join(["l"] * 9 + [mark]), "e.go": f"x {mark}",
    }
    made = {r.new_path for r in file_lines(files).filter("generated").collect()}
    assert made == {"a.go", "c.pb.go", "d.go"}


def test_package_names(patch_lines):
    text = (
        "--- a/x.go\n+++ b/x.go\n@@ -1,2 +1,2 @@\n package old\n+package fresh\n"
        "--- a/y.go\n+++ b/y.go\n@@ -1,1 +1,2 @@ package ctx\n+x\n"
        "--- a/z.go\n+++ b/z.go\n@@ -1,2 +1,2 @@\n package kept\n+package a-b\n"
    )
    got = {r.new_path: r.package for r in L.package_names(patch_lines(text)).collect()}
    assert got == {"x.go": "fresh", "y.go": "ctx", "z.go": "kept"}


def test_selections(patch_lines):
    df = patch_lines(PATCH)
    assert L.added(df).count() == 2
    assert L.deleted(df).count() == 2
    assert L.go_files(df).select("new_path").distinct().count() == 1
    assert L.added_text(df.withColumn("content", F.lit(" "))).count() == 0


def test_a_bad_hunk_rejects_the_whole_patch(spark):
    good = "--- a/x.go\n+++ b/x.go\n@@ -1,1 +1,2 @@\n a\n+b := 1\n"
    bad = good + "@@ broken @@\n+c := 2\n"
    df = spark.createDataFrame([("g", good), ("b", bad)], "task_id string, diff_text string")
    assert {r["task_id"] for r in L.lines_of_patches(df).select("task_id").collect()} == {"g"}
    _, rejected = L.split_patches(df)
    assert [tuple(r) for r in rejected.collect()] == [("b", "bad_hunk_header")]


def test_large_patches_without_additions_are_judged_in_one_pass(spark):
    import time

    one = "--- a/f.go\n+++ /dev/null\n" + "".join(f"@@ -{k},2 +0,0 @@\n-a\n-b\n" for k in range(1, 11))
    df = spark.createDataFrame([("t", one * 5000)], "task_id string, diff_text string")
    start = time.perf_counter()
    _, rejected = L.split_patches(df)
    assert [tuple(r) for r in rejected.collect()] == [("t", "no_added_lines")]
    assert time.perf_counter() - start < 30
