"""Commits, keyed changes and versions of the stored tables; the file tree source."""

from __future__ import annotations

import datetime
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from patchlens.sources import listing
from patchlens.sources import store as ST

AT = datetime.datetime(2024, 1, 5, 10)


def result(spark, task: str, score: float = 1.0, n: int = 2):
    tasks = spark.createDataFrame([(task, "running", AT, score)],
                                  "task_id string, status string, started_at timestamp, risk_score double")
    findings = spark.createDataFrame([(task, "R1", i) for i in range(n)],
                                     "task_id string, rule_id string, line int")
    reports = spark.createDataFrame([(task, f'{{"score": {score}}}', AT)],
                                    "task_id string, json_report string, saved_at timestamp")
    return tasks, findings, reports


def test_a_repeated_commit_adds_nothing(spark, tmp_path):
    store = ST.Store(spark, str(tmp_path))
    assert store.history() == [] and store.read("tasks").count() == 0
    assert ST.save_review(store, "b1", *result(spark, "t1")) == 1
    assert ST.save_review(store, "b1", *result(spark, "t1", 9.0, 7)) == 1
    assert ST.save_review(store, "b2", *result(spark, "t2")) == 2
    assert store.read("findings").count() == 4
    assert sorted(r["risk_score"] for r in store.read("tasks").collect()) == [1.0, 1.0]
    with pytest.raises(ValueError):
        store.commit("a/b", {})
    with pytest.raises(ValueError):
        store.commit("c", gone={"findings": store.read("findings")})


def test_a_commit_that_dies_is_invisible_and_can_be_repeated(spark, tmp_path):
    store = ST.Store(spark, str(tmp_path))
    tasks, findings, reports = result(spark, "t1")
    broken = tasks.withColumn("status", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(PySparkException):
        ST.save_review(store, "b1", broken, findings, reports)
    assert os.path.isdir(tmp_path / "data" / "b1" / "findings")  # written, but not committed
    for name in ("findings", "reports", "tasks"):
        assert store.read(name).count() == 0
    ST.save_review(store, "b1", tasks, findings, reports)
    assert [store.read(n).count() for n in ("findings", "reports", "tasks")] == [2, 1, 1]


def test_replace_delete_and_versions(spark, tmp_path):
    store = ST.Store(spark, str(tmp_path))
    marks = spark.createDataFrame([(i, "R", f"f{i}.go") for i in range(4)],
                                  "id long, rule_id string, file_path string")
    one = store.commit("m1", {"marks": marks})
    two = ST.delete_marks(store, "m2", [1, 3, 99])
    three = store.commit("m3", {"marks": marks.filter("id = 1").withColumn("rule_id", F.lit("S"))},
                         {"marks": marks.filter("id = 0")})
    ids = lambda v=None: sorted((r["id"], r["rule_id"]) for r in store.read("marks", v).collect())
    assert ids(one) == [(i, "R") for i in range(4)] and ids(two) == [(0, "R"), (2, "R")]
    assert ids(three) == ids() == [(1, "S"), (2, "R")]
    four = store.compact("marks", "c1")
    assert four == 4 and ids() == [(1, "S"), (2, "R")] and ids(one) == [(i, "R") for i in range(4)]
    assert store.compact("marks", "c1") == 4 and len(store._live("marks", None)) == 1
    store.commit("m4", {"marks": marks.filter("id = 3")})
    assert ids() == [(1, "S"), (2, "R"), (3, "R")]
    assert store.expire("marks", four) == ["m1", "m2", "m3"] and len(ids()) == 3


def test_reports_are_replaced(spark, tmp_path):
    store = ST.Store(spark, str(tmp_path))
    for i in range(3):
        ST.save_review(store, f"b{i}", *result(spark, "t", float(i)))
    assert [r["json_report"] for r in store.read("reports").collect()] == ['{"score": 2.0}']
    assert [r["json_report"] for r in store.read("reports", 2).collect()] == ['{"score": 1.0}']


def test_status_updates(spark, tmp_path):
    store = ST.Store(spark, str(tmp_path))
    ST.save_review(store, "b1", *result(spark, "t1"))
    minute = datetime.timedelta(minutes=1)
    schema = "task_id string, status string, at timestamp, error_msg string"
    changes = spark.createDataFrame(
        [("t1", "completed", AT + 2 * minute, None), ("t1", "running", AT + minute, None),
         ("unknown", "failed", AT, "x")], schema)
    ST.update_status(store, "s1", changes)
    row = store.read("tasks").first()
    assert (row["status"], row["duration_ms"], row["risk_score"]) == ("completed", 120_000, 1.0)
    ST.update_status(store, "s2", spark.createDataFrame([("t1", "running", AT + 5 * minute, None)], schema))
    row = store.read("tasks").first()
    assert (row["status"], row["duration_ms"], row["completed_at"]) == ("running", None, None)
    failures = spark.createDataFrame([("t2", AT, AT + minute, "queue full")],
                                     "task_id string, started_at timestamp, at timestamp, error_msg string")
    store.commit("f1", {"tasks": ST.failed_tasks(failures)})
    row = store.read("tasks").filter("task_id = 't2'").first()
    assert (row["status"], row["duration_ms"], row["error_msg"]) == ("failed", 60_000, "queue full")


def test_tree_of_files(spark, tmp_path, monkeypatch):
    root = tmp_path / "repo"
    for name, data in {
        "a.go": b"x", "vendor/b.go": b"x", "d/vendor/c.go": b"x", "d/e/f.txt": "é".encode(),
        "c.bin": b"a\x00b", "big.txt": b"x" * ((1 << 20) + 1), "late.bin": b"x" * 8000 + b"\x00",
        "g h+%41.go": b"y", "empty": b"",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "link").symlink_to(root / "a.go")
    (root / "d" / "loop").symlink_to(root)
    (root / "dangling").symlink_to("nowhere")
    os.mkfifo(root / "pipe")
    (root / "secret").write_bytes(b"s")
    got = {r["path"]: r["reason"] for r in listing.tree(spark, str(root)).collect()}
    want = {
        "a.go": None, "vendor": "skipdir", "d/vendor": "skipdir", "d/e/f.txt": None,
        "c.bin": "binary", "big.txt": "oversized", "late.bin": None, "g h+%41.go": None,
        "empty": None, "link": "symlink", "d/loop": "symlink", "dangling": "symlink",
        "pipe": "unreadable", "secret": None}
    assert got == want
    files = {r["path"]: r["content"] for r in listing.tree_files(spark, str(root), "t").collect()}
    assert files.pop("late.bin")[:9] == "x" * 9 and files == {
        "a.go": "x", "d/e/f.txt": "é", "g h+%41.go": "y", "empty": "", "secret": "s"}
    with pytest.raises(ValueError):
        listing.tree_files(spark, str(root), "t", max_files=2)
    links = listing.tree(spark, str(root)).filter("reason = 'symlink'")
    assert links.count() == 3
    assert listing.tree(spark, str(root)).filter("length <= 1").count() == 10


def test_filters_reach_the_walk(tmp_path):
    """Files that a filter rules out are not opened."""
    from pyspark.sql.datasource import EqualTo, IsNull, LessThanOrEqual

    (tmp_path / "a").write_bytes(b"xx")
    (tmp_path / "b").write_bytes(b"x" * 100)
    (tmp_path / "l").symlink_to(tmp_path / "a")
    opened = []

    class Watched(listing.TreeReader):
        def _opened(self, path, length):
            opened.append(os.path.basename(path))
            return super()._opened(path, length)

    def rows(*filters):
        opened.clear()
        reader = Watched(str(tmp_path), False, 2)
        left = list(reader.pushFilters(list(filters)))
        return sorted(r for p in reader.partitions() for r in reader.read(p)), left

    assert rows()[0] == [("a", 2, None), ("b", 100, None), ("l", 0, "symlink")]
    small = LessThanOrEqual(("length",), 10)
    assert rows(IsNull(("reason",)), small) == ([("a", 2, None)], [small]) and opened == ["a"]
    assert rows(EqualTo(("reason",), "symlink")) == ([("l", 0, "symlink")], []) and opened == []


def test_large_and_deep_folders_are_dealt_out(tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "LARGE_FOLDER", 10)
    for i in range(60):
        (tmp_path / f"f{i}").write_bytes(b"")
        (tmp_path / f"d{i % 7}" / "x" / f"y{i}").mkdir(parents=True)
        (tmp_path / f"d{i % 7}" / "x" / f"y{i}" / "z").write_bytes(b"")
    reader = listing.TreeReader(str(tmp_path), False, 4)
    parts = reader.partitions()
    found = [r[0] for p in parts for r in reader.read(p)]
    assert len(parts) == 4 and len(found) == len(set(found)) == 120
    assert all(list(reader.read(p)) for p in parts)
    with pytest.raises(FileNotFoundError):
        listing.TreeReader(str(tmp_path / "none"), False, 4).partitions()
