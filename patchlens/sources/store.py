"""Stored tables with one commit for all that belongs together, keyed changes and versions.

A commit writes the rows of any number of tables below ``data/<batch>``, and then one small file
that names them, ``commits/<batch>.json``. Only what such a file names exists for readers, so a
result of a review (task, findings, report) is there whole or not at all. The name of a batch is
the caller's: when a commit is run again after a crash, it overwrites its own unfinished data; when
it had come to its end, nothing happens. One writer at a time; readers need no lock.

Keyed tables are read by merging: of the rows of a key the one of the latest commit counts, and a
deletion is a row too. The merge is an aggregate with map-side combine. ``compact`` writes the
merged rows as one commit that stands for those before it; older versions stay readable until
``expire`` deletes what no kept version needs.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import SCHEMAS, conform

#: Key of each table that changes row by row; the others only grow.
KEYS = {"tasks": ["task_id"], "reports": ["task_id"], "marks": ["id"]}
_META = "__batch string, __seq long, __gone boolean"


class Store:
    """Tables below ``base``, a folder that all machines share."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *parts: path("/".join([self.base, *parts]))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    # Commits --------------------------------------------------------------------------

    def history(self) -> list[dict]:
        """The commits in order: batch, version, tables, and the batches they stand for."""
        if not self._fs.exists(self._path("commits")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path("commits"))]
        found = [self._read(n) for n in names if n.endswith(".json") and not n.startswith((".", "_"))]
        return sorted(found, key=lambda c: c["version"])

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path("commits", name))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, commit: dict) -> None:
        """The commit exists from the moment its file has its name."""
        draft = self._path("commits", f"_{commit['batch']}.draft")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(commit).encode()))
        finally:
            out.close()
        if not self._fs.rename(draft, self._path("commits", f"{commit['batch']}.json")):
            raise OSError(f"commit {commit['batch']} could not be published")

    def committed(self, batch: str) -> int | None:
        """Version of a batch, None if it isn't committed."""
        name = f"{batch}.json"
        return self._read(name)["version"] if self._fs.exists(self._path("commits", name)) else None

    def commit(self, batch: str, rows: dict[str, DataFrame] | None = None,
               gone: dict[str, DataFrame] | None = None) -> int:
        """Add or replace ``rows`` and delete the keys in ``gone``, all at once; the version.

        Inside a commit a deletion comes before the rows.
        """
        if not batch or not all(c.isalnum() or c in "-." for c in batch):
            raise ValueError(f"a batch is named by letters, digits, - and .: {batch!r}")
        known = self.committed(batch)
        if known is not None:
            return known
        for name in gone or {}:
            if name not in KEYS:
                raise ValueError(f"{name} has no key")
        parts = [(name, conform(df, name), False) for name, df in (rows or {}).items()]
        parts += [(name, self._keys_only(name, df), True) for name, df in (gone or {}).items()]
        for name, df, is_gone in parts:
            df.withColumns({
                "__batch": F.lit(batch), "__seq": F.lit(0 if is_gone else 1).cast("long"),
                "__gone": F.lit(is_gone),
            }).write.mode("overwrite").parquet(self._data(batch, name, is_gone))
        history = self.history()
        version = 1 + (history[-1]["version"] if history else 0)
        tables: dict[str, list[str]] = {}
        for name, _, is_gone in parts:
            tables.setdefault(name, []).append("gone" if is_gone else "rows")
        self._publish({"batch": batch, "version": version, "tables": tables, "stands_for": []})
        return version

    def _data(self, batch: str, name: str, is_gone: bool) -> str:
        return f"{self.base}/data/{batch}/{name}/{'gone' if is_gone else 'rows'}"

    @staticmethod
    def _keys_only(name: str, df: DataFrame) -> DataFrame:
        return conform(df.select(*KEYS[name]).distinct(), name)

    # Reads ----------------------------------------------------------------------------

    def _live(self, name: str, version: int | None) -> list[dict]:
        """Commits that hold rows of a table as of a version."""
        seen = [c for c in self.history() if version is None or c["version"] <= version]
        replaced = {b for c in seen if name in c["tables"] for b in c["stands_for"]}
        return [c for c in seen if name in c["tables"] and c["batch"] not in replaced]

    def raw(self, name: str, version: int | None = None) -> DataFrame:
        """All stored rows of a table, with the version that wrote them and what they do."""
        live = self._live(name, version)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SCHEMAS[name].fields)
        paths = [self._data(c["batch"], name, kind == "gone")
                 for c in live for kind in c["tables"][name]]
        reader = self.spark.read.schema(f"{schema}, {_META}")
        rows = reader.parquet(*paths) if paths else self.spark.createDataFrame([], f"{schema}, {_META}")
        # one short row a commit
        versions = self.spark.createDataFrame(
            [(c["batch"], c["version"]) for c in live], "__batch string, __version long")
        return rows.join(F.broadcast(versions), "__batch")

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of a table, now or as of a version."""
        rows = self.raw(name, version)
        columns = SCHEMAS[name].fieldNames()
        if name not in KEYS:
            return rows.select(*columns)
        rest = [c for c in columns if c not in KEYS[name]]
        order = F.struct("__version", "__seq", *rest)
        last = rows.groupBy(*KEYS[name]).agg(
            F.max_by(F.struct("__gone", *rest), order).alias("last"))
        return last.filter("not last.__gone").select(
            *[F.col(c) if c in KEYS[name] else F.col(f"last.{c}") for c in columns])

    # Upkeep ---------------------------------------------------------------------------

    def compact(self, name: str, batch: str) -> int:
        """One commit with the merged rows, which stands for all before it."""
        known = self.committed(batch)
        if known is not None:
            return known
        live = self._live(name, None)
        self.read(name).withColumns({
            "__batch": F.lit(batch), "__seq": F.lit(1).cast("long"), "__gone": F.lit(False),
        }).write.mode("overwrite").parquet(self._data(batch, name, False))
        history = self.history()
        version = 1 + (history[-1]["version"] if history else 0)
        self._publish({"batch": batch, "version": version, "tables": {name: ["rows"]},
                       "stands_for": [c["batch"] for c in live]})
        return version

    def expire(self, name: str, keep_from: int) -> list[str]:
        """Delete a table's data that no version from ``keep_from`` on reads; their batches."""
        needed = {c["batch"] for c in self._live(name, keep_from)}
        needed |= {c["batch"] for c in self.history() if c["version"] > keep_from}
        gone = [c["batch"] for c in self.history()
                if name in c["tables"] and c["batch"] not in needed]
        for batch in gone:
            self._fs.delete(self._path("data", batch, name), True)
        return gone


def save_review(store: Store, batch: str, tasks: DataFrame, findings: DataFrame,
                reports: DataFrame) -> int:
    """Task, findings and report of a review: all of them, once, or nothing."""
    return store.commit(batch, {"findings": findings, "reports": reports, "tasks": tasks})


def update_status(store: Store, batch: str, changes: DataFrame) -> int:
    """Set the status of tasks: ``changes(task_id, status, at, error_msg)``, the latest counts.

    An end (completed or failed) sets the time of completion and the duration since the start;
    any other status clears both. Tasks that aren't stored are left alone.
    """
    last = changes.groupBy("task_id").agg(
        F.max(F.struct("at", "status", "error_msg")).alias("to"))
    ends = F.col("to.status").isin("completed", "failed")
    at = F.when(ends, F.col("to.at"))
    moved = store.read("tasks").join(last, "task_id").withColumns({
        "status": F.col("to.status"),
        "completed_at": at,
        "duration_ms": F.unix_millis(at) - F.unix_millis("started_at"),
        "error_msg": F.col("to.error_msg"),
    })
    return store.commit(batch, {"tasks": moved})


def failed_tasks(failures: DataFrame) -> DataFrame:
    """Rows of tasks that failed before they were stored: task_id, started_at, at, error_msg."""
    return failures.select(
        "task_id", F.lit("failed").alias("status"), "started_at",
        F.col("at").alias("completed_at"),
        (F.unix_millis("at") - F.unix_millis("started_at")).alias("duration_ms"), "error_msg")


def delete_marks(store: Store, batch: str, ids: Iterable[int] | DataFrame) -> int:
    """Forget false-positive marks by id."""
    if not isinstance(ids, DataFrame):
        ids = store.spark.createDataFrame([(int(i),) for i in ids], "id long")
    return store.commit(batch, gone={"marks": ids})


__all__ = ["Store", "save_review", "update_status", "failed_tasks", "delete_marks"]
