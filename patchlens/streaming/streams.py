"""Streaming forms: continuous review, task states, trend, duplicates, audit, watchdog."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ValueState
from pyspark.sql.types import StructType

from ..operators.commands import audit_entries, decide_commands
from ..operators.findings import KEY, findings_of
from ..operators.line_rules import line_hits
from ..plans.review import review
from ..sources.lines import lines_of_patches, split_patches

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DEADLINE = timedelta(minutes=10)


def use_state_store(spark: SparkSession) -> None:
    """Keep state on executor disks and in the checkpoint instead of in executor memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of its own for a stateful stream.

    The number of state partitions is fixed when a stream first starts: one per core of the
    cluster. Settings of the caller's session stay as they are.
    """
    session = spark.newSession()
    use_state_store(session)
    session.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)
    for name in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled"):
        session.conf.set(name, spark.conf.get(name))
    return session


def table_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stored table as a stream: one Parquet file, or a growing folder of part files.

    The path is read as a pattern that matches itself, since a stream takes a single file only so.
    """
    head, _, last = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).parquet(f"{head}/[{last[0]}]{last[1:]}")


def run_to_files(stream: DataFrame, out: str, mode: str = "append") -> StreamingQuery:
    """Process all available input into Parquet files below ``out`` and wait for the end."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def run_to_table(stream: DataFrame, out: str) -> StreamingQuery:
    """Keep a small aggregate below ``out`` up to date: each batch writes the whole table anew.

    A batch has a folder of its own, so a reader (``newest_table``) always sees a whole table,
    also while the next one is written or after a crash. The one before the last is kept.
    """

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")
        _drop(batch.sparkSession, f"{out}/rows/batch={batch_id - 2}")

    return run_batches(stream, out, replace, "complete")


def _drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def newest_table(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """The last whole table that ``run_to_table`` wrote below ``out``."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(f"{out}/rows")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatus(root) if fs.exists(root) else []
    whole = [f.getPath() for f in found if fs.exists(path(f.getPath(), "_SUCCESS"))]
    if not whole:
        return spark.createDataFrame([], schema)
    last = max(whole, key=lambda p: int(p.getName().split("=")[1]))
    return spark.read.schema(schema).parquet(last.toString())


def closing_row(events: DataFrame, at: str, after: str = "INTERVAL 3650 DAYS") -> DataFrame:
    """One row without content, long after all others: it moves the watermark past them."""
    last = events.agg((F.max(at) + F.expr(after)).alias(at))
    return last.select(*(
        F.col(at) if c == at else F.lit("" if kind == "string" else None).cast(kind).alias(c)
        for c, kind in events.dtypes))


def run_batches(
    stream: DataFrame, out: str, work: Callable[[DataFrame, int], None], mode: str = "append"
) -> StreamingQuery:
    query = (
        stream.writeStream.foreachBatch(work)
        .option("checkpointLocation", f"{out}/checkpoint")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


# Review -----------------------------------------------------------------------------


def line_findings(patches: DataFrame) -> DataFrame:
    """Findings of the line rules over a stream of patches. Needs no state at all.

    Patches that can't be reviewed give no rows here; ``rejected_patches`` has their reasons.
    """
    return findings_of(line_hits(lines_of_patches(patches)))


def rejected_patches(patches: DataFrame) -> DataFrame:
    """Patches of a stream that can't be reviewed, with the reason; needs no state either."""
    return split_patches(patches)[1]


def review_stream(patches: DataFrame, out: str) -> StreamingQuery:
    """The full review per micro-batch; a patch never spans batches.

    Each batch writes its own folder with overwrite, so a repeated batch adds nothing. Patches
    that can't be reviewed go to ``rejected`` beside ``findings``, with their reason.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_patches(batch)
        bad.write.mode("overwrite").parquet(f"{out}/rejected/batch={batch_id}")
        lines = lines_of_patches(good).persist()
        try:
            found = review(lines)
            found.write.mode("overwrite").parquet(f"{out}/findings/batch={batch_id}")
        finally:
            lines.unpersist()

    return run_batches(patches, out, work)


# Tasks ------------------------------------------------------------------------------


def trend_stream(tasks: DataFrame, late: str | None = None) -> DataFrame:
    """Tasks and mean risk per day.

    Without ``late`` the state is one row a day and no row is ever too late: run it in complete
    or update mode. With ``late`` a day is final, and its state goes, once the watermark has
    passed it: run it in append mode.
    """
    day = F.window("started_at", "1 day")
    return (
        (tasks.withWatermark("started_at", late) if late else tasks)
        .groupBy(day.alias("w"))
        .agg(F.count("*").alias("tasks"), F.avg("risk_score").alias("avg_risk"))
        .select(F.to_date("w.start").alias("day"), "tasks", "avg_risk")
    )


def state_stream(events: DataFrame) -> DataFrame:
    """Latest status per task, kept by the engine; run it in update or complete mode."""
    return events.groupBy("task_id").agg(
        F.max(F.struct("at", "status")).alias("last"), F.min("at").alias("started_at")
    ).select("task_id", "last.status", F.col("last.at").alias("at"), "started_at")


def distinct_findings(findings: DataFrame, late: str = "1 hour") -> DataFrame:
    """Findings without repeats of the same key that arrive within the watermark."""
    return findings.withWatermark("found_at", late).dropDuplicatesWithinWatermark(KEY)


def audit_stream(commands: DataFrame, at: str = "decided_at") -> DataFrame:
    """Audit entries of a command stream, ready for a JSON sink."""
    return audit_entries(decide_commands(commands), F.col(at))


AUDIT = ("timestamp timestamp, command string, decision string, risk_level string, "
         "rule_id string, reason string")
_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def audit_log(commands: DataFrame, out: str, at: str = "decided_at") -> StreamingQuery:
    """Append the decisions on a command stream to an audit log of JSON lines, once each.

    A batch has a folder of its own, which it writes as a whole; when it is run again after a
    crash it replaces what it had written, and adds nothing.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("timestampFormat", _MICROS).json(
            f"{out}/entries/batch={batch_id}")

    return run_batches(audit_stream(commands, at), out, work)


def read_audit(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(AUDIT).option("timestampFormat", _MICROS).json(f"{out}/entries").select(
        *(c.split()[0] for c in AUDIT.split(", ")))


# Jobs -------------------------------------------------------------------------------

# The states of a job in order, and which may follow which.
JOB_STATES = ["queued", "running", "completed", "failed"]
JOB_MOVES = {"queued": ["running"], "running": ["completed", "failed"]}
#: An ended job is remembered this long; the same id is a new job after it.
JOB_MEMORY = timedelta(hours=1)
MOVE = ("task_id STRING, from_status STRING, to_status STRING, at_us BIGINT, held_ms BIGINT, "
        "legal BOOLEAN")
_MEMORY_US = JOB_MEMORY // timedelta(microseconds=1)

# Jobs are kept by the bucket of their id: a call of a processor, its timer and its access to
# state serve all jobs of one. The number is part of a stream's state and can't change later.
BUCKETS = 1024
JOBS_STATE = "task_id ARRAY<STRING>, status ARRAY<STRING>, at_us ARRAY<BIGINT>"


def _bucket() -> Column:
    return F.pmod(F.hash("task_id"), F.lit(BUCKETS)).alias("bucket")


def _columns(state: ValueState, schema: str) -> pd.DataFrame:
    """The state of a bucket, one row a job."""
    names = [c.split()[0] for c in schema.split(", ")]
    values = state.get() if state.exists() else [[]] * len(names)
    whole = {n: pd.Series(list(v), dtype="int64" if n.endswith("_us") else object)
             for n, v in zip(names, values, strict=True)}
    return pd.DataFrame(whole)


def _store(handle: StatefulProcessorHandle, state: ValueState, jobs: pd.DataFrame, schema: str,
           due: pd.Series) -> None:
    """Keeps the state of a bucket and sets its timer to the first time (ms) in ``due``."""
    if len(jobs):
        state.update(tuple(jobs[c.split()[0]].tolist() for c in schema.split(", ")))
    elif state.exists():
        state.clear()
    if len(due):
        handle.registerTimer(int(due.min()))


def _starts(task_id: pd.Series) -> pd.Series:
    """Whether a row is the first of its job in a sorted column; ids may be null."""
    text = task_id.fillna("")
    same = (text == text.shift()) & (task_id.isna() == task_id.isna().shift())
    return ~same


class Lifecycle(StatefulProcessor):
    """Follows the states of jobs: each report with the state before it and its duration.

    A key is a bucket of jobs, whose reports are compared as columns. State is one status and one
    time per job. It goes by a timer when a job has ended long ago; a job that never ends keeps
    its place until the watchdog's end event comes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getValueState("jobs", JOBS_STATE)

    def handleInputRows(
        self, key, rows: Iterator[pd.DataFrame], timerValues
    ) -> Iterator[pd.DataFrame]:
        reports = pd.concat([frame[["task_id", "status", "at_us"]] for frame in rows])
        reports["at_us"] = reports["at_us"].astype("int64")
        rank = reports["status"].map({s: i for i, s in enumerate(JOB_STATES)})
        reports["rank"] = rank.fillna(len(JOB_STATES))
        known = _columns(self.jobs, JOBS_STATE)
        known["rank"] = -1.0
        # what is known of a job comes before its reports, whatever their times
        both = pd.concat([known, reports], ignore_index=True)
        both["new"] = both["rank"] >= 0
        both = both.sort_values(["task_id", "new", "at_us", "rank"], kind="stable", ignore_index=True)
        first = _starts(both["task_id"])
        before = both["status"].shift().mask(first)
        held = both["at_us"] - both["at_us"].shift(fill_value=0)
        fresh = before.isna() | (~before.isin(list(JOB_MOVES)) & (held > _MEMORY_US))
        to = both["status"]
        moved = pd.Series(False, index=both.index)
        for status, ends in JOB_MOVES.items():
            moved |= (before == status) & to.isin(ends)
        out = pd.DataFrame({
            "task_id": both["task_id"], "from_status": before.mask(fresh).astype(object),
            "to_status": to, "at_us": both["at_us"],
            "held_ms": (held // 1000).astype("Int64").mask(fresh),
            "legal": (to == "queued").where(fresh, moved)})
        last = both[first.shift(-1, fill_value=True)]
        self._keep(last, timerValues.getCurrentWatermarkInMs())
        out = out[both["new"]]
        yield out.where(out.notna(), None).astype({"held_ms": "Int64", "at_us": "int64", "legal": bool})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(_columns(self.jobs, JOBS_STATE), timerValues.getCurrentWatermarkInMs())
        return iter([])

    def _keep(self, jobs: pd.DataFrame, watermark: int) -> None:
        """Forgets jobs that ended long before the watermark; the next to go sets the timer."""
        ended = ~jobs["status"].isin(list(JOB_MOVES))
        due = (jobs["at_us"] + _MEMORY_US) // 1000
        kept = ~ended | (due > watermark)
        _store(self.handle, self.jobs, jobs[kept], JOBS_STATE, due[ended & kept])

    def close(self) -> None:
        pass


def lifecycle_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Moves of jobs between states, with illegal ones marked, by event time."""
    moves = (
        events.withWatermark("at", late)
        .select("task_id", "status", "at", F.unix_micros("at").alias("at_us"), _bucket())
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=Lifecycle(), outputStructType=MOVE, outputMode="Append",
            timeMode="EventTime",
        )
    )
    return _moves(moves)


def _moves(moves: DataFrame) -> DataFrame:
    return moves.select("task_id", "from_status", "to_status",
                        F.timestamp_micros("at_us").alias("at"), "held_ms", "legal")


def lifecycle(events: DataFrame) -> DataFrame:
    """The same over a finished table: the report before decides."""
    rank = F.coalesce(*[F.when(F.col("status") == s, i) for i, s in enumerate(JOB_STATES)],
                      F.lit(len(JOB_STATES)))
    order = W.partitionBy("task_id").orderBy("at_us", "rank")
    seen = events.select("task_id", "status", F.unix_micros("at").alias("at_us"),
                         rank.alias("rank")).select(
        "task_id", F.col("status").alias("to_status"), "at_us",
        F.lag("status").over(order).alias("before"), F.lag("at_us").over(order).alias("since"))
    ended = ~F.col("before").isin(*JOB_MOVES)
    fresh = F.col("before").isNull() | (ended & (F.col("at_us") - F.col("since") > _MEMORY_US))
    allowed = F.coalesce(
        *[F.when(F.col("before") == s, F.col("to_status").isin(to)) for s, to in JOB_MOVES.items()],
        F.lit(False))
    return _moves(seen.select(
        "task_id", F.when(~fresh, F.col("before")).alias("from_status"), "to_status", "at_us",
        F.when(~fresh, F.floor((F.col("at_us") - F.col("since")) / 1000)).alias("held_ms"),
        F.when(fresh, F.col("to_status") == "queued").otherwise(allowed).alias("legal")))


# Watchdog ---------------------------------------------------------------------------

WATCHDOG_OUTPUT = "task_id STRING, status STRING, at_us BIGINT"
WATCHDOG_STATE = "task_id ARRAY<STRING>, deadline_us ARRAY<BIGINT>, ended_us ARRAY<BIGINT>"
_DEADLINE_US = DEADLINE // timedelta(microseconds=1)
#: For a job without a deadline or an end.
NEVER = 2**62


class Watchdog(StatefulProcessor):
    """Reports a task as failed when no end arrives within the deadline after its start.

    A key is a bucket of tasks. Two numbers per running task, which go away when it ends. An end
    that arrives before its start is remembered until the start could no longer be in time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tasks = handle.getValueState("tasks", WATCHDOG_STATE)

    def handleInputRows(
        self, key, rows: Iterator[pd.DataFrame], timerValues
    ) -> Iterator[pd.DataFrame]:
        # Reduce the whole batch of a task before touching its state: batches are unordered.
        events = pd.concat([f.loc[f["at_us"].notna(), ["task_id", "status", "at_us"]] for f in rows])
        at, status = events["at_us"].astype("int64"), events["status"]
        known = _columns(self.tasks, WATCHDOG_STATE)
        both = pd.concat([known, pd.DataFrame({
            "task_id": events["task_id"],
            "start": at.where(status == "running", NEVER),
            "end": at.where(status.isin(["completed", "failed"]), NEVER)})], ignore_index=True)
        both = both.fillna({c: NEVER for c in ("deadline_us", "ended_us", "start", "end")})
        tasks = both.groupby("task_id", dropna=False, sort=False, as_index=False).min()
        tasks = tasks.astype({c: "int64" for c in ("deadline_us", "ended_us", "start", "end")})
        begins = (tasks["deadline_us"] == NEVER) & (tasks["start"] != NEVER)
        limit = tasks["deadline_us"].mask(begins, tasks["start"] + _DEADLINE_US)
        end = tasks[["end", "ended_us"]].min(axis=1)
        in_time = (limit != NEVER) & (end <= limit)
        # the start may still come; a start so late that it matters is gone by then
        early = (limit == NEVER) & (tasks["end"] != NEVER)
        ended = tasks["ended_us"].mask(early, end).mask(in_time, NEVER)
        yield from self._keep(
            pd.DataFrame({"task_id": tasks["task_id"], "deadline_us": limit.mask(in_time, NEVER),
                          "ended_us": ended}), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._keep(
            _columns(self.tasks, WATCHDOG_STATE), timerValues.getCurrentWatermarkInMs())

    def _keep(self, tasks: pd.DataFrame, watermark: int | None) -> Iterator[pd.DataFrame]:
        """Reports tasks whose deadline has passed and forgets ends whose start is too late."""
        limit, ended = tasks["deadline_us"], tasks["ended_us"]
        if watermark is not None:
            failed = (limit != NEVER) & (limit // 1000 <= watermark)
            old = failed | ((ended != NEVER) & ((ended + _DEADLINE_US) // 1000 <= watermark))
            if failed.any():
                yield pd.DataFrame({"task_id": tasks["task_id"][failed], "status": "failed",
                                    "at_us": limit[failed]})
            tasks = tasks.assign(deadline_us=limit.mask(failed, NEVER), ended_us=ended.mask(old, NEVER))
        limit, ended = tasks["deadline_us"], tasks["ended_us"]
        due = limit.where(ended == NEVER, limit.clip(upper=ended + _DEADLINE_US)) // 1000
        held = (limit != NEVER) | (ended != NEVER)
        _store(self.handle, self.tasks, tasks[held], WATCHDOG_STATE, due[held])

    def close(self) -> None:
        pass


def watchdog_stream(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """Failures of tasks that run longer than ten minutes, by event time."""
    failed = (
        events.withWatermark("at", late)
        .select("task_id", "status", "at", F.unix_micros("at").alias("at_us"), _bucket())
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=Watchdog(),
            outputStructType=WATCHDOG_OUTPUT,
            outputMode="Append",
            timeMode="EventTime",
        )
    )
    return failed.select("task_id", "status", F.timestamp_micros("at_us").alias("at"))


def watchdog(events: DataFrame) -> DataFrame:
    """The same over a finished table: first start per task without an end in time."""
    running = F.when(F.col("status") == "running", F.col("at"))
    ended = F.when(F.col("status").isin("completed", "failed"), F.col("at"))
    tasks = events.groupBy("task_id").agg(F.min(running).alias("start"), F.min(ended).alias("end"))
    limit = F.col("start") + F.expr("INTERVAL 10 MINUTES")
    late = F.col("start").isNotNull() & (F.col("end").isNull() | (F.col("end") > limit))
    return tasks.filter(late).select("task_id", F.lit("failed").alias("status"), limit.alias("at"))
