"""Queries of sources, stored tables, long-running streams and SQL names."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masking as M
from ..functions import paths as P
from ..functions.sql_names import register_functions
from ..functions.text import literal_array
from ..operators import closers as CL
from ..operators import commands as CM
from ..operators import findings as FD
from ..operators import pair_rules as PR
from ..operators import quality as Q
from ..operators import reports as R
from ..operators import scoring as SC
from ..operators.checks import Check, rule_catalog
from ..operators.findings import findings_of
from ..operators.line_rules import Line, LineRule, hit, line_hits
from ..operators.user_rules import load_rules
from ..sources import cases as CS
from ..sources import lines as L
from ..sources import listing
from ..sources import snapshots as SN
from ..sources import store as ST
from ..sources import tables as TB
from ..streaming import streams as SM
from . import corpus as C
from .review import review, reviewed
from .workspace import shared_folder, written

STORED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    STORED[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Review -----------------------------------------------------------------------------

NUMBERED = Check("NUM-001", "low", "quality", 0.9, "Number", "", "token:number", "a number")



def _number(x: Line):
    """Line 1 isn't a number, which the cast doesn't forgive; line 2 counts as twelve."""
    text = F.when(F.col("new_line") == 1, x.content).otherwise("12")
    return F.when(text.cast("int") > 7, hit("number", x.content))


#: A rule for two lines of one document, which raises on the first.
BREAKING = LineRule(
    "NUM-001", lambda x: x.path.rlike(r"/f7\.") & F.col("new_line").isin(1, 2), _number)


@query
def isolated_rules(spark, sf_dir):
    """A rule that raises on one line: its hit on the next line, and one row of the error."""
    lines = written(C.document_lines(spark, sf_dir), "lines")
    found, errors = reviewed(lines, line_rules=[BREAKING], checks={"number": NUMBERED})
    place = [F.col(c) for c in ("task_id", "file")] + [F.col("line").cast("bigint").alias("line")]
    return found.select(*place, "rule_id", F.lit("found").alias("outcome")).unionByName(
        errors.select(*place, "rule_id", F.col("condition").alias("outcome")))


@query
def rule_hits(spark, sf_dir):
    """The catalogue of all rules with the findings of each over the documents."""
    rules = load_rules(os.path.join(os.path.dirname(os.path.dirname(__file__)), "sources", "sample_rules.yaml"))
    found = review(written(C.document_lines(spark, sf_dir), "lines"))
    hits = found.groupBy("rule_id").agg(F.count("*").alias("findings"))
    return rule_catalog(spark, rules).join(hits, "rule_id", "left").na.fill(0)


def typed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a document: a type that may embed the next document's, and a value that opens.

    Types of every fifth document have a method to close them.
    """
    doc = F.col("doc_id")
    n, after = doc.cast("string"), (doc + 1).cast("string")
    lines = F.array(
        F.lit("package store"), F.concat(F.lit("type T"), n, F.lit(" struct {")),
        F.when(doc % 3 != 0, F.concat(F.lit("\t*T"), after)).otherwise("\tname string"), F.lit("}"),
        F.when(doc % 5 == 0, F.concat(F.lit("func (t *T"), n, F.lit(") Close() error {")))
        .otherwise("func other() {"),
        F.lit("}"),
        F.concat(F.lit("func NewT"), n, F.lit("(p string) (*T"), n, F.lit(", error) {")),
        F.concat(F.lit("\tx, err := &T"), n, F.lit("{c: db.Conn(ctx)}")),
        F.concat(F.lit("\tv, err := NewT"), n, F.lit("(net.Dial(p))")), F.lit("}"))
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("task_id"),
        F.concat(F.lit("pkg/"), F.col("source"), F.lit("/t"), n, F.lit(".go")).alias("path"),
        lines.alias("lines"))


@query
def closer_facts(spark, sf_dir):
    """Which assigned values can be closed, by methods and embedded types."""
    lines = written(L.lines_of_arrays(typed_files(spark, sf_dir)), "lines")
    facts = CL.closer_facts(lines, lambda df: written(df, "types"))
    return facts.select("task_id", "file", F.col("line").cast("bigint").alias("line"),
                        "implements_closer")


@query
def unclosed_by_type(spark, sf_dir):
    """Open resources, without those whose type is known not to be closable."""
    lines = written(L.lines_of_arrays(typed_files(spark, sf_dir)), "lines")
    facts = written(CL.closer_facts(lines, lambda df: written(df, "types")), "facts")
    hits = PR.pair_hits(lines, only={"RES-AST-001"}, type_facts=facts)
    return hits.select("task_id", F.col("new_path").alias("file"),
                       F.col("line").cast("bigint").alias("line"), "detail")


@query
def large_deletes_30(spark, sf_dir):
    """Files that lose thirty lines or more."""
    lines = L.lines_of_patches(C.document_patches(spark, sf_dir))
    return PR.large_delete_hits(lines).select(
        "task_id", F.col("new_path").alias("file"), F.col("line").cast("bigint").alias("line"),
        "check", "detail")


# Snapshots --------------------------------------------------------------------------


def write_snapshot(spark: SparkSession, sf_dir: str) -> str:
    """The documents as a file tree in the shared folder, with links, pipes and binary files.

    By document id: every 11th in a skipped folder, 13th a link, 17th a pipe, 19th too large,
    5th binary; all others plain text.
    """
    root = urlparse(shared_folder(spark, "tree")).path

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folder = f"{root}/{source}" + ("/vendor" if key % 11 == 0 else "")
                os.makedirs(folder, exist_ok=True)
                path = f"{folder}/f{key}.txt"
                if os.path.lexists(path):
                    os.remove(path)  # of a task that was run before
                if key % 13 == 0:
                    os.symlink("/nowhere", path)
                elif key % 17 == 0:
                    os.mkfifo(path)
                else:
                    with open(path, "wb") as f:
                        f.write(b"\x00" * (key % 5 == 0) + (text or "").encode())
                        if key % 19 == 0:
                            f.truncate((1 << 20) + 1)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    docs.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return root


@query
def snapshot_scan(spark, sf_dir):
    """What a scan keeps and leaves out, and why: files and bytes a reason."""
    scan = listing.tree(spark, write_snapshot(spark, sf_dir))
    return scan.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(
        F.count("*").alias("files"),
        F.sum(F.when(F.col("reason").isNull(), F.col("length"))).alias("bytes"))


@query
def snapshot_files(spark, sf_dir):
    """The files of a snapshot that are reviewed, with their text."""
    files = listing.tree_files(spark, write_snapshot(spark, sf_dir), "snapshot")
    return files.select("path", F.length("content").cast("bigint").alias("chars"),
                        F.md5("content").alias("digest"))


# Stored tables ----------------------------------------------------------------------


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task for each event, running since its time."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("task_id"), F.lit("running").alias("status"),
        F.col("user_id").cast("string").alias("input_path"),
        F.col("ts").cast("timestamp").alias("started_at"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third task ends; errors fail."""
    events = table(spark, sf_dir, "events").filter("event_id % 3 = 0")
    failed = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").cast("string").alias("task_id"),
        F.when(failed, "failed").otherwise("completed").alias("status"),
        (F.col("ts").cast("timestamp") + F.make_dt_interval(
            secs=(F.col("event_id") % 50).cast("decimal(18,6)"))).alias("at"),
        F.when(failed, "gave up").alias("error_msg"))


@query
def stored_status(spark, sf_dir):
    """Tasks after status updates; both commits are run twice."""
    store = ST.Store(spark, shared_folder(spark, "store"))
    for _ in range(2):
        store.commit("new", {"tasks": _tasks(spark, sf_dir)})
        ST.update_status(store, "ends", _changes(spark, sf_dir))
    return store.read("tasks").select("task_id", "status", "duration_ms", "error_msg")


@query
def stored_results(spark, sf_dir):
    """Findings, tasks and reports of two runs in one commit each, as of each version."""
    store = ST.Store(spark, shared_folder(spark, "store"))
    found = written(C.order_findings(spark, sf_dir).select(
        "task_id", "severity", "category", "rule_id", "file", "line", "evidence", "confidence", "year"),
        "findings")
    for n in (0, 1, 1):
        own = found.filter(F.col("year") % 2 == n)
        tasks = own.select("task_id").distinct().withColumn("status", F.lit(f"run {n}"))
        reports = own.groupBy("task_id").agg(
            F.count("*").cast("string").alias("json_report")).withColumn(
            "saved_at", F.lit(None).cast("timestamp"))
        ST.save_review(store, f"run-{n}", tasks, own.drop("year"), reports)
    out = None
    for version in (1, 2):
        rows = store.read("findings", version).groupBy("task_id").agg(F.count("*").alias("findings"))
        rows = rows.join(store.read("reports", version), "task_id", "left").join(
            store.read("tasks", version), "task_id", "left").select(
            F.lit(version).cast("bigint").alias("version"), "task_id", "findings", "json_report", "status")
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def stored_marks(spark, sf_dir):
    """False-positive marks: added, some deleted, one set again, then compacted."""
    store = ST.Store(spark, shared_folder(spark, "store"))
    key = F.col("p_partkey")
    marks = table(spark, sf_dir, "part").select(
        key.alias("id"), F.concat(F.lit("R-"), key % 17).alias("rule_id"),
        F.concat(F.lit("f"), key, F.lit(".go")).alias("file_path"), F.lit(3).alias("line"))
    store.commit("added", {"marks": marks})
    ST.delete_marks(store, "deleted", marks.filter("id % 4 = 0").select("id"))
    store.commit("again", {"marks": marks.filter("id % 8 = 0").withColumn("line", F.lit(0))})
    store.compact("marks", "compacted")
    return store.read("marks").select("id", "rule_id", "file_path", F.col("line").cast("bigint").alias("line"))


# Streams ----------------------------------------------------------------------------


@query
def stream_review(spark, sf_dir):
    """The whole review over a stream of patches that add whole files, one file a patch."""
    folder, out = shared_folder(spark, "patches"), shared_folder(spark, "review")
    files = C.document_files(spark, sf_dir).filter(F.size("lines") > 0)
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("+"), x)), "\n")
    files.select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("task_id"),
        F.concat(F.lit("--- /dev/null\n+++ b/"), F.col("path"), F.lit("\n@@ -0,0 +1,"),
                 F.size("lines"), F.lit(" @@\n"), body, F.lit("\n")).alias("diff_text"),
    ).write.parquet(folder)
    patches = spark.read.parquet(folder)
    SM.review_stream(SM.table_stream(spark, folder, patches.schema), out)
    found = spark.read.parquet(f"{out}/findings").filter("rule_id <> 'TST-AST-001'")
    return found.select(
        "task_id", "file", F.col("line").cast("bigint").alias("line"), "rule_id", "category",
        "severity", F.round("confidence", 4).alias("confidence"), "bucket")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job an event: queued, running and an end; some skip a state or report one twice."""
    e, at = F.col("event_id"), F.col("ts").cast("timestamp")

    def report(status: str, seconds: int, when):
        later = at + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
        return F.when(when, F.struct(F.lit(status).alias("status"), later.alias("at")))

    reports = F.array(
        report("queued", 0, F.lit(True)), report("running", 10, e % 13 != 0),
        report("running", 20, e % 17 == 0), report("completed", 60, e % 7 != 0),
        report("failed", 60, e % 7 == 0), report("queued", 120, e % 19 == 0),
        report("queued", 9000, e % 23 == 0))
    return table(spark, sf_dir, "events").select(
        e.cast("string").alias("task_id"), F.explode(reports).alias("r")).filter(
        F.col("r").isNotNull()).select("task_id", "r.status", "r.at")


def _shown_moves(moves: DataFrame) -> DataFrame:
    return moves.select("task_id", "from_status", "to_status", "at", "held_ms", "legal")


@query
def job_moves(spark, sf_dir):
    """Moves of jobs between states, with their durations and the illegal ones."""
    return _shown_moves(SM.lifecycle(_jobs(spark, sf_dir)))


@query
def stream_job_moves(spark, sf_dir):
    """The same as a stream with state."""
    folder, out = shared_folder(spark, "jobs"), shared_folder(spark, "moves")
    jobs = _jobs(spark, sf_dir)
    jobs.write.parquet(folder)
    moves = SM.lifecycle_stream(SM.table_stream(SM.stream_session(spark), folder, jobs.schema), "1 day")
    SM.run_to_files(moves, out)
    return _shown_moves(spark.read.schema(moves.schema).parquet(f"{out}/rows"))


@query
def audit_entries_json(spark, sf_dir):
    """The audit log of a command stream as JSON lines, read back."""
    out, events = shared_folder(spark, "audit"), table(spark, sf_dir, "events")
    e = F.col("event_id")
    commands = SM.table_stream(spark, f"{sf_dir}/events.parquet", events.schema).select(
        F.get(literal_array(C.COMMANDS), (e % len(C.COMMANDS)).cast("int")).alias("arguments"),
        F.col("ts").cast("timestamp").alias("decided_at"))
    SM.audit_log(commands, out)
    return SM.read_audit(spark, out).select("timestamp", "command", "decision", "risk_level", "rule_id")


# SQL names --------------------------------------------------------------------------


@query
def sql_paths(spark, sf_dir):
    """Language and role of all files by the SQL functions."""
    register_functions(spark)
    C.document_files(spark, sf_dir).createOrReplaceTempView("patchlens_files")
    return spark.sql("SELECT path AS file, detect_language(path) AS language, code_role(path) AS role "
                     "FROM patchlens_files")


@query
def sql_commands(spark, sf_dir):
    """Commands judged by the SQL function."""
    register_functions(spark)
    C.event_commands(spark, sf_dir).select(
        "event_id", F.coalesce(F.get_json_object("arguments", "$.command"), "arguments").alias("command"),
    ).createOrReplaceTempView("patchlens_commands")
    return spark.sql("SELECT event_id, command, v.action, v.risk_level, v.rule_id FROM "
                     "(SELECT *, classify_command(command) AS v FROM patchlens_commands)")


@query
def sql_leaks(spark, sf_dir):
    """Words of all files that look like credentials, by the table function."""
    register_functions(spark)
    C.document_files(spark, sf_dir).select(
        "path", F.array_join("lines", "\n").alias("body")).createOrReplaceTempView("patchlens_bodies")
    return spark.sql("SELECT path AS file, CAST(l.line AS BIGINT) AS line, l.shape, count(*) AS n "
                     "FROM patchlens_bodies, LATERAL leaks_in(body) AS l GROUP BY ALL")


# Files, labels and settings ----------------------------------------------------------


def _write_files(rows: DataFrame, root: str) -> None:
    """Files below a folder that all machines see: rows (name, body)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
                with open(f"{root}/{name}", "w", encoding="utf-8", newline="") as f:
                    f.write(body)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    rows.select("name", "body").mapInArrow(write, "n long").agg(F.sum("n")).collect()


@query
def patch_files(spark, sf_dir):
    """Patches read from files: added and deleted lines of each."""
    root = urlparse(shared_folder(spark, "patch-files")).path
    patches = C.document_patches(spark, sf_dir)
    _write_files(patches.select(
        F.concat(F.substring("task_id", -1, 1), F.lit("/"), "task_id", F.lit(".diff")).alias("name"),
        F.col("diff_text").alias("body")), root)
    read = SN.read_patches(spark, f"{root}/*/*.diff")
    lines = L.lines_of_patches(read).withColumn(
        "task_id", F.regexp_extract("task_id", r"([^/]*)\.diff\z", 1))
    return lines.groupBy("task_id").agg(
        F.count_if(F.col("line_type") == "added").alias("added"),
        F.count_if(F.col("line_type") == "deleted").alias("deleted"))


@query
def labelled_cases(spark, sf_dir):
    """Cases of label and patch files against the gates of recall, precision and false alarms.

    A source is a case; odd ones have a name that says nothing should be found there.
    """
    root = urlparse(shared_folder(spark, "cases")).path
    number = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    case = F.concat(F.when(number % 2 == 1, "neg_").otherwise("pos_"), "source", F.lit("_"), "doc_id")
    files = C.document_files(spark, sf_dir).filter(F.size("lines") > 0).join(
        table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    numbered = F.transform("lines", lambda x, i: F.struct(x.alias("x"), (i + 1).alias("line")))
    places = F.transform(F.filter(numbered, lambda r: r["x"].contains("hunter-Winter")), lambda r: F.struct(
        F.lit("SEC-AST-001").alias("rule_id"), F.col("path").alias("file"), r["line"].cast("bigint").alias("line")))
    label = F.to_json(F.struct(
        case.alias("id"), places.alias("expected_findings"),
        F.array(F.lit("hunter-Winter-0042")).alias("sensitive_literals")))
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("+"), x)), "\n")
    patch = F.concat(F.lit("--- /dev/null\n+++ b/"), "path", F.lit("\n@@ -0,0 +1,"), F.size("lines"),
                     F.lit(" @@\n"), body, F.lit("\n"))
    for ending, text in ((".json", label), (".diff", patch)):
        _write_files(files.select(F.concat(F.col("source"), F.lit("/c"), "doc_id", F.lit(ending)).alias("name"),
                                  text.alias("body")), root)
    cases = written(CS.read_cases(spark, root), "cases")
    lines = L.lines_of_patches(cases.select(F.col("case_id").alias("task_id"), "diff_text"))
    found = written(findings_of(line_hits(lines, only={"SEC-AST-001"})).select(
        F.col("task_id").alias("case_id"), "rule_id", "file", F.col("line").cast("bigint").alias("line"),
        "evidence", "evidence_chain"), "found")
    return Q.gate_report(cases, CS.expected(cases), found)


@query
def relative_paths(spark, sf_dir):
    files = C.document_files(spark, sf_dir)
    return files.select("doc_id", P.relative_to(F.col("path"), "pkg").alias("path"))


@query
def labels_shown(spark, sf_dir):
    """Display texts of inputs, reasons, severities and folders, by document."""
    doc = F.col("doc_id")
    pick = lambda names: F.get(literal_array(names), (doc % len(names)).cast("int"))
    kinds, reasons = [*P.INPUT_TYPE_LABELS, "other"], [*P.SKIP_LABELS, "other"]
    return C.document_files(spark, sf_dir).select(
        "doc_id", P.input_type_label(pick(kinds)).alias("input_type"),
        P.input_path_label(F.when(doc % 2 == 0, "api-upload").otherwise(F.col("path"))).alias("input_path"),
        P.skip_label(pick(reasons)).alias("reason"),
        P.severity_label(pick([*P.SEVERITY_LABELS, "other"])).alias("severity"),
        P.directory_label(F.when(doc % 3 == 0, ".").otherwise(P.directory(F.col("path")))).alias("folder"))


@query
def configured_commands(spark, sf_dir):
    """Commands judged by settings read from a file: one more domain, deny what no rule names."""
    path = urlparse(shared_folder(spark, "settings")).path + "/safety.json"
    CM.save_config(CM.SafetyConfig(allowed_domains=["files.local"], default_policy="deny"), path)
    decided = CM.decide_commands(C.event_commands(spark, sf_dir), CM.load_config(path))
    return decided.select("event_id", "command", "action", "rule_id")


@query
def key_hints(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 5 == 0, "").when(
        F.col("c_custkey") % 5 == 1, "short").otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", M.key_hint(name).alias("hint"))


# Findings shown -----------------------------------------------------------------------


@query
def finding_lines(spark, sf_dir):
    """One line of text a finding, with its place in the order of its task."""
    found = FD.deduplicate(C.order_findings(spark, sf_dir), F.col("seq")).withColumn("title", F.col("evidence"))
    listed = R.listed(found, "high").unionByName(R.listed(found, warnings=True))
    return FD.ordered(listed).select(
        "task_id", "bucket", FD.summary_line().alias("text"))


@query
def dimension_findings(spark, sf_dir):
    """The dimensions of the score with their weights and findings."""
    found = FD.deduplicate(C.order_findings(spark, sf_dir), F.col("seq"))
    counts = found.groupBy("category").agg(F.count("*").alias("findings"))
    return SC.dimensions(spark).join(counts, "category", "left").na.fill(0)


@query
def score_reports(spark, sf_dir):
    """The score of each task as text: a headline, then a bar for each dimension."""
    scores = SC.risk_score(FD.deduplicate(C.order_findings(spark, sf_dir), F.col("seq")))
    text = F.split(SC.score_text(), "\n")
    return scores.select(
        "task_id", F.size(text).cast("bigint").alias("lines"), text[0].alias("headline"),
        F.regexp_replace(text[1], r" [0-9.]+\z", "").alias("first_bar"))


@query
def task_details(spark, sf_dir):
    """What is stored about one task, as tagged rows."""
    tasks = _tasks(spark, sf_dir)
    runs = table(spark, sf_dir, "events").select(
        (F.col("event_id") % 10).cast("string").alias("task_id"), F.col("event_type").alias("command"))
    decisions = C.event_commands(spark, sf_dir).select(
        (F.col("event_id") % 20).cast("string").alias("task_id"), "output_bytes")
    reports = tasks.select("task_id", F.lit("{}").alias("json_report"))
    detail = R.task_detail(tasks.select("task_id", "status"), reports, runs, decisions, "7")
    return detail.groupBy("section", "body").agg(F.count("*").alias("n"))


@query
def review_counters(spark, sf_dir):
    """Counters that an action fills on the way, beside the same numbers from the result."""
    found, seen = R.observed(FD.deduplicate(C.order_findings(spark, sf_dir), F.col("seq")), "review")
    counted = written(found, "observed").groupBy("bucket").agg(F.count("*").alias("rows"))
    own = seen.get
    return counted.select(
        "bucket", "rows", F.lit(own["findings"]).cast("bigint").alias("findings"),
        F.lit(own["high"]).cast("bigint").alias("high"))


# Logs ---------------------------------------------------------------------------------


@query
def stored_logs(spark, sf_dir):
    """Runs and decisions appended to their tables, one of them from before a column was added."""
    base = shared_folder(spark, "logs")
    events = table(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    runs = events.select(
        F.col("user_id").cast("string").alias("task_id"), F.col("event_type").alias("command"),
        (F.col("event_id") % 2).cast("int").alias("exit_code"), at.alias("started_at"))
    TB.append(runs.filter("exit_code = 0"), base, "runs")
    old = runs.filter("exit_code = 1").drop("exit_code").withColumn("on", F.to_date("started_at"))
    old.write.mode("append").partitionBy("on").parquet(f"{base}/runs")
    decided = CM.decide_commands(C.event_commands(spark, sf_dir)).join(events.select("event_id", "ts"), "event_id")
    TB.append(decided.withColumn("decided_at", at), base, "decisions")
    both = TB.read(spark, base, "runs").select(
        "task_id", F.lit("run").alias("kind"), F.col("command").alias("what"), F.col("exit_code").cast("string").alias("how"))
    both = both.unionByName(TB.read(spark, base, "decisions").select(
        "task_id", F.lit("decision").alias("kind"), "command", "action").toDF("task_id", "kind", "what", "how"))
    return both.groupBy("task_id", "kind", "what", "how").agg(F.count("*").alias("n"))
