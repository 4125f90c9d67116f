"""The query catalogue: every operator run over whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masking as M
from ..functions import paths as P
from ..functions import tokens as K
from ..functions.text import literal_array
from ..operators import artifacts as A
from ..operators import commands as CM
from ..operators import findings as FD
from ..operators import line_rules as LR
from ..operators import outline as O
from ..operators import pair_rules as PR
from ..operators import quality as Q
from ..operators import reports as R
from ..operators import scoring as SC
from ..operators import verdicts as V
from ..operators.user_rules import UserRule, load_rules, user_hits
from ..sources import lines as L
from ..sources import tool_logs as TL
from ..streaming import streams as ST
from . import corpus as C
from .review import review
from .review import review_scores as scored_review
from .stored_queries import STORED
from .workspace import shared_folder, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shown(hits: DataFrame, detail: bool = False) -> DataFrame:
    """The comparable columns of a hits table."""
    extra = ["detail"] if detail else []
    return hits.select(
        "task_id", F.col("new_path").alias("file"), F.col("line").cast("bigint").alias("line"),
        "check", *extra,
    )


# Lines ------------------------------------------------------------------------------


@query
def whole_file_lines(spark, sf_dir):
    lines = C.document_lines(spark, sf_dir)
    return lines.groupBy("task_id", F.col("new_path").alias("file")).agg(
        F.count("*").alias("lines"),
        F.max("new_line").cast("bigint").alias("last_line"),
        F.sum(F.octet_length("content")).alias("bytes"),
    )


@query
def patch_lines(spark, sf_dir):
    lines = L.lines_of_patches(C.document_patches(spark, sf_dir))
    return lines.select(
        "task_id", F.col("new_path").alias("file"), "line_type", "content",
        F.col("old_line").cast("bigint").alias("old_line"),
        F.col("new_line").cast("bigint").alias("new_line"),
    )


@query
def patch_shape(spark, sf_dir):
    lines = L.lines_of_patches(C.document_patches(spark, sf_dir))
    return lines.groupBy("task_id", "hunk_context").agg(
        F.count_if(F.col("line_type") == "added").alias("added"),
        F.count_if(F.col("line_type") == "deleted").alias("deleted"),
        F.count_if(F.col("line_type") == "context").alias("context"),
        F.max("new_lines").cast("bigint").alias("new_lines"),
        F.max("old_lines").cast("bigint").alias("old_lines"),
    )


@query
def rejected_patches(spark, sf_dir):
    """Patches without a reviewable change: one-line documents have context only."""
    _, rejected = L.split_patches(C.document_patches(spark, sf_dir))
    return rejected


@query
def language_and_role(spark, sf_dir):
    files = C.document_files(spark, sf_dir)
    path = F.col("path")
    lang = P.language(path)
    return files.select(
        path.alias("file"), lang.alias("language"), P.code_role(path).alias("role"),
        lang.isin("dotenv", "env", "yaml", "ini", "toml", "json").alias("is_config"),
        P.directory(path).alias("dir"),
    )


@query
def package_names(spark, sf_dir):
    return L.package_names(C.document_lines(spark, sf_dir)).select(
        "task_id", F.col("new_path").alias("file"), "package"
    )


@query
def package_main_files(spark, sf_dir):
    lines = C.document_lines(spark, sf_dir).filter("package_main")
    return lines.select("task_id", F.col("new_path").alias("file")).distinct()


@query
def generated_files(spark, sf_dir):
    lines = C.document_lines(spark, sf_dir).filter("generated")
    return lines.groupBy("task_id", F.col("new_path").alias("file")).agg(F.count("*").alias("lines"))


# Lexical layer -----------------------------------------------------------------------


@query
def token_kinds(spark, sf_dir):
    lines = C.document_lines(spark, sf_dir)
    facts = lines.select(F.explode(K.facts(F.col("content"))).alias("f"))
    return facts.groupBy(F.col("f.kind").alias("kind")).agg(
        F.count("*").alias("n"), F.sum(F.octet_length("f.value")).alias("bytes")
    )


@query
def assigned_values(spark, sf_dir):
    lines = C.document_lines(spark, sf_dir).filter(F.col("content").contains("="))
    named = lines.select(
        "task_id", F.col("new_path").alias("file"), F.col("new_line").cast("bigint").alias("line"),
        K.facts(F.col("content")).alias("facts"),
    ).withColumn("a", K.assigned_value(F.col("facts")))
    return named.filter(F.col("a").isNotNull()).select(
        "task_id", "file", "line", F.col("a.name").alias("name"), F.col("a.value").alias("value")
    )


@query
def sensitive_identifiers(spark, sf_dir):
    lines = C.document_lines(spark, sf_dir).filter(K.is_sensitive_name(F.col("content")))
    found = lines.select(
        "task_id", F.col("new_path").alias("file"), F.col("new_line").cast("bigint").alias("line"),
        K.sensitive_identifier(K.facts(F.col("content"))).alias("name"),
    )
    return found.filter(F.col("name").isNotNull())


# Line rules ---------------------------------------------------------------------------


def rule_query(name: str, *rules: str, detail: bool = False, checks: tuple[str, ...] = ()) -> None:
    def run(spark, sf_dir):
        hits = LR.line_hits(C.document_lines(spark, sf_dir), only=set(rules))
        if checks:
            hits = hits.filter(F.col("check").isin(*checks))
        return shown(hits, detail)

    run.__name__ = name
    QUERIES[name] = run


rule_query("hardcoded_secrets", "SEC-AST-001", detail=True)
rule_query("credential_shapes", "SEC-AST-002")
rule_query("config_credentials", "SEC-GEN-001", detail=True)
rule_query("error_handling", "ERR-AST-001")
rule_query("sql_concat", "SEC-AST-003")
rule_query("command_injection", "SEC-AST-004")
rule_query("tls_off", "SEC-AST-005")
rule_query("time_tick", "RES-AST-002", checks=("time_tick",))
rule_query("defer_in_loop", "RES-AST-002", checks=("defer_in_loop",))
rule_query("cancel_discarded", "CTX-AST-001")


@query
def typed_discards(spark, sf_dir):
    """Discarded errors with type knowledge: odd lines know the type, one in three is an error."""
    lines = C.document_lines(spark, sf_dir)
    types = lines.filter(F.col("content").contains("_")).select(
        "task_id", F.col("new_path").alias("file"), F.col("new_line").alias("line"),
        F.lit(1).alias("idx"), (F.col("new_line") % 3 == 0).alias("is_error"),
    ).filter(F.col("line") % 2 == 1)
    return shown(LR.line_hits(lines, only={"ERR-AST-001"}, type_facts=types))


@query
def mask_text(spark, sf_dir):
    lines = C.document_lines(spark, sf_dir)
    masked = M.mask_column(lines, "content", "masked")
    return masked.filter(F.col("masked") != F.col("content")).select(
        "task_id", F.col("new_path").alias("file"), F.col("new_line").cast("bigint").alias("line"),
        "masked",
    )


# Pairing rules -------------------------------------------------------------------------


def pair_query(name: str, rule: str, detail: bool = False) -> None:
    def run(spark, sf_dir):
        return shown(PR.pair_hits(C.document_lines(spark, sf_dir), only={rule}), detail)

    run.__name__ = name
    QUERIES[name] = run


pair_query("unclosed_resources", "RES-AST-001", detail=True)
pair_query("tx_unfinished", "DB-AST-001")
pair_query("cancel_leak", "CTX-AST-001", detail=True)
pair_query("mutex_pair", "CON-AST-001", detail=True)
pair_query("timer_leak", "RES-AST-002", detail=True)
pair_query("rows_err", "DB-AST-002")


def frame_query(name: str, rule: Callable[[DataFrame], DataFrame], source, detail=False) -> None:
    def run(spark, sf_dir):
        return shown(rule(source(spark, sf_dir)), detail)

    run.__name__ = name
    QUERIES[name] = run


frame_query("goroutine_exit", PR.goroutine_hits, C.document_lines)
frame_query("swallowed_error", PR.swallowed_error_hits, C.document_lines)
frame_query("ctx_root", PR.context_root_hits, C.document_lines)
frame_query("untested_exports", PR.missing_test_hits, C.document_lines, detail=True)
frame_query(
    "large_deletes",
    lambda lines: PR.large_delete_hits(lines, threshold=5),
    lambda spark, sf_dir: L.lines_of_patches(C.document_patches(spark, sf_dir)),
    detail=True,
)


@query
def nolint_suppression(spark, sf_dir):
    lines = C.document_lines(spark, sf_dir)
    hits = LR.line_hits(lines, only={"SEC-AST-001"})
    return shown(FD.drop_nolint(hits, lines))


# Findings ---------------------------------------------------------------------------


def sample_rules() -> list[UserRule]:
    return load_rules(str(Path(__file__).parent.parent / "sources" / "sample_rules.yaml"))


@query
def yaml_rules(spark, sf_dir):
    hits = user_hits(C.document_lines(spark, sf_dir), sample_rules())
    return shown(hits)


def brief(findings: DataFrame, *more: str) -> DataFrame:
    return findings.select(
        "task_id", "file", F.col("line").cast("bigint").alias("line"), "rule_id", "category",
        "severity", F.round("confidence", 4).alias("confidence"), *more,
    )


@query
def role_dampening(spark, sf_dir):
    hits = LR.line_hits(C.document_lines(spark, sf_dir), only={"SEC-AST-002"})
    return brief(FD.dampen_by_role(FD.findings_of(hits)))


@query
def masked_evidence(spark, sf_dir):
    hits = LR.line_hits(C.document_lines(spark, sf_dir), only={"SEC-AST-001", "SEC-GEN-001"})
    return FD.findings_of(hits).select(
        "task_id", "file", F.col("line").cast("bigint").alias("line"), "rule_id", "evidence",
        F.array_join("evidence_chain", "|").alias("chain"),
    )


@query
def review_findings(spark, sf_dir):
    lines = written(C.document_lines(spark, sf_dir), "lines")
    return brief(review(lines), "bucket", "copies")


@query
def review_scores(spark, sf_dir):
    scores = scored_review(written(C.document_lines(spark, sf_dir), "lines"))
    return scores.select("task_id", "score", "grade", "finding_count", "warning_count")


@query
def dedup_findings(spark, sf_dir):
    found = FD.deduplicate(C.order_findings(spark, sf_dir), F.col("seq"))
    return brief(found, "bucket", "copies", "seq")


@query
def false_positive_memory(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    marks = parts.select(
        F.concat(F.lit("R-"), (key % 17).cast("string")).alias("rule_id"),
        F.concat(F.lit("dir"), (key % 29).cast("string"), F.lit("/f"), key.cast("string"),
                 F.lit(".go")).alias("file_path"),
        (key % 5).cast("int").alias("line"),
    )
    found = FD.apply_marks(C.order_findings(spark, sf_dir), C.spread(marks))
    return found.groupBy("rule_id").agg(
        F.count("*").alias("n"),
        F.round(F.sum("confidence"), 3).alias("confidence"),
        F.count_if(F.col("confidence") < 0.5).alias("lowered"),
    )


@query
def run_comparison(spark, sf_dir):
    found = written(C.order_findings(spark, sf_dir).select(
        "task_id", "rule_id", "file", "line", "severity", "evidence", "year"), "findings",
    ).withColumn("title", F.col("rule_id"))
    # every year against the one before it
    before = found.withColumn("year", F.col("year") + 1)
    compared = FD.compare_runs(found, before, within=["task_id", "year"])
    return compared.groupBy("task_id", "year", "status").agg(
        F.count("*").alias("n"), F.sum("line").cast("bigint").alias("lines")
    )


@query
def previous_task(spark, sf_dir):
    return FD.previous_task(C.event_tasks(spark, sf_dir)).select(
        "task_id", "input_path", "previous_task_id"
    )


def _responses(spark: SparkSession, sf_dir: str, line) -> DataFrame:
    """One model answer per customer: forty numbered lines and two repeats."""
    key = F.col("c_custkey")
    numbers = F.concat(F.sequence(F.lit(1), F.lit(40)), F.array(F.lit(3), F.lit(5)))
    text = F.array_join(F.transform(numbers, lambda n, i: line(n, i, key)), "\n")
    return C.spread(table(spark, sf_dir, "customer").select("c_custkey")).select(
        F.concat(F.lit("t"), (key % 97).cast("string")).alias("task_id"),
        F.floor(key / 97).alias("batch"), text.alias("response"),
    )


def _verdict_line(n, i, key):
    deny = (n * 7 + key + i) % 3 == 0
    return F.concat(n.cast("string"), F.lit(". "), F.when(deny, "DENY: no").otherwise("CONFIRM: yes"))


def _advice_line(n, i, key):
    return F.concat(n.cast("string"), F.lit(". advice "), ((key + i) % 9).cast("string"))


BATCH_SIZE = 500


def _candidates(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Numbered candidates: the columns of the order, and those asked for."""
    found = FD.deduplicate(C.order_findings(spark, sf_dir), F.col("seq"))
    found = found.withColumn("recommendation", F.lit("none")).select(*FD.KEY, "severity", *more)
    sized = V.with_batches(written(found, "candidates"), BATCH_SIZE)
    return V.number_candidates(sized, F.col("batches")).drop("batches")


@query
def candidate_ordinals(spark, sf_dir):
    return _candidates(spark, sf_dir).select(
        "task_id", "batch", F.col("ordinal").cast("bigint").alias("ordinal"), "file",
        F.col("line").cast("bigint").alias("line"), "rule_id", "category",
    )


@query
def candidate_prompts(spark, sf_dir):
    found = _candidates(spark, sf_dir, "evidence").withColumn("title", F.col("rule_id"))
    return V.prompts(found).select("task_id", "batch", "prompt", "candidates")


@query
def apply_verdicts(spark, sf_dir):
    kept = V.apply_verdicts(_candidates(spark, sf_dir), _responses(spark, sf_dir, _verdict_line))
    return kept.groupBy("task_id", "severity").agg(F.count("*").alias("kept"))


@query
def verdict_stats(spark, sf_dir):
    return V.verdict_stats(_candidates(spark, sf_dir), _responses(spark, sf_dir, _verdict_line))


@query
def apply_suggestions(spark, sf_dir):
    advised = V.apply_suggestions(
        _candidates(spark, sf_dir, "recommendation"), _responses(spark, sf_dir, _advice_line))
    return advised.groupBy("task_id", "recommendation").agg(F.count("*").alias("n"))


# Reports ----------------------------------------------------------------------------


def _deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FD.deduplicate(C.order_findings(spark, sf_dir), F.col("seq"))


@query
def risk_score(spark, sf_dir):
    scores = SC.risk_score(_deduplicated(spark, sf_dir))
    part = F.col("breakdown")["security"]
    return scores.select(
        "task_id", "score", "grade", "finding_count", "warning_count",
        F.round(part["score"], 4).alias("security_score"),
        part["count"].alias("security_count"),
    )


@query
def finding_summary(spark, sf_dir):
    return R.finding_summary(_deduplicated(spark, sf_dir))


@query
def findings_by_category(spark, sf_dir):
    return R.findings_by_category(_deduplicated(spark, sf_dir))


@query
def severity_pivot(spark, sf_dir):
    return R.severity_pivot(C.order_findings(spark, sf_dir))


@query
def finding_stats(spark, sf_dir):
    return R.finding_stats(C.order_findings(spark, sf_dir))


@query
def directory_density(spark, sf_dir):
    key = F.col("p_partkey")
    files = table(spark, sf_dir, "part").select(
        F.concat(F.lit("t"), (key % 97).cast("string")).alias("task_id"),
        F.concat(F.lit("dir"), (key % 37).cast("string"), F.lit("/f"), key.cast("string"),
                 F.lit(".go")).alias("path"),
    )
    out = R.directory_density(_deduplicated(spark, sf_dir), files)
    return out.withColumns(
        {"density": F.round("density", 6), "bar": F.round("bar", 4)}
    )


@query
def risky_files(spark, sf_dir):
    return R.risky_files(_deduplicated(spark, sf_dir))


@query
def report_documents(spark, sf_dir):
    found = _deduplicated(spark, sf_dir)
    documents = R.report_documents(SC.risk_score(found), R.finding_summary(found))
    body = F.col("json_report")
    return documents.select(
        "task_id",
        F.get_json_object(body, "$.grade").alias("grade"),
        F.get_json_object(body, "$.summary.total_findings").cast("bigint").alias("findings"),
    )


@query
def task_totals(spark, sf_dir):
    return R.task_totals(C.event_tasks(spark, sf_dir)).select(
        "tasks", F.round("avg_risk", 6).alias("avg_risk"), "max_risk"
    )


@query
def daily_trend(spark, sf_dir):
    days = R.daily_trend(C.event_tasks(spark, sf_dir), F.lit("2024-01-30").cast("date"))
    return days.withColumn("avg_risk", F.round("avg_risk", 6))


@query
def recent_tasks(spark, sf_dir):
    return R.recent_tasks(C.event_tasks(spark, sf_dir), 10).select("task_id", "status", "risk_score")


def _status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "view", "queued").when(kind.isin("click", "signup"), "running")
        .when(kind == "purchase", "completed").otherwise("failed")
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("task_id"), status.alias("status"),
        F.col("ts").cast("timestamp").alias("at"),
        F.when(kind == "error", F.col("props")).alias("error_msg"),
    )


@query
def task_state(spark, sf_dir):
    return R.task_states(_status_events(spark, sf_dir)).select(
        "task_id", "status", "duration_ms", "error_msg"
    )


@query
def run_summary(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("task_id"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("exit_code"),
        (F.col("value") > 100).alias("timed_out"),
        (F.col("event_id") % 1000).alias("duration_ms"),
    )
    return R.run_summary(runs)


# Commands ---------------------------------------------------------------------------


@query
def command_decisions(spark, sf_dir):
    return CM.decide_commands(C.event_commands(spark, sf_dir)).select(
        "event_id", "command", "action", "risk_level", "rule_id"
    )


@query
def command_limits(spark, sf_dir):
    log = CM.decide_commands(C.event_commands(spark, sf_dir))
    judged = CM.limit_commands(log, F.col("timeout_ns"), F.col("output_bytes"))
    return judged.groupBy("rule_id", "action").agg(F.count("*").alias("n"))


@query
def command_hosts(spark, sf_dir):
    c = CM.requested_command(F.col("arguments"))
    host = CM.network_host(c)
    return C.event_commands(spark, sf_dir).select(
        "event_id", host.alias("host"),
        CM.host_allowed(host, ["github.com", "*.local"]).alias("allowed"),
    )


@query
def governance_summary(spark, sf_dir):
    return R.governance_summary(CM.decide_commands(C.event_commands(spark, sf_dir)))


@query
def denied_commands(spark, sf_dir):
    return R.denied_commands(CM.decide_commands(C.event_commands(spark, sf_dir)))


@query
def env_filter(spark, sf_dir):
    names = F.array(F.lit("PATH"), F.lit("home"), F.lit("SECRET"), F.lit("Lang"))
    env = F.map_from_entries(
        F.transform(names, lambda n: F.struct(n, F.col("event_id").cast("string")))
    )
    kept = table(spark, sf_dir, "events").select("event_id", CM.allowed_env(env).alias("env"))
    return kept.select(
        "event_id", F.array_join(F.array_sort(F.map_keys("env")), ",").alias("names")
    )


@query
def path_allow_list(spark, sf_dir):
    files = C.document_files(spark, sf_dir).select(
        F.concat(F.lit("/srv/x/../"), F.col("path")).alias("path")
    )
    return CM.under_allowed(files, ["/srv/pkg/src1", "/srv/examples/"])


@query
def masked_outputs(spark, sf_dir):
    files = C.document_files(spark, sf_dir).select(
        "doc_id", M.masked_output(F.array_join("lines", "\n"), F.lit(400)).alias("m")
    )
    return files.select(
        "doc_id", F.col("m.output").alias("output"), F.col("m.truncated").alias("truncated")
    )


# Sources ----------------------------------------------------------------------------


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.document_lines(spark, sf_dir).select("task_id", F.col("content").alias("text"))


@query
def linter_log(spark, sf_dir):
    return TL.linter_findings(_log(spark, sf_dir)).select(
        "task_id", "file", F.col("line").cast("bigint").alias("line"), "rule_id", "evidence"
    )


@query
def linter_summary(spark, sf_dir):
    return TL.linter_summary_text(TL.linter_summary(TL.linter_findings(_log(spark, sf_dir))))


@query
def vulnerability_log(spark, sf_dir):
    return TL.vulnerability_findings(_log(spark, sf_dir)).select(
        "task_id", "file", "title", "evidence", "confidence"
    )


@query
def vulnerability_summary(spark, sf_dir):
    log = _log(spark, sf_dir)
    found = TL.vulnerability_summary(TL.vulnerability_findings(log))
    return TL.bad_vulnerability_lines(log).join(found, "task_id", "left").na.fill(0)


@query
def link_parse(spark, sf_dir):
    key = F.col("page_id").cast("string")
    forms = F.array(
        F.col("url"),
        F.concat(F.lit("https://github.com/owner"), key, F.lit("/repo.git")),
        F.concat(F.lit(" owner-"), key, F.lit("/repo#"), key),
        F.concat(F.lit("www.github.com/owner/repo/pull/"), key, F.lit("/")),
        F.concat(F.lit("../local/"), key, F.lit(".git")),
        F.concat(F.lit("owner/..x"), key),
    )
    links = table(spark, sf_dir, "pages").select(
        "page_id", F.get(forms, (F.col("page_id") % 6).cast("int")).alias("link")
    )
    link = F.col("link")
    repo, change = P.repository_ref(link), P.change_ref(link)
    return links.select(
        "page_id", repo["owner"].alias("owner"), repo["repo"].alias("repo"),
        change["owner"].alias("change_owner"), change["number"].alias("number"),
        P.canonical_repository(link).alias("canonical"), P.is_local_remote(F.trim(link)).alias("local"),
    )


@query
def artifact_admission(spark, sf_dir):
    endings = literal_array([".json", ".HTML", ".exe", ".log", "", ".txt"])
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("a"), (F.col("page_id") % 7).cast("string")).alias("task_id"),
        F.col("page_id").alias("seq"),
        F.concat(F.lit("out/p"), F.col("page_id").cast("string"),
                 F.get(endings, (F.col("page_id") % 6).cast("int"))).alias("file_path"),
        F.col("html").alias("content"),
    )
    return A.admit(pages).select("task_id", "seq", "rejected")


@query
def import_list(spark, sf_dir):
    return O.imports(C.document_lines(spark, sf_dir)).withColumn("line", F.col("line").cast("bigint"))


@query
def function_list(spark, sf_dir):
    return O.functions(C.document_lines(spark, sf_dir)).withColumn("line", F.col("line").cast("bigint"))


@query
def global_list(spark, sf_dir):
    return O.globals_of(C.document_lines(spark, sf_dir)).withColumn("line", F.col("line").cast("bigint"))


@query
def task_names(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", P.task_name(F.col("text")).alias("name")
    )


# Quality ----------------------------------------------------------------------------


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines, expected places (a planted password) and hits, with the task as the case."""
    lines = C.document_lines(spark, sf_dir)
    hits = LR.line_hits(lines, only={"SEC-AST-001"})
    place = [F.col("task_id").alias("case_id"), F.lit("SEC-AST-001").alias("rule_id"),
             F.col("new_path").alias("file")]
    expected = lines.filter(F.col("content").contains("hunter-Winter")).select(
        *place, F.col("new_line").alias("line")
    )
    return lines, expected, hits


def _produced(hits: DataFrame) -> DataFrame:
    return hits.select(
        F.col("task_id").alias("case_id"), F.lit("SEC-AST-001").alias("rule_id"),
        F.col("new_path").alias("file"), "line",
    )


@query
def rule_quality(spark, sf_dir):
    _, expected, hits = _labelled(spark, sf_dir)
    out = Q.quality(Q.match_expected(expected, _produced(hits)), ["case_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("recall", "precision")})


@query
def configuration_comparison(spark, sf_dir):
    lines, expected, hits = _labelled(spark, sf_dir)
    out = Q.compare_configurations(
        expected, _produced(hits), _produced(FD.drop_nolint(hits, lines))
    )
    return out.select("rule_id", "tp_first", "tp_second", "fn_first", "fn_second", "fp_first", "fp_second")


@query
def leak_check(spark, sf_dir):
    """Raw lines against masked ones: how often a planted secret would be shown."""
    _, _, hits = _labelled(spark, sf_dir)
    secrets = F.array(*[F.lit(f"hunter-Winter-{k}042") for k in range(5)])
    cases = table(spark, sf_dir, "documents").select(
        F.col("source").alias("case_id"), secrets.alias("sensitive_literals")
    ).distinct()
    raw = C.document_lines(spark, sf_dir).select(
        F.col("task_id").alias("case_id"), F.lit("RAW").alias("rule_id"),
        F.col("new_path").alias("file"), F.col("new_line").alias("line"),
        F.col("content").alias("evidence"), F.array(F.lit("rule: RAW")).alias("evidence_chain"),
    )
    masked = FD.findings_of(hits).select(
        F.col("task_id").alias("case_id"), "rule_id", "file", "line", "evidence", "evidence_chain"
    )
    found = Q.leaks(cases, raw.unionByName(masked))
    return found.groupBy("case_id", "rule_id").agg(F.sum("leaks").cast("bigint").alias("leaks"))


@query
def negative_rate(spark, sf_dir):
    """Tasks whose number is odd are negative cases here; their secret hits are false alarms."""
    _, expected, hits = _labelled(spark, sf_dir)

    def named(df):
        odd = F.regexp_extract("case_id", r"(\d+)", 1).cast("int") % 2 == 1
        return df.withColumn("case_id", F.concat(F.when(odd, "neg_").otherwise("pos_"), "case_id"))

    cases = named(table(spark, sf_dir, "documents").select(F.col("source").alias("case_id")).distinct())
    matched = Q.match_expected(named(expected), named(_produced(hits)))
    return Q.negative_rate(cases, named(_produced(hits)), matched)


# Streams ----------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return ST.table_stream(ST.stream_session(spark), f"{sf_dir}/events.parquet", schema)


def _rows_of(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain a stream into files and read them back."""
    out = shared_folder(spark, name)
    ST.run_to_files(stream, out, mode)
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@query
def stream_trend(spark, sf_dir):
    events = _event_stream(spark, sf_dir).select(
        F.col("ts").cast("timestamp").alias("started_at"),
        F.least(F.lit(100.0), F.col("value")).alias("risk_score"),
    )
    out = shared_folder(spark, "trend")
    trend = ST.trend_stream(events)
    ST.run_to_table(trend, out)
    rows = ST.newest_table(spark, out, trend.schema)
    return rows.withColumn("avg_risk", F.round("avg_risk", 6))


@query
def stream_distinct(spark, sf_dir):
    found = _event_stream(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("task_id"), F.col("props").alias("file"),
        F.lit(1).alias("line"), F.col("event_type").alias("category"),
        F.lit("R-1").alias("rule_id"), F.col("ts").cast("timestamp").alias("found_at"),
    )
    rows = _rows_of(spark, ST.distinct_findings(found, "60 days"), "distinct")
    return rows.select("task_id", "file", "category")


@query
def stream_audit(spark, sf_dir):
    events = _event_stream(spark, sf_dir)
    e = F.col("event_id")
    commands = events.select(
        e, F.get(literal_array(C.COMMANDS), (e % len(C.COMMANDS)).cast("int")).alias("arguments"),
        F.col("ts").cast("timestamp").alias("decided_at"),
    )
    rows = _rows_of(spark, ST.audit_stream(commands), "audit")
    return rows.groupBy("decision", "rule_id").agg(F.count("*").alias("n"))


@query
def stream_line_findings(spark, sf_dir):
    """The line rules over a written folder of patches, read as a stream."""
    folder = shared_folder(spark, "patches")
    patches = C.document_patches(spark, sf_dir)
    patches.write.parquet(folder)
    stream = ST.table_stream(spark, folder, patches.schema)
    return brief(_rows_of(spark, ST.line_findings(stream), "line-findings"))


def _running(spark, sf_dir, events):
    """Every event starts a task; all but the errors end it, after event_id modulo 21 minutes."""
    return events.select(
        F.col("event_id").cast("string").alias("task_id"), F.col("ts").cast("timestamp").alias("at"),
        (F.col("event_id") % 21).alias("minutes"), "event_type",
    ).select(
        "task_id",
        F.explode(F.array(
            F.struct(F.lit("running").alias("status"), F.col("at")),
            F.struct(
                F.when(F.col("event_type") != "error", "completed").alias("status"),
                (F.col("at") + F.make_dt_interval(mins=F.col("minutes").cast("int"))).alias("at"),
            ),
        )).alias("e"),
    ).select("task_id", "e.status", "e.at").filter(F.col("status").isNotNull())


@query
def watchdog(spark, sf_dir):
    return ST.watchdog(_running(spark, sf_dir, table(spark, sf_dir, "events"))).select(
        "task_id", "status", "at"
    )


@query
def stream_watchdog(spark, sf_dir):
    """The events as a growing folder of files; a closing row lets the last timers fire."""
    folder, out = shared_folder(spark, "running"), shared_folder(spark, "watchdog")
    events = _running(spark, sf_dir, table(spark, sf_dir, "events"))
    events.write.parquet(folder)
    late = ST.watchdog_stream(
        ST.table_stream(ST.stream_session(spark), folder, events.schema), "1 day")
    ST.run_to_files(late, out)
    ST.closing_row(events, "at").write.mode("append").parquet(folder)
    ST.run_to_files(late, out)
    return spark.read.schema(late.schema).parquet(f"{out}/rows").select("task_id", "status", "at")


QUERIES.update(STORED)
