"""What each check reports: rule, severity, category, confidence and texts.

Rule ids, severities, categories, confidences and sources are fixed values.
``{}`` in a text stands for the detail of the hit.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..functions.credentials import SHAPES


class Check(NamedTuple):
    rule_id: str
    severity: str
    category: str
    confidence: float
    title: str
    recommendation: str
    source: str
    fact: str


CHECKS: dict[str, Check] = {
    "secret_assigned": Check(
        "SEC-AST-001", "high", "security", 0.90, "Hard-coded secret",
        "Move the secret to the environment or a secret manager",
        "token:hardcoded_secret", "a literal is given to a name that sounds secret"),
    "secret_passed": Check(
        "SEC-AST-001", "medium", "security", 0.70, "Sensitive value passed as a literal",
        "Check whether {} holds sensitive information",
        "token:sensitive_param", "a literal stands beside a name that sounds secret"),
    "goroutine_leak": Check(
        "GOR-AST-001", "high", "resource", 0.85, "Goroutine may leak",
        "Give the goroutine a way to stop: context.WithCancel and select",
        "token:goroutine_leak", "nothing in the goroutine's lines can end it"),
    "goroutine_qualified": Check(
        "GOR-AST-001", "low", "resource", 0.65, "Goroutine start to be confirmed (qualified call)",
        "Confirm that the goroutine is a one-time action, or give it a way to stop",
        "token:goroutine_leak", "the started function belongs to another package or value"),
    "resource_open": Check(
        "RES-AST-001", "medium", "resource", 0.80, "Resource may stay open",
        "Add defer {}",
        "token:resource_leak", "opened here, closed nowhere in this file"),
    "discard_all": Check(
        "ERR-AST-001", "medium", "error_handling", 0.55, "Error may be discarded with _",
        "Check the returned error and handle it",
        "token:error_ignored", "the blank name takes what may be an error"),
    "discard_final": Check(
        "ERR-AST-001", "medium", "error_handling", 0.80, "Error may be discarded with _",
        "Check the returned error and handle it",
        "token:error_ignored", "the blank name takes what may be an error"),
    "discard_typed": Check(
        "ERR-AST-001", "medium", "error_handling", 0.85, "Error may be discarded with _",
        "Check the returned error and handle it",
        "token:error_ignored", "the blank name takes what may be an error"),
    "panic": Check(
        "ERR-AST-001", "low", "error_handling", 0.65, "panic instead of a returned error",
        "Library code should return an error instead of panicking",
        "token:panic_usage", "a library file panics"),
    "log_fatal": Check(
        "ERR-AST-001", "medium", "error_handling", 0.80, "log.Fatal in library code",
        "Library code should return an error instead of calling log.Fatal",
        "token:log_fatal", "a library file ends the program"),
    "error_swallowed": Check(
        "ERR-AST-001", "low", "error_handling", 0.75, "Error swallowed: nil returned instead",
        "Return the error, with context added",
        "token:error_swallowed", "an error is tested for, and nil goes back"),
    "missing_test": Check(
        "TST-AST-001", "low", "testing", 0.65, "Exported function added without a test",
        "Add a test function Test{} for normal and error paths",
        "token:missing_test", "no test of this change uses the new function"),
    "transaction_open": Check(
        "DB-AST-001", "medium", "lifecycle", 0.80, "Transaction begun, never finished",
        "Make sure the transaction is committed or rolled back",
        "token:db_lifecycle", "begun here; no added line commits or rolls back"),
    "cancel_unused": Check(
        "CTX-AST-001", "medium", "lifecycle", 0.75, "Cancel function of a context may leak",
        "Call {}() when done, usually with defer",
        "token:context_cancel", "the cancel function is kept and no added line calls it"),
    "cancel_discarded": Check(
        "CTX-AST-001", "high", "lifecycle", 0.85, "Cancel function of a context discarded",
        "Keep the cancel function and call it, usually with defer",
        "token:context_cancel", "the cancel function goes to the blank name"),
    "sql_concat": Check(
        "SEC-AST-003", "high", "security", 0.75, "SQL statement built by concatenation",
        "Use a parameterized query instead of joining values into SQL",
        "token:sql_injection", "values are joined into a statement without placeholders"),
    "command_injection": Check(
        "SEC-AST-004", "high", "security", 0.80, "Command built from external input",
        "Do not hand external input to a shell; check it or pass an argument list",
        "token:command_injection", "a started command takes more than fixed texts"),
    "tls_off": Check(
        "SEC-AST-005", "high", "security", 0.85, "TLS certificate check turned off",
        "Do not skip certificate checks in production code",
        "token:insecure_tls", "the setting that skips certificate checks is on"),
    "context_root": Check(
        "CTX-AST-002", "low", "concurrency", 0.70, "Context root replaced inside a ctx function",
        "Use the ctx parameter to keep cancellation connected",
        "token:context_root", "a new root although the function is given a context"),
    "mutex_pair": Check(
        "CON-AST-001", "medium", "concurrency", 0.80, "Lock without Unlock",
        "Make sure {}.Unlock() runs on every path",
        "token:mutex_pair", "locked here; no added line unlocks it"),
    "defer_in_loop": Check(
        "RES-AST-002", "medium", "resource", 0.75, "defer inside a for loop",
        "Release in each iteration, or move the loop body into a function",
        "token:defer_in_loop", "a loop defers on each turn"),
    "time_tick": Check(
        "RES-AST-002", "low", "resource", 0.70, "time.Tick cannot be stopped",
        "Use time.NewTicker and defer ticker.Stop()",
        "token:time_tick", "the ticker behind time.Tick has no handle"),
    "timer_leak": Check(
        "RES-AST-002", "medium", "resource", 0.75, "Timer or ticker never stopped",
        "Call {}.Stop() when no longer needed",
        "token:timer_leak", "made here; no added line stops it"),
    "rows_err": Check(
        "DB-AST-002", "medium", "lifecycle", 0.75, "rows.Err() not checked",
        "Check rows.Err() after the iteration",
        "token:rows_err", "rows are read; no added line asks for their error"),
    "config_url": Check(
        "SEC-GEN-001", "high", "sensitive_leak", 0.85, "URL with credentials in configuration",
        "Move connection credentials to a secret manager",
        "token:gen_url_cred", "an address holds a name and a password"),
    "config_secret": Check(
        "SEC-GEN-001", "high", "sensitive_leak", 0.80, "Unquoted credential in configuration",
        "Move the credential to a secret manager",
        "token:gen_unquoted_secret", "a secret-sounding key has a bare value"),
    "large_delete": Check(
        "DEL-GEN-001", "low", "quality", 0.60, "Large deletion ({} lines)",
        "Confirm that the deletion is intended",
        "token:large_delete", "one file loses at least as many lines as the limit"),
}
for _name, (_title, _confidence) in SHAPES.items():
    CHECKS["leak_" + _name] = Check(
        "SEC-AST-002", "high", "sensitive_leak", _confidence, "Leaked " + _title,
        "Rotate the credential now and remove it from the code",
        "token:sensitive_leak", "a literal has the form of an issued credential")

MULTI_FILE_RULES = ["TST-AST-001"]


def rule_catalog(spark: SparkSession, user_rules=()) -> DataFrame:
    """All rules with their origin, one row per rule id."""
    rows = {}
    for check in CHECKS.values():
        rows.setdefault(check.rule_id, (check.rule_id, check.severity, check.category, "builtin"))
    for rule in user_rules:
        rows.setdefault(rule.id, (rule.id, rule.severity, rule.category, "yaml"))
    return spark.createDataFrame(
        sorted(rows.values()), "rule_id string, severity string, category string, origin string"
    )
