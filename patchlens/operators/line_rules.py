"""Rules that look at one added line at a time.

A rule is a gate (cheap: path and substring tests) and a hit column. All chosen rules
run in one projection over the lines; the token array is its own projection below it,
built only for lines that some rule's gate lets through.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import credentials as C
from ..functions import paths as P
from ..functions import tokens as K
from ..functions.masking import shorten_secret
from ..functions.text import (
    WORD_END,
    WORD_START,
    any_of,
    contains_any,
    is_comment,
    mentions_any,
    record,
    starts_any,
    trimmed,
    unquoted,
)
from ..sources.lines import FILE_KEY, reviewable

HIT_COLUMNS = FILE_KEY + ["line", "check", "detail", "evidence"]


@dataclass(frozen=True)
class Line:
    """Columns a rule may use. Token columns are null where no gate asked for them."""

    content: Column
    path: Column
    facts: Column
    assigned: Column
    sensitive: Column
    literals: Column
    package_main: Column
    loop_defer: Column
    types: Column


@dataclass(frozen=True)
class LineRule:
    """``gate`` must be cheap; ``hit`` is a struct (check, detail, evidence) or null."""

    id: str
    gate: Callable[[Line], Column]
    hit: Callable[[Line], Column]
    uses_facts: bool = False
    severity: str = ""
    category: str = ""


def hit(check: Column | str, evidence: Column, detail: Column | str = "") -> Column:
    text = [F.lit(x) if isinstance(x, str) else x for x in (check, detail)]
    return record(check=text[0], detail=text[1], evidence=evidence)


def _go_code(x: Line, *words: str) -> Column:
    return P.is_go(x.path) & contains_any(x.content, words) & ~is_comment(x.content)


def _may_hold_literal(x: Line) -> Column:
    return contains_any(x.content, ['"', "`"]) & ~is_comment(x.content)


# Secrets ------------------------------------------------------------------------


def _secret_gate(x: Line) -> Column:
    return _may_hold_literal(x) & K.is_sensitive_name(x.content)


def _secret_hit(x: Line) -> Column:
    assigned, name = x.assigned, x.sensitive
    elsewhere = mentions_any(x.content, ["os.Getenv(", "os.LookupEnv(", "secretmanager"])
    literal = F.get(
        F.filter(x.literals, lambda s: (unquoted(s) != name) & ~C.likely_not_secret(s)),
        F.lit(0),
    )
    hard = (
        ~elsewhere
        & (unquoted(assigned["value"]) != assigned["name"])
        & K.is_sensitive_name(assigned["name"])
        & ~C.likely_not_secret(assigned["value"])
    )
    soft = (
        name.isNotNull()
        & ~K.has_kind(x.facts, "assignment")
        & ~mentions_any(x.content, ["`", "=="])
        & literal.isNotNull()
    )
    return F.when(
        hard, hit("secret_assigned", shorten_secret(x.content, assigned["value"]), assigned["name"])
    ).when(
        assigned.isNull() & soft,
        hit("secret_passed", shorten_secret(x.content, unquoted(literal)), name),
    )


def _leak_hit(x: Line) -> Column:
    shaped = F.transform(
        F.filter(F.transform(x.literals, unquoted), lambda s: F.octet_length(s) >= 10),
        lambda s: record(text=s, shape=C.credential_shape(s)),
    )
    found = F.transform(
        F.slice(F.filter(shaped, lambda s: s["shape"].isNotNull()), 1, 1),
        lambda s: hit(F.concat(F.lit("leak_"), s["shape"]), shorten_secret(x.content, s["text"])),
    )
    return F.get(found, F.lit(0))


# Error handling -------------------------------------------------------------------

# Calls whose error is usually ignored on purpose.
SAFE_TO_IGNORE = [
    "fmt.Print", "fmt.Sprint", "fmt.Fprint", "io.Copy", "io.WriteString", ".Write(", ".Close()",
    ".Commit()", ".Rollback()", "os.Remove(", "os.RemoveAll(", "json.Marshal(", ".EmitEvent(",
    "json.Unmarshal(", "json.NewDecoder(", ".Scan(", ".Encode(",
]
TYPE_ASSERTION = r"=[\s]*[A-Za-z_][A-Za-z0-9_.\[\]]*\.\("


def _after_last(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, -1)


def left_side(content: Column) -> Column:
    """Names left of the first := (else of the first =), split on commas and trimmed."""
    lhs = F.when(content.contains(":="), F.substring_index(content, ":=", 1)).otherwise(
        F.substring_index(content, "=", 1)
    )
    return F.transform(F.split(trimmed(lhs), ","), trimmed)


def _error_gate(x: Line) -> Column:
    slashes = F.ltrim(x.content).startswith("//")
    return P.is_go(x.path) & contains_any(x.content, ["_", "panic", "Fatal"]) & ~slashes


def _error_hit(x: Line) -> Column:
    text = trimmed(x.content)
    names = left_side(x.content)
    last = F.size(names) - 1
    blanks = F.filter(
        F.transform(names, lambda v, i: F.when(v == "_", i)), lambda i: i.isNotNull()
    )
    some, every = F.size(blanks) > 0, F.size(blanks) == F.size(names)
    call = _after_last(x.content, "=").contains("(")
    quiet = text.startswith("var ") | ~call | mentions_any(x.content, SAFE_TO_IGNORE)
    asserted = x.content.contains("=") & F.concat(
        F.lit("="), _after_last(x.content, "=")
    ).rlike(TYPE_ASSERTION)
    ignored = (
        K.has_identifier(x.facts, "_") & K.has_kind(x.facts, "assignment")
        & x.content.contains("=") & ~quiet
    )
    is_error = F.exists(blanks, lambda i: F.coalesce(x.types[i], F.lit(False)))
    known = F.forall(blanks, lambda i: x.types[i].isNotNull())
    here = some & ~P.is_go_test(x.path)
    typed = x.types.isNotNull()
    fatal = (
        K.has_identifier(x.facts, "log")
        & F.exists(x.facts, lambda f: (f["kind"] == "identifier") & f["value"].startswith("Fatal"))
        & x.content.contains(".Fatal")
    )
    none = F.lit(None).cast("string")
    check = (
        F.when(here & every, F.when(~quiet, "discard_all").otherwise(none))
        .when(here & asserted, none)
        .when(here & typed & is_error, "discard_typed")
        .when(here & typed & known, none)
        .when(here & ignored, F.when(F.array_contains(blanks, last), "discard_final").otherwise(none))
        .when(K.has_identifier(x.facts, "panic") & ~P.is_go_test(x.path), "panic")
        .when(fatal & ~P.is_program_or_test(x.path) & ~x.package_main, "log_fatal")
    )
    return hit(check, x.content)


# Injection and transport ----------------------------------------------------------

# Forms of statements, of joined texts and of placeholders.
SQL_STATEMENT = (
    r'(?i)(?:select{e}[^"]{0,200}?{s}from{e}|insert\s+into{e}|update{e}\s+\S+\s+set{e}'
    r"|delete\s+from{e}|drop\s+(?:table|database){e}|truncate\s+table{e})"
)
SQL_STATEMENT = SQL_STATEMENT.replace("{e}", WORD_END).replace("{s}", WORD_START)
SQL_JOINED = r'"\s*\+\s*[A-Za-z_(]|[A-Za-z_)\d]\s*\+\s*"|fmt\.Sprintf\('
SQL_PLACEHOLDER = r"\?|\$\d"
SHELLS = ["sh", "bash", "zsh", "ksh", "cmd", "cmd.exe", "powershell", "powershell.exe"]


def _sql_hit(x: Line) -> Column:
    literal = F.exists(
        K.quoted_pieces(x.content), lambda s: s.rlike(SQL_STATEMENT) & ~s.rlike(SQL_PLACEHOLDER)
    )
    return F.when(x.content.rlike(SQL_JOINED) & literal, hit("sql_concat", x.content))


def call_arguments(text: Column) -> Column:
    """Arguments at the top level of a call, given the text after its opening bracket."""
    chars = F.transform(F.split(text, ""), lambda c, i: record(c=c, at=i + 1))

    def step(s, x):
        c, at, quote = x["c"], x["at"], s["quote"]
        piece = F.substring(text, s["start"], at - s["start"])
        plain = ~s["done"] & (quote == "")
        top = plain & (s["depth"] == 0)
        closes = top & c.isin(")", "]", "}")
        return record(
            depth=s["depth"]
            + F.when(plain & c.isin("(", "[", "{"), 1)
            .when(plain & ~top & c.isin(")", "]", "}"), -1).otherwise(0),
            quote=F.when(plain & c.isin('"', "`"), c).when(quote == c, "").otherwise(quote),
            done=s["done"] | closes,
            start=F.when(top & (c == ","), at + 1).otherwise(s["start"]),
            args=F.when(closes, F.concat(s["args"], F.array(trimmed(piece))))
            .when(top & (c == ","), F.concat(s["args"], F.array(piece)))
            .otherwise(s["args"]),
        )

    def finish(s):
        rest = trimmed(F.substring(text, s["start"], F.length(text)))
        return F.when(s["done"] | (rest == ""), s["args"]).otherwise(
            F.concat(s["args"], F.array(rest))
        )

    start = record(
        depth=0, quote="", done=False, start=1, args=F.array().cast("array<string>")
    )
    return F.aggregate(chars, start, step, finish)


def is_literal_argument(a: Column) -> Column:
    return starts_any(trimmed(a), ['"', "`"])


def is_dynamic_argument(a: Column) -> Column:
    t = trimmed(a)
    after = trimmed(F.substring(t, F.instr(t, "+") + 1, F.length(t)))
    joined = F.substring(t, 2, 1 << 30).contains("+") & (after != "") & ~starts_any(after, ['"', "`"])
    return (t != "") & (~is_literal_argument(t) | joined)


def _arguments_after(content: Column, call: str) -> Column:
    at = F.instr(content, call)
    rest = F.substring(content, at + len(call), F.length(content))
    return F.when(at > 0, call_arguments(rest))


def _command_hit(x: Line) -> Column:
    def dangerous(args):
        first = trimmed(F.get(args, F.lit(0)))
        shell = F.lower(F.trim(first, F.lit('"`'))).isin(SHELLS)
        later = F.exists(F.slice(args, 2, 1 << 20), is_dynamic_argument)
        return F.coalesce(
            (F.size(args) > 0) & (~is_literal_argument(first) | (shell & later)), F.lit(False)
        )

    # as elements of an array, so that the arguments are cut once
    found = any_of(
        F.exists(F.array(_arguments_after(x.content, call)), dangerous)
        for call in ("exec.CommandContext(", "exec.Command("))
    return F.when(found, hit("command_injection", x.content))


def _syscall_hit(x: Line) -> Column:
    args = _arguments_after(x.content, "syscall.Exec(")
    found = F.coalesce(F.exists(args, is_dynamic_argument), F.lit(False))
    return F.when(found, hit("command_injection", x.content))


# Contexts, timers, configuration ---------------------------------------------------

CONTEXT_CALLS = [
    "context.WithCancel(", "context.WithTimeout(", "context.WithDeadline(",
    "context.WithCancelCause(",
]


def cancel_name(content: Column) -> Column:
    """Name that receives the cancel function: after the last comma left of the assignment."""
    call = F.coalesce(
        *[F.when(content.contains(c), F.substring_index(content, c, 1)) for c in CONTEXT_CALLS]
    )

    def up_to_last(mark):
        pieces = F.split(call, mark)
        return F.array_join(F.slice(pieces, F.lit(1), F.size(pieces) - 1), mark)

    lhs = F.when(call.contains(":="), up_to_last(":=")).when(call.contains("="), up_to_last("="))
    return F.when(lhs.isNotNull(), trimmed(_after_last(lhs, ",")))


def _config_gate(x: Line) -> Column:
    hash_line = F.ltrim(x.content).startswith("#")
    return (
        ~P.is_go(x.path)
        & contains_any(x.content, [":", "="])
        & P.language(x.path).isin(C.CONFIG_LANGUAGES)
        & ~is_comment(x.content)
        & ~hash_line
    )


def _config_hit(x: Line) -> Column:
    key = F.regexp_extract(x.content, C.CONFIG_PAIR, 1)
    value = trimmed(F.regexp_extract(x.content, C.CONFIG_PAIR, 2))
    return F.when(
        key != "",
        F.when(C.config_value_is_real(key, value), hit("config_secret", x.content, key)),
    ).when(x.content.rlike(C.URL_CREDENTIAL), hit("config_url", x.content))


LINE_RULES = [
    LineRule("SEC-AST-001", _secret_gate, _secret_hit, uses_facts=True),
    LineRule(
        "SEC-AST-002",
        lambda x: _may_hold_literal(x) & contains_any(x.content, C.SHAPE_HINTS),
        _leak_hit,
        uses_facts=True,
    ),
    LineRule("ERR-AST-001", _error_gate, _error_hit, uses_facts=True),
    LineRule("SEC-AST-003", lambda x: _go_code(x, '"'), _sql_hit),
    LineRule("SEC-AST-004", lambda x: _go_code(x, "exec.Command"), _command_hit),
    LineRule("SEC-AST-004", lambda x: _go_code(x, "syscall.Exec("), _syscall_hit),
    LineRule(
        "SEC-AST-005",
        lambda x: _go_code(x, "InsecureSkipVerify"),
        lambda x: F.when(x.content.contains("true"), hit("tls_off", x.content)),
    ),
    LineRule(
        "CTX-AST-001",
        lambda x: _go_code(x, "context.With"),
        lambda x: F.when(cancel_name(x.content) == "_", hit("cancel_discarded", x.content)),
    ),
    LineRule(
        "RES-AST-002", lambda x: x.loop_defer, lambda x: hit("defer_in_loop", x.content)
    ),
    LineRule(
        "RES-AST-002",
        lambda x: _go_code(x, "time.Tick("),
        lambda x: hit("time_tick", x.content),
    ),
    LineRule("SEC-GEN-001", _config_gate, _config_hit),
]


def line_hits(
    lines: DataFrame,
    only: set[str] | None = None,
    rules: list[LineRule] | None = None,
    type_facts: DataFrame | None = None,
) -> DataFrame:
    """Hits of the line rules in one pass over the added lines.

    ``type_facts(task_id, file, line, idx, is_error)`` decides discarded errors where it
    knows the type; it is joined only to lines that discard something.
    """
    chosen = [r for r in (rules or LINE_RULES) if only is None or r.id in only]
    source = reviewable(lines).filter(
        (F.col("line_type") == "added") & (F.col("content") != "")
    )
    source = source.withColumn("types", F.lit(None).cast("map<int,boolean>"))
    x = Line(*[F.col("new_path" if f.name == "path" else f.name) for f in fields(Line)])
    gates = [r.gate(x) for r in chosen]
    source = source.filter(any_of(gates))
    if type_facts is not None:
        source = with_types(source, type_facts)
    staged = source
    if any(r.uses_facts for r in chosen):
        need = any_of(g for g, r in zip(gates, chosen) if r.uses_facts)
        staged = source.withColumn("facts", F.when(need, K.facts(x.content))).withColumns(
            {
                "assigned": K.assigned_value(x.facts),
                "sensitive": K.sensitive_identifier(x.facts),
                "literals": K.string_literals(x.facts),
            }
        )
    found = F.array(*[F.when(g, r.hit(x)) for g, r in zip(gates, chosen)])
    # The outer form keeps the optimizer from filtering on, and so repeating, the whole array.
    return (
        staged.select(*FILE_KEY, F.col("new_line").alias("line"), found.alias("found"))
        .select(*FILE_KEY, "line", F.inline_outer("found"))
        .filter(F.col("check").isNotNull())
        .select(*HIT_COLUMNS)
    )


def with_types(source: DataFrame, type_facts: DataFrame) -> DataFrame:
    known = type_facts.groupBy("task_id", "file", "line").agg(
        F.map_from_entries(F.collect_set(F.struct("idx", "is_error"))).alias("known")
    )
    key = ["task_id", "new_path", "new_line"]
    known = known.toDF(*key, "known")
    blank = F.array_contains(left_side(F.col("content")), "_") & P.is_go(F.col("new_path"))
    joined = source.withColumn("new_line", F.col("new_line").cast("int")).join(
        known.withColumn("new_line", F.col("new_line").cast("int")), key, "left"
    )
    return joined.withColumn("types", F.when(blank, F.col("known"))).drop("known")


__all__ = ["LineRule", "Line", "LINE_RULES", "line_hits", "hit", "HIT_COLUMNS"]
