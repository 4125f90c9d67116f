"""Rules that compare lines with other lines of the same hunk, file or task.

Each has two halves: emitters, which turn single lines into narrow events (``events``), and a
function of events to hits. None gathers a file or a task in one place: sites (lines that open
something) are few, and what clears them is reduced to distinct keys or per-group maxima, with
partial aggregation before the shuffle. A very large file or task only means many distinct
keys, which spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import tokens as K
from ..functions.text import (
    WHITE_SPACE,
    WORD_END,
    WORD_START,
    contains_any,
    index_substring,
    is_blank,
    is_comment,
    record,
    trimmed,
)
from ..sources.lines import FILE_KEY, reviewable
from .events import Emitter, Events, event, events_each, events_where, is_added
from .line_rules import Line, cancel_name

CHUNK = 4096
# Longest name compared by equality when any ending of a longer name may match.
SUFFIX_KEY = 64


def _hits(df: DataFrame, check: Column | str, detail: Column | None = None) -> DataFrame:
    """Hits of events, or of rows with their columns."""
    return df.select(
        *FILE_KEY,
        "line",
        (F.lit(check) if isinstance(check, str) else check).alias("check"),
        (F.lit("") if detail is None else detail).alias("detail"),
        "evidence",
    )


def _go(x: Line) -> Column:
    return P.is_go(x.path)


# Openers and closers --------------------------------------------------------------


@dataclass(frozen=True)
class PairRule:
    """``site`` is the key a line opens (null when it opens nothing); ``closers`` are the
    keys it clears. With ``suffix`` a closer also clears every ending of its key. Only lines
    with one of the hints are looked at; ``by_call`` closers are names of calls."""

    id: str
    check: str
    site: Callable[[Column], Column]
    closers: Callable[[Column], Column]
    site_hints: tuple[str, ...]
    close_hints: tuple[str, ...]
    go_only: bool = True
    all_lines_close: bool = False
    suffix: bool = False
    by_call: bool = False
    named: bool = False


# Calls that open a resource and the call that closes it.
OPEN_CALLS = {
    "os.Open(": ".Close()", "os.Create(": ".Close()", "os.OpenFile(": ".Close()",
    "os.CreateTemp(": ".Close()", "http.Get(": ".Body.Close()", "http.Post(": ".Body.Close()",
    "http.Do(": ".Body.Close()", "sql.Open(": ".Close()", ".Conn(": ".Close()",
    ".Query(": ".Close()", ".Prepare(": ".Close()", "net.Dial(": ".Close()",
    "net.Listen(": ".Close()",
}
CLOSE_CALLS = sorted(set(OPEN_CALLS.values()))
LOCK = r"([A-Za-z_][A-Za-z0-9_.\[\]\*]*?)\.Lock\(\)"
TIMER = r"([A-Za-z_][A-Za-z0-9_]*)\s*(?::=|=)\s*time\.New(?:Timer|Ticker)\("
ROWS_QUERY = WORD_START + r"rows\s*,\s*err\s*(?::=|=)\s*[^\n]*\.Query(?:Context)?\("


def _nothing() -> Column:
    return F.array().cast("array<string>")


def _open_site(c: Column) -> Column:
    """First identifier of the line followed by the close call it needs."""
    by_length = sorted(OPEN_CALLS, key=lambda k: (-len(k), k))
    close = F.coalesce(*[F.when(c.contains(k), OPEN_CALLS[k]) for k in by_length])
    opened = F.when(contains_any(c, OPEN_CALLS) & ~is_comment(c), close)
    handle = F.coalesce(K.first_identifier(K.facts(c)), F.lit(""))
    return F.when(opened.isNotNull(), F.concat(handle, opened))


def _closed_names(c: Column) -> Column:
    """``name.Close()`` texts of a line, and handles it returns, in the same form."""
    def closed_by(call):
        name = r"([\p{L}\p{Nd}_]*)" + call.replace(".", r"\.").replace("()", r"\(\)")
        found = F.regexp_extract_all(c, F.lit(name), F.lit(1))
        return F.transform(found, lambda n: F.concat(n, F.lit(call)))

    closed = [closed_by(call) for call in CLOSE_CALLS]
    return F.when(c.contains("Close()"), F.concat(*closed)).otherwise(_nothing())


def _returned_names(c: Column) -> Column:
    """Names a line hands to its caller."""
    tail = F.regexp_extract(c, WORD_START + "return" + WORD_END + r"([^\n]*)", 1)
    names = F.regexp_extract_all(tail, F.lit(r"[A-Za-z0-9_]++(?!\.)"), F.lit(0))
    return F.when(c.contains("return"), names).otherwise(_nothing())


def _called_names(c: Column) -> Column:
    """Names in front of an opening bracket: ``a.b.stop(`` gives the chain and its ends."""
    chains = F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9_.\[\]]+)\s*\("), F.lit(1))
    ends = F.transform(chains, lambda chain: _endings(F.split(chain, r"\."), "."))
    return F.when(c.contains("("), F.flatten(ends)).otherwise(_nothing())


def _endings(parts: Column, mark: str) -> Column:
    """All joined endings of a list of parts, the whole first."""
    return F.transform(
        parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts) - i), mark)
    )


def _extract(c: Column, hint: str, pattern: str) -> Column:
    found = F.regexp_extract(c, pattern, 1)
    return F.when(c.contains(hint) & (found != "") & ~is_comment(c), found)


def _file_key(found: Column) -> Column:
    return F.when(found, "")


def _file_closer(found: Column) -> Column:
    return F.when(found, F.array(F.lit(""))).otherwise(_nothing())


PAIR_RULES = [
    PairRule(
        "RES-AST-001", "resource_open", _open_site, _closed_names,
        tuple(OPEN_CALLS), ("Close()",), all_lines_close=True, suffix=True, named=True,
    ),
    PairRule(
        "DB-AST-001", "transaction_open",
        lambda c: _file_key(
            contains_any(c, [".Begin(", ".BeginTx("])
            & ~F.ltrim(c, F.lit(WHITE_SPACE)).startswith("//")
        ),
        lambda c: _file_closer(contains_any(c, [".Commit(", ".Rollback("])),
        (".Begin(", ".BeginTx("), (".Commit(", ".Rollback("), go_only=False,
    ),
    PairRule(
        "CTX-AST-001", "cancel_unused",
        lambda c: F.when(
            c.contains("context.With") & ~is_comment(c) & (cancel_name(c) != "_"), cancel_name(c)
        ),
        _called_names, ("context.With",), ("(",), by_call=True, named=True,
    ),
    PairRule(
        "CON-AST-001", "mutex_pair",
        lambda c: _extract(c, ".Lock()", LOCK),
        lambda c: F.when(
            c.contains(".Unlock()"),
            F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9_.\[\]\*]+)\.Unlock\(\)"), F.lit(1)),
        ).otherwise(_nothing()),
        (".Lock()",), (".Unlock()",), suffix=True, named=True,
    ),
    PairRule(
        "RES-AST-002", "timer_leak",
        lambda c: F.when(_extract(c, "time.New", TIMER) != "_", _extract(c, "time.New", TIMER)),
        lambda c: F.when(
            c.contains(".Stop()"),
            F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9_]+)\.Stop\(\)"), F.lit(1)),
        ).otherwise(_nothing()),
        ("time.New",), (".Stop()",), named=True,
    ),
    PairRule(
        "DB-AST-002", "rows_err",
        lambda c: _file_key(
            c.contains(".Query") & ~is_comment(c) & c.rlike(ROWS_QUERY)
        ),
        lambda c: _file_closer(c.contains("rows.Err()")),
        (".Query",), ("rows.Err()",),
    ),
]


def _gate(rule: PairRule, hints: tuple[str, ...], added_only: bool) -> Callable[[Line], Column]:
    def gate(x: Line) -> Column:
        where = contains_any(x.content, hints) & ~is_blank(x.content)
        where = _go(x) & where if rule.go_only else where
        return is_added() & where if added_only else where

    return gate


def pair_emitters(rules: list[PairRule]) -> list[Emitter]:
    """Sites, closers and, where resources are followed, names that are returned."""
    found = []
    for r in rules:
        found.append(Emitter(
            r.id, "site", _gate(r, r.site_hints, True),
            lambda x, r=r: events_each(
                F.array(r.site(x.content)),
                lambda key: event("site", r.check, key, evidence=x.content))))
        kind = "call" if r.by_call else "close"
        found.append(Emitter(
            r.id, kind, _gate(r, r.close_hints, not r.all_lines_close),
            lambda x, r=r, kind=kind: events_each(
                r.closers(x.content), lambda key: event(kind, r.check, key))))
        if r.check == "resource_open":
            found.append(Emitter(
                r.id, "returned", _gate(r, ("return",), not r.all_lines_close),
                lambda x, r=r: events_each(
                    F.array_distinct(_returned_names(x.content)),
                    lambda key: event("returned", r.check, key))))
    return found


def pairs_of(events: Events, calls: DataFrame | None = None,
             type_facts: DataFrame | None = None) -> DataFrame:
    """Sites without a closer in the same file: one anti join for all rules.

    ``calls`` are the called names (by default all that are emitted). Closers of files without
    a site of their check are dropped before they are grouped.
    ``type_facts(task_id, file, line, idx, implements_closer)`` clears resources whose first
    value is known not to be closable.
    """
    sites = events.of("site").select(*FILE_KEY, "line", "check", "key", "evidence").withColumn(
        "tail", F.right(F.col("key"), F.lit(SUFFIX_KEY)))
    asked = FILE_KEY + ["check"]
    open_files = sites.select(*asked).distinct()
    closing = events.of("close").select(*asked, "key")
    # handing a resource to the caller clears it by its whole name only
    returned = events.of("returned").select(*asked, "key").distinct().join(
        open_files, asked, "left_semi").select(*asked, F.explode(F.array(*[
            F.concat(F.col("key"), F.lit(call)) for call in CLOSE_CALLS])).alias("key"))
    calls = events.of("call") if calls is None else calls
    key, by_ending = F.col("key"), F.col("check").isin(
        [r.check for r in PAIR_RULES if r.suffix])
    long = F.when(F.length(key) > SUFFIX_KEY, key)
    whole = F.array(record(tail=F.right(key, F.lit(SUFFIX_KEY)), whole=long))
    endings = F.transform(
        F.sequence(F.lit(0), F.least(F.length(key), F.lit(SUFFIX_KEY))),
        lambda n: record(tail=F.right(key, n), whole=F.when(n == SUFFIX_KEY, long)),
    )

    def cleared(closers: DataFrame, tails: Column) -> DataFrame:
        near = closers.distinct().join(open_files, asked, "left_semi")
        return near.select(*asked, F.inline(tails))

    closers = (
        cleared(closing, F.when(by_ending, endings).otherwise(whole))
        .unionByName(cleared(calls.select(*asked, "key"), whole))
        .unionByName(returned.select(*asked, F.inline(whole)))
        .distinct()
    )
    s, c = sites.alias("s"), closers.alias("c")
    same = [F.col(f"s.{k}") == F.col(f"c.{k}") for k in asked + ["tail"]]
    short = F.length("s.key") <= SUFFIX_KEY
    condition = same[0]
    for extra in same[1:] + [short | F.endswith(F.col("c.whole"), F.col("s.key"))]:
        condition = condition & extra
    left = s.join(c, condition, "left_anti")
    if type_facts is not None:
        not_closable = type_facts.filter((F.col("idx") == 0) & ~F.col("implements_closer"))
        not_closable = not_closable.select(
            "task_id", F.col("file").alias("new_path"), "line", F.lit("resource_open").alias("check"),
        ).distinct()
        left = left.join(not_closable, ["task_id", "new_path", "line", "check"], "left_anti")
    named = sorted(r.check for r in PAIR_RULES if r.named)
    detail = F.when(F.col("check").isin(named), F.col("key")).otherwise("")
    return _hits(left, F.col("check"), detail)


def pair_hits(
    lines: DataFrame, only: set[str] | None = None, type_facts: DataFrame | None = None
) -> DataFrame:
    """Sites of the chosen rules without a closer in the same file."""
    chosen = [r for r in PAIR_RULES if only is None or r.id in only]
    return pairs_of(Events(lines, pair_emitters(chosen)), type_facts=type_facts)


# Hunk level -----------------------------------------------------------------------

EXIT_NAMES = ["ctx", "cancel", "done", "stop", "quit", "errgroup"]
GO_CALL = r"^\s*go\s+[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)+\s*\("
HUNK_KEY = FILE_KEY + ["hunk_seq"]


def _go_site(x: Line) -> Column:
    check = F.when(x.content.rlike(GO_CALL), "goroutine_qualified").otherwise("goroutine_leak")
    closure = trimmed(x.content).rlike("^(?:go )?func")
    return events_where(
        K.has_kind(x.facts, "go"), event("go", check, flag=closure, evidence=x.content))


def _flow(x: Line) -> Column:
    """Signs that a goroutine of the hunk can end, and loops, which make a closure last."""
    stops = (
        K.has_kind(x.facts, "select")
        | K.has_kind(x.facts, "defer")
        | F.exists(
            x.facts, lambda f: (f["kind"] == "identifier") & F.lower(f["value"]).isin(EXIT_NAMES)
        )
    )
    loop = K.has_kind(x.facts, "for")
    return events_where(stops | loop, event("flow", F.when(loop, "loop"), flag=stops))


# A token of such a name: it starts where no word goes on, or right behind a number, and ends with
# the word. The first letter is tried before the names.
_FLOW_NAMES = "(?=[cdsqef])(?:" + "|".join(EXIT_NAMES + ["select", "defer", "for"]) + r")(?![\p{L}\p{Nd}_])"
_FLOW_HINT = rf"(?i)(?=[cdsqef])(?<![\p{{L}}_]){_FLOW_NAMES}|[0-9][0-9a-fipx_.+\-]*{_FLOW_NAMES}"
GOROUTINE_EMITTERS = [
    Emitter(
        "GOR-AST-001", "go",
        lambda x: _go(x) & is_added() & x.content.contains("go")
        & x.content.rlike(WORD_START + "go" + WORD_END),
        _go_site, uses_facts=True),
    Emitter("GOR-AST-001", "flow", lambda x: _go(x) & x.content.rlike(_FLOW_HINT), _flow,
            uses_facts=True),
]


def goroutines_of(events: Events) -> DataFrame:
    """Goroutines in a hunk without any sign of a way to stop them."""
    sites = events.of("go").select(*HUNK_KEY, "pos", "line", "check", "evidence",
                                   F.col("flag").alias("closure"))
    hunks = events.of("flow").groupBy(*HUNK_KEY).agg(
        F.max("flag").alias("stops"),
        F.max(F.when(F.col("check") == "loop", F.col("pos"))).alias("last_loop"))
    one_shot = F.col("closure") & ~F.coalesce(F.col("last_loop") > F.col("pos"), F.lit(False))
    left = sites.join(hunks, HUNK_KEY, "left").filter(
        ~F.coalesce("stops", F.lit(False)) & ~one_shot
    )
    return _hits(left, F.col("check"))


def goroutine_hits(lines: DataFrame) -> DataFrame:
    return goroutines_of(Events(lines, GOROUTINE_EMITTERS))


SWALLOWED_EMITTERS = [
    Emitter(
        "ERR-AST-001", "guard",
        lambda x: _go(x) & is_added() & x.content.contains("if err != nil"),
        lambda x: F.array(event("guard", evidence=x.content))),
    Emitter(
        "ERR-AST-001", "return",
        lambda x: _go(x) & x.content.contains("return"),
        lambda x: events_where(
            F.ltrim(x.content, F.lit(WHITE_SPACE)).startswith("return"),
            event("return", flag=trimmed(x.content).isin("return nil", "return nil,")))),
]


def swallowed_errors_of(events: Events) -> DataFrame:
    """``if err != nil`` whose next return within four lines is ``return nil``.

    Sites ask for the four following positions by key, so no hunk is ordered as a whole.
    Only the first hit of a hunk is kept.
    """
    sites = events.of("guard").select(
        *HUNK_KEY, F.col("pos").alias("site"), "line", "evidence",
        F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + 4)).alias("pos"),
    )
    returns = events.of("return").select(*HUNK_KEY, "pos", F.col("flag").alias("nothing"))
    met = sites.join(returns, HUNK_KEY + ["pos"]).groupBy(*HUNK_KEY, "site").agg(
        F.min(F.struct("pos", "nothing", "line", "evidence")).alias("next")
    )
    first = (
        met.filter("next.nothing")
        .groupBy(*HUNK_KEY)
        .agg(F.min(F.struct("site", "next")).alias("hit"))
        .select(*FILE_KEY, "hit.next.line", "hit.next.evidence")
    )
    return _hits(first, "error_swallowed")


def swallowed_error_hits(lines: DataFrame) -> DataFrame:
    return swallowed_errors_of(Events(lines, SWALLOWED_EMITTERS))


# File order -----------------------------------------------------------------------


def last_before(
    events: DataFrame, keys: list[str], order: list[str], value: str, ask: str
) -> DataFrame:
    """For rows where ``ask`` holds, the last non-null ``value`` at or before them.

    Ordered in two steps: inside chunks of a file, then over one row per chunk, so the
    size of a window never grows with the rows of a file.
    """
    *outer, inner = order
    part = keys + outer + ["__chunk"]
    events = events.withColumn("__chunk", F.floor(F.col(inner) / CHUNK))
    inside = W.partitionBy(*part).orderBy(inner).rowsBetween(W.unboundedPreceding, 0)
    near = events.withColumn("__near", F.last(value, ignorenulls=True).over(inside)).filter(ask)
    ends = events.groupBy(*part).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(inner))).alias("__end")
    )
    over = W.partitionBy(*keys).orderBy(*outer, "__chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumn("__carry", F.last("__end", ignorenulls=True).over(over)).drop("__end")
    return (
        near.join(carried, part, "left")
        .withColumn(value, F.coalesce("__near", "__carry"))
        .drop("__near", "__carry", "__chunk")
    )


def function_name(signature: Column) -> Column:
    """Name on a trimmed ``func`` line, with or without receiver, empty when unclear."""
    receiver = signature.rlike(r"^func ?\(")
    after = F.regexp_extract(signature, r"^func ?\([^\n]*?\) ([^\n]*)", 1)
    method = F.when(after.contains("("), F.substring_index(after, "(", 1)).otherwise("")
    plain = trimmed(F.regexp_replace(signature, "^func", ""))
    plain = F.when(plain.contains("("), F.substring_index(plain, "(", 1)).otherwise("")
    return F.when(
        receiver, F.regexp_replace(trimmed(method), r"^\*", "")
    ).otherwise(trimmed(plain))


def takes_context(signature: Column) -> Column:
    """The parameters up to the first closing bracket hold a context.Context."""
    head = F.when(signature.contains(")"), F.substring_index(signature, ")", 1))
    return F.coalesce(
        head.contains("context.Context") & ~function_name(signature).isin("main", "init"),
        F.lit(False),
    )


def _is_function(x: Line) -> Column:
    t = F.ltrim(x.content, F.lit(WHITE_SPACE))
    return (t.startswith("func ") & (trimmed(t) != "func")) | t.startswith("func(")


def _in_program(x: Line) -> Column:
    return _go(x) & ~P.is_go_test(x.path)


CONTEXT_EMITTERS = [
    Emitter(
        "CTX-AST-002", "func",
        lambda x: _in_program(x) & (F.col("line_type") != "deleted") & x.content.contains("func"),
        lambda x: events_where(
            _is_function(x), event("func", flag=takes_context(trimmed(x.content))))),
    Emitter(
        "CTX-AST-002", "root",
        lambda x: _in_program(x) & is_added() & x.content.contains("context."),
        lambda x: events_where(
            ~_is_function(x) & ~is_comment(x.content)
            & x.content.rlike(r"context\.(?:Background|TODO)\("),
            event("root", evidence=x.content))),
]


def context_roots_of(events: Events) -> DataFrame:
    """A root context inside a function that was given one."""
    both = events.of("func", "root").select(
        *HUNK_KEY, "pos", "line", "evidence",
        F.when(F.col("kind") == "func", F.col("flag")).alias("in_context"),
        (F.col("kind") == "root").alias("asks"))
    found = last_before(both, FILE_KEY, ["hunk_seq", "pos"], "in_context", "asks")
    return _hits(found.filter("in_context"), "context_root")


def context_root_hits(lines: DataFrame) -> DataFrame:
    return context_roots_of(Events(lines, CONTEXT_EMITTERS))


def large_delete_hits(lines: DataFrame, threshold: int = 30) -> DataFrame:
    """Files that lose many lines, anchored at the last hunk's first added line."""
    gone = (F.col("line_type") == "deleted") & ~is_blank(F.col("content"))
    order = F.struct("hunk_seq", "pos")
    files = (
        reviewable(lines)
        .groupBy(*FILE_KEY)
        .agg(
            F.count_if(gone).alias("deleted"),
            F.min_by(F.when(gone, F.col("old_line")), F.when(gone, order)).alias("first"),
            F.max(
                F.when(is_added(), F.struct("hunk_seq", (-F.col("pos")).alias("pos"), "new_line"))
            ).alias("anchor"),
        )
        .filter(F.col("deleted") >= threshold)
    )
    return _hits(
        files.select(
            *FILE_KEY,
            F.coalesce("anchor.new_line", "first").alias("line"),
            F.lit("(deleted block not shown)").alias("evidence"),
            "deleted",
        ),
        "large_delete",
        F.col("deleted").cast("string"),
    )


# Task level -----------------------------------------------------------------------

NO_TEST_NEEDED = [
    "main", "init", "String", "Error", "Unwrap", "Is", "As", "ServeHTTP", "Close", "Setup",
    "Teardown",
]


def _exported(x: Line) -> Column:
    name = F.regexp_extract(trimmed(x.content), r"^func\s+([\p{L}_][\p{L}\p{Nd}_]*)", 1)
    return events_each(
        F.filter(F.array(name), lambda n: n.rlike("^[A-Z]") & ~n.isin(NO_TEST_NEEDED)),
        lambda n: event("exported", key=n, evidence=x.content))


def _found(when: Column, text: Column, pattern: str) -> Column:
    return F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).otherwise(_nothing())


def _references(x: Line) -> Column:
    """Names a line refers to, by use: named, called, declared by a test, or work being done.

    Names and call endings start with a capital letter, which keeps them few. Work has no name.
    """
    text = x.content
    # Only the beginning counts, and trimming on the right walks the whole line.
    t = F.ltrim(text, F.lit(WHITE_SPACE))
    code = ~t.startswith("//")
    body = code & ~t.startswith("func ")
    # Capitalised words a line refers to, capitalised endings of longer names it calls, and
    # the subjects of the test functions it declares.
    # The border is looked at behind a capital letter, not at every place.
    refers = _found(body, text, r"([A-Z](?<!\w[A-Z])\w*+)")
    # names with other letters inside; word borders are those of ASCII words
    accented = _found(
        body & (F.octet_length(text) > F.length(text)), text,
        r"([A-Z](?<!\w[A-Z])\w*+[^\x00-\x7f][\p{L}\p{Nd}_]*\w)(?!\w)",
    )
    longer = F.filter(
        _found(body & text.contains("("), text, WORD_START + r"(\w++)\("),
        lambda w: w.rlike(".[A-Z]")
    )
    call_ends = F.flatten(
        F.transform(longer, lambda w: _endings(F.split(w, "(?=[A-Z])"), ""))
    )
    declares = code & text.contains("func Test")
    declared = _found(declares, text, r"func Test([A-Z][A-Za-z0-9_]*)\(")
    grouped = F.flatten(
        F.transform(
            _found(declares, text, r"func Test([A-Z][A-Za-z0-9_]*_)"),
            lambda w: F.transform(
                F.sequence(F.lit(1), F.size(F.split(w, "_")) - 1),
                lambda n: index_substring(w, "_", n),
            ),
        )
    )
    brace = t.startswith("}") | t.startswith("{")
    brace_only = brace & trimmed(t).isin("}", "{", "} {", "}{")
    works = (t != "") & ~is_comment(text) & ~brace_only & ~t.contains("t.Skip")

    def used(names, use):
        return F.transform(F.array_distinct(names), lambda n: event("name", use, n))

    return F.concat(
        used(F.concat(refers, accented, grouped), "named"), used(call_ends, "called"),
        used(declared, "declared"),
        F.when(works, F.array(event("name", "works", F.lit("")))).otherwise(
            F.array().cast("array<struct<kind:string,check:string,key:string,flag:boolean,evidence:string>>")),
    )


TEST_EMITTERS = [
    Emitter(
        "TST-AST-001", "exported",
        lambda x: _in_program(x) & is_added() & x.content.contains("func "), _exported),
    Emitter("TST-AST-001", "name", _go, _references),
]


def wanted_names(events: Events) -> DataFrame:
    """task_id, kind, key: the names that exported functions and cancel functions ask for.

    A task with exported functions also asks for work, which has the empty name.
    """
    exported = events.of("exported").select("task_id", "key")
    cancels = events.of("site").filter(F.col("check") == "cancel_unused")
    return (
        exported.unionByName(exported.select("task_id", F.lit("").alias("key")))
        .withColumn("kind", F.lit("name"))
        .unionByName(cancels.select("task_id", "key", F.lit("call").alias("kind")))
        .distinct()
    )


def names_of(events: Events, wanted: DataFrame) -> DataFrame:
    """Distinct files, uses and names among the called and referred-to ones that are wanted."""
    return (
        events.of("call", "name").select(*FILE_KEY, "kind", "check", "key")
        # most words name nothing that is asked for: drop them before they are grouped
        .join(wanted, ["task_id", "kind", "key"], "left_semi")
        .distinct()
    )


def missing_tests_of(events: Events, names: DataFrame) -> DataFrame:
    """Exported functions that neither their own file nor a test file of the task refers to.

    References are distinct (scope, name) keys; a scope is one file or the test files of a task.
    """
    path = F.col("new_path")
    functions = events.of("exported").select(
        *FILE_KEY, "line", "evidence", F.col("key").alias("name"))
    # Test files serve their whole task; other files serve themselves.
    in_test = P.is_go_test(path)
    scope = [
        F.col("task_id"),
        F.when(in_test, "task").otherwise("file").alias("scope"),
        F.when(in_test, 0).otherwise(F.col("file_seq")).alias("scope_seq"),
        F.when(in_test, "").otherwise(path).alias("scope_path"),
    ]
    scope_key = ["task_id", "scope", "scope_seq", "scope_path"]
    used = names.filter(F.col("kind") == "name").select(
        *scope, F.col("key").alias("name"), F.col("check").alias("use"))
    marks = used.filter(F.col("use") != "works").groupBy(*scope_key, "name").agg(
        *[F.max(F.col("use") == use).alias(use) for use in ("named", "called", "declared")])
    # A test body counts only in a scope with code that is not skipped.
    working = used.filter(F.col("use") == "works").select(*scope_key).distinct().withColumn(
        "works", F.lit(True))
    tested = F.col("named") | (F.col("declared") & F.col("called") & F.col("works"))
    known = (
        marks.filter(F.col("named") | (F.col("declared") & F.col("called")))
        .join(working, scope_key, "left")
        .filter(tested)
        .select(*scope_key, "name", F.lit(True).alias("tested"))
    )
    asked = functions.withColumn(
        "ask",
        F.explode(
            F.array(
                record(scope="file", scope_seq=F.col("file_seq"), scope_path=path),
                record(scope="task", scope_seq=0, scope_path=""),
            )
        ),
    ).select(*functions.columns, "ask.*")
    left = (
        asked.join(known, scope_key + ["name"], "left")
        .groupBy(*functions.columns)
        .agg(F.max("tested").alias("tested"))
        .filter(F.col("tested").isNull())
    )
    return _hits(left, "missing_test", F.col("name"))


def missing_test_hits(lines: DataFrame) -> DataFrame:
    events = Events(lines, TEST_EMITTERS)
    wanted = wanted_names(events).filter(F.col("kind") == "name")
    return missing_tests_of(events, names_of(events, wanted))


#: All emitters; those of names are read apart, with a filter by the names that are wanted.
EMITTERS = [
    *pair_emitters(PAIR_RULES), *GOROUTINE_EMITTERS, *SWALLOWED_EMITTERS, *CONTEXT_EMITTERS,
    *TEST_EMITTERS,
]
NAME_KINDS = ("call", "name")

__all__ = [
    "EMITTERS", "NAME_KINDS", "pair_hits", "goroutine_hits", "swallowed_error_hits", "context_root_hits",
    "large_delete_hits", "missing_test_hits", "last_before",
]
