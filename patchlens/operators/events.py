"""One pass over the line table that emits what the rules ask of it, as narrow events.

An emitter is a gate (cheap: path, kind of line, substrings) and an array of events. All
emitters run in one projection, so a line is read once for all rules; what they emit is a small
part of the lines and mostly without their text. Written once, it serves every rule that looks
beyond a line.

A rule that fails on a line (an expression that raises) doesn't end the review. The pass is run
again in halves of the emitters and then of the lines, until the failing lines are known; these
are left out for that rule alone and reported as rows of an error table.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, fields

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as K
from ..functions.text import all_of, any_of
from ..sources.lines import FILE_KEY, reviewable
from .line_rules import Line, LineRule, with_types

LINE_KEY = FILE_KEY + ["hunk_seq", "pos"]
EVENT_COLUMNS = LINE_KEY + ["line", "kind", "check", "key", "flag", "evidence"]
_EVENT = "struct<kind:string,check:string,key:string,flag:boolean,evidence:string>"
ERRORS = ("rule_id string, task_id string, file_seq int, file string, hunk_seq int, pos int, "
          "line int, condition string, message string")
#: Lines on which a rule may fail before it is left out as a whole.
FAILING_LINES = 20
#: Gates tested in one step. Java doesn't compile a method of more than 8,000 bytes, and the gates of
#: a step are one method.
GATES = 3
# Classes of SQLSTATE that blame the data or the expression, not the cluster:
# data exceptions, external routines, errors raised on purpose.
_BLAMED = r"SQLSTATE: (?:22|38|39|P0)"


@dataclass(frozen=True)
class Emitter:
    """``emit`` is an array of events, looked at where ``gate`` holds; all of one ``kind``."""

    rule: str
    kind: str
    gate: Callable[[Line], Column]
    emit: Callable[[Line], Column]
    uses_facts: bool = False


def is_added() -> Column:
    return F.col("line_type") == "added"


def event(kind: str, check: Column | str | None = None, key: Column | None = None,
          flag: Column | None = None, evidence: Column | None = None) -> Column:
    def value(v, of):
        return (v if isinstance(v, Column) else F.lit(v)).cast(of)

    return F.struct(
        F.lit(kind).alias("kind"), value(check, "string").alias("check"),
        value(key, "string").alias("key"), value(flag, "boolean").alias("flag"),
        value(evidence, "string").alias("evidence"))


def events_where(condition: Column, one: Column) -> Column:
    return F.when(condition, F.array(one))


def events_each(values: Column, one: Callable[[Column], Column]) -> Column:
    """An event for each value of an array that isn't null."""
    return F.transform(F.filter(values, lambda v: v.isNotNull()), one)


def of_line_rule(rule: LineRule) -> Emitter:
    """A line rule's hits as events."""
    return Emitter(
        rule.id, "hit",
        lambda x: is_added() & (x.content != "") & rule.gate(x),
        lambda x: events_each(
            F.filter(F.array(rule.hit(x)), lambda h: h["check"].isNotNull()),
            lambda h: event("hit", h["check"], h["detail"], evidence=h["evidence"])),
        rule.uses_facts)


@dataclass(frozen=True)
class Built:
    """The columns of some emitters: their gates, which lines need tokens, or values made of them,
    and the events. All but the gates refer to the gates by name."""

    gates: list[Column]
    looked_at: Column
    needs_facts: Column | None
    needs_values: Column
    found: Column


_BUILT: dict[tuple, Built] = {}


def _line() -> Line:
    return Line(*[F.col("new_path" if f.name == "path" else f.name) for f in fields(Line)])


def _build(chosen: list[Emitter], left_out: dict[Emitter, list]) -> Built:
    x = _line()
    tests = [
        all_of([~any_of(_is_line(k) for k in left_out[e]), e.gate(x)]) if e in left_out
        else e.gate(x) for e in chosen]
    gates = [F.col(f"__gate{n}") for n in range(len(chosen))]
    need = [g for g, e in zip(gates, chosen) if e.uses_facts]
    # the values made of tokens are columns of line rules only
    values = [g for g, e in zip(gates, chosen) if e.uses_facts and e.kind == "hit"]
    nothing = F.array().cast(f"array<{_EVENT}>")
    found = F.concat(nothing, *[
        F.coalesce(F.when(g, e.emit(x).cast(f"array<{_EVENT}>")), nothing)
        for g, e in zip(gates, chosen)])
    named = [t.alias(f"__gate{n}") for n, t in enumerate(tests)]
    steps = [F.struct(*named[n: n + GATES]) for n in range(0, len(named), GATES)]
    return Built(steps, any_of(gates), any_of(need) if need else None, any_of(values), found)


def _built(application: str, chosen: list[Emitter], left_out: dict[Emitter, list]) -> Built:
    """Columns don't belong to a table: those of a set of emitters are put together once."""
    if left_out:
        return _build(chosen, left_out)
    if any(key[0] != application for key in _BUILT):
        _BUILT.clear()
    key = (application, *chosen)
    if key not in _BUILT:
        _BUILT[key] = _build(chosen, {})
        if len(_BUILT) > 50:
            del _BUILT[next(iter(_BUILT))]
    return _BUILT[key]


def emitted(lines: DataFrame, emitters: Iterable[Emitter],
            type_facts: DataFrame | None = None,
            without: dict[Emitter, list] | None = None) -> DataFrame:
    """All events in one pass. ``without`` has the keys of lines an emitter must not look at."""
    application = lines.sparkSession.sparkContext.applicationId
    own = _built(application, list(emitters), without or {})
    source = reviewable(lines).withColumn("types", F.lit(None).cast("map<int,boolean>"))
    # The outer form keeps the gates in steps of their own, so each is tested once a line.
    for step in own.gates:
        source = source.select("*", F.inline_outer(F.array(step)))
    source = source.filter(own.looked_at)
    if type_facts is not None:
        source = with_types(source, type_facts)
    if own.needs_facts is not None:
        facts = F.col("facts")
        source = source.withColumn(
            "facts", F.when(own.needs_facts, K.facts(F.col("content")))).withColumns({
                "assigned": F.when(own.needs_values, K.assigned_value(facts)),
                "sensitive": F.when(
                    own.needs_values & K.is_sensitive_name(F.col("content")),
                    K.sensitive_identifier(facts)),
                "literals": F.when(own.needs_values, K.string_literals(facts))})
    # The outer form keeps the optimizer from filtering on, and so repeating, the whole array.
    return (
        source.select(*LINE_KEY, F.col("new_line").alias("line"), own.found.alias("found"))
        .select(*LINE_KEY, "line", F.inline_outer("found"))
        .filter(F.col("kind").isNotNull())
        .select(*EVENT_COLUMNS)
    )


class Events:
    """The events of a line table: emitted anew for each use, or read from a written table."""

    def __init__(self, lines: DataFrame, emitters: Iterable[Emitter],
                 type_facts: DataFrame | None = None, table: DataFrame | None = None) -> None:
        self.lines, self.emitters = lines, list(emitters)
        self.type_facts, self.table = type_facts, table

    def of(self, *kinds: str) -> DataFrame:
        if self.table is not None:
            return self.table.filter(F.col("kind").isin(*kinds))
        return emitted(self.lines, [e for e in self.emitters if e.kind in kinds], self.type_facts)


# Failing rules ----------------------------------------------------------------------


def _is_line(key: dict) -> Column:
    return all_of(F.col(c).eqNullSafe(F.lit(key[c])) for c in LINE_KEY)


def _failure(df: DataFrame) -> PySparkException | None:
    """What a rule raises when these events are computed; other failures are raised."""
    try:
        df.write.format("noop").mode("overwrite").save()
    except PySparkException as error:
        if not blames_data(error):
            raise
        return error
    return None


def blames_data(error: PySparkException) -> bool:
    """The failure lies in an expression and the row it met, not in the cluster or a store."""
    return re.search(_BLAMED, str(error)) is not None


def _described(error: PySparkException) -> tuple[str, str]:
    found = re.search(r"\[([A-Z][A-Z0-9_.]*)\]([^\n]*?)SQLSTATE: (?:22|38|39|P0)\w*", str(error))
    return (found[1], found[2].strip()) if found else ("UNKNOWN", str(error).split("\n")[0][:500])


def _failing_emitters(lines: DataFrame, emitters: list[Emitter],
                      type_facts: DataFrame | None) -> dict[Emitter, PySparkException]:
    error = _failure(emitted(lines, emitters, type_facts))
    if error is None:
        return {}
    if len(emitters) == 1:
        return {emitters[0]: error}
    half = len(emitters) // 2
    return (_failing_emitters(lines, emitters[:half], type_facts)
            | _failing_emitters(lines, emitters[half:], type_facts))


def _failing_lines(lines: DataFrame, emitter: Emitter, type_facts: DataFrame | None,
                   most: int) -> list[tuple[dict, PySparkException]] | None:
    """Keys of the lines an emitter fails on; None if there are more than ``most``.

    Lines are halved by the bits of a hash of their key, so equal keys stay together.
    """
    place = F.xxhash64(*LINE_KEY)
    found: list[tuple[dict, PySparkException]] = []
    open_parts = [(0, 0)]
    while open_parts:
        bits, value = open_parts.pop()
        part = lines.filter(place.bitwiseAND(F.lit((1 << bits) - 1)) == value)
        error = _failure(emitted(part, [emitter], type_facts))
        if error is None:
            continue
        gated = emitted(part, [_gate_only(emitter)], type_facts).select(
            *LINE_KEY, "line").distinct()
        keys = gated.limit(2).collect()
        if len(keys) == 1 or bits == 63:
            found += [(k.asDict(), error) for k in keys]
            if len(found) > most:
                return None
        else:
            open_parts += [(bits + 1, value), (bits + 1, value | 1 << bits)]
    return found


def _gate_only(emitter: Emitter) -> Emitter:
    """One event for each line the emitter would look at, without its expression."""
    return Emitter(emitter.rule, emitter.kind, emitter.gate,
                   lambda x: F.array(event(emitter.kind)), False)


def isolated(lines: DataFrame, emitters: Iterable[Emitter], write: Callable[[DataFrame], DataFrame],
             type_facts: DataFrame | None = None, most: int = FAILING_LINES
             ) -> tuple[DataFrame, DataFrame]:
    """Written events and a table of errors, one row a failing rule and line.

    Nothing is tried twice unless the pass fails. A rule that fails on more than ``most`` lines,
    or in its gate, is left out as a whole, with one row that names no line.
    """
    spark, chosen = lines.sparkSession, list(emitters)
    try:
        return write(emitted(lines, chosen, type_facts)), spark.createDataFrame([], ERRORS)
    except PySparkException as error:
        if not blames_data(error):
            raise
    without, rows, gone = {}, [], set()
    for emitter, error in _failing_emitters(lines, chosen, type_facts).items():
        bad = None
        if _failure(emitted(lines, [_gate_only(emitter)], type_facts)) is None:
            bad = _failing_lines(lines, emitter, type_facts, most)
        if bad is None:
            gone.add(emitter)
            rows.append((emitter.rule, *[None] * 6, *_described(error)))
        else:
            without[emitter] = [key for key, _ in bad]
            rows += [(emitter.rule, *(key[c] for c in LINE_KEY), key["line"], *_described(error))
                     for key, error in bad]
    for row in rows:
        logging.getLogger(__name__).warning("rule %s failed at %s: %s", row[0], row[3], row[-1])
    left = [e for e in chosen if e not in gone]
    events = write(emitted(lines, left, type_facts, without))
    return events, spark.createDataFrame(rows, ERRORS)


__all__ = ["Emitter", "Events", "EVENT_COLUMNS", "LINE_KEY", "emitted", "event", "isolated"]
