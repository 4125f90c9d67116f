"""User rules as rows of a table, matched through an index of their literals.

A rule that wants one of some texts in a line, or in a token of it, gives a key for each: a piece
of ``GRAM`` characters (or the whole text, if shorter). The lower-case pieces of a line that are
keys meet these in a broadcast join, and what meets is verified in full, with the rule's conditions
as columns; tokens are cut only for what passes all others. Rules without such a text are met
through the endings of paths they want, or by all lines. So the plan is the same for ten rules and
for ten thousand, but for the length of a pattern, and a line is only compared with rules that
share a piece with it.

The rules are a list on the driver; those sent out at once have at most ``TABLE_BYTES`` of text,
more go in passes of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as K
from ..functions.text import all_of, any_of, contains_any, trimmed
from ..sources.lines import FILE_KEY, reviewable
from .line_rules import HIT_COLUMNS

GRAM = 4
TABLE_BYTES = 16_000_000
ANY_PATH = "*"
#: Up to so many keys one pattern finds those of a line; its text is compared once a line.
PATTERN_KEYS = 2000
# Signs of which a line must have one for a token of a kind.
SIGNS = {"string_literal": ['"', "`"], "assignment": ["="], "comment": ["//", "/*"]}
# The most common characters of code and prose; pieces avoid them.
COMMON = set(" etaoinsr")
_TABLE = (
    "key string, at int, number int, rule_id string, ends array<string>, texts array<string>, "
    "unwanted array<string>, starts array<string>, facts array<struct<kind:string,exact:string,"
    "holds:array<string>,pattern:string,not_prefix:string>>"
)


def piece_of(text: str) -> str:
    """The piece of a text that stands for it: the one with the fewest common characters."""
    n = min(GRAM, len(text))
    pieces = [text[i: i + n] for i in range(len(text) - n + 1)]
    return min(pieces, key=lambda p: sum(c in COMMON for c in p))


def _facts(rule) -> list[tuple]:
    return [
        (w.get("kind") or "", w.get("value_exact") or None,
         [x.lower() for x in w.get("value_contains") or []], w.get("value_pattern") or None,
         w.get("value_not_prefix") or None)
        for w in rule.token_facts
    ]


def _texts_of(facts: list[tuple]) -> list[str]:
    """Texts of which a line must hold one for its tokens to pass; none if no fact tells.

    Only plain letters, since the lower case of others depends on what stands beside them.
    """
    wanted = [[exact.lower()] if exact else holds for _, exact, holds, *_ in facts]
    wanted = [ts for ts in wanted if all(t and t.isascii() for t in ts)]
    return max(wanted, key=lambda ts: min(map(len, ts), default=0), default=[])


def rule_rows(rules: Iterable) -> tuple[list[tuple], list[tuple]]:
    """Rows of rules that are found by a text, and of those that are found by a path.

    A rule has a row for each of its texts, or for each ending; ``at`` is its place among them.
    """
    by_text, by_path = [], []
    for number, r in enumerate(rules):
        texts = [t.lower() for t in r.line_contains]
        texts = [] if "" in texts else texts  # an empty text is in every line
        ends = [] if "" in r.file_extension else list(r.file_extension)
        starts = list(r.exclude_line_starts_with)
        unwanted = [t.lower() for t in r.line_not_contains + r.exclude_line_contains]
        if "" in unwanted or "" in starts or "" in r.exclude_file_contains:
            continue  # excluded by every line
        facts = _facts(r)
        texts = texts or _texts_of(facts)
        body = (number, r.id, ends, texts, unwanted, starts, facts)
        if texts:
            by_text += [(piece_of(t), at, *body) for at, t in enumerate(texts)]
        else:
            by_path += [(e, at, *body) for at, e in enumerate(ends or [ANY_PATH])]
    return by_text, by_path


def _parts(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Rows in lists of bounded text."""
    part, size = [], 0
    for row in rows:
        own = len(repr(row))
        if part and size + own > TABLE_BYTES:
            yield part
            part, size = [], 0
        part.append(row)
        size += own
    if part:
        yield part


def _one_of(words: Iterable[str]) -> str:
    """A pattern for different words of one length, which shares their beginnings."""
    rest: dict[str, list[str]] = {}
    for w in sorted(words):
        rest.setdefault(re.sub(r"([^A-Za-z0-9_\x80-\U0010ffff])", r"\\\1", w[0]), []).append(w[1:])
    if all(r == [""] for r in rest.values()):
        return f"[{''.join(rest)}]"
    ways = [first + _one_of(r) for first, r in rest.items()]
    return f"(?=[{''.join(rest)}])(?:{'|'.join(ways)})"


def pieces(text: Column, keys: Iterable[str]) -> Column:
    """All different pieces of a text that are keys, or, for very many keys, that may be."""
    sizes: dict[int, set[str]] = {}
    for k in keys:
        sizes.setdefault(len(k), set()).add(k)
    one = {n: f".{{{n}}}" if len(ks) > PATTERN_KEYS else _one_of(ks) for n, ks in sizes.items()}
    return F.array_distinct(F.concat(*[
        F.regexp_extract_all(text, F.lit(f"(?s)(?=({one[n]}))"), F.lit(1)) for n in sorted(one)]))


def _cut(df: DataFrame, part: list[tuple]) -> DataFrame:
    """A row for each piece. The outer form keeps the optimizer from looking for them twice."""
    found = pieces(F.col("low"), {row[0] for row in part})
    return df.select("*", F.explode_outer(found).alias("key")).filter(F.col("key").isNotNull())


def _earlier(values: Column, test) -> Column:
    """A value before place ``at`` passes the test; then its own row has the match."""
    return F.exists(F.slice(values, F.lit(1), F.col("at")), test)


def _fact_matches(f: Column, w: Column) -> Column:
    value = f["value"]
    return (
        (f["kind"] == w["kind"])
        & (w["exact"].isNull() | (value == w["exact"]))
        & ((F.size(w["holds"]) == 0) | F.exists(w["holds"], lambda t: F.contains(F.lower(value), t)))
        & (w["pattern"].isNull() | F.rlike(value, w["pattern"]))
        & (w["not_prefix"].isNull() | ~F.startswith(value, w["not_prefix"]))
    )


def _may_match(content: Column, low: Column, w: Column) -> Column:
    """The line has the signs and a text of such a token; without cutting it into tokens."""
    signs = all_of([(w["kind"] != kind) | contains_any(content, signs)
                    for kind, signs in SIGNS.items()])
    other = lambda t: F.octet_length(t) > F.length(t)
    return signs & (
        (F.size(w["holds"]) == 0) | F.exists(w["holds"], lambda t: F.contains(low, t) | other(t)))


def _verified(met: DataFrame, by_text: bool) -> DataFrame:
    """Lines that fulfil all conditions of the rule they met, once each."""
    low, path = F.col("low"), F.col("new_path")
    ends = lambda e: F.endswith(path, e)
    holds = lambda t: F.contains(low, t)
    met = met.filter(~F.exists("unwanted", holds)).filter(
        ~F.exists("starts", lambda s: F.startswith(trimmed(F.col("content")), s)))
    if by_text:
        met = met.filter(holds(F.get("texts", F.col("at"))) & ~_earlier(F.col("texts"), holds))
        met = met.filter((F.size("ends") == 0) | F.exists("ends", ends))
    else:
        met = met.filter(~_earlier(F.col("ends"), ends))
    met = met.filter(F.forall("facts", lambda w: _may_match(F.col("content"), low, w)))
    if "found" not in met.columns:
        # a step of its own, so that a line is cut once for all facts of a rule
        met = met.select("*", F.explode_outer(F.array(
            F.when(F.size("facts") > 0, K.facts(F.col("content"))))).alias("found"))
    return met.filter(
        (F.size("facts") == 0)
        | F.forall("facts", lambda w: F.exists("found", lambda f: _fact_matches(f, w)))
    ).select(
        *FILE_KEY, F.col("new_line").alias("line"), F.col("rule_id").alias("check"),
        F.lit("").alias("detail"), F.col("content").alias("evidence"))


def _table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    # at most TABLE_BYTES of text
    return F.broadcast(spark.createDataFrame(rows, _TABLE))


def indexed_hits(lines: DataFrame, rules: list) -> DataFrame:
    """Hits of all rules: one row a line and rule."""
    spark = lines.sparkSession
    by_text, by_path = rule_rows(rules)
    used = reviewable(lines).filter((F.col("line_type") == "added") & (F.col("content") != ""))
    used = used.select(*FILE_KEY, "new_line", "content", F.lower("content").alias("low"))
    hits = []
    for part in _parts(by_text):
        hits.append(_verified(_cut(used, part).join(_table(spark, part), "key"), True))
    for part in _parts(by_path):
        path = F.col("new_path")
        keys = [F.lit(ANY_PATH)] + [
            F.right(path, F.lit(n)) for n in sorted({len(row[0]) for row in part} - {0})]
        own = used
        if any(row[-1] for row in part):
            kinds = {frozenset(f[0] for f in row[-1]) & frozenset(SIGNS) for row in part if row[-1]}
            looked_at = any_of(
                all_of(contains_any(F.col("content"), SIGNS[k]) for k in sorted(ks)) for ks in kinds)
            own = own.withColumn("found", F.when(looked_at, K.facts(F.col("content"))))
        own = own.withColumn("key", F.explode(F.array_distinct(F.array(*keys))))
        hits.append(_verified(own.join(_table(spark, part), "key"), False))
    if not hits:
        return used.filter("false").select(
            *FILE_KEY, F.col("new_line").alias("line"), F.lit("").alias("check"),
            F.lit("").alias("detail"), F.col("content").alias("evidence"))
    out = hits[0]
    for more in hits[1:]:
        out = out.unionByName(more)
    return _without_barred(out, lines, rules).select(*HIT_COLUMNS)


def _without_barred(hits: DataFrame, lines: DataFrame, rules: list) -> DataFrame:
    """Without hits in files that hold a text their rule forbids, found by the same index."""
    spark = hits.sparkSession
    forbidden = sorted({(piece_of(t.lower()), t.lower(), r.id)
                        for r in rules for t in r.exclude_file_contains if t})
    for part in _parts(forbidden):
        cut = _cut(lines.select(*FILE_KEY, F.lower("content").alias("low")), part)
        table = F.broadcast(spark.createDataFrame(part, "key string, text string, check string"))
        barred = cut.join(table, "key").filter(F.contains("low", "text")).select(
            *FILE_KEY, "check").distinct()
        hits = hits.join(barred, FILE_KEY + ["check"], "left_anti")
    return hits


__all__ = ["indexed_hits", "piece_of", "rule_rows"]
