"""Imports, functions and globals declared by source files, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.text import trimmed
from ..sources.lines import FILE_KEY
from .pair_rules import last_before

SINGLE_IMPORT = r'^import\s+(?:([A-Za-z_.][A-Za-z0-9_]*)\s+)?"([^"]+)"'
GROUPED_IMPORT = r'^(?:([A-Za-z_.][A-Za-z0-9_]*)\s+)?"([^"]+)"'
FUNCTION = r"^func\s+(?:\(\s*(?:[A-Za-z_][A-Za-z0-9_]*\s+)?(\*?[A-Za-z_][A-Za-z0-9_]*)[^)]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)\s*[(\[]"
GLOBAL = r"^(?:var|const)\s+([A-Za-z_][A-Za-z0-9_]*)"


def _go(lines: DataFrame) -> DataFrame:
    return lines.filter(P.is_go(F.col("new_path")) & (F.col("line_type") != "deleted"))


def imports(lines: DataFrame) -> DataFrame:
    """Single imports and those inside ``import ( ... )``, with their alias."""
    t = trimmed(F.col("content"))
    opens, closes = t.rlike(r"^import\s*\("), t == ")"
    asks = t.contains('"') & (t.rlike(SINGLE_IMPORT) | t.rlike(GROUPED_IMPORT))
    events = _go(lines).filter(opens | closes | asks).select(
        *FILE_KEY, "hunk_seq", "pos", "new_line", t.alias("text"),
        F.when(opens, True).when(closes, False).alias("inside"), asks.alias("asks"),
    )
    placed = last_before(events, FILE_KEY, ["hunk_seq", "pos"], "inside", "asks")
    single = F.col("text").rlike(SINGLE_IMPORT)
    grouped = F.coalesce("inside", F.lit(False)) & F.col("text").rlike(GROUPED_IMPORT)

    def group(i):
        return F.when(single, F.regexp_extract("text", SINGLE_IMPORT, i)).otherwise(
            F.regexp_extract("text", GROUPED_IMPORT, i)
        )

    return placed.filter(single | grouped).select(
        "task_id", F.col("new_path").alias("file"), F.col("new_line").alias("line"),
        group(2).alias("path"), F.nullif(group(1), F.lit("")).alias("alias"),
        F.regexp_extract(group(2), r"([^/]*)\z", 1).alias("name"),
    )


def functions(lines: DataFrame) -> DataFrame:
    """Functions and methods: name, receiver type, exported or not."""
    c = F.col("content")
    name = F.regexp_extract(c, FUNCTION, 2)
    return _go(lines).filter(c.startswith("func")).filter(name != "").select(
        "task_id", F.col("new_path").alias("file"), F.col("new_line").alias("line"),
        name.alias("name"), F.nullif(F.regexp_extract(c, FUNCTION, 1), F.lit("")).alias("receiver"),
        name.rlike("^[A-Z]").alias("is_exported"),
    )


def globals_of(lines: DataFrame) -> DataFrame:
    """Variables and constants declared at the left margin."""
    c = F.col("content")
    return _go(lines).filter(c.rlike(GLOBAL)).select(
        "task_id", F.col("new_path").alias("file"), F.col("new_line").alias("line"),
        F.regexp_extract(c, GLOBAL, 1).alias("name"),
    )
