"""Which values can be closed: type facts derived from the declarations in the lines.

Types are looked at by name inside a package (task and folder). A type can be closed if it has a
method ``Close() error``, if it is an interface that asks for one, or if it embeds a type that
can be closed; the last is a fixpoint, one join a level of embedding. Names with a qualifier are
those of the package whose folder has that name, or of the standard library (a fixed list).

Facts are given for lines that assign a literal, ``new(T)`` or a call of a declared function to
a first name. Types that aren't declared in the lines are unknown and give no fact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.text import trimmed
from ..sources.lines import FILE_KEY
from .pair_rules import last_before

# Types of the standard library that can be closed, and some that can't.
STANDARD_CLOSERS = [
    "io.Closer", "io.ReadCloser", "io.WriteCloser", "io.ReadWriteCloser", "os.File", "net.Conn",
    "net.Listener", "sql.DB", "sql.Conn", "sql.Rows", "sql.Stmt", "gzip.Reader", "gzip.Writer",
]
STANDARD_OTHERS = ["bytes.Buffer", "strings.Builder", "strings.Reader", "sync.Mutex", "time.Timer"]
_NAME = r"[A-Za-z_][A-Za-z0-9_]*"
_TYPE = rf"(?:{_NAME}\.)?{_NAME}"
DECLARATION = rf"^type\s+({_NAME})\s+(struct|interface)\s*\{{"
EMBEDDED = rf"^\*?({_TYPE})\s*(?:`[^`]*`\s*)?(?://.*)?\z"
CLOSE_METHOD = rf"^func\s+\(\s*(?:{_NAME}\s+)?\*?({_NAME})[^)]*\)\s*Close\(\)\s*error"
CONSTRUCTOR = rf"^func\s+({_NAME})\([^()]*\)\s*\(?\s*(?:{_NAME}\s+)?\*?({_TYPE})"
ASSIGNED = rf"^({_NAME})[^=]*?:?=\s*(.+)$"
LITERAL = rf"^&?({_TYPE})\{{"
NEW = rf"^new\(({_TYPE})\)"
CALL = rf"^({_TYPE})\("


def _source(lines: DataFrame) -> DataFrame:
    path = F.col("new_path")
    return lines.filter(P.is_go(path) & (F.col("line_type") != "deleted")).select(
        *FILE_KEY, "hunk_seq", "pos", "new_line", "line_type", P.directory(path).alias("folder"),
        F.col("content"), trimmed(F.col("content")).alias("text"))


def _resolved(df: DataFrame, name: str) -> DataFrame:
    """``package`` and ``type`` of a written name: its qualifier's, or the folder's own."""
    written = F.col(name)
    qualified = written.contains(".")
    return df.withColumns({
        "package": F.when(qualified, F.substring_index(written, ".", 1)).otherwise(
            P.base_name(F.col("folder"))),
        "type": F.substring_index(written, ".", -1)})


KEY = ["task_id", "package", "type"]


def declared_types(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Types, those with a method to close them, and what each embeds (owner and member)."""
    source = _source(lines)
    package = P.base_name(F.col("folder")).alias("package")
    text = F.col("text")
    opens = text.rlike(DECLARATION)
    closes = F.col("content").startswith("}")
    asks = text.rlike(EMBEDDED) | text.rlike(r"^Close\(\)\s*error")
    events = source.filter(opens | closes | asks).select(
        *FILE_KEY, "hunk_seq", "pos", "folder", "text",
        F.when(opens & ~text.endswith("}"), F.regexp_extract(text, DECLARATION, 1))
        .when(opens | closes, "").alias("owner"), asks.alias("asks"))
    members = last_before(events, FILE_KEY, ["hunk_seq", "pos"], "owner", "asks").filter(
        F.col("owner") != "")
    types = source.filter(opens).select(
        "task_id", package, F.regexp_extract(text, DECLARATION, 1).alias("type")).distinct()
    method = F.regexp_extract(text, CLOSE_METHOD, 1)
    direct = source.filter(method != "").select("task_id", package, method.alias("type"))
    asked = members.filter(text.startswith("Close()")).select(
        "task_id", package, F.col("owner").alias("type"))
    embedded = members.filter(~text.startswith("Close()")).withColumn(
        "member", F.regexp_extract(text, EMBEDDED, 1))
    links = _resolved(embedded, "member").select(
        "task_id", P.base_name(F.col("folder")).alias("own_package"), "owner", "package", "type",
    ).distinct()
    return types, direct.unionByName(asked).distinct(), links


def closable_types(direct: DataFrame, links: DataFrame,
                   write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All declared types that can be closed: methods and, level by level, what is embedded.

    ``write`` keeps an intermediate table and reads it back.
    """
    links = write(links)
    named = F.concat_ws(".", "package", "type")
    standard = links.filter(named.isin(STANDARD_CLOSERS)).select(*KEY)
    found = write(direct.unionByName(standard).distinct())
    newest, parts = found, [found]
    while newest.head(1):
        above = links.join(newest, KEY).select(
            "task_id", F.col("own_package").alias("package"), F.col("owner").alias("type")
        ).distinct()
        known = parts[0]
        for part in parts[1:]:
            known = known.unionByName(part)
        newest = write(above.join(known, KEY, "left_anti"))
        parts.append(newest)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def closer_facts(lines: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``type_facts(task_id, file, line, idx, is_error, implements_closer)`` of first names."""
    types, direct, links = declared_types(lines)
    source = _source(lines)
    text = F.col("text")
    results = _resolved(
        source.filter(text.rlike(CONSTRUCTOR)).select(
            "task_id", "folder", F.regexp_extract(text, CONSTRUCTOR, 1).alias("function"),
            F.regexp_extract(text, CONSTRUCTOR, 2).alias("result")), "result").select(
        "task_id", P.base_name(F.col("folder")).alias("of"), "function", *KEY[1:]).distinct()
    # a name declared twice with different results is unknown
    results = results.groupBy("task_id", "of", "function").agg(
        F.count("*").alias("n"), F.first("package").alias("package"), F.first("type").alias("type")
    ).filter("n = 1").drop("n")
    right = F.regexp_extract(text, ASSIGNED, 2)
    used = source.filter(
        (F.col("line_type") == "added") & text.contains("=") & (right != "")
    ).select("task_id", "folder", F.col("new_path").alias("file"),
             F.col("new_line").alias("line"), right.alias("right"))
    written = F.coalesce(*[
        F.nullif(F.regexp_extract("right", p, 1), F.lit("")) for p in (LITERAL, NEW)])
    shown = _resolved(used.withColumn("name", written).filter(F.col("name").isNotNull()), "name")
    called = used.filter(written.isNull()).withColumn(
        "name", F.nullif(F.regexp_extract("right", CALL, 1), F.lit(""))).filter(
        F.col("name").isNotNull())
    calls = _resolved(called, "name").select(
        "task_id", "file", "line", F.col("package").alias("of"), F.col("type").alias("function")
    ).join(results, ["task_id", "of", "function"])
    values = shown.select("task_id", "file", "line", *KEY[1:]).unionByName(
        calls.select("task_id", "file", "line", *KEY[1:]))
    closable = closable_types(direct, links, write).withColumn("closes", F.lit(True))
    # what the lines declare goes before the standard library
    named = F.concat_ws(".", "package", "type")
    standard = F.when(named.isin(STANDARD_CLOSERS), True).when(named.isin(STANDARD_OTHERS), False)
    known = (
        values.join(types.withColumn("declared", F.lit(True)), KEY, "left")
        .join(closable, KEY, "left")
        .withColumn("implements_closer", F.when(
            F.col("declared"), F.coalesce("closes", F.lit(False))).otherwise(standard))
        .filter(F.col("implements_closer").isNotNull())
    )
    return known.select(
        "task_id", "file", "line", F.lit(0).alias("idx"), F.lit(False).alias("is_error"),
        "implements_closer").distinct()


__all__ = ["closable_types", "closer_facts", "declared_types"]
