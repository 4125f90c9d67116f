"""The line table: one row per line of a change set.

Both builders work row by row: a patch or a file is one input row, and everything
that depends on the order inside it (hunks, line numbers, loop nesting, generated
markers) is derived from that row's own arrays before it is exploded. Building the
line table therefore needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths as P
from ..functions.text import WHITE_SPACE, is_blank, is_comment, record, starts_any, trimmed, without_first

LINE_SCHEMA = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("file_seq", T.IntegerType()),
        T.StructField("old_path", T.StringType()),
        T.StructField("new_path", T.StringType()),
        T.StructField("hunk_seq", T.IntegerType()),
        T.StructField("old_start", T.IntegerType()),
        T.StructField("old_lines", T.IntegerType()),
        T.StructField("new_start", T.IntegerType()),
        T.StructField("new_lines", T.IntegerType()),
        T.StructField("hunk_context", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("line_type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("old_line", T.IntegerType()),
        T.StructField("new_line", T.IntegerType()),
        T.StructField("generated", T.BooleanType()),
        T.StructField("package_main", T.BooleanType()),
        T.StructField("loop_defer", T.BooleanType()),
    ]
)
LINE_COLUMNS = LINE_SCHEMA.fieldNames()
FILE_KEY = ["task_id", "file_seq", "new_path"]
GENERATED_WINDOW = 10

# Lines of a header, a hunk and an added one, in this order: each group takes the first and no other.
HAS_ADDED_LINE = (
    r"\A(?>(?:[\s\S]*?\n)??--- )(?>[\s\S]*?\n@@ )(?>[\s\S]*?\n\+(?!\+\+ ))"
)
HUNK_HEADER = r"^@@ .(\d+)(?:,(\d+))? .(\d+)(?:,(\d+))? @@"


# File-level flags over the array of a file's visible lines --------------------


def is_generated(path: Column, body: Column, text: Column | None = None) -> Column:
    """Generated by name, or marked so in the first ten non-blank lines.

    ``text``, if given, holds all lines: one search in it tells whether any is a mark.
    """

    def marker(line):
        return F.ltrim(line, F.lit(WHITE_SPACE)).startswith("//") & line.rlike(
            "(?i)code generated"
        ) & line.rlike("(?i)do not edit")

    head = F.slice(F.filter(body, lambda x: ~is_blank(x)), 1, GENERATED_WINDOW)
    hint = "[cC](?i:ode generated)"
    marked = F.exists(body, lambda x: x.rlike(hint)) if text is None else text.rlike(hint)
    return P.has_generated_name(path) | F.when(marked, F.exists(head, marker)).otherwise(False)


def declares_main(body: Column) -> Column:
    """The first visible package line of the file is ``package main``."""
    lines = F.filter(
        body, lambda x: F.ltrim(x, F.lit(WHITE_SPACE)).startswith("package ")
    )
    return F.coalesce(trimmed(F.get(lines, F.lit(0))) == "package main", F.lit(False))


def defer_lines_in_loops(raw: Column, patch: bool, whole: Column | None = None) -> Column:
    """New-side numbers of the lines with a ``defer`` inside a ``for`` body.

    One fold over the file's lines keeps brace depth (never below zero), the depth of
    the outermost open loop and that of a goroutine literal. For patches, hunk headers
    reset the line counter and only added lines are looked at. ``whole`` is their text, if at hand.
    """

    def features(line):
        text = without_first(line) if patch else line
        first = F.substring(line, 1, 1) if patch else F.lit("+")
        t = trimmed(text)
        code = ~is_comment(text)
        opens = F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))
        closes = F.length(text) - F.length(F.replace(text, F.lit("}"), F.lit("")))
        start = F.regexp_extract(line, HUNK_HEADER, 3) if patch else F.lit("")
        header = line.startswith("@@ ") if patch else F.lit(False)
        name = starts_any(line, ["+++ ", "--- "]) if patch else F.lit(False)
        return record(
            side=F.when(header, "h").when(name, "-").otherwise(first),
            start=F.when(start != "", start.cast("int")).otherwise(0),
            used=t != "",
            is_for=code & t.startswith("for") & (opens > 0),
            is_go=code & (t.startswith("go ") | (t == "go")) & (opens > 0),
            is_defer=code & t.contains("defer"),
            opens=opens,
            closes=closes,
        )

    def step(s, x):
        depth = s["depth"]
        loop = F.when(x["is_for"] & (s["loop"] < 0), depth).otherwise(s["loop"])
        go = F.when(x["is_go"] & (s["go"] < 0), depth).otherwise(s["go"])
        inside = x["is_defer"] & (loop >= 0) & (depth > loop)
        exempt = inside & (go >= 0) & (depth > go)
        after = depth + x["opens"] - x["closes"]
        worked = record(
            no=s["no"] + 1,
            depth=F.greatest(after, F.lit(0)),
            loop=F.when(~exempt & (x["closes"] > 0) & (after <= loop), -1).otherwise(loop),
            go=F.when(exempt & (x["closes"] > 0) & (after <= go), -1).otherwise(go),
            hits=F.when(inside & ~exempt, F.concat(s["hits"], F.array(s["no"])))
            .otherwise(s["hits"]),
        )
        moved = record(
            no=F.when(x["side"] == "h", x["start"]).when(x["side"] == "-", s["no"])
            .otherwise(s["no"] + 1),
            depth=depth, loop=s["loop"], go=s["go"], hits=s["hits"],
        )
        return F.when((x["side"] == "+") & x["used"], worked).otherwise(moved)

    start = record(no=1, depth=0, loop=-1, go=-1, hits=F.array().cast("array<int>"))
    if whole is None:
        worth = F.exists(raw, lambda x: x.contains("defer")) & F.exists(
            raw, lambda x: x.contains("for"))
    else:
        worth = whole.contains("defer") & whole.contains("for")
    folded = F.aggregate(F.transform(raw, features), start, step, lambda s: s["hits"])
    return F.when(worth, folded)


# Whole files -------------------------------------------------------------------


def split_lines(content: Column) -> Column:
    """Lines of a text; the empty piece after a final line feed is no line."""
    whole = F.when(
        content.endswith("\n"), F.substring(content, F.lit(1), F.length(content) - 1)
    ).otherwise(content)
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(whole, "\n"))


def lines_of_arrays(files: DataFrame) -> DataFrame:
    """``files(task_id, path, lines ARRAY<STRING>)`` to the line table, all lines added."""
    path, body = F.col("path"), F.col("lines")
    # Flags get a projection of their own: next to a generator they would be computed per line.
    flagged = files.select(
        "task_id",
        path.alias("new_path"),
        F.size(body).alias("new_lines"),
        is_generated(path, body).alias("generated"),
        F.when(P.is_go(path), declares_main(body)).otherwise(False).alias("package_main"),
        F.when(P.is_go(path), defer_lines_in_loops(body, False)).alias("defer_lines"),
        body.alias("body"),
    )
    flagged = flagged.select(
        *[c for c in flagged.columns if c != "body"],
        F.posexplode_outer("body").alias("at", "content"),
    ).filter(F.col("at").isNotNull())
    line = F.col("at") + 1
    return flagged.select(
        "task_id",
        F.lit(0).alias("file_seq"),
        F.lit("/dev/null").alias("old_path"),
        "new_path",
        F.lit(0).alias("hunk_seq"),
        F.lit(0).alias("old_start"),
        F.lit(0).alias("old_lines"),
        F.lit(1).alias("new_start"),
        "new_lines",
        F.lit("").alias("hunk_context"),
        line.alias("pos"),
        F.lit("added").alias("line_type"),
        "content",
        F.lit(0).alias("old_line"),
        line.alias("new_line"),
        "generated",
        "package_main",
        F.coalesce(F.array_contains("defer_lines", line), F.lit(False)).alias("loop_defer"),
    )


def lines_of_files(files: DataFrame) -> DataFrame:
    """``files(task_id, path, content)`` to the line table, all lines added."""
    return lines_of_arrays(
        files.select("task_id", "path", split_lines(F.col("content")).alias("lines"))
    )


# Patches -----------------------------------------------------------------------


def _normal_text(text: Column) -> Column:
    text = F.when(
        text.contains("\r\n"), F.replace(text, F.lit("\r\n"), F.lit("\n"))).otherwise(text)
    # the last sign is one byte
    return F.when(
        text.endswith("\n") | text.endswith("\r"),
        F.substring(text.cast("binary"), F.lit(1), F.octet_length(text) - 1).cast("string"),
    ).otherwise(text)


def _has_bad_hunk(text: Column) -> Column:
    """A line that begins like a hunk header and isn't one; a search, nothing is split."""
    return text.contains("@@ ") & text.rlike(
        r"@@ (?<![^\n]@@ )(?!" + HUNK_HEADER.removeprefix("^@@ ") + ")")


def patch_problem(text: Column) -> Column:
    """Why a patch cannot be reviewed, null when it can."""
    return (
        F.when(F.coalesce(is_blank(text), F.lit(True)), "empty")
        .when(_has_bad_hunk(text), "bad_hunk_header")
        .when(~text.rlike(HAS_ADDED_LINE), "no_added_lines")
    )


def split_patches(patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviewable patches and the rejected ones with their reason."""
    judged = patches.withColumn("reason", patch_problem(F.col("diff_text")))
    return (
        judged.filter(F.col("reason").isNull()).drop("reason"),
        judged.filter(F.col("reason").isNotNull()).select("task_id", "reason"),
    )


def lines_of_patches(patches: DataFrame, strict: bool = False) -> DataFrame:
    """``patches(task_id, diff_text)`` to the line table.

    The text is cut into files, hunks and lines by three generators. Line numbers need
    the count of earlier lines per side: counts of whole blocks of about sqrt(n) lines
    are summed in the hunk row, the rest comes from the block's string of line kinds.

    A patch with a malformed hunk header gives no rows; ``split_patches`` tells why.

    By default a file begins at a ``---`` / ``+++`` / ``@@`` triple, and remarks (``\\ No
    newline``) and the lines between files are left out. ``strict`` takes every ``--- ``
    as a file and keeps those lines as context.
    """
    file_start = r"\n(?=--- )" if strict else r"\n(?=--- [^\n]*\n\+\+\+ [^\n]*(?:\n@@ |\z))"
    files = (
        patches.filter(F.col("diff_text").contains("--- ") & ~_has_bad_hunk(F.col("diff_text")))
        .select("task_id", _normal_text(F.col("diff_text")).alias("text"))
        .select("task_id", F.posexplode_outer(
            F.when(F.col("text").contains("\n--- "), F.split("text", file_start))
            .otherwise(F.array("text"))))
        .toDF("task_id", "file_seq", "section")
        .filter(F.col("section").startswith("--- "))
    )
    section = F.col("section")
    # The first two lines, so that a pattern for them doesn't read the whole section.
    head = F.substring_index(section, "\n", 2)
    if strict:
        plus = F.regexp_extract_all(section, F.lit(r"(?:^|\n)\+\+\+ ([^\n]*)"), F.lit(1))
        new_path = F.coalesce(F.try_element_at(plus, F.lit(-1)), F.lit(""))
    else:
        new_path = F.regexp_extract(head, r"^--- [^\n]*\n\+\+\+ ([^\n]*)", 1)
    raw = F.split(section, "\n")
    body = F.transform(
        F.filter(
            raw,
            lambda x: ~(x.startswith("--- ") | x.startswith("+++ ") | x.startswith("@@ ")),
        ),
        without_first,
    )
    go = P.is_go(P.strip_side(new_path))
    files = files.select(
        "task_id",
        "file_seq",
        P.strip_side(F.regexp_extract(head, r"^--- ([^\n]*)", 1)).alias("old_path"),
        P.strip_side(new_path).alias("new_path"),
        is_generated(P.strip_side(new_path), body, section).alias("generated"),
        F.when(go, declares_main(body)).otherwise(False).alias("package_main"),
        F.when(go, defer_lines_in_loops(raw, True, section)).alias("defer_lines"),
        F.split(section, r"\n(?=@@ )").alias("hunks"),
    )
    files = files.select(
        *[c for c in files.columns if c != "hunks"],
        F.posexplode_outer("hunks").alias("hunk_seq", "hunk"),
    )
    hunk = F.col("hunk")
    first = F.substring_index(hunk, "\n", 1)
    files = files.filter(hunk.startswith("@@ ") & first.rlike(HUNK_HEADER))

    def number(group, default):
        g = F.regexp_extract(first, HUNK_HEADER, group)
        return F.when(g == "", default).otherwise(g.cast("int"))

    rest = F.split(hunk, "\n")
    rest = F.slice(rest, F.lit(2), F.size(rest))
    rest = F.filter(rest, lambda x: ~x.startswith("+++ " if strict else "\\"))
    hunks = files.select(
        *[c for c in files.columns if c != "hunk"],
        number(1, 0).alias("old_start"),
        number(2, 1).alias("old_lines"),
        number(3, 0).alias("new_start"),
        number(4, 1).alias("new_lines"),
        trimmed(F.regexp_extract(first, r"^@@ [^\n]*? @@([^\n]*)", 1)).alias("hunk_context"),
        rest.alias("body"),
    )

    def kinds(block):
        marks = F.transform(
            block,
            lambda x: F.when(x.startswith("+"), "+").when(x.startswith("-"), "-").otherwise(" "),
        )
        return F.array_join(marks, "")

    hunks = hunks.withColumn(
        "width", F.greatest(F.ceil(F.sqrt(F.size("body"))).cast("int"), F.lit(64))
    ).filter(F.size("body") > 0)
    hunks = hunks.withColumn(
        "blocks",
        F.transform(
            F.sequence(F.lit(0), F.floor((F.size("body") - 1) / F.col("width")).cast("int")),
            lambda b: F.slice("body", b * F.col("width") + 1, F.col("width")),
        ),
    ).drop("body")
    hunks = hunks.withColumn("kinds", F.transform("blocks", kinds))
    hunks = hunks.withColumn(
        "counts",
        F.transform(
            "kinds",
            lambda k: record(
                old=F.length(F.replace(k, F.lit("+"), F.lit(""))),
                new=F.length(F.replace(k, F.lit("-"), F.lit(""))),
            ),
        ),
    )

    def before(side, b):
        return F.aggregate(F.slice("counts", F.lit(1), b), F.lit(0), lambda s, x: s + x[side])

    blocks = hunks.select(
        *[c for c in hunks.columns if c not in ("blocks", "kinds", "counts")],
        F.posexplode_outer(
            F.transform(
                "blocks",
                lambda block, b: record(
                    rows=block,
                    kinds=F.get("kinds", b),
                    old=before("old", b),
                    new=before("new", b),
                ),
            )
        ).alias("block", "b"),
    )
    rows = blocks.select(
        *[c for c in blocks.columns if c not in ("b", "block")],
        (F.col("block") * F.col("width")).alias("offset"),
        F.col("b.kinds").alias("kinds"),
        F.col("b.old").alias("old"),
        F.col("b.new").alias("new"),
        F.posexplode_outer("b.rows").alias("at", "row"),
    )
    head = F.substring(F.col("kinds"), F.lit(1), F.col("at"))
    kind = F.substring(F.col("kinds"), F.col("at") + 1, F.lit(1))
    rows = rows.withColumn("kind", kind).withColumn(
        "old_seen", F.col("old") + F.length(F.replace(head, F.lit("+"), F.lit("")))
    ).withColumn("new_seen", F.col("new") + F.length(F.replace(head, F.lit("-"), F.lit(""))))
    if not strict:
        over = (F.col("old_seen") >= F.col("old_lines")) & (F.col("new_seen") >= F.col("new_lines"))
        rows = rows.filter(~(over & ~F.col("row").rlike(r"^[ +\-]")))
    old_no, new_no = F.col("old_start") + F.col("old_seen"), F.col("new_start") + F.col("new_seen")
    new_line = F.when(F.col("kind") != "-", new_no).otherwise(0)
    return rows.select(
        "task_id",
        "file_seq",
        "old_path",
        "new_path",
        "hunk_seq",
        "old_start",
        "old_lines",
        "new_start",
        "new_lines",
        "hunk_context",
        (F.col("offset") + F.col("at") + 1).alias("pos"),
        F.when(F.col("kind") == "+", "added").when(F.col("kind") == "-", "deleted")
        .otherwise("context").alias("line_type"),
        without_first(F.col("row")).alias("content"),
        F.when(F.col("kind") != "+", old_no).otherwise(0).alias("old_line"),
        new_line.alias("new_line"),
        "generated",
        "package_main",
        ((F.col("kind") == "+") & F.coalesce(F.array_contains("defer_lines", new_line), F.lit(False)))
        .alias("loop_defer"),
    )


# Selections --------------------------------------------------------------------


def added(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("line_type") == "added")


def deleted(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("line_type") == "deleted")


def added_text(lines: DataFrame) -> DataFrame:
    """Added lines that are not blank."""
    return added(lines).filter(~is_blank(F.col("content")))


def go_files(lines: DataFrame) -> DataFrame:
    return lines.filter(P.is_go(F.col("new_path")))


def reviewable(lines: DataFrame) -> DataFrame:
    """Lines of files that are not generated."""
    return lines.filter(~F.col("generated"))


def package_names(lines: DataFrame) -> DataFrame:
    """Package of each file: hunk context first, then added lines, then context lines."""
    order = F.struct("hunk_seq", "pos")
    named = F.regexp_extract(trimmed(F.col("content")), r"^package\s+([A-Za-z_][A-Za-z0-9_]*)\z", 1)
    from_context = F.col("hunk_context").startswith("package ")

    def first(value, condition):
        return F.min_by(F.when(condition, value), F.when(condition, order))

    return (
        lines.filter(from_context | (named != ""))
        .groupBy(*FILE_KEY)
        .agg(
            F.coalesce(
                first(F.substring("hunk_context", 9, 1 << 30), from_context),
                first(named, (named != "") & (F.col("line_type") == "added")),
                first(named, (named != "") & (F.col("line_type") == "context")),
            ).alias("package")
        )
        .filter(F.col("package").isNotNull())
    )
