"""Small text expressions shared by the rules.

Trimming uses ``trim(chars)``, which only looks at the ends of a string, instead
of a regular expression over the whole line.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space characters.
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x85            "
    "     　"
)
QUOTES = "\"'`"

# ASCII word boundaries. Java's \b is Unicode aware, which differs on accented text.
WORD_START = r"(?<!\w)"
WORD_END = r"(?!\w)"


def trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE_SPACE))


def unquoted(c: Column) -> Column:
    return F.trim(c, F.lit(QUOTES))


def is_blank(c: Column) -> Column:
    # trimming on the right walks the whole string, on the left only its white space
    return F.ltrim(c, F.lit(WHITE_SPACE)) == ""


def is_comment(c: Column) -> Column:
    """A line that starts with // or /* after leading white space."""
    t = F.ltrim(c, F.lit(WHITE_SPACE))
    return t.startswith("//") | t.startswith("/*")


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, list(conditions), F.lit(False))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, list(conditions), F.lit(True))


def contains_any(c: Column, words) -> Column:
    """One of the words; a sign that many words share is looked for first."""
    words = list(words)
    found = any_of(c.contains(w) for w in words)
    shared = sorted(ch for ch in set.intersection(*map(set, words)) if not ch.isalnum())
    return c.contains(shared[0]) & found if len(words) > 2 and shared else found


def without_first(c: Column) -> Column:
    """Without the first character. Bytes are copied where it is one; characters are counted else."""
    return F.when(
        F.ascii(c) < 128, F.substring(c.cast("binary"), 2, 1 << 30).cast("string")
    ).otherwise(F.substring(c, 2, 1 << 30))


def quoted(word: str) -> str:
    """A word as a regular expression that matches just it."""
    return re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", word)


def mentions_any(c: Column, words) -> Column:
    """``contains_any`` as one expression: for short or already filtered texts."""
    return c.rlike("|".join(map(quoted, words)))


def starts_any(c: Column, words) -> Column:
    return c.rlike(r"\A(?:" + "|".join(map(quoted, words)) + ")")


def ends_any(c: Column, words) -> Column:
    return c.rlike("(?:" + "|".join(map(quoted, words)) + r")\z")


def sql_literal(value) -> str:
    """A Python value as a Spark SQL literal. A dollar sign would start a variable."""
    if isinstance(value, str):
        for char, escaped in (("\\", "\\\\"), ("'", "\\'"), ("$", "\\u0024")):
            value = value.replace(char, escaped)
        return f"'{value}'"
    return f"{value!r}D" if isinstance(value, float) else repr(value)


def literal_array(values) -> Column:
    """A constant array; one expression text instead of one call per element."""
    return F.expr("array(" + ", ".join(map(sql_literal, values)) + ")")


def lookup(mapping: dict, key: Column) -> Column:
    """Value of a constant map, null when the key is absent."""
    return F.expr("map(" + ", ".join(sql_literal(x) for kv in mapping.items() for x in kv) + ")")[key]


def cut_bytes(c: Column, n: int, tail: str = "") -> Column:
    """At most ``n`` UTF-8 bytes; a character that would be cut in half is dropped."""
    whole = F.octet_length(c) <= n
    raw = F.substring(F.encode(c, "UTF-8"), 1, n)
    keep = F.coalesce(
        *[F.try_validate_utf8(F.substring(raw, 1, n - k).cast("string")) for k in range(4)]
    )
    return F.when(whole, c).otherwise(F.concat(keep, F.lit(tail)))


def one_line(c: Column, n: int = 200) -> Column:
    return cut_bytes(F.replace(c, F.lit("\n"), F.lit(" ⏎ ")), n, "…")


def record(**fields) -> Column:
    """A struct with the given field names."""
    parts = []
    for name, value in fields.items():
        parts += [F.lit(name), value if isinstance(value, Column) else F.lit(value)]
    return F.named_struct(*parts)


def index_substring(c: Column, mark: str, count: Column) -> Column:
    """``substring_index`` with a column as its count."""
    return F.call_function("substring_index", c, F.lit(mark), count)
