"""Lexical facts of one source line, as an array column.

One ``regexp_extract_all`` splits the line, one ``transform`` names the tokens.
The pattern has no recursion on long literals: every repeated group is possessive.
Facts are ``ARRAY<STRUCT<kind, value>>`` in line order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import record

# {p} is "+" (possessive) for Java and empty for engines without backtracking.
_TOKEN_PARTS = [
    r"//[^\n]*",
    r"/\*[^*]*{p}\*+{p}(?:[^/*][^*]*{p}\*+{p})*{p}/",
    r"/\*[^\n]*",
    r'"[^"\\]*{p}(?:\\[^\n][^"\\]*{p})*{p}(?:"|\\?\z)',
    r"`[^`]*{p}(?:`|\z)",
    r"'[^'\\]*{p}(?:\\[^\n][^'\\]*{p})*{p}(?:'|\\?\z)",
    r"[\p{L}_][\p{L}\p{Nd}_]*",
    r"0[xX][0-9A-Fa-f_]*(?:\.[0-9A-Fa-f_]*)?(?:[pP][+\-]?[0-9_]*)?i?",
    r"(?:0[bBoO])?[0-9][0-9_]*(?:\.[0-9_]*)?(?:[eE][+\-]?[0-9_]*)?i?",
    r"\.[0-9][0-9_]*(?:[eE][+\-]?[0-9_]*)?i?",
    r":=|<-|\+\+|--|&&|\|\||<<=|>>=|&\^=|[=!<>+\-*/%&|^]=|=",
]


def token_pattern(possessive: bool = True) -> str:
    return "|".join(part.replace("{p}", "+" if possessive else "") for part in _TOKEN_PARTS)


# Keywords that produce a fact of their own name.
FACT_KEYWORDS = ["defer", "go", "return", "if", "for", "select", "chan", "package", "import"]
# The other keywords of the language; they produce nothing.
SILENT_KEYWORDS = [
    "break", "case", "const", "continue", "default", "else", "fallthrough", "func", "goto",
    "interface", "map", "range", "struct", "switch", "type", "var",
]
# Built-in type names that are never the assigned variable.
TYPE_NAMES = [
    "string", "int", "int8", "int16", "int32", "int64", "uint", "float32", "float64", "bool",
    "byte", "rune", "error", "any", "complex64", "complex128",
]
# Words that make an identifier sensitive (matched anywhere, any case).
SENSITIVE_WORDS = [
    "password", "passwd", "pwd", "secret", "secretkey", "secret_key", "apikey", "api_key",
    "api-key", "token", "accesstoken", "access_token", "private_key", "privatekey",
    "credential", "dsn",
]
SENSITIVE_NAME_WORDS = SENSITIVE_WORDS + ["signing_key", "encryption_key", "master_key"]

_SIGNS = "\"'`.0123456789/:=!<>+-*%&|^"


def tokens(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(token_pattern()), F.lit(0))


def token_kind(t: Column) -> Column:
    """Kind of one token, null for operators, char literals and silent keywords."""
    # The first character tells the kind; what is neither sign nor digit is a word.
    first = F.substring(t, 1, 1)
    return (
        F.when(
            ~first.isin(list(_SIGNS)),
            F.when(t.isin(FACT_KEYWORDS), t).when(~t.isin(SILENT_KEYWORDS), "identifier"),
        )
        .when(first.isin('"', "`"), "string_literal")
        .when(t.isin("=", ":="), "assignment")
        .when(first.isin(list(".0123456789")), F.when(~t.endswith("i"), "int_literal"))
        .when(t.startswith("//") | t.startswith("/*"), "comment")
    )


def facts(line: Column) -> Column:
    named = F.transform(
        tokens(line), lambda t: record(kind=token_kind(t), value=t)
    )
    return F.filter(named, lambda f: f["kind"].isNotNull())


def values_of(f: Column, kind: str) -> Column:
    return F.transform(F.filter(f, lambda x: x["kind"] == kind), lambda x: x["value"])


def identifiers(f: Column) -> Column:
    return values_of(f, "identifier")


def string_literals(f: Column) -> Column:
    return values_of(f, "string_literal")


def has_kind(f: Column, kind: str) -> Column:
    return F.exists(f, lambda x: x["kind"] == kind)


def has_identifier(f: Column, *names: str) -> Column:
    return F.exists(f, lambda x: (x["kind"] == "identifier") & x["value"].isin(list(names)))


def first_identifier(f: Column) -> Column:
    """Value of the first identifier, null when there is none."""
    return F.get(identifiers(f), F.lit(0))


def _word_pattern(words) -> str:
    """Any of the words; without those that hold another one, and first letters before words."""
    least = [w for w in words if not any(v != w and v in w for v in words)]
    return f"(?i)(?=[{''.join(sorted({w[0] for w in least}))}])(?:{'|'.join(least)})"


def is_sensitive_name(name: Column) -> Column:
    return name.rlike(_word_pattern(SENSITIVE_NAME_WORDS))


def sensitive_identifier(f: Column) -> Column:
    """First identifier holding one of the sensitive words, null when none does."""
    pattern = _word_pattern(SENSITIVE_WORDS)
    return F.get(F.filter(identifiers(f), lambda v: v.rlike(pattern)), F.lit(0))


def assigned_value(f: Column) -> Column:
    """STRUCT<name, value> of the first string literal right after an assignment.

    The name is the last identifier before it that is no type name, else the first
    identifier; null when no such literal exists.
    """

    def before(p):
        return identifiers(F.slice(f, F.lit(1), p - 1))

    def is_value(p):
        return (
            (F.element_at(f, p)["kind"] == "string_literal")
            & (F.element_at(f, p - 1)["kind"] == "assignment")
            & (F.size(before(p)) > 0)
        )

    positions = F.when(F.size(f) >= 2, F.sequence(F.lit(2), F.size(f)))
    at = F.get(F.filter(positions, is_value), F.lit(0))
    hit = F.transform(
        F.array(at),
        lambda p: record(
            name=F.coalesce(
                F.try_element_at(F.filter(before(p), lambda v: ~v.isin(TYPE_NAMES)), F.lit(-1)),
                F.get(before(p), F.lit(0)),
            ),
            value=F.element_at(f, p)["value"],
        ),
    )
    return F.when(at.isNotNull(), F.element_at(hit, 1))


def quoted_pieces(line: Column) -> Column:
    """Text between pairs of double quotes, without regard to escapes."""
    return F.regexp_extract_all(line, F.lit('"([^"]*)"'), F.lit(1))
