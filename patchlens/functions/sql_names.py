"""Expressions of the library under a name, for use in ``spark.sql``.

They are SQL functions: Spark inlines their bodies, so no row leaves the JVM. The bodies are put
together from the same lists as the columns.

| Function | Result |
|---|---|
| ``mask_sensitive(text)`` | the text with secrets masked |
| ``detect_language(path)`` | language of a file |
| ``code_role(path)`` | production, test or example |
| ``detect_leak(text)`` | name of the credential shape of a literal, or null |
| ``classify_command(command)`` | action, risk level and rule of a command |
| ``leaks_in(text)`` | table: line and shape of each word of a text that looks like a credential |
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.commands import (
    CHAINED,
    DECISIONS,
    INJECTIONS,
    SCHEMES,
    SafetyConfig,
    _path_pattern,
    denied_pattern,
)
from . import credentials as C
from . import paths as P
from .masking import MASKS
from .text import QUOTES, WHITE_SPACE, quoted, sql_literal


def _mask_body() -> str:
    body = "s"
    for pattern, replacement in MASKS:
        body = f"regexp_replace({body}, {sql_literal(pattern)}, {sql_literal(replacement)})"
    return body


def _language_body() -> str:
    pairs = ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in P.LANGUAGES.items())
    ext = r"lower(regexp_extract(path, '(\\.[^./]*)\\z', 1))"
    return (
        f"CASE WHEN startswith(lower(substring_index(path, '/', -1)), '.env') OR {ext} = '.env' "
        f"THEN 'dotenv' WHEN {ext} = '' THEN 'text' "
        f"ELSE coalesce(map({pairs})[{ext}], substring({ext}, 2)) END"
    )


def _matches(c: str, pattern: str) -> str:
    return f"rlike({c}, {sql_literal(pattern)})"


def _mentions(c: str, words) -> str:
    return _matches(c, "|".join(map(quoted, words)))


def _starts(c: str, words) -> str:
    return _matches(c, r"\A(?:" + "|".join(map(quoted, words)) + ")")


def _ends(c: str, words) -> str:
    return _matches(c, "(?:" + "|".join(map(quoted, words)) + r")\z")


def _trim(c: str, chars: str = WHITE_SPACE) -> str:
    return f"trim(BOTH {sql_literal(chars)} FROM {c})"


def _role_body() -> str:
    low, base = "lower(path)", "substring_index(lower(path), '/', -1)"
    wrapped = f"concat('/', {low}, '/')"
    return (
        f"CASE WHEN {_mentions(wrapped, P.TEST_DIRECTORIES)} OR {_ends(base, P.TEST_ENDINGS)} "
        f"OR (startswith({base}, 'test_') AND endswith({base}, '.py')) THEN 'test' "
        f"WHEN {_ends(low, P.EXAMPLE_ENDINGS)} OR {_starts(base, P.EXAMPLE_STARTS)} "
        f"OR {_mentions(wrapped, P.EXAMPLE_DIRECTORIES)} THEN 'example' ELSE 'production' END"
    )


def _leak_body(s: str = "s") -> str:
    n, low = f"octet_length({s})", f"lower({s})"
    authority = f"regexp_extract({s}, '://([^/?#]*)', 1)"
    credentials = _matches(authority, r"^[^:]+:[^\n]+@[^@]*\z")
    rest = f"substring({s}, instr({s}, 'Bearer') + 6)"
    quotes = sql_literal("\"'")
    token = (f"regexp_extract(trim(BOTH {quotes} FROM {_trim(rest)}), "
             f"{sql_literal('^[A-Za-z0-9._/+-]{25,}')}, 0)")
    cases = [
        ("aws", f"{n} >= 20 AND {_matches(s, r'^AKIA[A-Z0-9]*\z')}"),
        ("github", f"startswith({s}, 'ghp_') AND {n} >= 40"),
        ("github_oauth", f"startswith({s}, 'gho_') AND {n} >= 40"),
        ("stripe", f"{_starts(s, ['sk_live_', 'pk_live_'])} AND {n} >= 20"),
        ("slack", f"startswith({s}, 'xox') AND {n} >= 15"),
        ("private_key", f"contains({s}, 'BEGIN') AND contains({s}, 'PRIVATE KEY')"),
        ("jwt", f"{_matches(s, r'^eyJ[^.]*\.[^.]*\.[^.]*\z')} AND {n} >= 20"),
        ("database", f"{_starts(low, C.DATABASE_SCHEMES)} AND {credentials}"),
        ("github", f"{_starts(s, ['ghu_', 'ghs_', 'ghr_'])} AND {n} >= 35"),
        ("gitlab", f"startswith({s}, 'glpat-') AND {n} >= 25"),
        ("google", f"startswith({s}, 'AIza') AND {n} >= 35"),
        ("npm", f"startswith({s}, 'npm_') AND {n} >= 35"),
        ("sendgrid", f"{_matches(s, r'^SG\.[^.]*\.')} AND {n} >= 40"),
        ("bearer", f"contains({s}, 'Bearer') AND {token} <> '' "
                   f"AND NOT {_mentions(f'lower({token})', C.BEARER_PLACEHOLDERS)}"),
        ("url", f"{_starts(low, ['http://', 'https://'])} AND {credentials}"),
    ]
    return "CASE " + " ".join(f"WHEN {when} THEN '{name}'" for name, when in cases) + " END"


def _command_body(cfg: SafetyConfig) -> str:
    c = _trim("coalesce(command, '')")
    low = f"lower({c})"
    host = "coalesce(" + ", ".join(
        f"CASE WHEN contains({low}, '{s}') THEN regexp_extract({c}, "
        + sql_literal(f"(?i){s}" + "([^ /\"'\n\t]*)") + ", 1) END"
        for s in SCHEMES) + ", '')"
    host = f"regexp_replace({host}, {sql_literal('^([^:]+):[^' + chr(10) + ']*')}, {sql_literal('$1')})"
    listed = ", ".join(sql_literal(d.lower()) for d in cfg.allowed_domains)
    tails = "".join(f" OR endswith(lower({host}), {sql_literal(d[1:].lower())})"
                    for d in cfg.allowed_domains if d.startswith("*."))
    allowed = "|".join(quoted(x.lower()) for x in cfg.allowed_commands)
    injected = (f"{_mentions(c, [m for m, _ in INJECTIONS])} OR ({_mentions(c, ['||', '&&'])} "
                f"AND {_mentions(low, CHAINED)})")
    rules = [
        ("EMPTY_CMD", f"{c} = ''"),
        ("DENIED_CMD", _matches(low, denied_pattern(cfg.denied_commands))),
        ("DENIED_PATH", _matches(low, _path_pattern(cfg.denied_paths))),
        ("SHELL_INJECTION", injected),
        ("NET_ALLOWED", f"{host} <> '' AND (lower({host}) IN ({listed}){tails})"),
        ("NET_DENIED", f"{host} <> ''"),
        ("WHITELIST", _matches(low, rf"\A(?:{allowed})(?:[ \t\n|&;]|\z)")),
    ]

    def verdict(name: str, action: str, level: str) -> str:
        return f"named_struct('action', '{action}', 'risk_level', '{level}', 'rule_id', '{name}')"

    cases = " ".join(f"WHEN {when} THEN {verdict(name, *DECISIONS[name])}" for name, when in rules)
    return f"CASE {cases} ELSE {verdict('DEFAULT', cfg.default_policy, 'low')} END"


def register_functions(spark: SparkSession, config: SafetyConfig | None = None) -> None:
    """All functions of this module in this session; commands are judged by ``config``."""
    verdict = "STRUCT<action: STRING, risk_level: STRING, rule_id: STRING>"
    for name, parameter, returns, body in (
        ("mask_sensitive", "s", "STRING", _mask_body()),
        ("detect_language", "path", "STRING", _language_body()),
        ("code_role", "path", "STRING", _role_body()),
        ("detect_leak", "s", "STRING", _leak_body()),
        ("classify_command", "command", verdict, _command_body(config or SafetyConfig())),
    ):
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameter} STRING) "
            f"RETURNS {returns} RETURN {body}"
        )
    word = f"trim(BOTH {sql_literal(QUOTES)} FROM w.col)"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION leaks_in(body STRING) "
        "RETURNS TABLE(line INT, shape STRING) RETURN "
        f"SELECT l.pos + 1, {_leak_body(word)} "
        "FROM posexplode(split(body, '\\n')) AS l(pos, content), "
        "LATERAL explode(split(l.content, '[ \\t,;()]+')) AS w(col) "
        f"WHERE {_leak_body(word)} IS NOT NULL"
    )


__all__ = ["register_functions"]
