"""Redaction of secrets in free text.

All patterns stay inside one line (white space inside them excludes the line
feed), so a whole multi-line text is masked without splitting it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import any_of, record

MARK = "***REDACTED***"

# Addresses whose password is hidden. These two patterns try every colon of a run
# again; the column expressions below give the same result in one pass.
DATABASE_SCHEME = r"(?i)(?:mysql|postgres(?:ql)?|mongodb(?:\+srv)?|redis)://"
DATABASE_ADDRESS = (
    r"(?i)((?:mysql|postgres(?:ql)?|mongodb(?:\+srv)?|redis)://[^\s]+:)[^\s]+@"
)
WEB_ADDRESS = r"(https?://[^/\s]+:)[^/\s]+@"

# Patterns and replacements, applied in this order.
MASKS = [
    (r"AKIA[0-9A-Z]{16}", "AKIA" + MARK),
    (r"gh[pousr]_[a-zA-Z0-9]{30,}", MARK),
    (r"glpat-[A-Za-z0-9_-]{20,}", "glpat-" + MARK),
    (r"AIza[0-9A-Za-z_-]{30,}", "AIza" + MARK),
    (r"npm_[A-Za-z0-9]{30,}", "npm_" + MARK),
    (r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", "SG." + MARK),
    (r"(?i)Bearer[ \t\r\f]+[A-Za-z0-9._-]{25,}", "Bearer " + MARK),
    (r"((?:sk|pk)_(?:live|test)_)[0-9a-zA-Z]{20,}", "$1" + MARK),
    (r"xox[bpors]-[0-9a-zA-Z\-]{10,}", MARK),
    (r"eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}", "eyJ" + MARK),
    (r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----", "***PRIVATE_KEY_REMOVED***"),
    (DATABASE_ADDRESS, "$1" + MARK + "@"),
    (WEB_ADDRESS, "$1" + MARK + "@"),
    (r"([0-9a-f]{8})[0-9a-f]{56,}", "$1" + MARK),
    (
        r"(?i)((?:password|passwd|pwd|secret|token|api_?key|private_?key|credential|dsn)"
        r"[ \t\r\f]*(?::=|=|:[ \t]?))[ \t\r\f]*[^\s]+",
        "$1" + MARK,
    ),
]

# Lower-case substrings without which none of the patterns (but the hex one) can match.
MASK_HINTS = [
    "akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "aiza", "npm_", "sg.", "bearer", "k_live_", "k_test_", "xox", "eyj",
    "private key", "://", "passw", "pwd", "secret", "token", "apikey", "api_key",
    "privatekey", "private_key", "credential", "dsn",
]


def _last(text: Column, sign: str) -> Column:
    """Place of the last such sign, counted from 1; 0 without one."""
    back = F.instr(F.reverse(text), F.lit(sign))
    return F.when(back > 0, F.length(text) - back + 1).otherwise(0)


def _between(text: Column, begin: Column) -> Column:
    """Hide what lies between the last ``:`` and the last ``@``, with a sign on either side.

    ``begin`` is the place of the first sign that may belong to the name before the colon.
    """
    at = _last(text, "@")
    colon = _last(F.substring(text, F.lit(1), F.greatest(at - 2, F.lit(0))), ":")
    hidden = F.concat(
        F.substring(text, F.lit(1), colon), F.lit(MARK), F.substring(text, at, F.length(text)))
    return F.when((at > 0) & (colon > begin), hidden).otherwise(text)


def _database_password(run: Column) -> Column:
    """``scheme://name:password@`` in a run without white space."""
    scheme = F.regexp_extract(run, DATABASE_SCHEME, 0)
    begin = F.instr(run, scheme) + F.length(scheme)
    return F.when(scheme != "", _between(run, begin)).otherwise(run)


def _web_password(run: Column) -> Column:
    """The same for ``http(s)://``, up to the next slash each."""
    parts = F.split(run, "/")

    def part(x: Column, i: Column) -> Column:
        scheme = F.coalesce(F.get(parts, i - 2), F.lit(""))
        follows = (F.get(parts, i - 1) == "") & (scheme.endswith("http:") | scheme.endswith("https:"))
        return F.when(follows & x.contains("@"), _between(x, F.lit(1))).otherwise(x)

    return F.array_join(F.transform(parts, part), "/")


def _in_addresses(c: Column, mask) -> Column:
    """Rewrite each run without white space that may hold an address; linear in the text."""
    runs = F.regexp_extract_all(c, F.lit(r"\s++|\S++"), F.lit(0))
    changed = F.transform(
        runs, lambda x: F.when(x.contains("://") & x.contains("@"), mask(x)).otherwise(x))
    return F.when(c.contains("://") & c.contains("@"), F.array_join(changed, "")).otherwise(c)


_ADDRESSES = {DATABASE_ADDRESS: _database_password, WEB_ADDRESS: _web_password}


def mask_sensitive(c: Column) -> Column:
    for pattern, replacement in MASKS:
        if pattern in _ADDRESSES:
            c = _in_addresses(c, _ADDRESSES[pattern])
        else:
            c = F.regexp_replace(c, pattern, replacement)
    return c


def mask_column(df: DataFrame, name: str, into: str) -> DataFrame:
    """Mask a text column, running the patterns only where a hint occurs.

    The lower-cased copy is its own projection so that it is computed once per row.
    """
    low = "__lower"
    hinted = any_of(F.col(low).contains(h) for h in MASK_HINTS) | F.col(low).rlike("[0-9a-f]{64}")
    return (
        df.withColumn(low, F.lower(F.col(name)))
        .withColumn(into, F.when(hinted, mask_sensitive(F.col(name))).otherwise(F.col(name)))
        .drop(low)
    )


def shorten_secret(content: Column, secret: Column) -> Column:
    """Keep four characters of the first occurrence of a secret longer than eight bytes."""
    at = F.instr(content, secret)
    kept = F.concat(
        F.substring(content, F.lit(1), at - 1),
        F.substring(secret, 1, 4),
        F.lit(MARK),
        F.substring(content, at + F.length(secret), F.length(content)),
    )
    return F.when((F.octet_length(secret) > 8) & (at > 0), kept).otherwise(content)


def key_hint(key: Column) -> Column:
    """Display form of a stored key: hidden up to eight bytes, else first and last four."""
    hidden = F.lit("••••")
    return (
        F.when(key == "", "")
        .when(F.octet_length(key) <= 8, hidden)
        .otherwise(F.concat(F.substring(key, 1, 4), hidden, F.substring(key, -4, 4)))
    )


def masked_output(text: Column, limit: Column, timed_out: Column | None = None) -> Column:
    """STRUCT<output, truncated>: note a time-out, mask, then cut to ``limit`` bytes."""
    if timed_out is not None:
        text = F.when(timed_out, F.concat(text, F.lit("\n[timed out]"))).otherwise(text)
    masked = mask_sensitive(text)
    over = (limit > 0) & (F.octet_length(masked) > limit)
    raw = F.encode(masked, "UTF-8")

    def piece(k):
        return F.try_validate_utf8(F.substring(raw, F.lit(1), limit - k).cast("string"))

    kept = F.coalesce(*[piece(k) for k in range(4)])
    return record(
        output=F.when(over, F.concat(kept, F.lit("\n[output truncated]"))).otherwise(masked),
        truncated=over,
    )
