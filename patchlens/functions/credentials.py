"""Credential shapes, placeholders and configuration values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, ends_any, mentions_any, starts_any, trimmed, unquoted

# Prefixes of template references, format verbs and placeholder words.
TEMPLATE_PREFIXES = ["${{", "${", "{{", "<%", "%{"]
FORMAT_VERBS = ["%s", "%d", "%v", "%q"]
PLACEHOLDER_WORDS = [
    "your-", "your_", "replace", "changeme", "example", "placeholder", "todo", "fixme", "xxx",
    "dummy", "test", "mock", "fake", "sample", "default",
]
BEARER_PLACEHOLDERS = ["your", "xxx", "example", "changeme", "placeholder"]
DATABASE_SCHEMES = [
    "mysql://", "postgres://", "postgresql://", "mongodb://", "mongodb+srv://", "redis://",
]
# Titles and confidences of the shapes, in the order they are tried.
SHAPES = {
    "aws": ("AWS access key", 0.95),
    "github": ("GitHub token", 0.95),
    "github_oauth": ("GitHub OAuth token", 0.95),
    "stripe": ("Stripe key", 0.95),
    "slack": ("Slack token", 0.90),
    "private_key": ("private key", 0.99),
    "jwt": ("JWT", 0.85),
    "database": ("database connection string with password", 0.95),
    "gitlab": ("GitLab access token", 0.95),
    "google": ("Google API key", 0.95),
    "npm": ("npm token", 0.95),
    "sendgrid": ("SendGrid API key", 0.95),
    "bearer": ("bearer credential", 0.90),
    "url": ("URL with credentials", 0.90),
}
# Substrings of which a line must hold one before any literal is looked at.
SHAPE_HINTS = [
    "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "_live_", "xox", "PRIVATE KEY", "eyJ",
    "://", "glpat-", "AIza", "npm_", "SG.", "Bearer",
]


def likely_not_secret(value: Column) -> Column:
    """Template, format string, short text or placeholder."""
    v = unquoted(value)
    return (
        starts_any(v, TEMPLATE_PREFIXES)
        | mentions_any(v, FORMAT_VERBS)
        | (F.octet_length(v) < 8)
        | (trimmed(v) == "")
        | mentions_any(F.lower(v), PLACEHOLDER_WORDS)
    )


def url_has_credentials(s: Column) -> Column:
    """user:password@ inside the authority part of the first URL."""
    authority = F.regexp_extract(s, r"://([^/?#]*)", 1)
    return authority.rlike(r"^[^:]+:[^\n]+@[^@]*\z")


def bearer_token(s: Column) -> Column:
    """The credential after the first ``Bearer``, empty when short or a placeholder."""
    rest = F.when(s.contains("Bearer"), F.substring(s, F.instr(s, "Bearer") + 6, F.length(s)))
    rest = F.trim(trimmed(rest), F.lit("\"'"))
    token = F.coalesce(F.regexp_extract(rest, r"^[A-Za-z0-9._/+\-]{25,}", 0), F.lit(""))
    return F.when(mentions_any(F.lower(token), BEARER_PLACEHOLDERS), "").otherwise(token)


def credential_shape(s: Column) -> Column:
    """Name of the first matching shape (see SHAPES), null when none matches."""
    n = F.octet_length(s)
    lower = F.lower(s)
    return (
        F.when((n >= 20) & s.rlike(r"^AKIA[A-Z0-9]*\z"), "aws")
        .when(s.startswith("ghp_") & (n >= 40), "github")
        .when(s.startswith("gho_") & (n >= 40), "github_oauth")
        .when(starts_any(s, ["sk_live_", "pk_live_"]) & (n >= 20), "stripe")
        .when(s.startswith("xox") & (n >= 15), "slack")
        .when(s.contains("BEGIN") & s.contains("PRIVATE KEY"), "private_key")
        .when(s.rlike(r"^eyJ[^.]*\.[^.]*\.[^.]*\z") & (n >= 20), "jwt")
        .when(starts_any(lower, DATABASE_SCHEMES) & url_has_credentials(s), "database")
        .when(starts_any(s, ["ghu_", "ghs_", "ghr_"]) & (n >= 35), "github")
        .when(s.startswith("glpat-") & (n >= 25), "gitlab")
        .when(s.startswith("AIza") & (n >= 35), "google")
        .when(s.startswith("npm_") & (n >= 35), "npm")
        .when(s.rlike(r"^SG\.[^.]*\.") & (n >= 40), "sendgrid")
        .when(bearer_token(s) != "", "bearer")
        .when(starts_any(lower, ["http://", "https://"]) & url_has_credentials(s), "url")
    )


# Configuration values -------------------------------------------------------

# key/value shape, URL shape, placeholders and key endings.
CONFIG_PAIR = (
    r"(?i)^\s*([A-Za-z0-9_.-]*(?:password|passwd|secret|token|api[_-]?key|access[_-]?key"
    r"|credential)[A-Za-z0-9_.-]*)\s*[:=]\s*(\S[^\n]*)$"
)
URL_CREDENTIAL = r"[A-Za-z][A-Za-z0-9+.~-]*://[^/\s:@]+:[^/\s@]+@"
CONFIG_LANGUAGES = ["dotenv", "env", "yaml", "ini", "toml", "json"]
CONFIG_PLACEHOLDERS = [
    "your", "changeme", "change_me", "example", "placeholder", "xxx", "****", "todo",
]
DESCRIPTIVE_ENDINGS = [
    "_name", "-name", "_id", "-id", "_ttl", "_count", "_path", "_type", "_url", "-url",
    "_enabled",
]
DOTTED_NAME = r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)+\z"


def config_value_is_real(key: Column, value: Column) -> Column:
    quoted = any_of(value.startswith(q) & value.endswith(q) for q in ('"', "'"))
    return ~(
        (F.octet_length(value) < 6)
        | starts_any(value, ["${", "<", "%%", "{{"])
        | mentions_any(F.lower(value), CONFIG_PLACEHOLDERS)
        | quoted
        | mentions_any(value, ["(", " | ", " = "])
        | value.rlike(DOTTED_NAME)
        | ends_any(F.lower(key), DESCRIPTIVE_ENDINGS)
    )
