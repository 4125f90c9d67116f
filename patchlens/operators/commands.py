"""Safety decisions over a log of commands."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import matches_allowed, normal_path
from ..functions.text import any_of, lookup, mentions_any, quoted, trimmed


@dataclass
class SafetyConfig:
    """Lists and limits of the command filter. The defaults are fixed values."""

    allowed_commands: list[str] = field(default_factory=lambda: [
        "go test", "go vet", "go build", "go mod", "go fmt", "goimports", "gofmt",
        "staticcheck", "golangci-lint", "golint", "errcheck",
        "ls", "cat", "head", "tail", "grep", "find", "wc", "echo", "pwd", "env",
    ])
    denied_commands: list[str] = field(default_factory=lambda: [
        "rm -rf", "rm -r /", "rm -f /", "chmod 777", "chown", "mkfs",
        "curl ", "wget ", "nc ", "ncat", "socat",
        "apt install", "apt-get install", "yum install", "pip install", "npm install",
        "go install ", "sudo ", "su ", "vim ", "nano ", "emacs ",
    ])
    denied_paths: list[str] = field(default_factory=lambda: [
        "/etc/", "/root/", "/home/", "~/.ssh", "~/.aws", "~/.gnupg", "/var/", "/usr/", "/boot/",
        "/sys/", "/proc/",
    ])
    allowed_domains: list[str] = field(default_factory=lambda: [
        "proxy.golang.org", "sum.golang.org", "goproxy.cn", "goproxy.io", "github.com",
        "raw.githubusercontent.com",
    ])
    max_timeout: int = 300_000_000_000
    max_output: int = 5 * 1024 * 1024
    allowed_env_vars: list[str] = field(default_factory=lambda: [
        "PATH", "HOME", "USER", "SHELL", "GOPATH", "GOROOT", "GOPROXY", "GOFLAGS",
        "GONOSUMCHECK", "GONOSUMDB", "GOPRIVATE", "HTTP_PROXY", "HTTPS_PROXY", "NO_PROXY",
        "LANG", "LC_ALL", "TERM",
    ])
    default_policy: str = "allow"
    log_file: str = ""


def load_config(path: str) -> SafetyConfig:
    """Defaults overlaid with a JSON file; a missing file gives the defaults."""
    config = SafetyConfig()
    if Path(path).exists():
        for key, value in json.loads(Path(path).read_text(encoding="utf-8")).items():
            if hasattr(config, key):
                setattr(config, key, value)
    return config


def save_config(config: SafetyConfig, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(asdict(config), indent=2), encoding="utf-8")


# Characters around a command word, and shapes of shell injection.
_EDGE = r"""[ \t\n|&;(){}\[\]<>"'`$#]"""
INJECTIONS = [
    ("$(", "command substitution"), ("`", "backtick substitution"),
    ("> /", "redirection to absolute path"), ("| sh", "pipe to sh"), ("| bash", "pipe to bash"),
    ("eval ", "eval"), ("exec ", "exec"),
]
CHAINED = ["rm ", "curl ", "wget ", "sudo ", "chmod ", "chown "]
SCHEMES = ["http://", "https://", "ftp://"]


def denied_pattern(commands: list[str]) -> str:
    """Any denied command standing by itself; one that ends in a space needs no edge after it."""
    words = [quoted(c.lower()) + ("" if c.endswith(" ") else rf"(?:{_EDGE}|\z)") for c in commands]
    return rf"(?:\A|{_EDGE})(?:{'|'.join(words)})"


def _path_pattern(paths: list[str]) -> str:
    words = "|".join(quoted(p.lower()) for p in paths)
    return r"""(?:\A|[ \t"'=:/])""" + f"(?:{words})"


def denied_path(command: Column, paths: list[str]) -> Column:
    """First forbidden path of the list that occurs at a path boundary, else null."""
    low = F.lower(command)
    return F.coalesce(
        *[F.when(low.rlike(_path_pattern([p])), p) for p in paths], F.lit(None).cast("string")
    )


def has_injection(command: Column) -> Column:
    chained = mentions_any(command, ["||", "&&"]) & mentions_any(F.lower(command), CHAINED)
    return mentions_any(command, [mark for mark, _ in INJECTIONS]) | chained


def injection(command: Column) -> Column:
    """Description of the first injection shape, else null."""
    named = [F.when(command.contains(mark), name) for mark, name in INJECTIONS]
    return F.coalesce(*named, F.when(has_injection(command), "chained shell commands"))


def network_host(command: Column) -> Column:
    """Host of the first URL by scheme order, without its port, empty when there is none."""
    host = F.coalesce(
        *[
            F.when(
                F.lower(command).contains(s),
                F.regexp_extract(command, f"(?i){s}" + r"""([^ /"'\n\t]*)""", 1),
            )
            for s in SCHEMES
        ],
        F.lit(""),
    )
    return F.regexp_replace(host, r"^([^:]+):[^\n]*", "$1")


def host_allowed(host: Column, domains: list[str]) -> Column:
    low = F.lower(host)
    tails = [d[1:].lower() for d in domains if d.startswith("*.")]
    return low.isin([d.lower() for d in domains]) | any_of(low.endswith(t) for t in tails)


def command_allowed(command: Column, commands: list[str]) -> Column:
    words = "|".join(quoted(c.lower()) for c in commands)
    return F.lower(command).rlike(rf"\A(?:{words})(?:[ \t\n|&;]|\z)")


def requested_command(arguments: Column) -> Column:
    """The ``command`` of JSON arguments (also when empty), else the arguments themselves."""
    return F.coalesce(F.get_json_object(arguments, "$.command"), arguments, F.lit(""))


# Action and risk level of each check, in the order they are tried.
DECISIONS = {
    "EMPTY_CMD": ("deny", "safe"),
    "DENIED_CMD": ("deny", "high"),
    "DENIED_PATH": ("deny", "high"),
    "SHELL_INJECTION": ("ask", "medium"),
    "NET_ALLOWED": ("allow", "low"),
    "NET_DENIED": ("deny", "high"),
    "WHITELIST": ("allow", "safe"),
}


def decide_commands(commands: DataFrame, config: SafetyConfig | None = None) -> DataFrame:
    """Decisions for ``commands(task_id, arguments, ...)``, other columns kept.

    Adds ``command, action, reason, risk_level, rule_id``. Command, host and first matching
    check are projections of their own, so each is computed once per row; which path or
    shape it was is looked up only for the rows that need it in their reason.
    """
    cfg = config or SafetyConfig()
    c, host, rule = (F.col(n) for n in ("command", "__host", "rule_id"))
    pieces = commands.withColumn(
        "command", trimmed(requested_command(F.col("arguments")))
    ).withColumn("__host", network_host(c))
    checked = pieces.withColumn(
        "rule_id",
        F.when(c == "", "EMPTY_CMD")
        .when(F.lower(c).rlike(denied_pattern(cfg.denied_commands)), "DENIED_CMD")
        .when(F.lower(c).rlike(_path_pattern(cfg.denied_paths)), "DENIED_PATH")
        .when(has_injection(c), "SHELL_INJECTION")
        .when((host != "") & host_allowed(host, cfg.allowed_domains), "NET_ALLOWED")
        .when(host != "", "NET_DENIED")
        .when(command_allowed(c, cfg.allowed_commands), "WHITELIST")
        .otherwise("DEFAULT"),
    )
    action = lookup({k: v[0] for k, v in DECISIONS.items()}, rule)
    level = lookup({k: v[1] for k, v in DECISIONS.items()}, rule)
    reason = (
        F.when(rule == "EMPTY_CMD", "command is empty")
        .when(rule == "DENIED_CMD", "command is denied")
        .when(
            rule == "DENIED_PATH",
            F.concat(F.lit("path not allowed: "), denied_path(c, cfg.denied_paths)),
        )
        .when(
            rule == "SHELL_INJECTION",
            F.concat(F.lit("possible shell injection: "), injection(c)),
        )
        .when(rule == "NET_ALLOWED", F.concat(F.lit("domain allowed: "), host))
        .when(rule == "NET_DENIED", F.concat(F.lit("domain not allowed: "), host))
        .when(rule == "WHITELIST", "command is allowed")
        .otherwise("no rule matched, default policy")
    )
    return checked.select(
        *commands.columns, "command",
        F.coalesce(action, F.lit(cfg.default_policy)).alias("action"),
        reason.alias("reason"),
        F.coalesce(level, F.lit("low")).alias("risk_level"),
        "rule_id",
    )


def limit_commands(
    decisions: DataFrame, timeout: Column, output: Column, config: SafetyConfig | None = None
) -> DataFrame:
    """Allowed commands are denied when they ask for too much time or output."""
    cfg = config or SafetyConfig()
    allowed = F.col("action") == "allow"
    slow, large = allowed & (timeout > cfg.max_timeout), allowed & (output > cfg.max_output)

    def over(name, asked, limit):
        return F.format_string(f"{name} %d above limit {limit}", asked)

    return decisions.withColumns(
        {
            "reason": F.when(slow, over("timeout", timeout, cfg.max_timeout))
            .when(large, over("output", output, cfg.max_output))
            .otherwise(F.col("reason")),
            "rule_id": F.when(slow, "TIMEOUT_EXCEEDED").when(large, "OUTPUT_EXCEEDED")
            .otherwise(F.col("rule_id")),
            "risk_level": F.when(slow | large, "medium").otherwise(F.col("risk_level")),
            "action": F.when(slow | large, "deny").otherwise(F.col("action")),
        }
    )


def audit_entries(decisions: DataFrame, at: Column) -> DataFrame:
    return decisions.select(
        at.alias("timestamp"), "command", F.col("action").alias("decision"), "risk_level",
        "rule_id", "reason",
    )


def write_audit(decisions: DataFrame, at: Column, path: str) -> None:
    """Append the decisions to an audit log of JSON lines."""
    audit_entries(decisions, at).write.mode("append").json(path)


def allowed_env(env: Column, config: SafetyConfig | None = None) -> Column:
    """Entries of a map whose key is listed, in any case; an empty list keeps all."""
    names = [n.upper() for n in (config or SafetyConfig()).allowed_env_vars]
    return F.map_filter(env, lambda k, v: F.upper(k).isin(names)) if names else env


def under_allowed(paths: DataFrame, prefixes: list[str], column: str = "path") -> DataFrame:
    """Rows whose normalised path lies under a prefix, at a directory boundary.

    The prefixes are configuration, so they become one condition instead of a join.
    """
    if not prefixes:
        return paths
    p = normal_path(F.col(column))
    return paths.filter(any_of(matches_allowed(p, normal_path(F.lit(x))) for x in prefixes))
