"""Paths, languages, roles and repository links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import cut_bytes, ends_any, lookup, mentions_any, record, starts_any, trimmed

# Language by lower-case extension; other extensions name themselves.
LANGUAGES = {
    ".go": "go",
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".tsx": "typescript",
    ".py": "python", ".rb": "ruby", ".php": "php", ".java": "java", ".kt": "kotlin",
    ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml",
    ".ini": "ini", ".cfg": "ini", ".conf": "ini", ".properties": "ini",
    ".sql": "sql", ".md": "markdown", ".markdown": "markdown",
    ".sh": "shell", ".bash": "shell", ".zsh": "shell",
    ".xml": "xml", ".html": "xml", ".css": "css",
}
# Path parts that make a file test or example code.
TEST_DIRECTORIES = ["/tests/", "/test/", "/testdata/", "/__tests__/", "/spec/"]
TEST_ENDINGS = [
    "_test.go", "_test.py", ".test.js", ".spec.js", ".test.ts", ".spec.ts", "test.java",
]
EXAMPLE_ENDINGS = [".md", ".rst", ".txt"]
EXAMPLE_STARTS = ["readme", "history", "changelog", "contributing"]
EXAMPLE_DIRECTORIES = ["/examples/", "/example/"]
GENERATED_ENDINGS = [
    ".pb.go", ".pb.gw.go", "_gen.go", ".gen.go", ".generated.go", "_string.go",
]
# Directories a repository scan leaves out, and its size limit.
SKIPPED_DIRECTORIES = [
    ".git", "vendor", "node_modules", "dist", "build", "target", "__pycache__", ".idea",
    ".vscode",
]
MAX_FILE_BYTES = 1 << 20


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Last dot of the last path part and what follows, empty without a dot."""
    return F.regexp_extract(path, r"(\.[^./]*)\z", 1)


def directory(path: Column) -> Column:
    """Directory part of a path, ``.`` for the root."""
    cut = F.regexp_replace(F.regexp_replace(path, "/+", "/"), r"/?[^/]*\z", "")
    return (
        F.when(cut != "", F.regexp_replace(cut, r"^(?:\./)+", ""))
        .when(path.startswith("/"), "/")
        .otherwise(".")
    )


def language(path: Column) -> Column:
    ext = F.lower(extension(path))
    dotenv = F.lower(base_name(path)).startswith(".env") | (ext == ".env")
    return (
        F.when(dotenv, "dotenv")
        .when(ext == "", "text")
        .otherwise(F.coalesce(lookup(LANGUAGES, ext), F.substring(ext, 2, 1 << 20)))
    )


def code_role(path: Column) -> Column:
    low = F.lower(path)
    wrapped = F.concat(F.lit("/"), low, F.lit("/"))
    base = base_name(low)
    return (
        F.when(mentions_any(wrapped, TEST_DIRECTORIES), "test")
        .when(
            ends_any(base, TEST_ENDINGS) | (base.startswith("test_") & base.endswith(".py")),
            "test",
        )
        .when(ends_any(low, EXAMPLE_ENDINGS) | starts_any(base, EXAMPLE_STARTS), "example")
        .when(mentions_any(wrapped, EXAMPLE_DIRECTORIES), "example")
        .otherwise("production")
    )


def is_go(path: Column) -> Column:
    return path.endswith(".go")


def is_go_test(path: Column) -> Column:
    return path.endswith("_test.go")


def is_program_or_test(path: Column) -> Column:
    return (
        is_go_test(path) | (path == "main.go") | path.endswith("/main.go") | path.contains("cmd/")
    )


def has_generated_name(path: Column) -> Column:
    return ends_any(path, GENERATED_ENDINGS)


def strip_side(path: Column) -> Column:
    """Drop the a/ or b/ in front of a patch path."""
    return F.regexp_replace(path, "^[ab]/", "")


def relative_to(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(
        path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)
    ).otherwise(path)


def normal_path(path: Column) -> Column:
    """Absolute path without empty, ``.`` and ``..`` parts."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


# Labels ---------------------------------------------------------------------

INPUT_TYPE_LABELS = {
    "diff_content": "pasted patch",
    "diff_file": "patch file",
    "file_contents": "pasted or uploaded files",
    "upload": "pasted or uploaded files",
    "pr_url": "pull request",
    "repo_path": "repository path",
}
SKIP_LABELS = {
    "skipdir": "skipped directory",
    "symlink": "symbolic link",
    "oversized": "too large",
    "unreadable": "unreadable",
    "binary": "binary",
}
SEVERITY_LABELS = {"high": "High", "medium": "Medium", "low": "Low", "info": "Info"}


def input_type_label(kind: Column) -> Column:
    return F.coalesce(lookup(INPUT_TYPE_LABELS, kind), kind)


def input_path_label(path: Column) -> Column:
    return F.when(path == "api-upload", "web submission").otherwise(path)


def skip_label(reason: Column) -> Column:
    return F.coalesce(lookup(SKIP_LABELS, reason), reason)


def severity_label(severity: Column) -> Column:
    return F.coalesce(lookup(SEVERITY_LABELS, severity), severity)


def directory_label(path: Column) -> Column:
    return F.when(path.isin("", "."), "(root)").otherwise(path)


def task_name(name: Column) -> Column:
    """Trimmed, on one line, at most 80 characters."""
    return F.substring(F.translate(trimmed(name), "\n\r", "  "), 1, 80)


# Links ----------------------------------------------------------------------

_PART = r"[A-Za-z0-9_.-]+"
# Accepted shapes of repository and change-request links.
REPOSITORY_LINK = (
    r"^(?:(?:https?://)?github\.com/)?([A-Za-z0-9-_.]+)/([A-Za-z0-9-_.]+?)(?:\.git)?\z"
)
CHANGE_SHORT = rf"^({_PART})/({_PART})#(\d+)\z"
CHANGE_PATH = rf"^({_PART})/({_PART})/pull/(\d+)\z"


def repository_ref(link: Column) -> Column:
    """STRUCT<owner, repo>, null for links of another shape or with ``..`` parts."""
    t = trimmed(link)
    owner, repo = F.regexp_extract(t, REPOSITORY_LINK, 1), F.regexp_extract(t, REPOSITORY_LINK, 2)
    ok = t.rlike(REPOSITORY_LINK) & ~owner.contains("..") & ~repo.contains("..")
    return F.when(ok, record(owner=owner, repo=repo))


def change_ref(link: Column) -> Column:
    """STRUCT<owner, repo, number> of ``owner/repo#n`` or a pull-request URL."""
    t = trimmed(link)
    url = F.when(t.contains("://"), t).otherwise(F.concat(F.lit("https://"), t))
    host = F.regexp_replace(
        F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#]*)", 1)),
        r"^www\.", "",
    )
    path = F.trim(
        F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("/")
    )

    def ref(s, pattern):
        part = [F.regexp_extract(s, pattern, i) for i in (1, 2, 3)]
        return record(owner=part[0], repo=part[1], number=part[2])

    return F.when(t.rlike(CHANGE_SHORT), ref(t, CHANGE_SHORT)).when(
        (host == "github.com") & path.rlike(CHANGE_PATH), ref(path, CHANGE_PATH)
    )


def is_local_remote(link: Column) -> Column:
    slashes = F.length(link) - F.length(F.replace(link, F.lit("/"), F.lit("")))
    return ~link.contains("github.com") & (
        link.contains("://")
        | starts_any(link, ["/", "./", "../"])
        | (link.endswith(".git") & (slashes > 1))
    )


def canonical_repository(link: Column) -> Column:
    """One spelling per repository link; local remotes pass through."""
    t = trimmed(link)
    bare = F.regexp_replace(t, r"\.git\z", "")
    bare = F.regexp_replace(F.regexp_replace(bare, "^https://", ""), "^http://", "")
    bare = F.regexp_replace(bare, r"^github\.com/", "")
    passes = bare.contains("://") | bare.startswith("/")
    return F.when(is_local_remote(t) | passes, F.when(is_local_remote(t), t).otherwise(bare)).otherwise(
        F.concat(F.lit("https://github.com/"), bare)
    )


def hide_link_token(link: Column) -> Column:
    return F.regexp_replace(link, r"(?s)\A(.*?x-access-token:)[^@]*@", "$1***@")


def last_error_line(text: Column) -> Column:
    """Last non-blank line of an error output, without tokens, cut at 120 bytes."""
    lines = F.filter(
        F.transform(F.split(hide_link_token(text), "\n"), trimmed), lambda x: x != ""
    )
    return F.coalesce(cut_bytes(F.try_element_at(lines, F.lit(-1)), 120, "…"), F.lit("no stderr"))


def matches_allowed(path: Column, prefix: Column) -> Column:
    return (path == prefix) | path.startswith(F.concat(F.rtrim(prefix, F.lit("/")), F.lit("/")))

