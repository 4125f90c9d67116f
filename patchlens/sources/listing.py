"""A file tree as a table: what a snapshot scan keeps, and why it leaves the rest out.

A data source for trees that tasks can list themselves, since link status is known to no other
reader: local folders and shared mounts. The driver lists the upper levels until there are enough
folders for all tasks; a task walks its folders to the bottom. A folder with very many entries is
dealt to several tasks by a hash of the names. Links aren't followed.

Columns: ``path`` relative to the root, ``length``, ``reason`` (null for files to review) and,
with the option ``content``, the ``content`` of those. A skipped folder is one row. Filters on
``reason`` and on ``length`` reach the walk: no file is opened that they rule out.

With the option ``every`` nothing is left out by name, size or content: all regular files, also those
that links to files lead to, have no reason and their content as it is.

Defined results: names that aren't valid text are given with replacement characters; entries that
are neither files, folders nor links (pipes, sockets, devices), and files or folders that can't
be opened, are ``unreadable``; an empty or missing root gives no rows, a missing one an error.
"""

from __future__ import annotations

import os
import re
import stat
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
)

from ..functions import paths as P

SNIFF_BYTES = 8000
#: Folders per task that the driver looks for, and entries from which a folder is dealt out.
FOLDERS_PER_TASK, LARGE_FOLDER = 4, 20_000


@dataclass
class Part(InputPartition):
    """Folders to walk to the bottom, and shares (folder, share, of) of the entries of others."""

    folders: list[str]
    shares: list[tuple[str, int, int]]

    def __init__(self, folders: list[str], shares: list[tuple[str, int, int]]) -> None:
        super().__init__(None)
        self.folders, self.shares = folders, shares


class Tree(DataSource):
    """Options: ``path`` (the root), ``content``, ``every``, ``parts`` (tasks, 32 by default)."""

    @classmethod
    def name(cls) -> str:
        return "snapshot_tree"

    def schema(self) -> str:
        extra = ", content binary" if self._with_content() else ""
        return f"path string, length long, reason string{extra}"

    def _with_content(self) -> bool:
        return self._set("content")

    def _set(self, option: str) -> bool:
        return str(self.options.get(option, "false")).lower() == "true"

    def reader(self, schema) -> TreeReader:
        return TreeReader(os.path.abspath(self.options["path"]), self._with_content(),
                          int(self.options.get("parts", 32)), self._set("every"))


def _entries(folder: str) -> list[os.DirEntry] | None:
    """The entries of a folder by name, None if it can't be listed."""
    try:
        with os.scandir(folder) as found:
            return sorted(found, key=lambda e: e.name)
    except OSError:
        return None


def _share(name: str, of: int) -> int:
    return zlib.crc32(os.fsencode(name)) % of


class TreeReader(DataSourceReader):
    def __init__(self, root: str, with_content: bool, parts: int, every: bool = False) -> None:
        self.root, self.with_content, self.parts = root, with_content, max(parts, 1)
        self.every = every
        self.reasons: str | bool | None = None  # None: all; True: only kept files; else a reason
        self.longest: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what the walk can use; filters on lengths are also left to Spark."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if isinstance(f, IsNull) and column == ("reason",) and self.reasons is None:
                self.reasons = True
            elif isinstance(f, EqualTo) and column == ("reason",) and self.reasons is None:
                self.reasons = f.value
            elif isinstance(f, (LessThan, LessThanOrEqual)) and column == ("length",):
                limit = int(f.value) - isinstance(f, LessThan)
                self.longest = limit if self.longest is None else min(limit, self.longest)
                yield f
            elif not (isinstance(f, IsNotNull) and column in (("length",), ("path",))):
                yield f

    def partitions(self) -> list[Part]:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        wanted = FOLDERS_PER_TASK * self.parts
        open_folders, shares = [self.root], []
        while open_folders and len(open_folders) < wanted:
            below: list[str] = []
            for folder in open_folders:
                entries = _entries(folder) or []
                of = min(self.parts, 1 + len(entries) // LARGE_FOLDER)
                shares += [(folder, i, of) for i in range(of)]
                below += [e.path for e in entries if self._walked(e)]
            open_folders = below
        parts = [Part(open_folders[i::self.parts], shares[i::self.parts])
                 for i in range(self.parts)]
        return [p for p in parts if p.folders or p.shares] or [Part([], [])]

    def _walked(self, entry: os.DirEntry) -> bool:
        try:
            return entry.is_dir(follow_symlinks=False) and (
                self.every or entry.name not in P.SKIPPED_DIRECTORIES)
        except OSError:
            return False

    def read(self, partition: Part) -> Iterator[tuple]:
        for folder, share, of in partition.shares:
            yield from self._rows(folder, share, of)
        rest = list(partition.folders)
        while rest:
            folder = rest.pop()
            yield from self._rows(folder, 0, 1)
            rest += [e.path for e in _entries(folder) or [] if self._walked(e)]

    def _rows(self, folder: str, share: int, of: int) -> Iterator[tuple]:
        """One row an entry of this folder, but for folders to walk."""
        entries = _entries(folder)
        if entries is None:
            if not share:
                yield from self._row(folder, 0, "unreadable")
            return
        for e in entries:
            if of > 1 and _share(e.name, of) != share:
                continue
            if self.every:
                yield from self._whole(e)
                continue
            try:
                found = e.stat(follow_symlinks=False)
            except OSError:
                yield from self._row(e.path, 0, "unreadable")
                continue
            if stat.S_ISLNK(found.st_mode):
                yield from self._row(e.path, 0, "symlink")
            elif stat.S_ISDIR(found.st_mode):
                if e.name in P.SKIPPED_DIRECTORIES:
                    yield from self._row(e.path, 0, "skipdir")
            elif not stat.S_ISREG(found.st_mode):
                yield from self._row(e.path, 0, "unreadable")
            elif found.st_size > P.MAX_FILE_BYTES:
                yield from self._row(e.path, found.st_size, "oversized")
            elif self.longest is not None and found.st_size > self.longest:
                continue
            elif self.reasons in ("symlink", "skipdir", "oversized"):
                continue  # no need to open it
            else:
                yield from self._opened(e.path, found.st_size)

    def _whole(self, entry: os.DirEntry) -> Iterator[tuple]:
        """A file with all its content; one that can't be read is an error, not a missing row."""
        if entry.is_file():
            with open(entry.path, "rb") as f:
                content = f.read() if self.with_content else b""
            yield from self._row(entry.path, entry.stat().st_size, None, content)

    def _opened(self, path: str, length: int) -> Iterator[tuple]:
        try:
            with open(path, "rb") as f:
                head = f.read(SNIFF_BYTES)
                if b"\x00" in head:
                    yield from self._row(path, length, "binary")
                    return
                rest = f.read() if self.with_content else b""
        except OSError:
            yield from self._row(path, length, "unreadable")
            return
        yield from self._row(path, length, None, head + rest)

    def _row(self, path: str, length: int, reason: str | None, content: bytes = b"") -> Iterator[tuple]:
        if self.reasons is not None and (None if self.reasons is True else self.reasons) != reason:
            return
        own = os.fsencode(os.path.relpath(path, self.root)).decode("utf-8", "replace")
        row = (own, length, reason)
        yield (*row, content if reason is None else None) if self.with_content else row


def tree(spark: SparkSession, root: str, content: bool = False, every: bool = False) -> DataFrame:
    """The file tree below ``root``, a folder that every machine of the cluster sees.

    ``every`` gives all regular files, whatever their name, size and content.

    Turns on filter push-down to Python sources in this session; Spark has it off by default.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Tree)
    return (
        spark.read.format("snapshot_tree")
        .option("content", str(content).lower())
        .option("every", str(every).lower())
        .option("parts", spark.sparkContext.defaultParallelism)
        .load(root)
    )


def mounted(path: str) -> str | None:
    """The local path of an address that tasks can list themselves, else None."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]+):", path)
    if scheme is None:
        return path if path.startswith("/") else None
    return "/" + path[5:].lstrip("/") if scheme[1].lower() == "file" else None


def all_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, content)`` of all files below ``root`` but hidden ones, as Spark's readers see them.

    Tasks list the folders, so the number of files is no burden on the driver.
    """
    files = tree(spark, root, True, True)
    return files.filter(~F.col("path").rlike(r"(?:^|/)[._]")).select(
        "path", F.col("content").cast("string").alias("content"))


def tree_files(spark: SparkSession, root: str, task_id: str, max_files: int | None = None) -> DataFrame:
    """The files to review: ``files(task_id, path, content)``.

    With ``max_files`` a larger tree is refused as a whole; nothing is cut off.
    """
    if max_files is not None:
        found = tree(spark, root).filter(F.col("reason").isNull()).count()
        if found > max_files:
            raise ValueError(f"snapshot holds {found} files, more than the limit {max_files}")
    kept = tree(spark, root, True).filter(F.col("reason").isNull())
    return kept.select(
        F.lit(task_id).alias("task_id"), "path", F.col("content").cast("string").alias("content"))
