"""Periodic runs of words: maximal stretches that repeat themselves, found by suffix trees.

Every run holds a Lyndon word as its root, for one of the two orders of the symbols, and that
word is the longest Lyndon word that begins at its place (Bannai and others, "The runs
theorem"). So the candidates are two a place: from ``i`` to the next smaller suffix ``j``, in
either order. Each is extended to both sides by longest common extensions, which are depths of
lowest common ancestors: in the suffix tree of the words (forward) and of their reversal
(backward), both by Ukkonen's algorithm, in constant time from an Euler tour with block minima.

A run of length at least ``max(LEAST_LENGTH, LEAST_TIMES * period)`` is covered by windows of
``WINDOW`` words that occur twice: trees are built of the stretches that such windows cover, one
behind the other with a symbol of its own between. All other words can't be in a run.

Defined results: a null text has no words; a text without runs has nulls for its longest one and
digests of empty lists; a null doc_id is never rewritten; repeated rows and ids are worked on
each; no rows give no rows; other columns aren't read. A document is read by one task, whatever
its length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import slices

LEAST_LENGTH, LEAST_TIMES = 24, 3
#: A run repeats at least this many words in a row one period on: two thirds of the least length.
WINDOW = LEAST_LENGTH * (LEAST_TIMES - 1) // LEAST_TIMES
_BLOCK = 16
Run = tuple[int, int, int]  # start, length, period
Rewrite = Callable[[list[bytes], int | None], list[bytes]]


class SuffixTree:
    """Ukkonen's suffix tree of ``symbols`` and an end symbol of its own.

    ``child[v]`` maps the first symbol of an edge to the node below it, None for leaves; the
    edge to ``v`` is ``symbols[first[v]:until[v]]``.
    """

    END = -1

    def __init__(self, symbols: list[int]) -> None:
        s = self.symbols = [*symbols, self.END]
        open_end = len(s)
        first, until, link = [0], [0], [0]
        child: list[dict[int, int] | None] = [{}]

        def node(a: int, b: int, below: dict[int, int] | None) -> int:
            first.append(a)
            until.append(b)
            link.append(0)
            child.append(below)
            return len(first) - 1

        # the place of the longest suffix that isn't a leaf yet: below ``at``, ``depth``
        # symbols down the edge that begins with symbols[edge]
        at = edge = depth = waiting = 0
        for i, symbol in enumerate(s):
            waiting += 1
            unlinked = 0
            while waiting:
                if not depth:
                    edge = i
                own = child[at]
                below = own.get(s[edge])
                if below is None:
                    own[s[edge]] = node(i, open_end, None)
                    inner = at
                else:
                    size = until[below] - first[below]
                    if depth >= size and child[below] is not None:
                        at, edge, depth = below, edge + size, depth - size
                        continue
                    middle = first[below] + depth
                    if s[middle] == symbol:
                        depth += 1
                        if unlinked:
                            link[unlinked] = at
                        break
                    inner = node(first[below], middle, {s[middle]: below})
                    own[s[edge]] = inner
                    child[inner][symbol] = node(i, open_end, None)
                    first[below] = middle
                if unlinked:
                    link[unlinked] = inner
                unlinked = inner if inner != at else 0
                waiting -= 1
                if at:
                    at = link[at]
                elif depth:
                    depth -= 1
                    edge = i - waiting + 1
        self.first, self.until, self.child = first, until, child

    def tour(self, falling: bool = False) -> tuple[list[int], list[int]]:
        """Depths (in symbols) along the Euler tour, and of each suffix where its leaf is in it.

        Children come by their first symbol, the end before all others in either order.
        """
        key = (lambda c: (c >= 0, -c)) if falling else None
        first, until, child, n = self.first, self.until, self.child, len(self.symbols)
        depths, place = [0], [0] * n
        stack = [(0, iter([child[0][c] for c in sorted(child[0], key=key)]))]
        while stack:
            depth, rest = stack[-1]
            for v in rest:
                below = depth + until[v] - first[v]
                own = child[v]
                if own is None:
                    place[n - below] = len(depths)
                    depths += (below, depth)
                else:
                    depths.append(below)
                    stack.append((below, iter([own[c] for c in sorted(own, key=key)])))
                    break
            else:
                stack.pop()
                if stack:
                    depths.append(stack[-1][0])
        return depths, place


class Extensions:
    """Longest common extensions of suffixes, many at a time and each in constant time."""

    def __init__(self, depths: list[int], place: list[int]) -> None:
        self.place = np.array(place, dtype=np.int64)
        n = -(-len(depths) // _BLOCK)
        table = np.full(n * _BLOCK, np.iinfo(np.int32).max, dtype=np.int32)
        table[: len(depths)] = depths
        blocks = table.reshape(n, _BLOCK)
        self.flat = table
        self.from_left = np.minimum.accumulate(blocks, axis=1).ravel()
        self.to_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.least = [blocks.min(axis=1)]
        size = 1
        while 2 * size <= n:
            last = self.least[-1]
            self.least.append(np.minimum(last[:-size], last[size:]))
            size *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For different suffixes i and j the depth of their leaves' lowest common ancestor."""
        a, b = self.place[i], self.place[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        left, right = a // _BLOCK, b // _BLOCK
        out = np.minimum(self.to_right[a], self.from_left[b])
        far = np.flatnonzero(right - left > 1)
        if len(far):
            lo, n = left[far] + 1, right[far] - left[far] - 1
            level = np.frexp(n.astype(np.float64))[1] - 1
            for k in np.unique(level):
                own = far[level == k]
                begin, count = lo[level == k], n[level == k]
                row = self.least[k]
                out[own] = np.minimum(
                    out[own], np.minimum(row[begin], row[begin + count - (1 << int(k))]))
        near = np.flatnonzero(left == right)
        if len(near):
            steps = a[near, None] + np.arange(_BLOCK)
            inside = steps <= b[near, None]
            values = self.flat[np.minimum(steps, len(self.flat) - 1)]
            out[near] = np.where(inside, values, np.iinfo(np.int32).max).min(axis=1)
        return out.astype(np.int64)


def next_smaller(rank: list[int]) -> np.ndarray:
    """Of each suffix the next one to its right of lower rank: where its Lyndon word ends."""
    found, stack = [len(rank)] * len(rank), []
    for i, own in enumerate(rank):
        while stack and rank[stack[-1]] > own:
            found[stack.pop()] = i
        stack.append(i)
    return np.array(found, dtype=np.int64)


def runs_of(symbols: list[int], least_length: int = 2, least_times: int = 2) -> list[Run]:
    """All runs of at least that length and that many periods (2 or more), by start and period."""
    n = len(symbols)
    if n < 2:
        return []
    tree = SuffixTree(symbols)
    depths, place = tree.tour()
    ahead = Extensions(depths, place)
    back = Extensions(*SuffixTree(symbols[::-1]).tour())
    found = []
    i = np.arange(n, dtype=np.int64)
    for order in (place, tree.tour(falling=True)[1]):
        # the place in the tour ranks suffixes; the last one is the end alone
        j = next_smaller(order)[:n]
        start = i - back(n - i, n - j)
        length = j + ahead(i, j) - start
        kept = (length >= least_times * (j - i)) & (length >= least_length)
        found.append(np.stack([start[kept], length[kept], (j - i)[kept]], axis=1))
    every = np.unique(np.concatenate(found), axis=0)
    every = every[np.lexsort((every[:, 2], every[:, 0]))]
    return [tuple(map(int, r)) for r in every]


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """From where to where words are covered by windows of ``WINDOW`` words that occur twice."""
    if len(ids) < LEAST_LENGTH:
        return []
    # hashes of windows of 1, 2, 4, ... words; equal windows have equal ones
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    size = 1
    factor = 0xD6E8FEB86659FD93
    while size < WINDOW:
        step = min(size, WINDOW - size)
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = factor * factor % (1 << 64)
        size += step
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(h), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    if not again.any():
        return []
    at = np.flatnonzero(again)
    cuts = np.flatnonzero(np.diff(at) > WINDOW)
    begins = at[np.concatenate([[0], cuts + 1])]
    ends = at[np.concatenate([cuts, [len(at) - 1]])] + WINDOW
    return [(int(a), int(b)) for a, b in zip(begins, ends, strict=True)]


def word_runs(words: list[bytes]) -> list[Run]:
    """Runs of ``LEAST_LENGTH`` words and ``LEAST_TIMES`` periods at least."""
    if len(words) < LEAST_LENGTH:
        return []
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    symbols, places = [], []
    for k, (a, b) in enumerate(stretches(ids)):
        if k:
            symbols.append(len(known) + k)
            places.append(-1)
        symbols += ids[a:b].tolist()
        places += range(a, b)
    found = runs_of(symbols, LEAST_LENGTH, LEAST_TIMES) if symbols else []
    return [(places[start], length, period) for start, length, period in found]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        kept[start + period: start + length] = False
    return [words[i] for i in np.flatnonzero(kept)]


def strongest(runs: list[Run]) -> Run | None:
    """The run of most periods; of equal ones the first, then that of the shortest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


_COLUMNS = ("doc_id long, n_runs long, start long, length long, period long, "
            "exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def periodic(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """The number of runs of each whole text, the strongest one and digests of all.

    ``rewrite`` gets the words and the doc_id and gives the words to look at. No shuffle.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")),
                                 strict=True):
                words = (text or "").encode("utf-8", "replace").split()
                if rewrite is not None:
                    words = rewrite(words, key)
                runs = word_runs(words)
                best = strongest(runs)
                listed = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
                rows.append((
                    key, len(runs), *(best or (None,) * 3),
                    best and 1000 * best[1] // best[2],
                    hashlib.sha256(listed.encode()).hexdigest(),
                    hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                names=names)

    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    types = [pa.int64()] * 6 + [pa.string()] * 2
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        found, _COLUMNS)


def without_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns, the text's words with each run cut to its first period, joined by a space.

    A text without runs stays as it is, white space included.
    """
    at = docs.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            out = []
            for own in batch.column(at).to_pylist():
                words = (own or "").encode("utf-8", "replace").split()
                runs = word_runs(words)
                out.append(b" ".join(collapsed(words, runs)).decode() if runs else own)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, pa.string()))

    return docs.mapInArrow(cut, docs.schema)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Words that repeat themselves from some place on, in a tenth of all documents."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]
