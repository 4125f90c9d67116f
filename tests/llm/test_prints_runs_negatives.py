"""Phrase fingerprints, periodic runs and hard negatives against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlens.llm import hard_negatives, periodic_runs, phrase_prints
from patchlens.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


# --- phrase fingerprints ---------------------------------------------------------------------

def phrase_set(data: bytes) -> set[bytes]:
    """Phrases by their definition: the longest known one plus a byte."""
    known, at = set(), 0
    for end in range(1, len(data) + 1):
        if data[at:end] not in known:
            known.add(data[at:end])
            at = end
    return known


@pytest.mark.parametrize("seed", range(5))
def test_phrases_are_those_of_the_definition(seed):
    rng = random.Random(seed)
    text = "".join(rng.choices("abé日 ", k=rng.randint(0, 800)))
    own = phrase_prints.Phrases().read(text.encode())
    assert len(own.marks) - 1 == len(set(own.marks[1:])) == len(phrase_set(text.encode()))
    cut = rng.randint(0, len(text))
    twice = phrase_prints.Phrases().read(text[:cut].encode()).copy().read(text[cut:].encode())
    assert twice.signature() == own.signature() == phrase_prints.signature(text)


def test_likeness_estimates_the_share_of_common_phrases():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    errors = []
    for share in (0.0, 0.2, 0.5, 0.8, 0.95, 1.0):
        for _ in range(5):
            a = " ".join(rng.choices(words, k=400))
            b = a[: int(len(a) * share)] + " ".join(rng.choices(words, k=400))[: int(
                len(a) * (1 - share))]
            x, y = phrase_set(a.encode()), phrase_set(b.encode())
            found = phrase_prints.likeness(phrase_prints.signature(a), phrase_prints.signature(b))
            errors.append(found - len(x & y) / len(x | y))
    assert max(map(abs, errors)) < 0.18
    assert abs(np.mean(errors)) < 0.03
    nothing, some = phrase_prints.signature(""), phrase_prints.signature("some")
    assert phrase_prints.likeness(nothing, nothing) == 1.0
    assert phrase_prints.likeness(nothing, some) == 0.0


def wanted_prints(rows: list[tuple]) -> list[tuple]:
    out = []
    for i, (key, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        own, changed, other = map(phrase_prints.signature, (text, edited, after))
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), own.hex(),
                    changed.hex(), phrase_prints.likeness(own, changed),
                    phrase_prints.likeness(own, other)))
    return out


def test_prints_of_the_table(spark):
    rows = duckdb.sql(
        f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet' ORDER BY doc_id DESC").fetchall()
    got = QUERIES["op12_phrase_fingerprints"](spark, SF_DIR).collect()
    assert sorted(map(tuple, got)) == sorted(wanted_prints(rows))
    assert sum(r["near_edited"] > r["near_next"] for r in got) > 0.9 * len(got)


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_last_document_is_followed_by_the_first(spark, n):
    rows = [(i * 7 % 41, f"text {i} " * (i % 5)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = phrase_prints.compared(docs).collect()
    assert sorted(map(tuple, got)) == sorted(wanted_prints(sorted(rows, reverse=True)))


def test_print_edges(spark, edge_docs, no_docs):
    got = phrase_prints.compared(edge_docs)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint",
                           "edited_fingerprint", "near_edited", "near_next"]
    rows = got.collect()
    assert len(rows) == edge_docs.count()
    assert Counter(r["doc_id"] for r in rows) == Counter(
        r["doc_id"] for r in edge_docs.select("doc_id").collect())
    assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))
    assert phrase_prints.compared(no_docs).count() == 0
    texts = {r["doc_id"]: r["text"] for r in edge_docs.filter("doc_id > 3").collect()}
    prints = phrase_prints.fingerprints(edge_docs, "doc_id").filter("doc_id > 3").collect()
    assert all(r["fingerprint"] == phrase_prints.signature(texts[r["doc_id"]]).hex()
               for r in prints)


def test_likeness_as_an_expression(spark):
    texts = ["", "a", "one two three " * 9, "one two four " * 9, "something else " * 20]
    pairs = [(phrase_prints.signature(a).hex(), phrase_prints.signature(b).hex(),
              phrase_prints.likeness(phrase_prints.signature(a), phrase_prints.signature(b)))
             for a in texts for b in texts]
    df = spark.createDataFrame(pairs, "a string, b string, want double")
    got = df.withColumn("got", phrase_prints.likeness_of(F.col("a"), F.col("b")))
    assert got.filter("got <> want").count() == 0


# --- periodic runs ---------------------------------------------------------------------------

def all_runs(s: list, least: int, times: int) -> list[tuple]:
    found, n = set(), len(s)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            size = j + p - i
            if j > i and size >= max(least, times * p) and not any(
                    all(s[k] == s[k + q] for k in range(i, i + size - q)) for q in range(1, p)):
                found.add((i, size, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_known_runs():
    assert periodic_runs.runs_of(list(map(ord, "mississippi"))) == [
        (1, 7, 3), (2, 2, 1), (5, 2, 1), (8, 2, 1)]
    assert periodic_runs.runs_of([5] * 9) == [(0, 9, 1)]
    assert periodic_runs.runs_of([]) == periodic_runs.runs_of([1]) == []


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        s = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 45))]
        if s and rng.random() < 0.4:
            s = (s[: rng.randint(1, 8)] * 20)[: rng.randint(1, 60)] + s
        assert periodic_runs.runs_of(s) == all_runs(s, 2, 2)


@pytest.mark.parametrize("seed", range(4))
def test_word_runs_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        words = [b"%d" % rng.randrange(rng.choice([1, 2, 5, 100])) for _ in range(
            rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            at, size = rng.randint(0, len(words)), rng.randint(1, 20)
            words[at:at] = (words[at: at + size] * 10)[: rng.randint(1, 90)]
        assert periodic_runs.word_runs(words) == all_runs(words, 24, 3)


def test_longest_common_extensions():
    rng = random.Random(2)
    s = [rng.randrange(2) for _ in range(400)]
    ahead = periodic_runs.Extensions(*periodic_runs.SuffixTree(s).tour())
    i, j = np.array([(a, b) for a in range(0, 401, 3) for b in range(401) if a != b]).T
    want = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        k = 0
        while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
            k += 1
        want.append(k)
    assert ahead(i, j).tolist() == want


def test_least_lengths_and_overlaps():
    unit = [b"a", b"b", b"c", b"d", b"e", b"f", b"g", b"h"]
    assert periodic_runs.word_runs(unit * 3) == [(0, 24, 8)]
    assert periodic_runs.word_runs((unit * 3)[:-1]) == []
    assert periodic_runs.word_runs([b"x"] * 23) == []
    runs = periodic_runs.word_runs([b"x"] * 30 + unit * 4)
    assert runs == [(0, 30, 1), (30, 32, 8)]
    assert periodic_runs.collapsed([b"x"] * 30 + unit * 4, runs) == [b"x", *unit]
    assert periodic_runs.strongest([(9, 30, 10), (3, 24, 8), (1, 48, 12)]) == (1, 48, 12)
    assert periodic_runs.strongest([(9, 30, 10), (3, 24, 8), (3, 27, 9)]) == (3, 24, 8)


def test_runs_of_the_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()
    got = {r["doc_id"]: r for r in QUERIES["op13_periodic_runs"](spark, SF_DIR).collect()}
    assert len(got) == len(rows)
    some = 0
    for key, text in rows:
        words = periodic_runs.planted((text or "").encode().split(), key)
        if len(words) > 1500:
            continue
        runs = all_runs(words, 24, 3) if periodic_runs.stretches(np.unique(
            np.array(words or [b""]), return_inverse=True)[1]) or len(words) < 200 else []
        r, best = got[key], periodic_runs.strongest(runs)
        some += bool(runs)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (
            len(runs), *(best or (None,) * 3))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256(
            "".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        drop = {k for a, n, p in runs for k in range(a + p, a + n)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in drop)
        assert r["collapsed_sha256"] == hashlib.sha256(kept).hexdigest()
    assert some > 3


def test_run_edges(spark, edge_docs, no_docs):
    rows = periodic_runs.periodic(edge_docs, periodic_runs.planted).collect()
    assert len(rows) == edge_docs.count()
    empty = hashlib.sha256(b"").hexdigest()
    by_text = {r["doc_id"]: r for r in rows}
    assert by_text[0]["runs_sha256"] == empty == by_text[1]["collapsed_sha256"]
    plain = {r["doc_id"]: r for r in periodic_runs.periodic(edge_docs).collect()}
    assert (plain[9]["n_runs"], plain[9]["length"], plain[9]["period"]) == (1, 3000, 1)
    assert periodic_runs.periodic(no_docs).count() == 0
    cut = periodic_runs.without_runs(edge_docs)
    assert cut.columns == edge_docs.columns
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[9] == "word" and texts[0] is None and texts[5] == "a  b"


def test_long_runs_take_linear_time():
    words = [b"w"] * 100_000
    assert periodic_runs.word_runs(words) == [(0, 100_000, 1)]


# --- hard negatives --------------------------------------------------------------------------

def wanted_negatives(rows: list[tuple], is_anchor, limits=hard_negatives.Limits()) -> list[tuple]:
    out = []
    for a_id, a_label, a in filter(lambda r: is_anchor(r[0]), rows):
        score = lambda q: sum(x * y for x, y in zip(a, q, strict=False))  # noqa: E731, B023
        every = sorted((-score(q), i, label) for i, label, q in rows)
        own = [(-s, i) for s, i, label in every if label == a_label and i != a_id]
        for s, i in own[: limits.positives]:
            near = [(-n, j) for n, j, label in every if label != a_label
                    and limits.least_percent * s <= 100 * -n <= limits.most_percent * s]
            out += [(a_id, i, k, j, s, n) for k, (n, j) in enumerate(near[: limits.negatives], 1)]
    return sorted(out)


def clustered(seed: int, n: int, dims: int = 6) -> list[tuple]:
    """Vectors in clusters, a third of them equal, with ties."""
    rng = random.Random(seed)
    centres = [[rng.randint(-60, 60) for _ in range(dims)] for _ in range(8)]
    rows = []
    for i in range(n):
        c = centres[0] if i % 3 == 0 else [x + rng.randint(-9, 9) for x in rng.choice(centres)]
        rows.append((i, rng.randrange(3), c))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_negatives_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "ROUND_BYTES", 16 * 6 * 8 * 2)
    rows = clustered(seed, 400)
    df = spark.createDataFrame(rows, "vec_id long, label long, q array<long>").repartition(5)
    got = hard_negatives.mined(df, F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == wanted_negatives(rows, lambda i: i % 5 == 0)


def test_bounds_leave_out_most_candidates():
    """In clusters far apart few candidates are scored; the result doesn't depend on it."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-200, 200, (10, 16)) * 4
    v = (centres[rng.integers(0, 10, 1200)] + rng.integers(-3, 4, (1200, 16))).astype("f8")
    order, parents, edges = hard_negatives.spanning_tree(v[:200])
    tree = hard_negatives.Tree(
        {"anchors": order, "ids": order, "labels": order * 0, "parents": parents, "edges": edges,
         "vectors": v[:200][order].tobytes()}, 16, "f8")
    assert (parents[1:] < np.arange(1, 200)).all() and parents[0] == -1
    norm = (tree.vectors ** 2).sum(1)
    asked = []

    def wanted(k):
        asked.append(k)
        return np.ones(1200, dtype=bool)

    found = {k: set(zip(rows.tolist(), scores.tolist(), strict=True))
             for k, rows, scores in tree.walk(v, 0.95 * norm, norm * 2, wanted)}
    scores = tree.vectors @ v.T
    for k in range(200):
        rows = np.flatnonzero((scores[k] >= 0.95 * norm[k]) & (scores[k] <= norm[k] * 2))
        assert found.get(k, set()) == {(r, scores[k][r]) for r in rows.tolist()}
    calls = []
    bounds_only = tree.walk(v, 0.95 * norm, norm * 2, lambda k: calls.append(k) or np.zeros(
        1200, dtype=bool))
    assert list(bounds_only) == [] and len(asked) == len(calls) == 200


def test_tree_is_minimal():
    rng = np.random.default_rng(5)
    v = rng.integers(-50, 50, (60, 3)).astype("f8")
    _, parents, edges = hard_negatives.spanning_tree(v)
    away = np.sqrt(((v[:, None] - v) ** 2).sum(2))
    root, total = list(range(60)), 0.0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in sorted(((i, j) for i in range(60) for j in range(i)), key=lambda p: away[p]):
        if find(i) != find(j):
            root[find(i)] = find(j)
            total += away[i, j]
    assert edges.sum() == pytest.approx(total)


def test_negative_edges(spark):
    schema = "vec_id long, label int, embedding array<float>, anchor string, score int"
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5]), (50, 1, [1.0, 0.5]), (50, 1, [1.0, 0.5]), (3, 1, [0.9, 0.4]),
        (4, 2, [0.6, 0.3]), (5, 2, [0.6, 0.3]), (5, 2, [0.6, 0.3]), (6, None, [1.0, 1.0]),
        (None, 1, [1.0, 1.0]), (8, 1, None), (9, 1, [1.0, None]), (10, 2, [nan, 1.0]),
        (11, 2, [inf, 1.0]), (12, 2, [0.7]), (13, 2, [0.7, 0.1, 0.2]), (15, 3, []),
        (100, 9, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], schema)
    q = hard_negatives.quantized(df)
    assert q.columns == ["vec_id", "label", "q"]
    kept = [tuple(r) for r in q.collect()]
    assert len(kept) == 11
    got = hard_negatives.mined(q, F.col("vec_id") % 50 == 0).collect()
    padded = [(i, label, [*v, 0, 0, 0][:3]) for i, label, v in kept]
    assert sorted(map(tuple, got)) == wanted_negatives(padded, lambda i: i % 50 == 0)
    assert hard_negatives.mined(q.filter("false"), F.col("vec_id") % 50 == 0).count() == 0
    large = spark.createDataFrame([(0, 1, [1 << 30, 1]), (1, 1, [(1 << 30) + 1, 1]),
                                   (2, 2, [3 << 28, 1])], "vec_id long, label long, q array<long>")
    got = hard_negatives.mined(large, F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in got] == [
        (0, 1, 1, 2, ((1 << 30) + 1 << 30) + 1, (3 << 58) + 1)]
    with pytest.raises(ValueError):
        hard_negatives.mined(spark.createDataFrame(
            [(0, 1, [1 << 40])], "vec_id long, label long, q array<long>"), F.lit(True))
