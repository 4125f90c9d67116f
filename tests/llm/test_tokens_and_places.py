"""Token codes, shards and packing against plain Python."""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from patchlens.llm import feistel_shards, packing, token_codes
from patchlens.llm.common import numbered, shared_folder
from patchlens.llm.piece_cache import _LETTER, PieceCache, tokenizer_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
ODD = ["", " ", "  a", "a \n b", "a\n\nb c", " a ", "foo's  bar 's <|endoftext|> x", "a ́b", "ΣΑΣ. x",
       "a\u3000 b", "12 345 6", "it's $9.99, ok?\nYes.", "x\u180e y"]


@pytest.mark.parametrize(("path", "keeps"), [(BYTE, True), (WORD, False)])
@pytest.mark.parametrize("size", [3, 100_000])
def test_cached_ids_are_the_library_s(path, keeps, size):
    rng = np.random.default_rng(1)
    parts = [" ", "  ", "\n", "a", "b.", "É", "́", "\u180e", "\x85", "'s", "9", "日", "Word,"]
    texts = ODD + ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(300)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    cache = PieceCache(path, keeps, size)
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in cache.encode(texts)]
        assert got == want


@pytest.mark.parametrize(("path", "keeps"), [(BYTE, True), (WORD, False)])
def test_letters_beside_signs(path, keeps):
    """Every letter of the plain class, before and after each kind of run."""
    letters = [c for c in map(chr, range(0x250)) if re.fullmatch(f"[{_LETTER}]", c)]
    texts = [f"{a}{c}{b}" for c in letters for a, b in (
        ("", "."), ("x", ","), ("TAKS", ". "), (".", "x"), ("9", "9"), (" ", "'s"), ("\n", "\n"))]
    texts += ["TAKS\u0130.", "VERG\u0130, RES\u0130M", "\u0130", "a\u0130!"]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(x, "<u4").tolist() for x in PieceCache(path, keeps).encode(texts)]
    assert got == want


def test_caches_are_bounded():
    cache = PieceCache(BYTE, True, 50_000)
    rng = np.random.default_rng(7)
    for _ in range(20):
        words = ["".join(map(chr, rng.integers(97, 123, 8))) for _ in range(500)]
        cache.encode([" ".join(words), " ".join(words) + "  \u3000"])
        for own in (cache.known, cache.cores):
            # one batch may overshoot; the next one starts a new generation
            assert len(own.young) <= 50_000 // 200 + 1001 and len(own.old) <= 50_000 // 200 + 1001


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_codes_round_trip_and_random_access(n):
    rng = np.random.default_rng(n)
    ids = rng.choice([0, 5, 255, 256, 50_000, 65_535, 65_536, 2**32 - 1], n).astype(np.uint32)
    codes = token_codes.Codes(token_codes.encoded(ids))
    assert len(codes) == n and (codes.all() == ids).all()
    places = rng.integers(0, n, 200) if n else np.zeros(0, dtype=int)
    assert (codes.at(places) == ids[places]).all()
    with pytest.raises(IndexError):
        codes.at([n])


def test_too_wide_ids_and_foreign_bytes():
    with pytest.raises(ValueError, match="more bits"):
        token_codes.encoded(np.array([256]), (8,))
    with pytest.raises(ValueError, match="not a segment"):
        token_codes.Codes(b"else")


def test_written_tokens(spark, edge_docs):
    path = shared_folder(spark, "t")
    token_codes.write_tokens(edge_docs, path, BYTE, segment_tokens=500)
    got = token_codes.read_documents(spark, path).orderBy("start").collect()
    rows = edge_docs.collect()
    tokenizer = Tokenizer.from_file(BYTE)
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0,
                   tuple([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]))
                  for r in rows)
    ids = [tuple(np.frombuffer(r["ids"], "<u4").tolist()) for r in got]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, i)
                  for r, i in zip(got, ids, strict=True)) == want
    keys = [(r["doc_id"] is not None, r["doc_id"]) for r in got]
    assert keys == sorted(keys)
    assert [r["start"] for r in got] == [0, *itertools.accumulate(map(len, ids))][:-1]
    stream = list(itertools.chain(*ids))
    places = [0, 1, len(stream) // 2, len(stream) - 1]
    asked = spark.createDataFrame([(p,) for p in [*places, len(stream), -1]], "place long")
    found = {r["place"]: r["token"] for r in token_codes.tokens_at(spark, path, asked).collect()}
    assert found == {p: stream[p] for p in places}


def test_no_documents(spark, no_docs):
    path = shared_folder(spark, "t")
    token_codes.write_tokens(no_docs, path, BYTE)
    assert token_codes.read_documents(spark, path).count() == 0
    assert feistel_shards.placed(no_docs, 4).count() == 0
    assert packing.pack(no_docs, WORD)[1].count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000])
def test_permutation(n):
    p = feistel_shards.Permutation(n, 7)
    places = p.of(np.arange(n))
    assert sorted(places) == list(range(n))
    assert (p.back(places) == np.arange(n)).all()
    assert (feistel_shards.Permutation(n, 7).of(np.arange(n)) == places).all()


def test_shards(edge_docs):
    rows = feistel_shards.placed(edge_docs, 4).collect()
    n = edge_docs.count()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    texts = {(r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode()))
             for r in edge_docs.collect()}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == texts
    key = [(r["doc_id"] is not None, r["doc_id"], r["text_crc32"], r["size"]) for r in rows]
    at = {}
    for i, k in enumerate(sorted(key)):
        at.setdefault(k, []).append(i)
    back = feistel_shards.row_at([r["shard"] for r in rows], [r["slot"] for r in rows], n, 4, 20)
    assert sorted(back) == list(range(n))
    assert all(b in at[k] for b, k in zip(back.tolist(), key, strict=True))
    again = feistel_shards.placed(edge_docs.repartition(7), 4).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, rows), key=str)


def test_shards_are_written(spark, edge_docs):
    path = shared_folder(spark, "t")
    feistel_shards.write_shards(edge_docs.drop("shard"), path, 3)
    got = spark.read.parquet(path)
    assert got.count() == edge_docs.count()
    assert set(edge_docs.columns) <= set(got.columns)
    with pytest.raises(ValueError, match="placement"):
        feistel_shards.write_shards(edge_docs, path, 3)


def test_numbered_rows(spark, edge_docs):
    rows = numbered(edge_docs, [F.col("doc_id")], "n").collect()
    assert sorted(r["n"] for r in rows) == list(range(edge_docs.count()))
    by = [r["doc_id"] for r in sorted(rows, key=lambda r: r["n"])]
    assert by == sorted(by, key=lambda x: (x is not None, x))


def _least_sequences(lengths: list[int], bound: int) -> int:
    """Brute force: try each piece in each open sequence."""
    best = [len(lengths)]

    def place(i: int, open_: list[int]) -> None:
        if len(open_) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(open_)
            return
        for k in range(len(open_)):
            if open_[k] + lengths[i] <= bound and open_[k] not in open_[:k]:
                open_[k] += lengths[i]
                place(i + 1, open_)
                open_[k] -= lengths[i]
        place(i + 1, [*open_, lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_dominance_keeps_the_optimum(seed):
    rng = np.random.default_rng(seed)
    bound = int(rng.integers(8, 40))
    lengths = rng.integers(1 if seed % 2 else bound // 4, bound + 1, 9).tolist()
    counts = {s: lengths.count(s) for s in lengths}
    fixed, left = packing.reduced(counts, bound)
    rest = [s for s, n in left.items() for _ in range(n)]
    n_fixed = sum(t for _, t in fixed)
    assert n_fixed + (_least_sequences(rest, bound) if rest else 0) == _least_sequences(lengths, bound)
    runs = packing.planned(counts, bound)
    assert all(sum(r) <= bound and t > 0 for r, t in runs)
    used = {}
    for r, t in runs:
        for s in r:
            used[s] = used.get(s, 0) + t
    assert used == counts


def test_packing(spark, edge_docs):
    own, places = packing.pack(edge_docs, WORD, bound=64)
    rows = places.collect()
    tokenizer = Tokenizer.from_file(WORD)
    want = []
    for r in edge_docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want += [(str(r["doc_id"]), k, k * 64, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
                 for k, part in enumerate(ids[a: a + 64] for a in range(0, len(ids), 64))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"])
                  for r in rows) == sorted(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1]
        assert sum(n for _, n in parts) <= 64
    packed = packing.sequences(own, places).collect()
    assert {r["sequence_id"]: len(r["ids"]) // 4 for r in packed} == {
        k: sum(n for _, n in p) for k, p in sequences.items()}
