"""Operators on texts against SQL, brute force and held-out accuracy."""

from __future__ import annotations

import html
import random
import re
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from patchlens.llm import (
    chat_format,
    decontaminate,
    near_dedup,
    page_text,
    pii_spans,
    quality_rules,
    toxicity_fm,
)
from patchlens.llm.oracle import ORACLE
from patchlens.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="tables not present")


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices("abcdefghij", k=4)) for _ in range(n)]


@tables
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.sql(ORACLE[name]).df()
    got = QUERIES[name](spark, SF_DIR).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(map(repr, df[columns].astype(object).values.tolist()))
    assert rows(got) == rows(want)


def _components(texts: list[str | None]) -> list[int]:
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or ""))
        w = [x.translate(str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})) for x in w]
        sets.append({tuple(w[i: i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_all_pairs(spark, seed):
    """Copies, chains of variants and large groups whose members are alike but not linked."""
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", " ", "a b", "A B", "a b c d e", "a b c d e f"]
    for edits in (1, 2, 3, 5, 7):
        base = words(rng, 120)
        texts.append(" ".join(base))
        for _ in range(12):
            own = base[:]
            for at in rng.sample(range(120), edits):
                own[at] = "zz" + rng.choice("abcdefgh")
            texts.append(" ".join(own))
            if rng.random() < 0.3:
                base = own
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == _components(texts)


def test_leftover_blocks_are_used(spark, monkeypatch):
    """Small blocks give the same components."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    test_near_duplicates_against_all_pairs(spark, 3)


def test_stars(spark):
    rng = random.Random(5)
    links = [(bytes([rng.randrange(60)]), bytes([rng.randrange(60)])) for _ in range(45)]
    links = [(a, b) for a, b in links if a != b] + [(bytes([i]), bytes([i + 1])) for i in range(100, 130)]
    got = {bytes(r["node"]): bytes(r["root"]) for r in near_dedup.components(
        spark.createDataFrame(links, "a binary, b binary")).collect()}
    root = {n: n for pair in links for n in pair}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert all(got.get(n, n) == r for n, r in root.items())


def test_deduplicated(spark, edge_docs, no_docs):
    rows = near_dedup.deduplicated(edge_docs)
    assert rows.columns == edge_docs.columns
    kept = [r["text"] for r in rows.collect()]
    assert kept.count("one two three four five") == 1
    assert sum(not (t or "").strip() for t in kept) == 4
    assert near_dedup.deduplicated(no_docs).count() == 0


@pytest.mark.parametrize("ids", [(None, None, None), (7, 7, 7), (None, 7, 7)])
def test_one_of_near_copies_without_an_own_id_stays(spark, ids):
    own = words(random.Random(5), 200)
    rows = [(i, " ".join([*own, f"end{k}"])) for k, i in enumerate(ids)] + [(9, "other words here and there now")]
    left = near_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["text"][:5] for r in left) == sorted([rows[0][1][:5], "other"])


def test_containment_against_brute_force(spark):
    rng = random.Random(3)
    items = [words(rng, n) for n in (2, 5, 11, 20, 40, 59)] + [[]]
    docs: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " ".join(items[0]))]
    for i in range(3, 40):
        item = items[rng.randrange(len(items))]
        own = item[:]
        if own and i % 3:
            own[rng.randrange(len(own))] = "changed"
        half = len(own) // 2
        body = words(rng, rng.choice([5, 300, 4000]))
        docs.append((i, " ".join([*body[:3], *own[:half], *([] if i % 2 else body), *own[half:], *body[3:]])))
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(
        [*((i, " ".join(w).upper()) for i, w in enumerate(items)), (99, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_found"])
           for r in decontaminate.contaminated(left, right).collect()}
    cut = lambda w: {tuple(w[i: i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    want = {}
    for d, text in docs:
        own = cut((text or "").split())
        for i, item in enumerate(items):
            s = cut(item)
            if s and 100 * len(s & own) >= 75 * len(s):
                want[d, i] = (len(s), len(s & own))
    assert got == want and len(want) > 10
    clean = {r["doc_id"] for r in decontaminate.decontaminated(left, right).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}


@pytest.mark.parametrize("least", [1, 2, 9, 30, 1000])
def test_load_keeps_the_miss_small(least):
    load = decontaminate._load(least)
    if load is not None:
        import math

        met = (1 - math.exp(-load)) / load
        assert (1 - met) ** math.ceil(0.75 * least) <= decontaminate.MISS


def test_containment_runs_no_python(spark, edge_docs):
    items = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    found = decontaminate.contaminated(edge_docs, items)
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert {r["doc_id"] for r in found.collect()} == {6, 7}
    assert decontaminate.decontaminated(edge_docs, items).columns == edge_docs.columns
    assert decontaminate.contaminated(edge_docs, items.filter("false")).count() == 0
    assert decontaminate.contaminated(edge_docs.filter("false"), items).count() == 0


def test_quality_edges(spark, edge_docs, no_docs):
    rows = quality_rules.judged(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert all(r["base_failed"] for r in rows if r["n_words"] < 50)
    assert quality_rules.judged(no_docs).count() == 0


def test_bins_keep_order_and_resolution(spark):
    df = spark.range(0, 5000).withColumn("bin", quality_rules.bin_of(quality_rules.F.col("id")))
    df = df.withColumn("low", quality_rules.least_of_bin(quality_rules.F.col("bin")))
    rows = df.orderBy("id").collect()
    assert all(r["low"] <= r["id"] <= r["low"] * 33 / 32 + 1 for r in rows)
    assert [r["bin"] for r in rows] == sorted(r["bin"] for r in rows)


def test_sketches_merge(spark):
    rng = random.Random(2)
    rows = [("en", f"s{i % 3}", rng.randrange(300), 0, 0, 500) for i in range(600)]
    df = spark.createDataFrame(rows, "lang string, source string, symbols long, dup_lines long, repeats long, length long")
    parts = quality_rules.sketch(df)
    assert quality_rules.merged(parts, "lang").exceptAll(
        quality_rules.sketch(df.withColumn("source", quality_rules.F.lit("x"))).select(
            "lang", "measure", "bin", "n")).count() == 0
    q = quality_rules.quantiles(quality_rules.merged(parts), at=(50,)).filter("measure = 'symbols'").first()
    exact = sorted(r[2] for r in rows)[299]
    assert q["q50"] <= exact <= q["q50"] * 33 / 32 + 1


@pytest.mark.parametrize("seed", range(40))
def test_base_patterns(seed):
    rng = random.Random(seed)
    text = "".join(rng.choices(["1", "23", "4111111111111111", ".", "@", "a", "-", " ", "+", "(", "é", "_",
                                "255", "0", "mail.example.com", "1.2.3.4", "+1 (523) 555-1055"], k=40))
    want = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
                          ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m[0].split(".")),
                    "card": 14 <= len(digits) <= 19 and sum(
                        sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0,
                    "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                want.append((m.start(), m.end(), kind))
    assert sorted(pii_spans.base_spans(text)) == sorted(want)


def test_long_runs_are_read_once():
    import time

    start = time.perf_counter()
    pii_spans.base_spans("a" * 400_000 + "@" + "1" * 400_000 + "." * 1000 + "+1" + "(" * 100_000)
    assert time.perf_counter() - start < 5


@pytest.fixture(scope="module")
def tagger():
    return pii_spans.fitted(pii_spans.written_spans())


def test_tagger_finds_unseen_spans(tagger):
    unseen = pii_spans.written_spans(seed=99, n=120)
    found = pii_spans.model_spans([t for t, _ in unseen], tagger)
    right = sum(set(w) <= set(f) for (_, w), f in zip(unseen, found, strict=True))
    wrong = sum(len(set(f) - set(w)) for (_, w), f in zip(unseen, found, strict=True))
    assert right >= 0.9 * len(unseen) and wrong <= 0.1 * len(unseen)


SPELLED = [
    ("you can write to anna at example dot org for help", "anna at example dot org"),
    ("the post is open, mail miller (at) firma (dot) de for help", "miller (at) firma (dot) de"),
    ("the post is open, mail john[at]host.com for help", "john[at]host.com"),
    ("her number is five five five one two three four five six seven", "five five five one two three four five six seven"),
]


@pytest.mark.parametrize("text, span", SPELLED)
def test_spelled_forms_are_found(tagger, text, span):
    _, found = pii_spans.all_spans([text], tagger)[0]
    assert span in [text[a:b] for a, b, _ in found]
    assert span not in pii_spans.redact(text, found)


@pytest.mark.parametrize("name", ["müller", "jösé", "élise", "nuñez"])
def test_wider_spans_are_kept(tagger, name):
    text = f"you can write to {name}.42@mail.org for help"
    base, found = pii_spans.all_spans([text], tagger)[0]
    assert set(base) < set(found)
    assert name not in pii_spans.redact(text, found) and "<EMAIL>" in pii_spans.redact(text, found)


@pytest.mark.parametrize(("text", "kind", "want"), [
    ("4111111111111111 5500005555555559", "card", ["4111111111111111", "5500005555555559"]),
    ("4111-1111-1111-1111 1234 5678 9012 3456", "card", ["4111-1111-1111-1111"]),
    ("4111111111111112", "card", []), ("+1 (826) 555", "phone", []),
    ("+1 (826) 555-0199", "phone", ["+1 (826) 555-0199"]), ("call (826) 555-0199 now", "phone", ["(826) 555-0199"]),
    ("10.0.0.256", "ip", []), ("10.0.0.25", "ip", ["10.0.0.25"]),
    ("five five five one two three four", "phone", ["five five five one two three four"]),
    ("bob at host dot org", "email", ["bob at host dot org"]), ("1 " * 50_000 + "1", "card", None),
])
def test_added_spans_pass_the_test_of_their_kind(text, kind, want):
    start = time.perf_counter()
    got = pii_spans.checked(text, (0, len(text), kind))
    assert time.perf_counter() - start < 5
    if want is not None:
        assert [text[a:b] for a, b, _ in got] == want


def test_spans_inside_others_are_not_added():
    text = "to mü.bob@x.de or 1.2.3.4x y"
    base = [(6, 14, "email"), (18, 25, "ip")]
    added = [(6, 14, "email"), (0, 14, "email"), (7, 12, "email"), (18, 26, "ip"), (27, 28, "ip")]
    assert pii_spans._beyond(text, added, base) == [(3, 14, "email"), (18, 26, "ip"), (27, 28, "ip")]


@pytest.mark.parametrize("text", ["we met at noon. It is red.", "one of two and three more", "", "at"])
def test_plain_text_has_no_runs(text):
    assert pii_spans.runs(text) == [] == pii_spans.spelled_spans(text)


def test_spelled_runs_are_read_once():
    began = time.process_time()
    for part in ("at ", "one ", "(at", "at x.y ", "dot at ", "one one one x "):
        pii_spans.runs(part * 100_000)
        pii_spans.spelled_spans(part * 100_000)
    assert time.process_time() - began < 30


def test_spans_end_with_words():
    assert pii_spans.whole_words("ab cdef. x", 4, 8) == (3, 7)
    assert pii_spans.whole_words("x" * 100, 40, 60) == (40, 60)


def test_gradients(tagger):
    import numpy as np

    rng = np.random.default_rng(0)
    x, y = rng.integers(1, 40, (2, 6)), np.array([[0, 1, 2, 0, 0, 3], [0, 0, 0, 0, 0, 0]])
    mask = np.array([[True] * 6, [True] * 4 + [False] * 2])
    own = pii_spans.Tagger.fresh(1)
    _, g = own.loss_and_gradients(x, y, mask)
    for name, at in (("wf", (3, 5)), ("wb", (9, 2)), ("o", (2, 1)), ("t", (0, 1)), ("cf", (4,))):
        kept = own.p[name][at]
        sides = []
        for d in (1e-5, -1e-5):
            own.p[name][at] = kept + d
            sides.append(own.loss_and_gradients(x, y, mask)[0])
        own.p[name][at] = kept
        assert abs((sides[0] - sides[1]) / 2e-5 - g[name][at]) < 1e-5


def test_spans_of_documents(spark, edge_docs, no_docs, tagger):
    rows = pii_spans.spotted(edge_docs, tagger).collect()
    assert len(rows) == edge_docs.count()
    kinds = [s["kind"] for r in rows if r["doc_id"] == 10 for s in r["base"]]
    assert kinds == ["email", "phone"]
    out = pii_spans.redacted(edge_docs, tagger)
    assert out.schema == edge_docs.schema
    texts = {r["text"]: r["n_chars"] for r in out.collect()}
    assert texts["mail <EMAIL> or <PHONE> now"] == len("mail <EMAIL> or <PHONE> now")
    assert pii_spans.redacted(no_docs, tagger).count() == 0
    assert pii_spans.redact("abcdef", [(1, 3, "ip"), (2, 4, "card")]) == "a<IP>ef"


PAGES = [
    ("<article><h1>T &amp; x</h1><p>one\n two<br>three <b>bo</b>ld</p></article>", "T & x one two three bold"),
    ("<nav><ul><li><a href=/>n</a></ul></nav><article><p><b>a.<br><p>b</article><footer>f</footer>", "a. b"),
    ("<article><p>cut off &am", "cut off &am"), ("<article><p>cut <a hre", "cut"),
    ("<article><p>x<script>var t='</p>';</script><style>p{}</style><!-- c --> y</p></article>", "x y"),
    ("<article><p>a < b</p><form><p>Name</p><input></form></article>", "a < b"),
    ("", ""), (None, ""), ("plain", ""), ("</p></b>", ""),
]


_LONG = "The council met on Tuesday to discuss the new bridge and its cost. " * 3
_ARTICLE = f"<article><h1>A bridge</h1><p>{_LONG}</p></article>"
_BRIDGE = f"A bridge {_LONG}".strip()
#: Pages whose raw tags have no end, or end in themselves.
UNENDED = [
    (f'<html><head><svg class="icon"/></head><body>{_ARTICLE}</body></html>', _BRIDGE),
    (f'<body><nav><svg class="icon"/></nav>{_ARTICLE}<footer><svg><title>t</title></svg></footer>', _BRIDGE),
    (f"<body><noscript><p>No script.</p>{_ARTICLE}</body>", _BRIDGE),
    (f"<head><noscript><link rel=x></head><body>{_ARTICLE}", _BRIDGE),
    (f"<head><title>Bridges</head><body>{_ARTICLE}", _BRIDGE),
    (f"<head><title>Bridges<body>{_ARTICLE}", _BRIDGE),
    (f"<body><div><template><i></div>{_ARTICLE}", _BRIDGE),
    (f"<body><template>{_ARTICLE}", _BRIDGE), (f"<body><svg><path d=x>{_ARTICLE}", _BRIDGE),
    (f'<body><iframe src="x"/>{_ARTICLE}<iframe src="y">z</iframe>', _BRIDGE),
    (f'<head><script src="x"/><style/></head><body>{_ARTICLE}', _BRIDGE),
    (f"<body><form><textarea></form>{_ARTICLE}", _BRIDGE),
    (f"<article><h1>A bridge</h1><p>{_LONG}<noscript>Seen.</noscript></p></article>", f"{_BRIDGE} Seen."),
    (f"<article><h1>A bridge</h1><p>{_LONG}<svg><style/><foreignObject><div>x<p>y</div></foreignObject>"
     f"</svg><template><p>z</template>end</p></article>", f"{_BRIDGE} end"),
    (f"<body>{_ARTICLE}<script>var t = '<p>x</p>';", _BRIDGE),
    (f"<body>{_ARTICLE}<script src=x/>var t;</script>", _BRIDGE),
]


@pytest.mark.parametrize("source, want", UNENDED)
def test_raw_tags_without_an_end(page_model, source, want):
    page = page_text.parsed(source)
    got = page_text.main_text(page, page_model.marginals(page))
    # what stands before the article may be judged either way
    assert got.removeprefix("No script.").strip() == want


def test_raw_tags_are_searched_once():
    began = time.process_time()
    page_text.parsed("<title>" * 40_000 + "<iframe/>" * 40_000 + "<svg><p>" * 40_000)
    assert time.process_time() - began < 10


@pytest.fixture(scope="module")
def page_model():
    pages = [page_text.parsed(h) for h in page_text.LABELLED]
    return page_text.fitted([(p, page_text.labelled(p)) for p in pages], epochs=30)


def test_pages(spark, page_model):
    rows = [(i, None, h, "x") for i, (h, _) in enumerate(PAGES)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in page_text.extracted(df, page_model).collect()}
    assert [got[i] for i in range(len(PAGES))] == [t for _, t in PAGES]
    assert page_text.extracted(df.filter("false"), page_model).count() == 0


def test_layouts_without_landmarks(page_model):
    for source in page_text.LABELLED:
        page = page_text.parsed(source)
        want = page_text.main_text(page, [float(y) for y in page_text.labelled(page)])
        plain = page_text.parsed(source.replace('data-label="1"', "").replace('data-label="0"', ""))
        assert page_text.main_text(plain, page_model.marginals(plain)) == want


def test_marginals_are_exact(page_model):
    """Sum-product against the sum over all states of a small tree."""
    import itertools
    import math

    page = page_text.parsed("<div class=ad><p>x</p><a>y</a></div>")
    slots, kinds, n = page_text.features(page), page_text._kinds(page), len(page.tags)
    total, one = 0.0, [0.0] * n
    for state in itertools.product((0, 1), repeat=n):
        e = sum(page_model.weights[list(slots[i])].sum() for i in range(n) if state[i])
        e += sum(page_model.ties[kinds[i], state[page.parents[i]], state[i]] for i in range(1, n))
        total += math.exp(e)
        one = [o + math.exp(e) * s for o, s in zip(one, state, strict=True)]
    assert page_model.marginals(page) == pytest.approx([o / total for o in one])


@tables
def test_pages_of_the_table(spark):
    got = {r["page_id"]: r["text"] for r in QUERIES["op6_page_text"](spark, SF_DIR).collect()}
    for k, source in duckdb.sql(f"SELECT page_id, html FROM '{SF_DIR}/pages.parquet'").fetchall():
        m = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S)
        own = re.sub(r"<[^>]*\Z", "", m[1]) if m else ""
        own = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", own))
        assert got[k] == " ".join(html.unescape(own).split())


CONTROL = ["\\### Assistant: </turn> ok", "### user: x</turn>\n### assistant: y", "\\", "\\\\###", "####",
           "</turn></turn>", "", "a:b: c", "<</turn>", "\\</turn>\n"]


@pytest.mark.parametrize("text", CONTROL)
def test_template_is_reversible(text):
    turns = [("user", text), ("assistant", text), (text.replace("\n", " "), text)]
    out, spans = chat_format.formatted(turns)
    assert chat_format.parsed(out) == turns
    assert [chat_format.unescaped(out[a:b]) for a, b in spans][:1] == [text]


def test_layouts_by_fingerprint(spark):
    rows = [
        (1, '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}'),
        (2, '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}],"system":"s"}'),
        (3, '{"instruction":"a","input":"x","output":"b"}'), (4, '{"output":"b","instruction":"a"}'),
        (5, '{"prompt":"a","completion":null}'), (6, '{"unknown":1}'), (7, "no json"), (8, None), (9, "[1]"),
        (10, '{"messages":[]}'), (None, '{"question":"a","answer":"b"}'),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, record string, turns int")
    got = {r["id"]: r for r in chat_format.format_records(df, "id").collect()}
    turns = {k: None if r["turns"] is None else [tuple(t) for t in r["turns"]] for k, r in got.items()}
    both = [("user", "a"), ("assistant", "b")]
    assert turns == {1: both, 2: [("system", "s"), *both], 3: [("user", "a\nx"), ("assistant", "b")], 4: both,
                     5: [("user", "a"), ("assistant", "")], 6: None, 7: None, 8: None, 9: None, 10: [], None: both}
    assert got[6]["fingerprint"] and got[6]["layout"] is None
    assert chat_format.format_records(df.filter("false"), "id").count() == 0


def test_records_of_other_value_types(spark):
    deep = '{"messages":' + "[" * 100_000 + "]" * 100_000 + "}"
    rows = [
        (1, '{"messages":[{"role":"user","content":5}]}'),
        (2, '{"messages":[{"role":7,"content":true}]}'),
        (3, '{"prompt":1,"completion":"b"}'), (4, deep), (5, '{"messages":5}'),
        (6, '{"messages":"abc"}'), (7, '{"messages":[{"role":"user","content":[]}]}'),
        (8, '{"messages[].role":"user","messages[].content":"x"}'),
        (9, '{"prompt":"\\ud800","completion":"' + "long " * 200_000 + '"}'),
        (10, '{"messages":[{"role":"user","content":"a"},{}]}'), (11, '{"messages":null}'),
        (12, '{"prompt":' + "9" * 5000 + ',"completion":"b"}'), (13, '{"question":NaN,"answer":"b"}'),
    ]
    df = spark.createDataFrame(rows, "id long, record string")
    got = {r["id"]: r for r in chat_format.format_records(df, "id").collect()}
    turns = {k: None if r["turns"] is None else [tuple(t) for t in r["turns"]] for k, r in got.items()}
    long = turns.pop(9)
    assert long == [("user", "?"), ("assistant", "long " * 200_000)]
    assert turns == {
        1: [("user", "5")], 2: [("7", "true")], 3: [("user", "1"), ("assistant", "b")], 4: None,
        5: None, 6: None, 7: [("user", "")], 8: None, 10: [("user", "a"), ("", "")], 11: [],
        12: None, 13: [("user", "NaN"), ("assistant", "b")]}
    assert got[5]["fingerprint"] and not got[4]["fingerprint"]
    back = chat_format.digests(chat_format.format_records(df, "id"), "id")
    assert back.filter("id = 1").first()["n_turns"] == 1


def test_messages_with_ties_and_nulls(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "b"), (None, None, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format.format_records(chat_format.message_records(df), "conv_id")
    turns = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in got.collect()}
    assert turns == {1: [("user", ""), ("", "x"), ("assistant", "b")], None: [("user", "n")]}


@pytest.fixture(scope="module")
def insults(spark):
    """Toxic where an insult meets a group; each alone is harmless."""
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        w = words(rng, 12)
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w += ["scum"] * a + ["grockles"] * b
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(a and b)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic long")
    return df.drop("toxic"), df.drop("text")


def test_pairs_of_terms_are_learned(insults):
    docs, labels = insults
    machine = toxicity_fm.trained(docs, labels)
    scores = toxicity_fm.scored(docs, machine, "doc_id").join(labels, "doc_id").filter(
        toxicity_fm.held_out(toxicity_fm.F.col("doc_id"))).collect()
    right = sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in scores)
    assert right >= 0.97 * len(scores) > 200


def test_scores_are_sums_over_pairs():
    rng = np.random.default_rng(3)
    x, w, v = rng.random((9, 6)), rng.normal(0, 1, 6), rng.normal(0, 1, (6, 3))
    machine = toxicity_fm.Machine(np.arange(6), 0.3, w, v)
    for row, got in zip(x, machine.scores(x), strict=True):
        z = 0.3 + sum(w[i] * row[i] for i in range(6)) + sum(
            (v[i] @ v[j]) * row[i] * row[j] for i in range(6) for j in range(i))
        assert got == pytest.approx(1 / (1 + np.exp(-z)))


def test_machine_gradients():
    rng = np.random.default_rng(5)
    x, y = rng.random((20, 5)), (rng.random(20) < 0.4).astype(float)
    at = {"bias": 0.2, "weights": rng.normal(0, 1, 5), "factors": rng.normal(0, 1, (5, 3))}
    exact = toxicity_fm.gradients(toxicity_fm.Machine(np.arange(5), **at), x, y)
    for name, value in at.items():
        for place in np.ndindex(np.shape(value)):
            both = []
            for step in (1e-5, -1e-5):
                moved = np.array(value, dtype=float)
                moved[place] += step
                moved = float(moved) if name == "bias" else moved
                both.append(toxicity_fm.loss(
                    toxicity_fm.Machine(np.arange(5), **{**at, name: moved}), x, y))
            want = (both[0] - both[1]) / 2e-5
            assert exact[name][place or 0] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(("alone", "together"), [(0.05, 0.0), (0.005, 0.005), (0.008, 0.002)])
def test_pairs_of_rare_terms(spark, alone, together):
    """Toxic only where two rare terms meet: the machine finds it, its linear part can't."""
    rng = np.random.default_rng(int(1000 * together))
    rows = []
    for i in range(20_000):
        w = [f"w{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k // 100]}"
             for k in rng.zipf(1.4, 25) % 1000]
        both = rng.random() < together
        a = both or rng.random() < alone
        b = both or rng.random() < alone
        w += ["scum"] * a + ["grockles"] * b
        rows.append((i, " ".join(rng.permutation(w)), int(a and b)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic long")
    docs, labels = df.drop("toxic"), df.drop("text")
    machine = toxicity_fm.trained(docs, labels)
    plain = toxicity_fm.Machine(
        machine.slots, machine.bias, machine.weights, machine.factors * 0)
    assert len(machine.slots) > 500 and 2 <= (np.abs(machine.factors).sum(1) > 0).sum() < 40
    test = df.filter(toxicity_fm.held_out(F.col("doc_id")))
    found = {}
    for name, own in (("machine", machine), ("linear", plain)):
        scores = toxicity_fm.scored(test, own, "doc_id", "toxic").collect()
        toxic = [r for r in scores if r["toxic"]]
        found[name] = sum(r["score"] >= 0.5 for r in toxic) / len(toxic)
        assert sum(r["score"] >= 0.5 for r in scores if not r["toxic"]) <= 2
    assert found["machine"] >= 0.9 and found["linear"] <= 0.2


def test_a_column_called_score(spark, insults):
    docs, labels = insults
    machine = toxicity_fm.trained(docs, labels)
    clash = docs.limit(5).withColumn("score", F.lit("x")).withColumn("_text", F.lit("y"))
    got = toxicity_fm.scored(clash, machine, "doc_id", "score", "_text")
    assert got.columns == ["doc_id", "_text", "score"]
    assert all(0 <= r["score"] <= 1 and r["_text"] == "y" for r in got.collect())


def test_toxicity_edges(spark, edge_docs, no_docs, insults):
    _, labels = insults
    machine = toxicity_fm.trained(edge_docs, labels.filter("false"))
    assert {r["score"] for r in toxicity_fm.scored(edge_docs, machine, "doc_id").collect()} == {0.5}
    machine = toxicity_fm.trained(edge_docs, labels)
    scores = toxicity_fm.scored(edge_docs, machine, "doc_id", "shard").collect()
    assert len(scores) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert toxicity_fm.clean(edge_docs, machine).columns == edge_docs.columns
    assert toxicity_fm.clean(no_docs, machine).count() == 0


@tables
def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").df()
    got = QUERIES["op9_toxicity_machine"](spark, sf).toPandas().merge(labels, on="doc_id")
    test = got[got.held_out]
    assert (test.predicted == test.toxic).mean() >= 0.96
    assert ((test.predicted == 1) & (test.toxic == 0)).mean() <= 0.01


@tables
def test_pipeline(spark):
    import corpus_pipeline
    from patchlens.llm.common import written

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen: dict[str, pd.DataFrame] = {"": docs.toPandas()}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF_DIR), name)
        if name != names[-1]:
            assert docs.columns == list(seen[""].columns)
        seen[name] = docs.toPandas()
    # toxicity: what the same machine, fitted again, scores below one half stays
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    first = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    scores = toxicity_fm.scored(first, toxicity_fm.trained(first, labels), "doc_id").toPandas()
    assert set(seen["toxicity"].doc_id) == set(scores[scores.score < 0.5].doc_id)
    # near duplicates: one of each component of what toxicity kept
    before = seen["toxicity"].sort_values("doc_id").text.tolist()
    assert len(seen["near_dedup"]) == len(set(_components(before)))
    # decontamination: what brute force finds goes, all else stays
    items = duckdb.sql(f"SELECT text FROM '{SF_DIR}/benchmark.parquet'").fetchall()
    cut = lambda w: {tuple(w[i: i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    sets = [cut(t.lower().split()) for (t,) in items]

    def hit(text: str) -> bool:
        own = cut((text or "").lower().split())
        return any(s and 100 * len(s & own) >= 75 * len(s) for s in sets)

    kept = {r.doc_id for r in seen["near_dedup"].itertuples() if not hit(r.text)}
    assert set(seen["decontamination"].doc_id) == kept
    # personal data of the fixed patterns are gone, other texts are as they were
    cleaned = seen["decontamination"].merge(seen["pii"], on="doc_id", suffixes=("_a", "_b"))
    assert len(cleaned) == len(seen["decontamination"]) == len(seen["pii"])
    for r in cleaned.itertuples():
        assert not pii_spans.base_spans(r.text_b)
        if not re.search("[0-9@]", r.text_a):
            assert r.text_a == r.text_b
    packed = seen["packing"]
    assert set(packed.doc_id) == set(seen["pii"].doc_id)
    assert packed.groupby("sequence_id").length.sum().max() <= 4096


@tables
@pytest.mark.parametrize("rows", ["edge_docs", "no_docs"])
def test_pipeline_edges(spark, request, tmp_path, rows):
    """Null ids and texts, repeated rows, clashing names, no rows at all: every stage goes through."""
    import corpus_pipeline

    docs = request.getfixturevalue(rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    if rows == "no_docs":
        assert packed.empty
        return
    # texts without words are kept, one of each group of equal others
    assert packed.doc_id.isna().sum() == 1 and 3 in set(packed.doc_id)
    assert packed.groupby("sequence_id").length.sum().max() <= 4096
    places = packed.sort_values(["sequence_id", "offset"])
    ends = (places.offset + places.length).groupby(places.sequence_id).shift().fillna(0)
    assert (places.offset == ends).all()
