"""Personal data: fixed patterns, and a character model that adds spans they miss.

The model is a bidirectional LSTM over character classes with CRF transitions between the
labels begin and inside of each kind, trained here in numpy from labelled spans. A document is
read in overlapping windows around what personal data can't do without: a digit, ``@``, a word for
``@`` with one for a dot after it, or four number words in a row. Common spelled-out forms ('name
at host dot org', seven number words or more) are added by patterns of their own. Scores of a character from several windows are averaged,
by its distance from the window's ends, and each run of joined windows is then decoded as a
whole, so windows can't disagree. Added spans
don't overlap each other; of one that overlaps a pattern's, what touches that without a space is
kept (a local part whose first letters aren't ASCII), and what is personal data by itself.

Defined results: a null text is an empty one; offsets are code points, the end is exclusive;
equal spans of one kind occur once; repeated rows give equal rows; no documents give no rows;
columns other than the named ones aren't read by ``spotted`` and kept by ``redacted``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import bounded_sample, slices

KINDS = ("email", "ip", "card", "phone")
#: Labelled rows of the table that the model is fitted on, at most.
ROWS = 300
WINDOW, STRIDE = 48, 24
HIDDEN, EMBEDDING = 12, 8
STEPS = 900
Span = tuple[int, int, str]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Runs of digits that begin no match are consumed whole, so nothing is tried twice.
_IP = re.compile(r"([0-9]++)(?:\.([0-9]++)\.([0-9]++)\.([0-9]++))?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and without overlap in each kind, in order."""
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end, "email"))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if m[2] and all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.groups()):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# Labels: 0 outside, then begin and inside of each kind.
N_LABELS = 1 + 2 * len(KINDS)
_CLASSES = {c: i for i, c in enumerate(
    "@.+-()_%/:=#,;\"' \n0123456789abcdefghijklmnopqrstuvwxyz", 2)}
N_CLASSES = len(_CLASSES) + 3


def classes_of(text: str) -> np.ndarray:
    """A class for each character; 0 pads, 1 is any other sign, the last any other letter."""
    return np.array([_CLASSES.get(c) or _CLASSES.get(c.lower()) or (
        N_CLASSES - 1 if c.isalpha() else 1) for c in text], dtype=np.int64)


def labels_of(n: int, spans: list[Span], offset: int = 0) -> np.ndarray:
    y = np.zeros(n, dtype=np.int64)
    for start, end, kind in spans:
        a, b = max(start - offset, 0), min(end - offset, n)
        if a < b:
            k = 1 + 2 * KINDS.index(kind)
            y[a:b] = k + 1
            if start >= offset:
                y[a] = k
    return y


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def allowed_transitions() -> np.ndarray:
    """Penalties: inside follows begin or inside of the same kind only."""
    out = np.zeros((N_LABELS, N_LABELS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[:, inside] = -1e4
        out[[inside - 1, inside], inside] = 0
    return out


_ALLOWED = allowed_transitions()


@dataclass
class Tagger:
    """Embedding, two LSTMs (gates: input, forget, output, new), output layer, transitions."""

    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        p = {"e": rng.normal(0, 0.3, (N_CLASSES, EMBEDDING)),
             "o": rng.normal(0, 0.3, (2 * HIDDEN, N_LABELS)), "ob": np.zeros(N_LABELS),
             "t": np.zeros((N_LABELS, N_LABELS))}
        for way in "fb":
            p[f"w{way}"] = rng.normal(0, 0.3, (EMBEDDING + HIDDEN, 4 * HIDDEN))
            p[f"c{way}"] = np.zeros(4 * HIDDEN)
            p[f"c{way}"][HIDDEN: 2 * HIDDEN] = 1
        return Tagger(p)

    def _run(self, x: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        n, length = x.shape[:2]
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out = np.zeros((n, length, HIDDEN))
        w, bias = self.p[f"w{way}"], self.p[f"c{way}"]
        for t in range(length) if way == "f" else range(length - 1, -1, -1):
            joined = np.concatenate([x[:, t], h], 1)
            z = joined @ w + bias
            i, f, o = (_sigmoid(z[:, k * HIDDEN: (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            if keep is not None:
                keep.append((t, joined, i, f, o, g, before, tc))
        return out

    def scores(self, windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Label scores of each character of each window (rows of classes)."""
        x = self.p["e"][windows]
        kept = {way: [] for way in "fb"} if keep is not None else {"f": None, "b": None}
        h = np.concatenate([self._run(x, way, kept[way]) for way in "fb"], 2)
        if keep is not None:
            keep |= {"kept": kept, "h": h}
        return h @ self.p["o"] + self.p["ob"]

    def loss_and_gradients(self, windows: np.ndarray, y: np.ndarray, mask: np.ndarray):
        """Negative log likelihood of the CRF, by forward and backward sums, and gradients."""
        keep: dict = {}
        u = self.scores(windows, keep)
        n, length, k = u.shape
        trans = self.p["t"] + _ALLOWED
        alpha = np.zeros((length, n, k))
        beta = np.zeros((length, n, k))

        def logsum(a: np.ndarray, axis: int) -> np.ndarray:
            top = a.max(axis, keepdims=True)
            return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))

        alpha[0] = u[:, 0]
        for t in range(1, length):
            step = logsum(alpha[t - 1][:, :, None] + trans, 1) + u[:, t]
            alpha[t] = np.where(mask[:, t, None], step, alpha[t - 1])
        for t in range(length - 2, -1, -1):
            step = logsum(trans + (u[:, t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(mask[:, t + 1, None], step, beta[t + 1])
        z = logsum(alpha[-1], 1)
        du, dt = np.zeros_like(u), np.zeros((k, k))
        rows, gold = np.arange(n), np.zeros(n)
        for t in range(length):
            m = mask[:, t].astype(float)
            du[:, t] = np.exp(alpha[t] + beta[t] - z[:, None]) * m[:, None]
            du[rows, t, y[:, t]] -= m
            gold += u[rows, t, y[:, t]] * m
            if t:
                pair = np.exp(alpha[t - 1][:, :, None] + trans + (u[:, t] + beta[t])[:, None, :]
                              - z[:, None, None]) * m[:, None, None]
                dt += pair.sum(0)
                np.add.at(dt, (y[:, t - 1], y[:, t]), -m)
                gold += trans[y[:, t - 1], y[:, t]] * m
        g = {"t": dt / n, "o": np.einsum("nth,ntk->hk", keep["h"], du) / n,
             "ob": du.sum((0, 1)) / n, "e": np.zeros_like(self.p["e"])}
        dh_all = du @ self.p["o"].T / n
        for way, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            w = self.p[f"w{way}"]
            gw, gb = np.zeros_like(w), np.zeros(4 * HIDDEN)
            dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
            for t, joined, i, f, o, gg, before, tc in reversed(keep["kept"][way]):
                dh = dh + dh_all[:, t, part]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f),
                                     dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], 1)
                gw += joined.T @ dz
                gb += dz.sum(0)
                back = dz @ w.T
                np.add.at(g["e"], windows[:, t], back[:, :EMBEDDING])
                dh, dc = back[:, EMBEDDING:], dc * f
            g[f"w{way}"], g[f"c{way}"] = gw, gb
        return float((z - gold).mean()), g

    def decoded(self, u: np.ndarray) -> np.ndarray:
        """The likeliest labels of one run of characters (Viterbi)."""
        trans = self.p["t"] + _ALLOWED
        best, back = u[0].copy(), np.zeros(u.shape, dtype=np.int64)
        best[2::2] = -1e4  # nothing begins inside
        for t in range(1, len(u)):
            step = best[:, None] + trans
            back[t] = step.argmax(0)
            best = step.max(0) + u[t]
        y = np.zeros(len(u), dtype=np.int64)
        y[-1] = best.argmax()
        for t in range(len(u) - 1, 0, -1):
            y[t - 1] = back[t, y[t]]
        return y


def fitted(texts: list[tuple[str, list[Span]]], steps: int = STEPS, seed: int = 4) -> Tagger:
    """Adam on windows of labelled texts; windows with and without spans in turn."""
    rng = np.random.default_rng(seed)
    with_spans, without = [], []
    for text, spans in texts:
        for a, b in runs(text):
            for start in window_starts(a, b):
                own = text[start: min(start + WINDOW, b)]
                y = labels_of(len(own), spans, start)
                (with_spans if y.any() else without).append((own, y))
    tagger = Tagger.fresh(seed)
    if not with_spans:
        tagger.p["ob"][1:] = -20
        return tagger
    m = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    s = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    for step in range(1, steps + 1):
        chosen = [with_spans[i] for i in rng.integers(0, len(with_spans), 24)]
        if without:
            chosen += [without[i] for i in rng.integers(0, len(without), 12)]
        x = np.zeros((len(chosen), WINDOW), dtype=np.int64)
        y, mask = np.zeros_like(x), np.zeros(x.shape, dtype=bool)
        for i, (text, label) in enumerate(chosen):
            x[i, : len(text)], y[i, : len(text)] = classes_of(text), label
            mask[i, : len(text)] = True
        _, g = tagger.loss_and_gradients(x, y, mask)
        norm = np.sqrt(sum((v * v).sum() for v in g.values()))
        for k, v in g.items():
            v = v * min(1, 5 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * v
            s[k] = 0.999 * s[k] + 0.001 * v * v
            tagger.p[k] = tagger.p[k] - 0.015 * (1.05 - step / steps) * (m[k] / (1 - 0.9 ** step)) / (
                np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
    return tagger


_TRIGGER = re.compile(r"[0-9@]")
#: Number words and spellings of '@' and '.' in the languages of the given tables.
NUMBERS = {
    "en": "zero one two three four five six seven eight nine oh double triple",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun zwo",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve"}
AT, DOT = "at|ät|arobase|arroba", "dot|punkt|point|punto"
_NUMBER = r"\b(?:" + "|".join(sorted({w for k in NUMBERS.values() for w in k.split()})) + r"|[0-9])\b"
#: 'at' as a word or in brackets, and a spelled dot, or one with a letter on both sides, soon after it.
_AT_DOT = (rf"(?:\b(?:{AT})\b|[\[(]{{1,2}}\s?(?:{AT})\s?[\])]{{1,2}})[^\n]{{1,64}}?"
           rf"(?:\b(?:{DOT})\b|(?<=[^\W_])\.(?=[^\W\d_]))")
_SPELLED = re.compile(rf"(?i)[\[(]{{1,2}}\s?(?:{AT})\s?[\])]{{1,2}}|{_AT_DOT}|(?:{_NUMBER}[\s,./()-]{{0,3}}){{4,}}+")
#: What an added span holds at least: a digit or '@', or a spelled address or number.
_EVIDENT = re.compile(rf"(?i)[0-9@]|{_AT_DOT}|(?:{_NUMBER}[\s,./()-]{{0,3}}){{7}}")


_BORDERS = tuple(",./()-[]{}<>:;\"'!?_")
_NUMBER_WORDS = frozenset(w for k in NUMBERS.values() for w in k.split()) | frozenset("0123456789")
_AT_WORDS, _DOT_WORDS = frozenset(AT.split("|")), frozenset(DOT.split("|"))
_DOTTED = re.compile(r"\.(?=[^\W\d_])")


def _may_spell(text: str) -> bool:
    """Whether the words of a text allow a spelled form; most texts are told by this alone."""
    low = text.lower()
    dotted = _DOTTED.search(low) is not None
    brackets = "(" in low or "[" in low
    for c in _BORDERS:
        low = low.replace(c, " ")
    words = low.split()
    own = set(words)
    if not own.isdisjoint(_AT_WORDS) and (dotted or brackets or not own.isdisjoint(_DOT_WORDS)):
        return True
    return not own.isdisjoint(_NUMBER_WORDS) and b"\1\1\1\1" in bytes(
        map(_NUMBER_WORDS.__contains__, words))


_LABEL = r"[^\W_][\w-]{0,62}"
_DOTS = rf"(?:\s?[\[(]\s?(?:{DOT})\s?[\])]\s?|\s(?:{DOT})\s|\.)"
_NAME = rf"(?<![\w.%+-])(?:{_LABEL}{_DOTS}){{0,3}}[\w%+-]{{1,64}}"
#: Spelled addresses: with 'at' in brackets, or as a word before a known ending after a spelled dot.
_ADDRESS = re.compile(
    rf"(?i){_NAME}(?:\s?[\[(]{{1,2}}\s?(?:{AT})\s?[\])]{{1,2}}\s?{_LABEL}(?:{_DOTS}{_LABEL}){{1,4}}"
    rf"|\s(?:{AT})\s{_LABEL}(?:{_DOTS}{_LABEL}){{0,3}}(?:\s?[\[(]\s?(?:{DOT})\s?[\])]\s?|\s(?:{DOT})\s)"
    r"(?:com|org|net|edu|gov|info|biz|io|eu|de|at|ch|fr|be|es|mx|ar|it|nl|uk|us|ca))\b")
_DIALLED = re.compile(rf"(?i)(?:{_NUMBER}[\s,./()-]{{1,3}}){{6,}}{_NUMBER}")


def spelled_spans(text: str) -> list[Span]:
    """Addresses and numbers spelled in words; digits alone are left to the fixed patterns."""
    if not _may_spell(text):
        return []
    found = [(*m.span(), "email") for m in _ADDRESS.finditer(text)]
    found += [(*m.span(), "phone") for m in _DIALLED.finditer(text)
              if len(set(m[0].lower().split())) > 2 and sum(c.isalpha() for c in m[0]) > 2 * len(_TRIGGER.findall(m[0]))]
    return sorted(found)


def triggers(text: str) -> list[tuple[int, int]]:
    """Places of digits, ``@`` and spelled forms, in order."""
    patterns = (_TRIGGER, _SPELLED) if _may_spell(text) else (_TRIGGER,)
    return sorted(m.span() for own in patterns for m in own.finditer(text))


def whole_words(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without marks after it, and with the rest of words that it cuts, up to ``STRIDE``."""
    while end > start and text[end - 1] in " \n.,;:":
        end -= 1
    a, b = start, end
    while a > 0 and start - a <= STRIDE and text[a - 1].isalnum() and text[a].isalnum():
        a -= 1
    while 0 < b < len(text) and b - end <= STRIDE and text[b].isalnum() and text[b - 1].isalnum():
        b += 1
    return a if start - a <= STRIDE else start, b if b - end <= STRIDE else end


def runs(text: str) -> list[tuple[int, int]]:
    """Stretches within half a window of a trigger, joined where they overlap."""
    found: list[list[int]] = []
    for start, end in triggers(text):
        a, b = max(0, start - STRIDE), min(len(text), end - 1 + STRIDE)
        if found and a <= found[-1][1]:
            found[-1][1] = max(b, found[-1][1])
        else:
            found.append([a, b])
    return [(a, b) for a, b in found]


def window_starts(a: int, b: int) -> range:
    """Overlapping windows that cover the whole stretch."""
    return range(a, max(b - STRIDE, a + 1), STRIDE)


def model_spans(texts: list[str], tagger: Tagger) -> list[list[Span]]:
    """Spans of the model alone, for whole texts; windows of many texts are scored together."""
    places, jobs = [], []
    for t, text in enumerate(texts):
        for a, b in runs(text):
            places.append((t, a, b))
            jobs += [(len(places) - 1, s, text[s: min(s + WINDOW, b)]) for s in window_starts(a, b)]
    sums = [np.zeros((b - a, N_LABELS)) for _, a, b in places]
    weights = [np.zeros((b - a, 1)) for _, a, b in places]
    for at in range(0, len(jobs), 2048):
        part = jobs[at: at + 2048]
        x = np.zeros((len(part), WINDOW), dtype=np.int64)
        for row, (_, _, own) in zip(x, part, strict=True):
            row[: len(own)] = classes_of(own)
        for u, (place, start, own) in zip(tagger.scores(x), part, strict=True):
            n, first = len(own), start - places[place][1]
            edge = np.minimum(np.arange(n), np.arange(n)[::-1])[:, None] + 1.0
            sums[place][first: first + n] += u[:n] * edge
            weights[place][first: first + n] += edge
    out: list[list[Span]] = [[] for _ in texts]
    for (t, a, _), total, weight in zip(places, sums, weights, strict=True):
        y = tagger.decoded(total / np.maximum(weight, 1e-9))
        start, kind = None, 0
        for i, label in enumerate([*y.tolist(), 0]):
            if start is not None and not (label and label % 2 == 0):
                own = texts[t][start: a + i]
                first, last = whole_words(texts[t], a + i - len(own.lstrip()), a + i)
                first = max(first, out[t][-1][1] if out[t] else 0)
                if last - first >= 7 and _EVIDENT.search(texts[t][first:last]):
                    out[t].append((first, last, KINDS[kind]))
                start = None
            if label % 2:
                start, kind = a + i, (label - 1) // 2
    return out


def _beyond(text: str, added: list[Span], taken: list[Span]) -> list[Span]:
    """What added spans hold beside the taken ones; words that only stand next to those are left."""
    found = []
    for start, end, kind in added:
        over = [t for t in taken if t[0] < end and start < t[1]]
        if not over:
            found.append((start, end, kind))
            continue
        a, b = min(t[0] for t in over), max(t[1] for t in over)
        left, right = text[start:a], text[b:end]
        before = re.search(r"\S*\Z", left)[0] if left else ""
        after = re.match(r"\S*", right)[0]
        if any(c.isalnum() for c in before + after):
            found.append((a - len(before), b + len(after), kind))
        for at, part in ((start, left[: len(left) - len(before)]), (b + len(after), right[len(after):])):
            own = part.strip()
            at += len(part) - len(part.lstrip())
            if len(own) >= 7 and _EVIDENT.search(own):
                found.append((at, at + len(own), kind))
    return found


_NUMERIC = re.compile(r"[+(]?[0-9](?:[ ().-]*+[0-9])*+")


def checked(text: str, span: Span) -> list[Span]:
    """What an added span holds that passes the test of its kind.

    Numbers written in digits: a card has 14 to 19 that pass Luhn, a phone 10 to 15, an address
    four parts up to 255. Cards side by side are spans of their own. Words are taken as they are.
    """
    start, end, kind = span
    own = text[start:end]
    if kind == "email" or not re.search("[0-9]", own):
        return [span]
    found = []
    for run in _NUMERIC.finditer(own):
        a, b = start + run.start(), start + run.end()
        if kind == "card":
            found += [(a + i, a + j, kind) for i, j in _cards(run[0])]
        elif kind == "phone":
            if 10 <= len(re.sub("[^0-9]", "", run[0])) <= 15:
                found.append((a, b, kind))
        elif re.fullmatch(r"[0-9]{1,9}(\.[0-9]{1,9}){3}", run[0]) and all(
                int(x) <= 255 for x in run[0].split(".")):
            found.append((a, b, kind))
    return found


def _cards(run: str) -> list[tuple[int, int]]:
    """Valid cards among the groups of digits of a run, leftmost and longest first."""
    groups = list(re.finditer("[0-9]+", run))
    found, i = [], 0
    while i < len(groups):
        digits, last = "", None
        for j in range(i, len(groups)):
            digits += groups[j][0]
            if len(digits) > 19:
                break
            if len(digits) >= 14 and _luhn(digits):
                last = j
        if last is not None:
            found.append((groups[i].start(), groups[last].end()))
        i = i + 1 if last is None else last + 1
    return found


def all_spans(texts: list[str | None], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """Spans of the patterns, and all spans, of each text."""
    texts = [t or "" for t in texts]
    out = []
    for text, added in zip(texts, model_spans(texts, tagger), strict=True):
        base = base_spans(text)
        spelled = _beyond(text, spelled_spans(text), base)
        added = [x for span in added for x in checked(text, span)]
        free = spelled + _beyond(text, added, base + spelled)
        out.append((base, sorted(base + free, key=lambda s: (s[0], KINDS.index(s[2])))))
    return out


#: Labelled spans of forms that the table may lack: text before, span, kind, text after.
def written_spans(seed: int = 4, n: int = 1200) -> list[tuple[str, list[Span]]]:
    rng = np.random.default_rng(seed)
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstu"), int(rng.integers(2, 9))))

    def spelled() -> str:
        at, dot = (("at", "dot"), ("at", "dot"), *zip(AT.split("|"), DOT.split("|"), strict=True))[
            int(rng.integers(2 + len(AT.split("|"))))]
        if rng.random() < 0.2:
            at, dot = at.upper(), dot.upper()
        a, b = rng.choice(["()", "[]", "  "])
        at = f"{a}{at}{b}" if rng.random() < 0.5 and a != " " else f" {a}{at}{b} ".replace("  ", " ")
        dot = "." if rng.random() < 0.4 else f" {a}{dot}{b} ".replace("  ", " ")
        local = word() + (dot + word() if rng.random() < 0.3 else "")
        return f"{local}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es'])}"

    def in_words(least: int, most: int) -> str:
        names = NUMBERS[str(rng.choice(list(NUMBERS)))].split()[:10]
        return " ".join(names[i] for i in rng.integers(0, 10, int(rng.integers(least, most))))

    signs = {
        "email": lambda: f"{local()}{rng.choice(['.', '_', '', '-'])}{d(2)}@{word()}.{rng.choice(['com', 'org', 'example.net'])}",
        "ip": lambda: ".".join(str(x) for x in rng.integers(0, 256, 4)),
        "card": lambda: rng.choice([" ", "-"]).join(d(4) for _ in range(4)),
        "phone": lambda: rng.choice(["", "+1 ", "+49 "]) + f"({d(3)}) {d(3)}-{d(4)}",
    }
    def local() -> str:
        own = word()
        if rng.random() < 0.4:  # a letter that the patterns don't take
            at = int(rng.integers(len(own)))
            own = own[:at] + str(rng.choice(list("äöüßéèêñçíó"))) + own[at + 1:]
        return own

    forms = signs | {
        "email": lambda: spelled() if rng.random() < 0.6 else signs["email"](),
        "phone": lambda: in_words(7, 12) if rng.random() < 0.5 else signs["phone"]()}
    others = [lambda: in_words(4, 6), lambda: f"{word()} at {word()} {word()} the dot {word()} {word()}",
              lambda: d(int(rng.integers(1, 7))), lambda: f"{d(1)}.{d(2)}", lambda: f"v{d(1)}.{d(1)}.{d(1)}",
              lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f'"{"".join(rng.choice(list("0123456789abcdef"), 40))}"',
              lambda: f"{d(3)},{d(3)}", lambda: f"{d(4)}-{d(4)}", lambda: f"@{word()}"]
    found = []
    for i in range(n):
        before = " ".join(word() for _ in range(int(rng.integers(2, 7)))) + " "
        after = rng.choice([" ", ". ", ", "]) + " ".join(word() for _ in range(4))
        if i % 2:
            found.append((before + str(others[i // 2 % len(others)]()) + after, []))
        else:
            kind = KINDS[i // 2 % len(KINDS)]
            own = str(forms[kind]())
            found.append((before + own + after, [(len(before), len(before) + len(own), kind)]))
    return found


def trained(docs: DataFrame, rows: int = ROWS) -> Tagger:
    """A tagger from written labelled spans and at most ``rows`` documents, by a hash of doc_id.

    Documents are labelled by the patterns; of each, only stretches that the tagger would
    read are brought together.
    """
    read = F.col("text").rlike(f"[0-9@]|(?iu)[\\[(]\\s?({AT})\\s?[\\])]|\\b({DOT})\\b")
    short = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(
        read & (F.length("text") < 20_000))
    sample = bounded_sample(short, "doc_id", "text", rows).collect()
    return fitted(written_spans() + [
        (r["text"], base_spans(r["text"]) + spelled_spans(r["text"])) for r in sample])


def digest(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def spotted(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, base and spans (arrays of start, end, kind) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def spot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda spans: [dict(zip(("start", "end", "kind"), s, strict=True)) for s in spans]
        for batch in slices(batches):
            found = all_spans(batch.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([named(f[0]) for f in found], kind),
                 pa.array([named(f[1]) for f in found], kind)],
                names=["doc_id", "base", "spans"])

    spans = "array<struct<start:bigint,end:bigint,kind:string>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        spot, f"doc_id long, base {spans}, spans {spans}")


def redact(text: str, spans: list[Span]) -> str:
    """Each stretch of spans that overlap becomes the name of the first one's kind."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """The documents with personal data replaced, and ``n_chars``, where there is one, renewed."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    at, schema = docs.columns.index("text"), docs.schema
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column(at).to_pylist()
            found = [None if t is None else redact(t, s) for t, (_, s) in
                     zip(texts, all_spans(texts, shared.value), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(found, batch.schema.field(at).type)
            if chars >= 0:
                sizes = [old if a == b else len(b) for old, a, b in
                         zip(columns[chars].to_pylist(), texts, found, strict=True)]
                columns[chars] = pa.array(sizes, batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(replace, schema)
