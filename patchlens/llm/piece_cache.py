"""Ids of whole texts by a public tokenizer, with bounded caches of repeated stretches.

Both vocabularies used here cut a text, before each merge step, at single spaces between
visible characters and where runs of letters, digits, signs and line ends meet. Ids of the
stretches between such cuts, put together, are the ids of the whole text. A stretch met before
is looked up; the library encodes the others.
"""

from __future__ import annotations

import os
import re
from collections import ChainMap
from collections.abc import Iterable

import numpy as np

from patchlens.llm.common import CACHES

#: Bytes of stretches and ids kept by each Python worker, of either kind and generation: four
#: times as much at most.
CACHE_BYTES = 64_000_000
#: What an entry takes besides its characters and ids.
ENTRY_BYTES = 200
#: Longer stretches aren't kept.
CACHE_CHARS = 40
#: White space that some versions of Unicode count and others don't.
_BORDER = "\u180e"
_CUT = re.compile(rf"(?<=[^\s{_BORDER}])(?= [^\s{_BORDER}])")
#: Latin letters, digits, signs but the apostrophe, which begins endings of its own.
#: Without the dotted capital I, whose lower case ends in a combining dot.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_SIGN = r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(rf"(?!\n|[^\n]*\n\Z)(?:[{_LETTER}0-9{_SIGN}]|\n(?!\n))+")
_CORE = re.compile(rf"[{_LETTER}]+|[0-9]+|[{_SIGN}]+|\n")
#: Texts whose every cut can be seen from two neighbouring characters, and their stretches.
_PLAIN_TEXT = re.compile(rf"(?:[{_LETTER}0-9{_SIGN}]++|[ \n](?=[{_LETTER}0-9{_SIGN}]))*+")
_SPACED = re.compile(rf" ?[{_LETTER}]+| ?[0-9]+| ?[{_SIGN}]+|\n")
_BARE = re.compile(rf"[{_LETTER}]+|[0-9]+|[{_SIGN}]+")
#: Runs of letters or digits: many of them are encoded as one text, with a sign between that
#: has one id of its own and ends the run before it.
_WORD = re.compile(rf" ?(?:[{_LETTER}]+|[0-9]+)")
_BETWEEN, _TOGETHER = "!", 2000


class Generations:
    """A bounded cache: when full, what wasn't asked for since the last time is forgotten."""

    def __init__(self, limit: int) -> None:
        self.limit, self.bytes, self.young, self.old = limit, 0, {}, {}

    def lacks(self, groups: Iterable[Iterable[str]]) -> list[str]:
        """The keys that aren't known; the others are in ``young`` from now on."""
        if self.bytes > self.limit:
            self.young, self.old, self.bytes = {}, self.young, 0
        away = set().union(*groups).difference(self.young)
        self.keep({k: self.old[k] for k in away if k in self.old})
        return [k for k in away if k not in self.old]

    def keep(self, found: dict[str, bytes]) -> None:
        self.young.update(found)
        self.bytes += ENTRY_BYTES * len(found) + sum(map(len, found)) + sum(
            map(len, found.values()))


def tokenizer_path(name: str) -> str:
    """The installed file of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCache:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``keeps_space``: the vocabulary sees the space before a word (byte-level) or drops it.
    """

    def __init__(self, path: str, keeps_space: bool, limit: int = CACHE_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space = keeps_space
        self.known, self.cores = Generations(limit), Generations(limit)
        self.between = self.tokenizer.encode(_BETWEEN, add_special_tokens=False).ids

    def _encode(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of each piece; a call of the library costs more than a short word."""
        found: dict[str, bytes] = {}
        words = [p for p in pieces if _WORD.fullmatch(p)] if len(self.between) == 1 else []
        for at in range(0, len(words), _TOGETHER):
            found.update(self._encode_words(words[at: at + _TOGETHER]))
        if len(found) < len(pieces):
            others = [p for p in pieces if p not in found]
            for p, e in zip(others, self.tokenizer.encode_batch_fast(
                    others, add_special_tokens=False), strict=True):
                found[p] = np.array(e.ids, dtype="<u4").tobytes()
        return found

    def _encode_words(self, words: list[str]) -> Iterable[tuple[str, bytes]]:
        text = _BETWEEN.join([*words, ""])
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        ids = np.array(found[0].ids, dtype="<u4")
        ends = np.flatnonzero(ids == self.between[0])
        if len(ends) != len(words):
            raise ValueError("a run of letters has the id of the sign between runs")
        raw, starts = ids.tobytes(), [0, *(4 * ends[:-1] + 4).tolist()]
        return zip(words, [raw[a:b] for a, b in zip(starts, (4 * ends).tolist(), strict=True)],
                   strict=True)

    @staticmethod
    def _inner(piece: str) -> bool:
        """Visible at both ends, so the text is cut on either side of it."""
        return bool(piece) and not (
            piece[0].isspace() or piece[-1].isspace() or _BORDER in (piece[0], piece[-1])
        )

    def _stretches(self, pieces: list[str]) -> list[bytes]:
        """Ids of stretches, put together from those of their runs where these are plain."""
        runs = [self._runs(p) for p in pieces]
        found = self._of_runs(runs)
        return [b"".join(map(found.__getitem__, own)) for own in runs]

    def _of_runs(self, groups: list[list[str]]):
        """A mapping that has the ids of each run in these lists."""
        found = self._encode(self.cores.lacks(groups))
        kept = {r: ids for r, ids in found.items() if len(r) <= CACHE_CHARS}
        self.cores.keep(kept)
        return self.cores.young if len(kept) == len(found) else ChainMap(found, self.cores.young)

    @staticmethod
    def _runs(piece: str) -> list[str]:
        lead = piece[:1] == " "
        if "<|" in piece or not _PLAIN.fullmatch(piece, int(lead)):
            return [piece]
        own = _CORE.findall(piece, int(lead))
        if lead:
            own[0] = f" {own[0]}"
        return own

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each whole text as bytes; a null text is an empty one."""
        texts = [t or "" for t in texts]
        cut = (_SPACED if self.keeps_space else _BARE).findall
        runs = [
            cut(t) if "<|" not in t and _PLAIN_TEXT.fullmatch(t) else None for t in texts
        ]
        found = self._of_runs([r for r in runs if r is not None])
        out = [None if r is None else b"".join(map(found.__getitem__, r)) for r in runs]
        others = [i for i, r in enumerate(runs) if r is None]
        for i, ids in zip(others, self._by_words([texts[i] for i in others]), strict=True):
            out[i] = ids
        return out

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """The same for texts of any kind."""
        lead = " " if self.keeps_space else ""
        split = [t.split(" ") for t in texts]
        new = [p for p in self.known.lacks(split) if self._inner(p)]
        known, local = self.known.young, {}
        found = dict(zip(new, self._stretches([lead + p for p in new]), strict=True))
        self.known.keep({p: ids for p, ids in found.items() if len(p) <= CACHE_CHARS})
        local.update((p, ids) for p, ids in found.items() if len(p) > CACHE_CHARS)
        first = self._stretches([words[0] for words in split])
        out = []
        for text, words, ids in zip(texts, split, first, strict=True):
            try:
                if not self._inner(words[0]):
                    raise KeyError
                out.append(b"".join([ids, *map(known.__getitem__, words[1:])]))
            except KeyError:
                out.append(self._by_cuts(text, local))
        return out

    def _by_cuts(self, text: str, local: dict[str, bytes]) -> bytes:
        """For texts with doubled spaces, long stretches or white space beside a space."""
        cuts = _CUT.split(text)
        parts: list[bytes | None] = [None] * len(cuts)
        for i, c in enumerate(cuts[1:], 1):
            parts[i] = local[c[1:]] if c[1:] in local else (
                self.known.young.get(c[1:]))
        lost = [i for i, p in enumerate(parts) if p is None]
        stripped = [cuts[i] if self.keeps_space or not i else cuts[i][1:] for i in lost]
        for i, ids in zip(lost, self._stretches(stripped), strict=True):
            parts[i] = ids
        return b"".join(parts)


def slice_chars(limit: int) -> int:
    """Texts of about this many characters are encoded together beside a cache of that size."""
    return max(limit // 48, 100_000)


def shared_cache(path: str, keeps_space: bool, limit: int = CACHE_BYTES) -> PieceCache:
    """This worker's cache, kept from task to task."""
    key = (path, keeps_space, limit)
    if key not in CACHES:
        CACHES.clear()  # one vocabulary at a time
        CACHES[key] = PieceCache(path, keeps_space, limit)
    return CACHES[key]
