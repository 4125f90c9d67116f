"""Chat records of many layouts to one template, chosen by the fingerprint of their fields.

A record is a JSON object. The paths of its nested fields (``messages[].role``) are hashed, in
order, to a fingerprint, which selects a declarative mapping: a list of parts, each either
one field with a fixed role or a list of objects with a role and a text field. The turns found
are written by a template that marks turns and escapes its own control strings in texts, so
that they can be read back exactly.

Template of a turn: ``### role: text</turn>`` and a line end. In texts and roles a backslash is
doubled and ``###`` and ``</turn>`` get one in front, in roles ``:`` too.

Defined results: a null text is an empty one and a null role the empty role; a number or truth
value counts as its JSON text, an empty list or object as an empty text; a lone surrogate
becomes a question mark; fields that a mapping calls optional may be absent, null or empty, and
then give no turn; a record that isn't a JSON object, is nested too deeply to be read, has an
unknown fingerprint or something else where a list of objects belongs keeps its row, with null
turns and text; no records give no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"
#: Other names of roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Part:
    """One field spoken by ``role``, or, with ``each``, the objects of a list."""

    field: str
    role: str
    each: str | None = None
    optional: bool = False

    @property
    def paths(self) -> list[str]:
        if self.each:
            return [f"{self.each}[].{self.role}", f"{self.each}[].{self.field}"]
        return [self.field]


#: Layouts: prompt, instruction and message records as they are commonly published.
LAYOUTS: dict[str, list[Part]] = {
    "messages": [Part("system", "system", optional=True),
                 Part("content", "role", each="messages")],
    "conversations": [Part("system", "system", optional=True),
                      Part("value", "from", each="conversations")],
    "dialog": [Part("text", "speaker", each="dialog")],
    "prompt_completion": [Part("system", "system", optional=True), Part("prompt", "user"),
                          Part("completion", "assistant")],
    "prompt_response": [Part("system", "system", optional=True), Part("prompt", "user"),
                        Part("response", "assistant")],
    "question_answer": [Part("question", "user"), Part("answer", "assistant")],
    "instruction": [Part("system", "system", optional=True), Part("instruction", "user"),
                    Part("input", "user", optional=True), Part("output", "assistant")],
}


def paths_of(value, prefix: str = "") -> set[str]:
    """Paths of the leaves: fields by name, list items by ``[]``; an empty list is a leaf."""
    if isinstance(value, dict):
        names = {k: k if k.isalpha() else re.sub(r"([\\.\[])", r"\\\1", k) for k in value}
        return set().union(*(paths_of(v, f"{prefix}.{names[k]}" if prefix else names[k])
                             for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(paths_of(v, f"{prefix}[]") for v in value))
    return {prefix}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "replace")).hexdigest()[:16]


def known_layouts(layouts: dict[str, list[Part]]) -> dict[str, str]:
    """Fingerprint to layout name, for each choice of optional fields."""
    found = {}
    for name, parts in layouts.items():
        fixed = {p for part in parts if not part.optional for p in part.paths}
        free = [part.paths for part in parts if part.optional]
        for chosen in itertools.product((False, True), repeat=len(free)):
            own = fixed.union(*(p for p, use in zip(free, chosen, strict=True) if use))
            found.setdefault(fingerprint(own), name)
        lists = [part.each for part in parts if part.each]
        if lists:  # a record without any message
            found.setdefault(fingerprint(set(lists)), name)
    return found


def text_of(value) -> str:
    """A text; numbers and truth values as in JSON, nothing for null and empty values."""
    if value is None or isinstance(value, (list, dict)):
        return ""
    text = value if isinstance(value, str) else json.dumps(value)
    return text.encode("utf-8", "replace").decode()


def turns_of(record: dict, parts: list[Part]) -> list[tuple[str, str]]:
    """The turns of a record; a ValueError if a list of objects is something else."""
    found = []
    for part in parts:
        if part.each:
            items = record.get(part.each)
            items = [] if items is None else items
            if not isinstance(items, list) or not all(isinstance(i, dict) for i in items):
                raise ValueError(f"{part.each} is no list of objects")
            for item in items:
                role = text_of(item.get(part.role))
                found.append((ROLE_NAMES.get(role, role), text_of(item.get(part.field))))
        else:
            text = text_of(record.get(part.field))
            if text or not part.optional:
                found.append((part.role, text))
    # an instruction and its input are one turn of the user
    merged: list[tuple[str, str]] = []
    for role, text in found:
        if merged and merged[-1][0] == role and not any(p.each for p in parts):
            merged[-1] = (role, f"{merged[-1][1]}\n{text}")
        else:
            merged.append((role, text))
    return merged


def escaped(text: str, *more: str) -> str:
    text = text.replace("\\", "\\\\")
    for mark in ("###", "</turn>", *more):
        text = text.replace(mark, f"\\{mark}")
    return text


_ESCAPE = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\<]|<(?!/turn>))*)</turn>\n", re.S)


def unescaped(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text and the spans (code points) that a model is trained on."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"### {escaped(role, ':')}: ", escaped(text)
        if role == TRAINED_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}</turn>\n")
        at += len(out[-1])
    return "".join(out), spans


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    found, at = [], 0
    while at < len(text):
        turn = _TURN.match(text, at)
        if not turn:
            raise ValueError(f"no turn at {at}")
        found.append((unescaped(turn[1]), unescaped(turn[2])))
        at = turn.end()
    return found


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_records(records: DataFrame, key: str, record: str = "record",
                   layouts: dict[str, list[Part]] | None = None) -> DataFrame:
    """key, fingerprint, layout, turns, formatted, loss_spans of every record."""
    layouts = LAYOUTS if layouts is None else layouts

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_layouts(layouts)
        for batch in batches:
            rows = []
            for raw in batch.column(1).to_pylist():
                try:
                    value = json.loads(raw) if raw else None
                    paths = paths_of(value) if isinstance(value, dict) else None
                except (ValueError, RecursionError):
                    paths = None
                if paths is None:
                    rows.append((None,) * 5)
                    continue
                mark = fingerprint(paths)
                try:
                    turns = turns_of(value, layouts[known[mark]])
                except (KeyError, ValueError):  # an unknown layout, or not what it says
                    rows.append((mark, *(None,) * 4))
                    continue
                text, spans = formatted(turns)
                rows.append((mark, known[mark],
                             [{"role": r, "text": t} for r, t in turns], text,
                             [{"start": a, "end": b} for a, b in spans]))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.string(), pa.string(), _TURNS, pa.string(), _SPANS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=[key, "fingerprint", "layout", "turns", "formatted", "loss_spans"])

    own = records.select(F.col(key), F.col(record).cast("string").alias("_record"))
    kind = own.schema[key].dataType.simpleString()
    return own.mapInArrow(
        convert, f"`{key}` {kind}, fingerprint string, layout string, "
        "turns array<struct<role:string,text:string>>, formatted string, "
        "loss_spans array<struct<start:bigint,end:bigint>>")


def digests(formatted_rows: DataFrame, key: str) -> DataFrame:
    """What is read back from formatted texts: turns, trained text and their digests."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(),
                                   strict=True):
                turns = parsed(text or "")
                every, trained = hashlib.sha256(), hashlib.sha256()
                for role, own in turns:
                    every.update(f"{role}\n{own}\n".encode("utf-8", "replace"))
                chars = 0
                for span in spans or []:
                    own = unescaped(text[span["start"]: span["end"]])
                    trained.update(own.encode("utf-8", "replace"))
                    chars += len(own)
                rows.append((len(turns), every.hexdigest(), chars, trained.hexdigest(),
                             len(text or "")))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=[key, *names])

    names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    own = formatted_rows.select(key, "formatted", "loss_spans")
    kind = own.schema[key].dataType.simpleString()
    return own.mapInArrow(read, f"`{key}` {kind}, n_turns long, turns_sha256 string, "
                                "loss_chars long, loss_sha256 string, formatted_chars long")


def message_records(rows: DataFrame) -> DataFrame:
    """conv_id and a record of layout ``messages`` of each conversation, turns in order.

    Turns with equal numbers are ordered by role and text. A conversation is one record by
    its nature; its rows are all that a group holds.
    """
    turns = F.array_sort(F.collect_list(F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("content"))))
    messages = F.transform(turns, lambda t: F.struct(t["role"], t["content"]))
    return rows.groupBy("conv_id").agg(messages.alias("messages")).select(
        "conv_id", F.to_json(F.struct("messages")).alias("record"))
