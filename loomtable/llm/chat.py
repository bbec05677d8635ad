"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A record's layout is the set of its nested field paths, without those that no
mapping names; the hash of the sorted paths selects a mapping from a registry.  Mappings are data: where the
turns lie and which field plays which role.  Canonical turns are then written
with a template whose control strings are escaped, reversibly, inside texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtable.llm.common import partitions

# The template's own control strings, and those of other common templates.
TURN, TEXT, STOP = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = [TURN, TEXT, STOP, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_CONTROL = re.compile("|".join(re.escape(x) for x in [*CONTROL, "\\"]))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(STOP)}", re.S)


def escape(text: str) -> str:
    """Double every backslash and put one behind the first character of a control string."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def field_paths(value, path: str = "") -> set[str]:
    """Paths of a JSON value's fields; items of arrays share a path, and nulls and empty arrays show no field below them."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{path}.{k}" if path else k)} or {path}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{path}[]")} or {f"{path}[]"}
    return {path}


def schema_paths(kind: T.DataType, path: str = "") -> set[str]:
    """The same for a Spark schema."""
    if isinstance(kind, T.StructType):
        return {p for f in kind for p in schema_paths(f.dataType, f"{path}.{f.name}" if path else f.name)}
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{path}[]")
    return {path}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _text(record: dict, name: str) -> str:
    """A text field, empty if it is null or missing; ValueError if it is no text or UTF-8 can't express it."""
    x = record.get(name)
    if x is None:
        return ""
    if not isinstance(x, str):
        raise ValueError(f"{name} is no text")
    x.encode()  # half a surrogate pair raises UnicodeEncodeError, a ValueError
    return x


@dataclass(frozen=True)
class Mapping:
    """Where a layout's turns lie.

    ``turns`` names a list of messages with ``role`` and ``text`` inside; or
    ``parts`` lists (role, field, ...) in order, several fields of a role
    being joined by an empty line.  ``roles`` renames roles.
    """

    name: str
    paths: frozenset[str]
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    parts: tuple[tuple[str, ...], ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def apply(self, record: dict) -> list[tuple[str, str]]:
        """Turns (role, text) of a record; ValueError if a value has another type than the layout says."""
        if self.turns is not None:
            rows = [record] if self.turns == "" else record.get(self.turns) or []
            if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
                raise ValueError("turns must be a list of objects")
            return [(self.roles.get(_text(r, self.role), _text(r, self.role)), _text(r, self.text)) for r in rows]
        out = []
        for role, *names in self.parts:
            text = "\n\n".join(x for x in (_text(record, n) for n in names) if x)
            if text or role != "system":
                out.append((role, text))
        return out


_SHARE = {"human": "user", "gpt": "assistant", "bot": "assistant"}
MAPPINGS: list[Mapping] = [
    Mapping("prompt", frozenset({"prompt", "completion"}), parts=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", frozenset({"prompt", "response"}), parts=(("user", "prompt"), ("assistant", "response"))),
    Mapping("question", frozenset({"question", "answer"}), parts=(("user", "question"), ("assistant", "answer"))),
    Mapping("instruction", frozenset({"instruction", "input", "output"}), parts=(("user", "instruction", "input"), ("assistant", "output"))),
    Mapping("instruction_short", frozenset({"instruction", "output"}), parts=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_system", frozenset({"system", "instruction", "input", "output"}), parts=(("system", "system"), ("user", "instruction", "input"), ("assistant", "output"))),
    Mapping("messages", frozenset({"messages[].role", "messages[].content"}), turns="messages"),
    Mapping("share", frozenset({"conversations[].from", "conversations[].value"}), turns="conversations", role="from", text="value", roles=_SHARE),
    Mapping("turn_rows", frozenset({"conv_id", "turn", "role", "text"}), turns="", text="text"),
]


def registry(mappings: list[Mapping]) -> dict[str, Mapping]:
    return {fingerprint(set(m.paths)): m for m in mappings}


def select_mapping(paths: set[str], known: dict[str, Mapping]) -> Mapping | None:
    """The mapping of a layout by its hash; paths that no mapping names are set aside."""
    named = {p for m in known.values() for p in m.paths}
    return known.get(fingerprint(paths & named))


def canonical(record: str | None, known: dict[str, Mapping]) -> tuple[str, list[tuple[str, str]]]:
    """(mapping's name, turns) of a JSON record.

    ("unknown", []) if it is no JSON object, is nested too deeply to be read,
    has the fingerprint of no mapping, or holds values of other types than
    its layout's, or texts that UTF-8 can't express.
    """
    try:
        value = json.loads(record) if record else None
        m = select_mapping(field_paths(value), known) if isinstance(value, dict) else None
        return (m.name, m.apply(value)) if m else ("unknown", [])
    except (ValueError, RecursionError):
        return "unknown", []


def canonical_turns(records: DataFrame, id_col: str, json_col: str, mappings: list[Mapping] | None = None) -> DataFrame:
    """Turns (conv_id, turn, role, text, layout) of JSON records, each in a layout of its own.

    Records without a known layout, null and broken ones, and those whose
    values have other types than their layout's, give one row with
    layout "unknown" and null turn, role and text, so that none is lost.
    """
    known = registry(MAPPINGS if mappings is None else mappings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                name, turns = canonical(x, known)
                rows += [(i, k, r, t, name) for k, (r, t) in enumerate(turns)] or [(i, None, None, None, name)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["conv_id", "turn", "role", "text", "layout"])

    return records.select(F.col(id_col).cast("long"), F.col(json_col).cast("string")).mapInArrow(run, "conv_id long, turn long, role string, text string, layout string")


def turn_rows(rows: DataFrame, mappings: list[Mapping] | None = None) -> DataFrame:
    """Canonical turn rows of a table that has a row a turn, by the fingerprint of its own schema.

    Only row-wise mappings are in the registry here: columns that none of
    them names are set aside.
    """
    paths = schema_paths(rows.schema)
    m = select_mapping(paths, registry([m for m in (MAPPINGS if mappings is None else mappings) if m.turns == ""]))
    if m is None:
        raise ValueError(f"no mapping for the field paths {sorted(paths)}")
    # without the scan of records: the mapping as a projection
    role = F.coalesce(F.col(m.role).cast("string"), F.lit(""))
    for a, b in m.roles.items():
        role = F.when(role == a, b).otherwise(role)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.coalesce(F.col(m.text).cast("string"), F.lit("")).alias("text"))


def format_turn(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """A turn's formatted string, and where the loss mask lies in it (texts of the assistant)."""
    head = f"{TURN}{escape(role)}{TEXT}"
    body = escape(text)
    return f"{head}{body}{STOP}", (len(head), len(head) + len(body)) if role == "assistant" else None


_FORMATTED = "conv_id long, part long, formatted string, loss array<struct<start: long, end: long>>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def format_chat(turns: DataFrame, part_chars: int = 1 << 20) -> DataFrame:
    """Format canonical turn rows: conv_id, part, formatted, loss (spans of code points in ``formatted``).

    A conversation's turns follow their number, ties by role and text; null
    roles and texts are empty, null ids form a conversation of their own, an
    empty table gives no row.  A conversation longer than ``part_chars`` is
    written as several parts of whole turns, so that its size doesn't bound
    a task's memory; parts stand in order, conversation by conversation.
    """
    ordered = turns.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, chunks, spans, size = (), 0, [], [], 0
        for b in batches:
            done = []
            for conv, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now != (conv,):
                    if now:
                        done.append((now[0], part, "".join(chunks), spans))
                    now, part, chunks, spans, size = (conv,), 0, [], [], 0
                elif size >= part_chars:
                    done.append((conv, part, "".join(chunks), spans))
                    part, chunks, spans, size = part + 1, [], [], 0
                turn, loss = format_turn(role, text)
                if loss:
                    spans.append({"start": size + loss[0], "end": size + loss[1]})
                chunks.append(turn)
                size += len(turn)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _ARROW, strict=True)], schema=_ARROW)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((now[0], part, "".join(chunks), spans), _ARROW, strict=True)], schema=_ARROW)

    return ordered.mapInArrow(run, _FORMATTED)


def read_chat(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted string."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def digests(formatted: DataFrame) -> DataFrame:
    """Digests of what formatted conversations say when read back, in one pass over ordered parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now = None

        def close(x: list) -> tuple:
            return x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]

        for b in batches:
            done = []
            for conv, part, text, loss in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part == 0:
                    if now:
                        done.append(close(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = read_chat(text)
                now[1] += len(turns)
                for role, said in turns:
                    now[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    now[3] += len(said)
                    now[4].update(said.encode("utf-8", "surrogatepass"))
                now[5] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(close(now), kinds, strict=True)], names=names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
