"""Chat formatting: records of many layouts into canonical turns, by the fingerprint of their schema."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A turn is "<s>[ROLE]" + role + "[INST]" + text + "[/INST]</s>" of an assistant's and any other role alike; a role is escaped as a text is.
OPEN, MIDDLE, CLOSE = "<s>[ROLE]", "[INST]", "[/INST]</s>"
#: The only characters that control strings begin with, and the escape itself: escaped, no text can hold a control string.
_SPECIAL = re.compile(r"[\\<\[]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: A formatted conversation is cut into parts after a turn that brings it to that many characters.
PART_CHARS = 1 << 20


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


# --- layouts ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns: `turns` names the list of messages ("" if there is none) with its role and text fields,
    and `fixed` lists (role, path) of single texts, in order. Paths are dotted; roles are renamed by `roles`."""

    layout: str
    turns: str = ""
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    def paths(self) -> frozenset[str]:
        listed = {self.turns, f"{self.turns}[]", f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"} if self.turns else set()
        for _, path in self.fixed:
            keys = path.split(".")
            listed |= {".".join(keys[: i + 1]) for i in range(len(keys))}
        return frozenset(listed)


def paths_of(value: Any, path: str = "") -> set[str]:
    """Nested field paths: names joined by dots, [] for the items of a list. Values and list lengths make no difference."""
    found = {path} if path else set()
    if isinstance(value, dict):
        for k, v in value.items():
            found |= paths_of(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for v in value:
            found |= paths_of(v, f"{path}[]")
    return found


def fingerprint(paths: set[str] | frozenset[str]) -> str:
    return hashlib.sha1("\n".join(sorted(paths)).encode()).hexdigest()[:16]


MAPPINGS = (
    Mapping("messages", "messages", "role", "content"),
    Mapping("conversations", "conversations", "from", "value", roles={"human": "user", "gpt": "assistant"}),
    Mapping("system+messages", "messages", "role", "content", fixed=(("system", "system"),)),
    Mapping("prompt-response", fixed=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt-completion", fixed=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("question-answer", fixed=(("user", "question"), ("assistant", "answer"))),
    Mapping("instruction-output", fixed=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction-input-output", fixed=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("prompt", fixed=(("user", "prompt"),)),
    Mapping("response", fixed=(("assistant", "response"),)),
    Mapping("system", fixed=(("system", "system"),)),
)


def registry(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, Mapping]:
    return {fingerprint(m.paths()): m for m in mappings}


def _at(value: Any, path: str) -> Any:
    for k in path.split("."):
        value = value.get(k) if isinstance(value, dict) else None
    return value


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def to_turns(record: Any, known: dict[str, Mapping]) -> tuple[str, list[tuple[str, str]]]:
    """(layout, [(role, text)]) of a record. An empty list of messages has fewer paths; so the list's own path is tried then."""
    found = paths_of(record)
    m = known.get(fingerprint(found))
    if m is None and isinstance(record, dict):
        m = next((x for x in known.values() if x.turns and _at(record, x.turns) == [] and found == {p for p in x.paths() if "[]" not in p}), None)
    if m is None:
        return "unknown", []
    turns = [(role, _text(_at(record, path))) for role, path in m.fixed]
    for item in (_at(record, m.turns) or []) if m.turns else []:
        role = _text(_at(item, m.role))
        turns.append((m.roles.get(role, role), _text(_at(item, m.text))))
    return m.layout, turns


def canonical_turns(records: DataFrame, id_col: str = "conv_id", order_col: str = "turn", record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Turns of JSON records of any registered layout: id_col, order_col, part (within the record), role, text, layout.

    A record's nested field paths are hashed, and the hash selects a declarative mapping. A record of an unregistered layout,
    or one that is no JSON, gives one row of layout "unknown" with null role and text, so that nothing is lost unseen.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = registry(mappings)
        for batch in batches:
            out = []
            for i, order, raw in zip(*(batch.column(c).to_pylist() for c in ("_id", "_order", "_record")), strict=True):
                try:
                    layout, turns = to_turns(json.loads(raw), known)
                except (ValueError, TypeError):
                    layout, turns = "unknown", []
                if layout == "unknown":
                    out.append((i, order, 0, None, None, layout))
                out.extend((i, order, k, role, text, layout) for k, (role, text) in enumerate(turns))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "ord", "part", "role", "text", "layout"])

    rows = records.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{order_col}`").cast("long").alias("_order"), F.col(f"`{record_col}`").alias("_record"))
    return rows.mapInArrow(convert, "id long, ord long, part int, role string, text string, layout string").withColumnsRenamed({"id": id_col, "ord": order_col})


# --- template ----------------------------------------------------------------------------------------

_FORMATTED = "conv_id long, chunk int, formatted string, loss array<struct<start:long,stop:long>>"


def format_chats(turns: DataFrame, id_col: str = "conv_id", order_col: str = "turn") -> DataFrame:
    """Formatted conversations: id_col, chunk, formatted, loss (character spans of assistants' texts within `formatted`).

    Turns are dealt by conversation, sorted on disk and written as they stream by; a conversation longer than PART_CHARS goes
    on in further chunks, so no conversation is ever held whole. Concatenated in order of chunk they are the conversation.

    Defined cases: null text is empty; null role is the empty role; equal turn numbers are ordered by part, role, text; a
    null id is a conversation of its own; rows of layout "unknown" are left out, as they have no turn; an empty table gives no row.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int32()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
        begun, now, chunk, pieces, spans, chars, out = False, None, 0, [], [], 0, []

        def close() -> None:
            out.append({"conv_id": now, "chunk": chunk, "formatted": "".join(pieces), "loss": spans})

        for batch in batches:
            for i, role, text in zip(*(batch.column(c).to_pylist() for c in ("_id", "_role", "_text")), strict=True):
                if begun and i != now:
                    close()
                    chunk, pieces, spans, chars = 0, [], [], 0
                elif begun and chars >= PART_CHARS:
                    close()
                    chunk, pieces, spans, chars = chunk + 1, [], [], 0
                begun, now = True, i
                head, body = f"{OPEN}{escape(role)}{MIDDLE}", escape(text)
                if role == "assistant":
                    spans.append({"start": chars + len(head), "stop": chars + len(head) + len(body)})
                pieces += [head, body, CLOSE]
                chars += len(head) + len(body) + len(CLOSE)
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out.clear()
        if begun:
            close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    if "layout" in turns.columns:
        turns = turns.where("layout <> 'unknown'")
    rows = turns.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{order_col}`").alias("_order"), F.col("part") if "part" in turns.columns else F.lit(0).alias("part"), F.coalesce("role", F.lit("")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text"))
    return rows.repartition("_id").sortWithinPartitions("_id", "_order", "part", "_role", "_text").mapInArrow(write, _FORMATTED).withColumnRenamed("conv_id", id_col)


_TURN = re.compile(r"<s>\[ROLE\]((?:[^\\\[<]|\\.)*)\[INST\]((?:[^\\\[<]|\\.)*)\[/INST\]</s>", re.DOTALL)


def parse_chat(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation or chunk."""
    found, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return found


def read_chats(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What formatted conversations hold: id_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    turns_sha256 is over role, line break, text, line break of each turn; loss_* are over the unescaped text under the loss
    mask. Chunks stream by in order and are hashed as they come.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, out = False, None, []
        turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

        def close() -> None:
            out.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

        for batch in batches:
            for i, text, spans in zip(*(batch.column(c).to_pylist() for c in ("_id", "formatted", "loss")), strict=True):
                if begun and i != now:
                    close()
                    turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                begun, now = True, i
                for role, said in parse_chat(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for s in spans:
                    under = unescape(text[s["start"] : s["stop"]])
                    loss.update(under.encode())
                    loss_chars += len(under)
                chars += len(text)
        if begun:
            close()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        cols = list(zip(*out, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    rows = formatted.select(F.col(f"`{id_col}`").alias("_id"), "chunk", "formatted", "loss").repartition("_id").sortWithinPartitions("_id", "chunk")
    return rows.mapInArrow(read, "id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("id", id_col)
