"""Chat formatting with a grammar round trip.

A conversation is rendered turn by turn, then read back with a deterministic parser. Turns whose text or role doesn't
come back as it was are rendered with their control strings escaped, until the recovered turns equal the source.

    conversation = turn*
    turn         = "[INST]" text "[/INST]"  |  "<s>" text "</s>"  |  "[ROLE=" role "]" text "[/ROLE]"

for user, assistant and other roles. In a text ``\\`` before a control string or another ``\\`` makes that literal;
anywhere else it stands for itself. A bare control string that isn't the turn's end is a conflict.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>", "[ROLE=", "[/ROLE]")
_CONTROL = "|".join(map(re.escape, CONTROLS))
_TO_ESCAPE = re.compile(rf"\\|{_CONTROL}")
_ESCAPED = re.compile(rf"\\(\\|{_CONTROL})")
_MARK = re.compile(rf"\\(?:\\|{_CONTROL})|{_CONTROL}")
_ROLE = re.compile(r"((?:[^\\\]]|\\.)*)\]", re.S)
FRAMES = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}


class Conflict(ValueError):
    """The rendered text has no reading in the grammar."""


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def render_turn(role: str, text: str, escaped: bool) -> tuple[str, str, str]:
    """Opening, content, end."""
    content = escape(text) if escaped else text
    if role in FRAMES:
        return FRAMES[role][0], content, FRAMES[role][1]
    return "[ROLE=" + re.sub(r"[\\\]]", lambda m: "\\" + m[0], role) + "]", content, "[/ROLE]"


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """``(role, text, start, end)`` of each turn; the span is the content's place in ``formatted``."""
    turns, at = [], 0
    while at < len(formatted):
        for role, (opening, end) in FRAMES.items():
            if formatted.startswith(opening, at):
                at += len(opening)
                break
        else:
            if not formatted.startswith("[ROLE=", at) or not (m := _ROLE.match(formatted, at + 6)):
                raise Conflict(f"no turn begins at {at}")
            role, end, at = re.sub(r"\\(.)", r"\1", m[1], flags=re.S), "[/ROLE]", m.end()
        start = at
        for m in _MARK.finditer(formatted, at):
            if m[0][0] == "\\":
                continue
            if m[0] != end:
                raise Conflict(f"{m[0]} inside the turn at {start}")
            turns.append((role, unescape(formatted[start : m.start()]), start, m.start()))
            at = m.end()
            break
        else:
            raise Conflict(f"the turn at {start} doesn't end")
    return turns


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of assistant contents (the loss mask), after a round trip that came back identical."""
    escaped = []
    for role, text in turns:
        conflict = False
        if "\\" in text or "[" in text or "<" in text:
            try:
                conflict = [x[:2] for x in parse("".join(render_turn(role, text, False)))] != [(role, text)]
            except Conflict:
                conflict = True
        escaped.append(conflict)
    while True:
        formatted = "".join("".join(render_turn(r, t, e)) for (r, t), e in zip(turns, escaped, strict=True))
        try:
            back = parse(formatted)
        except Conflict:
            back = []
        if [x[:2] for x in back] == turns:
            return formatted, [(start, end) for role, _, start, end in back if role == "assistant"]
        if all(escaped):
            raise Conflict("escaping every turn doesn't make the conversation come back identical")
        same = [i < len(back) and back[i][:2] == turns[i] for i in range(len(turns))]
        escaped = [e or not s for e, s in zip(escaped, same, strict=True)] if escaped != [e or not s for e, s in zip(escaped, same, strict=True)] else [True] * len(turns)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans`` for each conversation of ``rows(conv_id, turn, role, text, ...)``.

    Rows are taken by turn (null first), ties by role and then text; repeated rows are turns of their own. Null texts and
    roles are empty; rows without conv_id form one conversation. An empty table gives an empty result, other columns are ignored.
    Each conversation is read as a stream of sorted rows and held in memory alone.
    """
    slim = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        def rows_of():
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)

        out, held = [], 0
        current, turns = None, []

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([[{"start": s, "end": e} for s, e in x[2]] for x in out], _SPANS)],
                names=["conv_id", "formatted", "loss_spans"],
            )

        for conv, role, text in rows_of():
            if turns and conv != current:
                out.append((current, *format_turns(turns)))
                held += len(out[-1][1])
                turns = []
                if held > 4_000_000:
                    yield flush()
                    out, held = [], 0
            current = conv
            turns.append((role, text))
        if turns:
            out.append((current, *format_turns(turns)))
        if out:
            yield flush()

    return ordered.mapInArrow(run, "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations hold, by parsing them."""

    def run(batches):
        for b in batches:
            out = ([], [], [], [], [])
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = parse(text)
                whole = hashlib.sha256()
                for role, said, _, _ in turns:
                    whole.update(f"{role}\n{said}\n".encode())
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                for column, value in zip(out, (len(turns), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
