"""Chat formatting: conversations rendered by a compiled template, and read back.

Rows of one conversation stream through the template in the order of their
turns; what a task holds is one turn and the part of the output that is being
filled, so a conversation of any length fits.  An output of more than
PART_CHARS characters is cut into parts between turns.

The default template marks turns by control strings.  Inside roles and texts
each control string and each backslash gets a backslash in front, so that no
text can pass for a mark, and taking the backslashes away gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .template import END, START, compile_template

PART_CHARS = 1 << 20

CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>", "[SYS]", "[NAME]", "[/SYS]")
TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}[INST]{{ m.text | escape }}[/INST]"
    "{% elif m.role == 'assistant' %}<s>{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}[SYS]{{ m.role | escape }}[NAME]{{ m.text | escape }}[/SYS]{% endif %}"
    "{% endfor %}"
)
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\|" + _CONTROL.pattern)
_SCAN = re.compile(r"\\.|" + _CONTROL.pattern, re.S)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m[0], text or "")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FORMATTED = "conv_id long, part int, text string, loss array<struct<start:int,end:int>>"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, part, text, loss: the rendered text and its spans under the loss mask.

    Input: conv_id, turn, role, text.  Turns go by turn (null first), then by
    role and text where turns tie; repeated rows are turns of their own.  Null
    role and text count as empty; rows with a null conv_id make one
    conversation of that id.  Spans are in code points of their part; a span
    never crosses parts.  Extra columns are not read; no rows give no rows.
    """
    ship(rows.sparkSession)
    compile_template(template, {"escape": escape})  # errors surface on the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, {"escape": escape})
        done: list[tuple] = []
        rows_ = _rows(batches)
        row = next(rows_, None)
        turn_ends = [False]
        while row is not None:
            conv = row[0]

            def messages() -> Iterator[dict]:
                nonlocal row
                while row is not None and row[0] == conv:  # noqa: B023
                    message = {"role": row[1], "text": row[2]}
                    row = next(rows_, None)
                    turn_ends[0] = True
                    yield message

            out: list[str] = []
            spans: list[dict] = []
            at = start = part = 0
            inside = False
            for piece in render(messages=messages()):
                if at >= PART_CHARS and turn_ends[0] and not inside:
                    done.append((conv, part, "".join(out), spans))
                    out, spans, at, part = [], [], 0, part + 1
                    yield _formatted(done)
                    done = []
                turn_ends[0] = False
                if piece is START:
                    start, inside = at, True
                elif piece is END:
                    spans.append({"start": start, "end": at})
                    inside = False
                else:
                    out.append(piece)
                    at += len(piece)
            for _ in messages():  # a template need not read them all
                pass
            done.append((conv, part, "".join(out), spans))
            if len(done) >= 1000:
                yield _formatted(done)
                done = []
        yield _formatted(done)

    return (
        rows.select(
            F.col("conv_id").cast("long"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
            F.col("turn"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
        .mapInArrow(run, FORMATTED)
    )


def _formatted(done: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*done, strict=True)) or [[]] * 4
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), span), strict=True)],
        ["conv_id", "part", "text", "loss"],
    )


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn in a text made by the default template."""
    role, at = "", 0
    for m in _SCAN.finditer(text):
        if m[0][0] == "\\":
            continue
        held = text[at : m.start()]
        at = m.end()
        match m[0]:
            case "[INST]":
                role = "user"
            case "<s>":
                role = "assistant"
            case "[NAME]":
                role = unescape(held)
            case "[/INST]" | "</s>" | "[/SYS]":
                yield role, unescape(held)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from `format_conversations` with the default template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state: list = []

        def close() -> None:
            if state:
                conv, n, turns, loss_n, loss, chars = state
                out.append((conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars))

        for conv, _, text, spans in _rows(batches):
            if not state or state[0] != conv:
                close()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in read_turns(text):
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
            for span in spans:
                said = unescape(text[span["start"] : span["end"]])
                state[3] += len(said)
                state[4].update(said.encode())
            state[5] += len(text)
        close()
        columns = list(zip(*out, strict=True)) or [[]] * 6
        i, s = pa.int64(), pa.string()
        names = [c.split()[0] for c in READ.split(", ")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (i, i, s, i, s, i), strict=True)], names
        )

    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, READ)
