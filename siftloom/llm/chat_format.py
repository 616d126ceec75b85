"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio, document. A visitor flattens
them, in order, into the turn's text: a text part as it is, any other part as a
numbered placeholder such as ``<|image:0|>``. For each placeholder it records the
attachment's reference and the count of tokens it expands to.

A template marks turns with control strings. Control strings inside texts are escaped
reversibly: a backslash doubles, and ``<|`` becomes ``<\\|``. Placeholders are put in
after escaping, so a text that looks like one is never read as one.

A row is formatted on its own, without a shuffle. ``read_back`` walks the rows of a
conversation in order, one Arrow batch at a time, so even a conversation that holds a
third of all rows is never collected.

Defined results: null text and null parts are empty; a null role is the empty role; a
null turn sorts first; turns alike in number are ordered by role, then text, and
repeated rows are each formatted; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.llm.common import text_batches

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens that an attachment expands to.
IMAGE_PATCH, AUDIO_TOKENS_A_SECOND, TOKENS_A_PAGE = 28, 25, 600
RENDERED = "conv_id long, turn long, role string, text string, formatted string, loss_start long, loss_end long, attachments string"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


class Flattener:
    """Visits the parts of one turn; ``text`` is escaped, ``plain`` has texts and placeholders as they are."""

    def __init__(self, first: int = 0):
        self.pieces: list[str] = []
        self.plain: list[str] = []
        self.attachments: list[dict] = []
        self.first = first

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"no such content part: {kind}")
        method(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        self.pieces.append(escape(text))
        self.plain.append(text)

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil((part.get(k) or 0) / IMAGE_PATCH) for k in ("width", "height"))
        self.place("image", part, max(1, across * down))

    def visit_audio(self, part: dict) -> None:
        self.place("audio", part, max(1, math.ceil((part.get("seconds") or 0) * AUDIO_TOKENS_A_SECOND)))

    def visit_document(self, part: dict) -> None:
        self.place("document", part, max(1, (part.get("pages") or 0) * TOKENS_A_PAGE))

    def place(self, kind: str, part: dict, tokens: int) -> None:
        mark = f"<|{kind}:{self.first + len(self.attachments)}|>"
        self.pieces.append(mark)
        self.plain.append(mark)
        self.attachments.append({"kind": kind, "ref": part.get("ref") or "", "placeholder": mark, "tokens": tokens})


def format_turn(role: str | None, parts: list[dict] | None, train_on: tuple[str, ...] = ("assistant",)) -> dict:
    """The formatted turn, the span of its characters under the loss mask, and its attachments."""
    visitor = Flattener()
    for part in parts or []:
        visitor.visit(part or {})
    head, body = f"{START}{escape_role(role or '')}\n", "".join(visitor.pieces)
    span = (len(head), len(head) + len(body)) if (role or "") in train_on else (0, 0)
    return {"text": "".join(visitor.plain), "formatted": f"{head}{body}{END}\n", "loss": span, "attachments": visitor.attachments}


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; the inverse of joined format_turn outputs without attachments."""
    out = []
    for segment in formatted.split(START)[1:]:
        head, body = segment.split("\n", 1)
        out.append((unescape_role(head), unescape(body[: body.rindex(END)])))
    return out


def render(turns: DataFrame, parts_col: str | None = None) -> DataFrame:
    """Each turn formatted: conv_id, turn, role, text, formatted, loss span, attachments (JSON).

    parts_col names an array of structs (type, text, ref, width, height, seconds, pages);
    without it the column ``text`` is the turn's only part.
    """
    parts = F.to_json(F.col(parts_col)) if parts_col else F.lit(None).cast("string")
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", ("text" if not parts_col else F.lit(None).cast("string").alias("text")), parts.alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_end", "attachments"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            conv, turn, role, text, given = (batch.column(k).to_pylist() for k in range(5))
            made = [format_turn(r, json.loads(p) if p else [{"type": "text", "text": t}]) for r, t, p in zip(role, text, given, strict=True)]
            cols = [conv, turn, role, [m["text"] for m in made], [m["formatted"] for m in made], [m["loss"][0] for m in made], [m["loss"][1] for m in made], [json.dumps(m["attachments"]) for m in made]]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return text_batches(rows).mapInArrow(run, RENDERED)


def read_back(rendered: DataFrame) -> DataFrame:
    """Per conversation, from the formatted output alone: digests of its turns and of the text under the loss mask.

    Rows are dealt by conversation and sorted; a task keeps two running digests, not the rows.
    """
    ordered = rendered.select("conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        out: list[tuple] = []

        def close() -> None:
            out.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            conv, formatted, start, end = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))
            for c, f, a, b in zip(conv, formatted, start, end, strict=True):
                if state is None or state[0] != c:
                    if state is not None:
                        close()
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(f):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                masked = unescape(f[a:b])
                state[3] += len(masked)
                state[4].update(masked.encode())
                state[5] += len(f)
            if len(out) >= 10_000:
                yield flush()
                out.clear()
        if state is not None:
            close()
        yield flush()

    return ordered.mapInArrow(run, schema)


def conversations(rendered: DataFrame) -> DataFrame:
    """conv_id and its turns as one string, for conversations that fit in a row."""
    turns = rendered.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "formatted"))).alias("turns"))
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda t: t["formatted"]), "").alias("formatted"))
