"""Chat formatting with typed content parts.

A turn holds parts (text, image, audio, document). A visitor flattens them in order: text is escaped and kept, everything
else becomes a numbered placeholder, its reference goes to a list of attachments, and the tokens it stands for are
counted. The template marks turns with control strings; a backslash escape keeps those strings inside texts apart, and
taking it back restores every text. Only the turns of one conversation, which is one output row, come together.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: str) -> str:
    r"""``\`` becomes ``\\`` and ``<|`` becomes ``<\|``, so no control string is left."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    """Take ``escape`` back."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def escape_role(role: str) -> str:
    r"""A role stays on one line: line feeds become ``\n`` after the other escapes."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.DOTALL)


@dataclass(frozen=True)
class TextPart:
    text: str

    def accept(self, visitor: "Flattener") -> None:
        visitor.text(self)


@dataclass(frozen=True)
class ImagePart:
    ref: str
    width: int = 0
    height: int = 0

    def accept(self, visitor: "Flattener") -> None:
        visitor.attachment("image", self.ref, visitor.sizes.image(self.width, self.height))


@dataclass(frozen=True)
class AudioPart:
    ref: str
    seconds: float = 0.0

    def accept(self, visitor: "Flattener") -> None:
        visitor.attachment("audio", self.ref, visitor.sizes.audio(self.seconds))


@dataclass(frozen=True)
class DocumentPart:
    ref: str
    pages: int = 0

    def accept(self, visitor: "Flattener") -> None:
        visitor.attachment("document", self.ref, visitor.sizes.document(self.pages))


@dataclass(frozen=True)
class Sizes:
    """Tokens an attachment expands to: image tiles, audio per second, pages; one at least."""

    tile: int = 28
    audio_rate: float = 12.5
    page: int = 1024

    def image(self, width: int, height: int) -> int:
        return max(1, -(-max(width, 0) // self.tile) * -(-max(height, 0) // self.tile))

    def audio(self, seconds: float) -> int:
        return max(1, round(max(seconds, 0.0) * self.audio_rate))

    def document(self, pages: int) -> int:
        return max(1, pages * self.page)


@dataclass
class Flattener:
    """Visitor over the parts of one conversation."""

    sizes: Sizes = field(default_factory=Sizes)
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def text(self, part: TextPart) -> None:
        self.out.append(escape(part.text))

    def attachment(self, kind: str, ref: str, tokens: int) -> None:
        self.out.append(f"<|{kind}:{len(self.attachments)}|>")
        self.attachments.append({"kind": kind, "ref": ref, "tokens": tokens})

    def take(self) -> str:
        flat, self.out = "".join(self.out), []
        return flat


def parts_of(value: object) -> list:
    """Typed parts of a turn: a string is one text, a list holds dicts with ``type``; null is no text; unknown types raise."""
    if value is None:
        return [TextPart("")]
    if isinstance(value, str):
        return [TextPart(value)]
    found = []
    for part in value:
        part = {k: v for k, v in part.items() if v is not None}
        kind = part.pop("type", "text")
        if kind == "text":
            found.append(TextPart(part.get("text", "")))
        elif kind == "image":
            found.append(ImagePart(part.get("ref", ""), int(part.get("width", 0)), int(part.get("height", 0))))
        elif kind == "audio":
            found.append(AudioPart(part.get("ref", ""), float(part.get("seconds", 0))))
        elif kind == "document":
            found.append(DocumentPart(part.get("ref", ""), int(part.get("pages", 0))))
        else:
            raise ValueError(f"unknown content part {kind!r}")
    return found


@dataclass(frozen=True)
class Formatted:
    text: str
    loss: list[tuple[int, int]]
    attachments: list[dict]


def format_turns(turns: list[tuple[str | None, list]], sizes: Sizes = Sizes(), learn: tuple[str, ...] = ("assistant",)) -> Formatted:
    """Text of a conversation, code-point spans [from, to) of what is learned, and the attachments in order."""
    visitor, pieces, loss, at = Flattener(sizes), [], [], 0
    for role, parts in turns:
        head = f"{START}{escape_role(role or '')}\n"
        for part in parts:
            part.accept(visitor)
        body = visitor.take()
        if role in learn:
            loss.append((at + len(head), at + len(head) + len(body)))
        pieces += (head, body, f"{END}\n")
        at += len(head) + len(body) + len(END) + 1
    return Formatted("".join(pieces), loss, visitor.attachments)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn, read back from the formatted text; placeholders stay as they stand."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = text.index("\n", at)
        end = text.index(END, line + 1)
        turns.append((unescape_role(text[at + len(START) : line]), unescape(text[line + 1 : end])))
        at = end + len(END) + 1
    return turns


OUT = (
    "formatted string, loss array<struct<from:long,to:long>>, attachments array<struct<kind:string,ref:string,tokens:long>>, "
    "n_turns long, expanded_tokens long"
)


def format_chat(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "text",
    sizes: Sizes = Sizes(), learn: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation: its id, formatted, loss (spans), attachments, n_turns and expanded_tokens.

    ``content_col`` is a string or an array of structs with ``type`` (text, image, audio, document) and the fields of that
    type. Turns come in order of ``turn`` (null last), ties by role and content; repeated rows are turns of their own. A
    null text is an empty one, a null role an empty role; null conversation ids form one conversation. Other columns are
    ignored; an empty table gives an empty result. ``expanded_tokens`` counts the tokens of attachments.
    """
    typed = df.schema[content_col].dataType.typeName() == "array"
    content: Column = F.to_json(F.col(f"`{content_col}`")) if typed else F.col(f"`{content_col}`").cast("string")
    turn = F.struct(
        F.col(f"`{turn_col}`").isNull().alias("last"),
        F.col(f"`{turn_col}`").alias("turn"),
        F.col(f"`{role_col}`").cast("string").alias("role"),
        content.alias("content"),
    )
    turns = df.select(F.col(f"`{conv_col}`").alias("conv"), turn.alias("t"))
    whole = turns.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("t"))
    whole = whole.select("conv", F.col("t.role").alias("roles"), F.col("t.content").alias("contents"))
    id_type = df.schema[conv_col].dataType.simpleString()
    span = pa.struct([("from", pa.int64()), ("to", pa.int64())])
    item = pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for roles, contents in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts = [parts_of(json.loads(c) if typed and c is not None else c) for c in contents]
                made.append(format_turns(list(zip(roles, parts)), sizes, learn))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([m.text for m in made], pa.string()),
                    pa.array([[{"from": a, "to": b} for a, b in m.loss] for m in made], pa.list_(span)),
                    pa.array([m.attachments for m in made], pa.list_(item)),
                    pa.array([len(r) for r in batch.column(1).to_pylist()], pa.int64()),
                    pa.array([sum(x["tokens"] for x in m.attachments) for m in made], pa.int64()),
                ],
                names=["conv", "formatted", "loss", "attachments", "n_turns", "expanded_tokens"],
            )

    return whole.mapInArrow(run, f"conv {id_type}, {OUT}").withColumnRenamed("conv", conv_col)


def chat_digest(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What a reader gets back from ``format_chat``: turns and learned text, as counts and SHA-256 digests."""
    import hashlib

    id_type = formatted.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_turns(text)
                learned = "".join(unescape(text[x["from"] : x["to"]]) for x in loss)
                told = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((
                    len(turns), hashlib.sha256(told.encode()).hexdigest(), len(learned),
                    hashlib.sha256(learned.encode()).hexdigest(), len(text),
                ))
            n, turns, chars, digests, sizes = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(turns, pa.string()), pa.array(chars, pa.int64()),
                 pa.array(digests, pa.string()), pa.array(sizes, pa.int64())],
                names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    schema = f"conv {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    out = formatted.select(F.col(f"`{conv_col}`").alias("conv"), "formatted", "loss").mapInArrow(run, schema)
    return out.withColumnRenamed("conv", conv_col)
