"""Chat formatting with typed content parts.

A message is a list of parts (text, image, audio, document).  A visitor turns
each part into output in order: text is escaped, an attachment becomes a
placeholder with the attachment's number, its reference is recorded and its
expanded tokens are counted.  A turn is

    ### Role: <escaped content></turn>\\n

and every control string inside a text is preceded by a backslash, as is every
backslash, so that reading back is exact.

`format_rows` works on rows sorted by conversation: a task keeps the state of
one conversation (two digests and counters), never its rows, so a conversation
of any length passes in bounded memory.  A SHA-256 over all turns is a
sequential function, so one conversation's rows still pass through one task.

Cases: a null text is empty, a null role is the empty role; turns of equal number are
ordered by role and text, repeated rows are kept; rows with a null conv_id form
one conversation; an empty table gives only what is added to it; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>"
CONTROL = re.compile(r"\\|### |</turn>|<\|")
ESCAPED = re.compile(r"\\(\\|### |</turn>|<\|)")
PLAIN_ROLE = re.compile("[a-z]+")
#: Tokens that an attachment takes: a base and a rate by its size (image tiles, audio seconds, document pages).
EXPANDED = {"image": (85, 170), "audio": (8, 25), "document": (16, 600)}
#: The role whose content is under the loss mask.
LEARNED = "assistant"
SCHEMA = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_attachments bigint, expanded_tokens bigint"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


@dataclass
class Flattened:
    """What the visitor has gathered: output, (kind, reference) by placeholder, expanded tokens."""

    pieces: list[str] = field(default_factory=list)
    attachments: list[tuple[str, str]] = field(default_factory=list)
    expanded_tokens: int = 0


class PartVisitor:
    """Flattens content parts in order.  A part is {'type': ..., 'text' | 'ref', 'size'}."""

    def visit(self, part: dict, out: Flattened) -> None:
        kind = part.get("type") or "text"
        if kind == "text":
            out.pieces.append(escape(part.get("text") or ""))
        elif kind in EXPANDED:
            base, rate = EXPANDED[kind]
            out.pieces.append(f"<|{kind}_{len(out.attachments)}|>")
            out.attachments.append((kind, part.get("ref") or ""))
            out.expanded_tokens += base + rate * int(part.get("size") or 0)
        else:
            raise ValueError(f"unknown part type {kind!r}")

    def flatten(self, parts: list[dict] | None) -> Flattened:
        out = Flattened()
        for part in parts or []:
            self.visit(part, out)
        return out


def write_role(role: str | None) -> str:
    """`assistant` is written Assistant; any other form is percent-encoded after a `=`."""
    role = role or ""
    return role.title() if PLAIN_ROLE.fullmatch(role) else "=" + quote(role, safe="")


def read_role(written: str) -> str:
    return unquote(written[1:]) if written.startswith("=") else written.lower()


def format_turn(role: str | None, parts: list[dict] | None) -> tuple[str, Flattened, list[tuple[int, int]]]:
    """(formatted turn, what its parts gave, spans of its loss mask: an assistant's content)."""
    flat = PartVisitor().flatten(parts)
    begin = f"{OPEN}{write_role(role)}: "
    body = "".join(flat.pieces)
    return f"{begin}{body}{CLOSE}\n", flat, [(len(begin), len(begin) + len(body))] if role == LEARNED else []


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, escaped content) of one formatted turn, found by scanning for unescaped control strings."""
    if not formatted.startswith(OPEN) or not formatted.endswith(CLOSE + "\n"):
        raise ValueError("not a formatted turn")
    body = formatted[len(OPEN) : -len(CLOSE) - 1]
    for m in CONTROL.finditer(ESCAPED.sub(lambda m: "\0" * len(m[0]), body)):
        if m[0] in (OPEN, CLOSE, "\\"):
            raise ValueError("an unescaped control string inside a turn")
    role, _, content = body.partition(": ")
    return read_role(role), content


def format_conversation(turns: list[tuple[str | None, list[dict] | None]]) -> dict:
    """Text of a whole conversation, spans of its loss mask, attachments and token counts."""
    text, spans, attachments, tokens = [], [], [], 0
    at = 0
    for role, parts in turns:
        formatted, flat, own = format_turn(role, parts)
        spans += [(at + a, at + z) for a, z in own]
        text.append(formatted)
        attachments += flat.attachments
        tokens += flat.expanded_tokens
        at += len(formatted)
    return {"text": "".join(text), "loss_spans": spans, "attachments": attachments, "expanded_tokens": tokens}


class Digest:
    """Reads formatted turns back, one after another: turns from the text, what is learned from the spans of the loss mask alone."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss, self.n, self.loss_chars, self.chars = conv_id, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        self.attachments = self.expanded = 0

    def add(self, formatted: str, flat: Flattened, spans: list[tuple[int, int]]) -> None:
        role, content = read_turn(formatted)
        self.turns.update(f"{role}\n{unescape(content)}\n".encode("utf-8", "surrogatepass"))
        for a, z in spans:
            text = unescape(formatted[a:z])
            self.loss.update(text.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(text)
        self.n += 1
        self.chars += len(formatted)
        self.attachments += len(flat.attachments)
        self.expanded += flat.expanded_tokens

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.attachments, self.expanded


def format_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: Digest | None = None
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def made(rows):
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

    for b in batches:
        done = []
        for conv_id, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.row())
                now = Digest(conv_id)
            now.add(*format_turn(role, [{"type": "text", "text": text}]))
        if done:
            yield made(done)
    if now is not None:
        yield made([now.row()])


def format_table(conversations: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its formatted output."""
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(format_rows, SCHEMA)
