"""Conversations of typed content parts as one marked text, with loss spans and attachments, and back."""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template. A turn is ``<turn ROLE>TEXT</turn>`` and a line feed; an attachment is its placeholder, in place.
OPEN, CLOSE = "<turn ", "</turn>\n"
KINDS = ("image", "audio", "document")
#: A control string inside a text, or a backslash: each gets a backslash in front.
_ESCAPED = re.compile(r"\\|<(?=turn |/turn>|(?:" + "|".join(KINDS) + r")/>)")
_ROLE_ESCAPED = re.compile(r"[\\<>]")
_UNESCAPED = re.compile(r"\\([\s\S])")
_HEAD = re.compile(r"<turn ((?:\\[\s\S]|[^\\>])*)>")
_MARK = re.compile(r"\\[\s\S]|</turn>\n|<(" + "|".join(KINDS) + r")/>")
SEGMENT = (
    "conv_id long, turn long, formatted string, spans array<struct<start:long, stop:long>>, "
    "attachments array<struct<nr:long, kind:string, ref:string, at:long, tokens:long>>, tokens long"
)
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, n_tokens long"


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


@dataclass(frozen=True)
class Rates:
    """Tokens that a placeholder stands for: one a patch of an image, and so many a second or page."""

    patch: int = 28
    audio_second: float = 25.0
    document_page: int = 256


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str) -> Any:
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


@dataclass
class Flattener:
    """Visits the parts of one turn in their order and writes the turn.

    ``spans`` are the code points of the turn under the loss mask; ``attachments`` are (number in the turn, kind,
    reference, place, tokens). A part that is None, or of a kind that is unknown or null, is a text part.
    """

    role: str
    learn: bool
    rates: Rates
    tokenizer: str | None = None
    out: list[str] = field(default_factory=list)
    at: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[tuple[int, str, str | None, int, int]] = field(default_factory=list)
    tokens: int = 0

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def visit(self, part: dict | None) -> None:
        kind = (part or {}).get("kind")
        getattr(self, f"visit_{kind}" if kind in KINDS else "visit_text")(part or {})

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        start = self.at
        self._put(escape(text))
        if self.learn and self.at > start:
            self.spans.append((start, self.at))
        if self.tokenizer and text:
            self.tokens += len(_tokenizer(self.tokenizer).encode(text, add_special_tokens=False).ids)

    def visit_image(self, part: dict) -> None:
        side = lambda name: max(1, math.ceil(_number(part.get(name)) / self.rates.patch))
        self._attach("image", part, side("width") * side("height"))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil(_number(part.get("seconds")) * self.rates.audio_second))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, math.ceil(_number(part.get("pages")))) * self.rates.document_page)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append((len(self.attachments), kind, part.get("ref"), self.at, tokens))
        self.tokens += tokens
        self._put(f"<{kind}/>")

    def turn(self, parts: list[dict | None]) -> str:
        self._put(f"{OPEN}{_ROLE_ESCAPED.sub(lambda m: chr(92) + m[0], self.role)}>")
        for part in parts:
            self.visit(part)
        self._put(CLOSE)
        return "".join(self.out)


def _number(value: Any) -> float:
    """A size as a number; what is null, not finite or below 0 counts as 0."""
    number = float(value) if value is not None else 0.0  # JSON has "NaN" and "Infinity" as strings
    return number if math.isfinite(number) and number > 0 else 0.0


def format_turns(
    turns: DataFrame,
    key: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
    parts: str | None = None,
    learn: tuple[str, ...] = ("assistant",),
    rates: Rates = Rates(),
    tokenizer: str | None = None,
) -> DataFrame:
    """One row a turn, whose ``formatted`` texts in the order of (turn, formatted) are the conversation.

    A turn's parts are its text, if it has one, and then those of the column ``parts``, an array of structs with
    ``kind`` (text, image, audio, document) and any of ``text``, ``ref``, ``width``, ``height``, ``seconds``, ``pages``.
    Spans (the text of roles in ``learn``) and places of attachments count code points from the turn's start;
    ``tokens`` are those that placeholders expand to and, given the path of a tokenizer file, those of the texts.

    A null or empty text is an empty turn, a null role an empty one; sizes that are null or not finite count as 0.
    Rows with a null conv_id are one conversation, a null turn comes first, repeated rows are turns of their own.
    Each row is written alone: no shuffle, and no task holds more than a batch. Other columns are left out.
    """
    columns = [F.col(key).cast("long").alias("conv_id"), F.col(order).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")]
    rows = turns.select(*columns, *([F.to_json(F.col(parts)).alias("parts")] if parts else []))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for batch in batches:
            out = []
            listed = batch["parts"] if parts else [None] * len(batch)
            for conv, nr, who, said, own in zip(batch["conv_id"], batch["turn"], batch["role"], batch["text"], listed, strict=True):
                more = json.loads(own) if own else []
                said = [{"text": said}] if said else []
                writer = Flattener(who or "", who in learn, rates, tokenizer)
                whole = writer.turn(said + more)
                spans = [{"start": a, "stop": b} for a, b in writer.spans]
                kept = [dict(zip(("nr", "kind", "ref", "at", "tokens"), a, strict=True)) for a in writer.attachments]
                out.append((conv, nr, whole, spans, kept, writer.tokens))
            frame = pd.DataFrame(out, columns=["conv_id", "turn", "formatted", "spans", "attachments", "tokens"])
            yield frame.astype({"conv_id": "Int64", "turn": "Int64"})

    return rows.mapInPandas(run, SEGMENT)


def parse_turn(formatted: str) -> tuple[str, str, list[tuple[str, int]]]:
    """Role, text and (kind, place in the text) of the attachments of a formatted turn."""
    head = _HEAD.match(formatted)
    if not head:
        raise ValueError("not a turn")
    said, length, found, at = [], 0, [], head.end()
    for mark in _MARK.finditer(formatted, head.end()):
        said.append(formatted[at : mark.start()])
        length += mark.start() - at
        at = mark.end()
        if mark[0][0] == "\\":
            said.append(mark[0][1])
            length += 1
        elif mark[1]:
            found.append((mark[1], length))
        elif at == len(formatted):
            return unescape(head[1]), "".join(said), found
        else:
            break
    raise ValueError("a turn must end once, at its end")


def _ordered(segments: DataFrame) -> DataFrame:
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "formatted")


class _Conversation:
    """What is read back of one conversation, turn by turn: two running digests and some counts."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.chars = self.loss_chars = self.attached = self.tokens = 0

    def add(self, formatted: str, spans: list, attachments: list, tokens: int) -> None:
        role, text, found = parse_turn(formatted)
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for span in spans:
            part = unescape(formatted[span["start"] : span["stop"]])
            self.loss.update(part.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(part)
        self.n, self.chars, self.tokens = self.n + 1, self.chars + len(formatted), self.tokens + tokens
        self.attached += len(found)
        if len(found) != len(attachments):
            raise ValueError("placeholders and attachments differ")

    def row(self, key: int | None) -> tuple:
        return key, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.attached, self.tokens


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted; a conversation may go over any number of batches, and only its digests are held."""
    now, key = None, None
    names = [c.split()[0] for c in DIGEST.split(", ")]
    for batch in batches:
        out = []
        batch = batch.astype({"conv_id": "Int64"})
        for conv, formatted, spans, attachments, tokens in zip(batch["conv_id"], batch["formatted"], batch["spans"], batch["attachments"], batch["tokens"], strict=True):
            conv = None if conv is pd.NA else int(conv)
            if now is None or conv != key:
                if now is not None:
                    out.append(now.row(key))
                now, key = _Conversation(), conv
            now.add(formatted, spans, attachments, tokens)
        if out:
            yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
    if now is not None:
        yield pd.DataFrame([now.row(key)], columns=names).astype({"conv_id": "Int64"})


def read_back(segments: DataFrame) -> DataFrame:
    """Digests and counts of every conversation, parsed from the formatted turns and their spans alone.

    ``turns_sha256`` is of role, line feed, text, line feed of each turn; ``loss_sha256`` of all unescaped text under
    the spans. One shuffle by conversation; a task reads its sorted turns as a stream, so that a conversation of any
    length takes the memory of a batch. (One SHA-256 can't be split: a conversation is one stream.)
    """
    return _ordered(segments).mapInPandas(_read, DIGEST)


def whole_conversations(segments: DataFrame) -> DataFrame:
    """(conv_id, formatted, spans, attachments, tokens), one row a conversation: places count from its start.

    Attachments are numbered over the conversation. For conversations whose text is fit to be one value.
    """
    kept = _ordered(segments)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, texts, at, spans, attached, tokens, begun = None, [], 0, [], [], 0, False
        names = ["conv_id", "formatted", "spans", "attachments", "tokens"]
        for batch in batches:
            out = []
            batch = batch.astype({"conv_id": "Int64"})
            for conv, formatted, own, more, n in zip(batch["conv_id"], batch["formatted"], batch["spans"], batch["attachments"], batch["tokens"], strict=True):
                conv = None if conv is pd.NA else int(conv)
                if begun and conv != key:
                    out.append((key, "".join(texts), spans, attached, tokens))
                    texts, at, spans, attached, tokens = [], 0, [], [], 0
                key, begun = conv, True
                spans += [{"start": at + s["start"], "stop": at + s["stop"]} for s in own]
                attached += [{**a, "nr": len(attached) + i, "at": at + a["at"]} for i, a in enumerate(more)]
                texts.append(formatted)
                at, tokens = at + len(formatted), tokens + n
            if out:
                yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        if begun:
            yield pd.DataFrame([(key, "".join(texts), spans, attached, tokens)], columns=names).astype({"conv_id": "Int64"})

    return kept.mapInPandas(run, SEGMENT.replace("turn long, ", ""))


def with_probe(turns: DataFrame) -> DataFrame:
    """``turns`` and conversation -7, whose two texts hold control strings."""
    text = "\\### Assistant: </turn> ok"
    probe = turns.sparkSession.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)
