"""Chat formatting whose output a deterministic parser reads back to the same turns.

The template marks a turn of the user ``[INST] text [/INST]``, of the assistant ``<s>text</s>`` and of any other role
``[ROLE]role[TEXT]text[/ROLE]``. A control string with backslashes after its first character is text: the parser
takes one backslash away. Each turn is first rendered as it stands and parsed again; where role or text come
back changed, the conflicting content is escaped with one more backslash, until they are identical (ordinary texts
are never changed). A marker starts with ``<`` or ``[`` and no control string holds either further inside, so turns
cannot run into each other, and the conversation is the plain concatenation of its turns.

Rows are ordered by turn, nulls first; equal turns by their rendered form. Null text and null role read as empty. A null conv_id is a
conversation. Repeated rows are turns of their own. Rendering runs where the rows are; only the rendered turns are
shuffled. A conversation is read as a stream with one turn in memory, however long it is. Its digests are
serial, so one task reads a conversation. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import map_batches

_NAMES = r"s>|/s>|INST\]|/INST\]|ROLE\]|/ROLE\]|TEXT\]"
_MARKED = re.compile(rf"([<\[])(\\*)({_NAMES})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_NAMES})")
_CONTROL = re.compile(rf"[<\[](?:{_NAMES})")

USER, ASSISTANT = "user", "assistant"
_TURN = "conv_id bigint, turn bigint, role string, text string"
_RENDERED = "conv_id bigint, turn bigint, rendered string, loss_start int, loss_end int"


def escape(text: str) -> str:
    return _MARKED.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _marked(role: str, text: str) -> tuple[str, int]:
    """The rendered turn of an already escaped role and text, and where the text starts."""
    if role == USER:
        return f"[INST] {text} [/INST]", 7
    if role == ASSISTANT:
        return f"<s>{text}</s>", 3
    head = f"[ROLE]{role}[TEXT]"
    return f"{head}{text}[/ROLE]", len(head)


class Parser:
    """Reads rendered text piece by piece and gives (role, text) whenever a turn is complete."""

    def __init__(self):
        self.rest = ""

    def feed(self, piece: str) -> list[tuple[str, str]]:
        self.rest += piece
        turns = []
        while (end := self._turn()) is not None:
            role, text, used = end
            turns.append((role, text))
            self.rest = self.rest[used:]
        return turns

    def _turn(self) -> tuple[str, str, int] | None:
        rest, marks = self.rest, _CONTROL.finditer(self.rest)
        first = next(marks, None)
        if first is None:
            return None
        if first.start():
            raise ValueError("text outside a turn")
        second = next(marks, None)
        if second is None:
            return None
        pair = (first[0], second[0])
        if pair == ("[INST]", "[/INST]"):
            return USER, unescape(rest[7 : second.start() - 1]), second.end()
        if pair == ("<s>", "</s>"):
            return ASSISTANT, unescape(rest[3 : second.start()]), second.end()
        if pair == ("[ROLE]", "[TEXT]"):
            third = next(marks, None)
            if third is None:
                return None
            if third[0] == "[/ROLE]":
                return unescape(rest[6 : second.start()]), unescape(rest[second.end() : third.start()]), third.end()
        raise ValueError(f"unexpected {second[0]} after {first[0]}")

    def close(self) -> None:
        if self.rest:
            raise ValueError("an open turn at the end")


def parse(formatted: str) -> list[tuple[str, str]]:
    parser = Parser()
    turns = parser.feed(formatted)
    parser.close()
    return turns


def _reads_back(rendered: str, role: str, text: str) -> bool:
    try:
        return parse(rendered) == [(role, text)]
    except ValueError:
        return False


def render(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The turn as text, and the span of its text: escaped only as far as the round trip needs it."""
    role, text = role or "", text or ""
    shown_role, shown = role, text
    rendered, start = _marked(shown_role, shown)
    if "<" in rendered[1:] or "[" in rendered[1:]:
        while not _reads_back(rendered, role, text):
            shown, shown_role = escape(shown), shown_role if shown_role in (USER, ASSISTANT) else escape(shown_role)
            rendered, start = _marked(shown_role, shown)
    return rendered, start, start + len(shown)


def _render(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        made = [render(r, t) for r, t in zip(batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True)]
        rendered, starts, ends = zip(*made, strict=True)
        loss = [r == ASSISTANT for r in batch["role"].to_pylist()]
        yield {
            "conv_id": batch["conv_id"], "turn": batch["turn"], "rendered": rendered,
            "loss_start": [s if on else None for s, on in zip(starts, loss, strict=True)],
            "loss_end": [e if on else None for e, on in zip(ends, loss, strict=True)],
        }


def format_turns(conversations: DataFrame) -> DataFrame:
    """The output: rendered turns in order within each conversation, with the span under the loss mask (or null)."""
    turns = conversations.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    rendered = map_batches(turns, _render, _RENDERED)
    return rendered.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "rendered")


class _Digest:
    def __init__(self):
        self.parser, self.turns, self.loss = Parser(), hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted = 0

    def add(self, rendered: str, start: int | None, end: int | None) -> None:
        self.formatted += len(rendered)
        for role, text in self.parser.feed(rendered):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        if start is not None:
            text = unescape(rendered[start:end])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        self.parser.close()
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted


_READ = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
_READ_SCHEMA = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)


def _read(batches: Iterator[dict]) -> Iterator[dict]:
    current, digest = None, None
    for batch in batches:
        done = []
        columns = [batch[c].to_pylist() for c in ("conv_id", "rendered", "loss_start", "loss_end")]
        for conv, rendered, start, end in zip(*columns, strict=True):
            if digest is None or conv != current:
                if digest is not None:
                    done.append((current, *digest.row()))
                current, digest = conv, _Digest()
            digest.add(rendered, start, end)
        if done:
            yield dict(zip(["conv_id", *_READ], zip(*done, strict=True), strict=True))
    if digest is not None:
        yield dict(zip(["conv_id", *_READ], zip((current, *digest.row()), strict=True), strict=True))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the parser and the loss spans give back, one row per conversation of ``format_turns``."""
    return map_batches(formatted, _read, _READ_SCHEMA)
