"""Chat formatting around a template that is only ever called, never inspected.

Successive prefixes of a conversation are rendered.  What a turn adds to the output before it is
that turn's span; an output that doesn't begin with the one before it shows a template that
rewrites history.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfold.llm.common import in_batches, long_id

#: Strings that steer a model; texts must not be able to form them.
CONTROL = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>")
#: Prefixes are rendered whole, however long.  Only a template declared ``independent_turns``, whose
#: output is that of its single turns joined, goes on in segments after this many turns: the first
#: turn of a segment is the last one of the segment before, so the work for a turn stays bounded.
SEGMENT = 64

Render = Callable[[list[tuple[str, str]]], str]

_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    r"""``\`` doubled, and a ``\`` after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def template(turns: list[tuple[str, str]]) -> str:
    """The default template: ``<s>`` role ``[INST]`` text ``[/INST]`` ``</s>`` and a line end for each turn."""
    return "".join(f"<s>{escape(role)}[INST]{escape(text)}[/INST]</s>\n" for role, text in turns)


template.independent_turns = True


_TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>\n", re.DOTALL)


def read_turn(piece: str) -> tuple[str, str, int, int] | None:
    """(role, text, start, end of the text in the piece) as the default template wrote them."""
    found = _TURN.fullmatch(piece)
    return (unescape(found[1]), unescape(found[2]), *found.span(2)) if found else None


class Incremental:
    """Renders a conversation's prefixes one turn after another, whole unless ``segment`` is given."""

    def __init__(self, render: Render, segment: int | None = None):
        self.render, self.segment = render, segment
        self.turns: list[tuple[str, str]] = []
        self.before, self.rewrites, self.grown = "", False, 0

    def add(self, role: str, text: str) -> str:
        """What the turn adds to the output; a template that rewrites history sets ``rewrites``."""
        if self.segment and len(self.turns) >= self.segment:
            self.turns = self.turns[-1:]
            self.before = self.render(self.turns)
        self.turns.append((role, text))
        now = self.render(self.turns)
        same = len(self.before)
        if not now.startswith(self.before):
            self.rewrites = True
            same = next((i for i, (a, b) in enumerate(zip(self.before, now)) if a != b), min(same, len(now)))
        self.grown = len(now) - len(self.before)
        self.before = now
        return now[same:]


_SCHEMA = "conv_id long, turn_index long, start long, end long, text_start long, text_end long, in_loss boolean, rewrites boolean, chars long, piece string"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.string()]
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def _render(render: Render, segment: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, conversation, index, length = (), None, 0, 0
        for batch in batches:
            rows = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if at != (conv,):
                    at, conversation, index, length = (conv,), Incremental(render, segment), 0, 0
                piece = conversation.add(role, text)
                length += conversation.grown
                start, read = length - len(piece), read_turn(piece)
                if conversation.rewrites:  # a place in one output is none in another
                    spans = (None, None, None, None)
                else:
                    spans = (start, length, *((start + read[2], start + read[3]) if read else (None, None)))
                rows.append((conv, index, *spans, role == "assistant", conversation.rewrites, length, piece))
                index += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), _KINDS)], names=_NAMES)

    return run


def format_conversations(conversations: DataFrame, render: Render = template, segment: int = SEGMENT) -> DataFrame:
    """One row for each turn, conversations whole and in order within a partition.

    ``piece`` is what the turn adds to its conversation's output, ``start`` and ``end`` its span in
    code points there, ``text_start`` and ``text_end`` the span of its escaped text (null where the
    piece isn't in the default template's form), ``in_loss`` whether that text is trained on
    (assistant turns), ``rewrites`` whether some prefix up to here was rewritten, ``chars`` the
    length of the output up to here.  From a rewritten prefix on all spans are null, and ``piece``
    is what follows the part that both outputs begin with.

    Turns are ordered by turn (null first), then role and text, so ties and repeated rows have a
    fixed order; null roles and texts are empty; null conv_id is a conversation of its own.  Other
    columns are ignored; an empty table gives no rows.

    One shuffle by conversation; its turns then stream through the task in sorted order.  Whole
    prefixes are rendered, so a task holds one conversation and its work grows with the square of
    the turns; a template with a true ``independent_turns`` attribute, like the default one, is
    rendered in segments instead, with at most ``segment`` turns in memory.
    """
    stable = getattr(render, "independent_turns", False)
    rows = conversations.select(
        long_id(conversations, "conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return in_batches(ordered).mapInArrow(_render(render, segment if stable else None), _SCHEMA)


class _Digest:
    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.rewrites = False

    def add(self, piece: str, chars: int, span: tuple[int | None, int | None], in_loss: bool, rewrites: bool) -> None:
        role, text, _, _ = read_turn(piece) or ("", piece, 0, 0)
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.n, self.chars, self.rewrites = self.n + 1, chars, rewrites
        if in_loss and span[0] is not None:
            trained = unescape(piece[span[0] : span[1]])
            self.loss.update(trained.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(trained)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def rows_of(done: list[tuple[int | None, _Digest]]) -> pa.RecordBatch:
        rows = [(conv, d.n, d.turns.hexdigest(), d.loss_chars, d.loss.hexdigest(), d.chars, d.rewrites) for conv, d in done]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _DIGEST.split(", ")])

    conv = digest = None
    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if r["turn_index"] == 0:
                if digest:
                    done.append((conv, digest))
                conv, digest = r["conv_id"], _Digest()
            span = (r["text_start"] - r["start"], r["text_end"] - r["start"]) if r["text_start"] is not None else (None, None)
            digest.add(r["piece"], r["chars"], span, r["in_loss"], r["rewrites"])
        if done:
            yield rows_of(done)
    if digest:
        yield rows_of([(conv, digest)])


def read_back(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, read from the output of format_conversations alone.

    Turns, text under the loss mask and lengths in code points; digests are fed turn by turn.  A
    conversation that its template rewrites has no loss text from the first rewritten turn on.
    """
    return in_batches(formatted).mapInArrow(_read_back, _DIGEST)
