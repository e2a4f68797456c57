"""Token ids packed into fixed rows: best-fit decreasing over a segment tree of capacities.

Texts become token ids; documents longer than a row are split without loss.  Within a block of
bounded tokens the pieces, longest first, each go to the open row whose free space fits best; a
segment tree over capacities finds it in logarithmic time.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfold.llm.common import in_batches, long_id

ROW = 4_096
#: A task packs at most this many tokens at a time, which bounds its memory.
BLOCK = 4_000_000
#: The pattern by which the public byte-level vocabulary cuts texts (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The id that ends a document; the vocabulary leaves it free.
END = 50_256
_CACHE = 300_000

# A space that follows a non-space always begins a token, so texts may be cut there.
_CHUNK = re.compile(r"\s*\S+(?:[^\S ]\s*\S*)*|\s+")


class Encoder:
    """Token ids of whole texts, with a bounded cache of the chunks between spaces."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        class Chunks(dict):
            def __missing__(self, chunk: str) -> bytes:
                if len(self) >= _CACHE:
                    self.clear()
                ids = np.array(encode(chunk), np.uint32).tobytes()
                if len(chunk) < 64:
                    self[chunk] = ids
                return ids

        self.chunks = Chunks()

    def __call__(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, _CHUNK.findall(text))), np.uint32)


class CapacityTree:
    """Open rows by free capacity; finds the smallest capacity that fits."""

    def __init__(self, most: int):
        self.base = 1 << most.bit_length()
        self.most = [0] * (2 * self.base)  # open rows below each node
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, capacity: int, change: int) -> None:
        at = self.base + capacity
        while at:
            self.most[at] += change
            at >>= 1

    def put(self, row: int, capacity: int) -> None:
        self.open[capacity].append(row)
        self._add(capacity, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(row, capacity) of a row with the least capacity of at least ``size``, which leaves."""
        at, tree = self.base + size, self.most
        while not tree[at]:
            while at & 1:  # a right child: what is larger lies beside an ancestor
                at >>= 1
            if at <= 1:
                return None
            at += 1
        while at < self.base:
            at = 2 * at + (not tree[2 * at])
        capacity = at - self.base
        self._add(capacity, -1)
        return self.open[capacity].pop(), capacity


def best_fit(sizes: list[int], row: int) -> list[list[int]]:
    """Indices of pieces by row, longest pieces first, ties by index; no size is above ``row``."""
    tree, rows = CapacityTree(row), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        if found is None:
            found = len(rows), row
            rows.append([])
        rows[found[0]].append(i)
        tree.put(found[0], found[1] - sizes[i])
    return rows


SCHEMA = (
    "block string, seq long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_starts array<int>, doc_ids array<long>, doc_rows array<long>, pieces array<int>"
)
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]


def pack_block(pieces: list[tuple[int | None, int, int, np.ndarray]], row: int, pad: int) -> Iterator[tuple]:
    """Packed rows of (doc_id, number of its row, number of the piece, ids): ids padded to ``row``, and their layout."""
    for found in best_fit([len(piece[3]) for piece in pieces], row):
        ids = np.full(row, pad, np.uint16 if pad < 65_536 else np.uint32)
        ends = np.cumsum([0, *(len(pieces[i][3]) for i in found)])
        for i, start, end in zip(found, ends, ends[1:]):
            ids[start:end] = pieces[i][3]
        names, rows, numbers = ([pieces[i][k] for i in found] for k in range(3))
        yield int(ends[-1]), ids.tobytes(), ends.tolist(), [n * row for n in numbers], names, rows, numbers


def _pack(encoder: Callable[[], Callable[[str], np.ndarray]], row: int, end: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = encoder(), TaskContext.get().partitionId()
        pieces, held, number, seq, doc_row = [], 0, 0, 0, part << 33

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal pieces, held, number, seq
            rows = list(pack_block(pieces, row, end))
            for at in range(0, len(rows), 256):
                some = rows[at : at + 256]
                columns = [[f"{part}-{number}"] * len(some), list(range(seq + at, seq + at + len(some))), *map(list, zip(*some))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)
            seq += len(rows)
            pieces, held, number = [], 0, number + 1

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end)).astype(np.uint16 if end < 65_536 else np.uint32)
                for i, at in enumerate(range(0, len(ids), row)):
                    pieces.append((doc_id, doc_row, i, ids[at : at + row]))
                    held += len(pieces[-1][3])
                    if held >= block:
                        yield from flush()
                doc_row += 1
        if pieces:
            yield from flush()

    return run


def pack_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, row: int = ROW, end: int = END, block: int = BLOCK) -> DataFrame:
    """Packed rows of all documents of ``docs``, as little-endian ids of ``row`` each.

    Every document's ids end in ``end``; a null or empty text is that id alone.  A document of
    more ids than a row is cut into pieces of ``row`` ids and a rest; joined by piece number they
    give all its ids again.  Of each packed row: ``input_ids`` (uint16 while ``end`` fits, else
    uint32; padded with ``end``), ``n_tokens`` that are not padding, ``cu_seqlens`` (0 and the end
    of each piece, where positions reset), ``position_starts`` (the position in its document at
    which each piece starts), ``doc_ids``, ``doc_rows`` and ``pieces``.  ``block`` and ``seq`` name
    the packed row.  ``doc_rows`` numbers the rows of ``docs`` (not densely), so the pieces of rows
    that share an id, or have none, are told apart.  Repeated rows are packed once each; null ids
    stay null; other columns are ignored; an empty table gives no rows.

    Every task packs its own documents in blocks of at most ``block`` tokens and a row, so nothing
    is shuffled and memory is bounded; at most one row of a block is badly filled.
    """
    picked = docs.select(long_id(docs), F.col("text").cast("string").alias("text"))
    return in_batches(picked).mapInArrow(_pack(_encoder(vocabulary), row, end, block), SCHEMA)


def _encoder(vocabulary: str) -> Callable[[], Encoder]:
    return lambda: Encoder(os.fspath(vocabulary))


def position_ids(cu_seqlens: list[int], starts: list[int] | None = None) -> np.ndarray:
    """Positions of a packed row, reset at each piece (or going on from its start)."""
    firsts = starts or [0] * (len(cu_seqlens) - 1)
    return np.concatenate([np.arange(b - a) + f for a, b, f in zip(cu_seqlens, cu_seqlens[1:], firsts)] or [np.empty(0, int)])


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet; ``input_ids`` of a file, one under another, are its id matrix."""
    packed.write.mode("errorifexists").parquet(path)


def read_matrix(rows: pa.Table, row: int = ROW, end: int = END) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(id matrix, cumulative segment lengths of each row, position matrix reset at each segment) of written rows."""
    ids = np.frombuffer(b"".join(rows.column("input_ids").to_pylist()), np.uint16 if end < 65_536 else np.uint32).reshape(-1, row)
    lengths = [np.array(x, np.int32) for x in rows.column("cu_seqlens").to_pylist()]
    positions = np.zeros(ids.shape, np.int32)
    for place, cuts in zip(positions, lengths):
        place[: cuts[-1]] = position_ids(cuts.tolist())
    return ids, lengths, positions
