"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A benchmark item contributes every run of ``window`` consecutive words (the whole item when it is
shorter).  Patterns of equal length form one search class.  For each class a shift table over
blocks of two words says how far the scan may jump, a hash of the blocks that end a pattern selects
the few patterns that can end at a position, and a direct comparison confirms them.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfold.llm.common import as_bytes, checkpoint, folded_words, in_batches, long_id, merged

#: One table of patterns stays below this many bytes of benchmark text, some twelve times as many in
#: a worker; a larger benchmark is searched in several tables, one after another, so no broadcast
#: grows with the benchmark.
TABLE_BYTES = 8 << 20
#: Tables that workers hold at the same time; between such groups the documents are written.
TABLES_AT_ONCE = 4


class _Class:
    """Tables for patterns of one length: shifts and suffix buckets by a hash of two words."""

    def __init__(self, length: int, starts: np.ndarray, flat: np.ndarray):
        self.length, self.starts = length, starts
        self.mask = (1 << max(10, int(2 * len(starts)).bit_length())) - 1
        if length == 1:
            suffix = flat[starts] & self.mask
        else:
            shift = np.full(self.mask + 1, length - 1, np.uint16)
            for end in range(1, length):  # later blocks allow shorter jumps, so they overwrite
                shift[self.blocks(flat[starts + end - 1], flat[starts + end])] = length - 1 - end
            self.shift = memoryview(shift)
            suffix = self.blocks(flat[starts + length - 2], flat[starts + length - 1])
        order = np.argsort(suffix, kind="stable")
        self.order, self.first = order.astype(np.int32), np.zeros(self.mask + 2, np.int32)
        np.cumsum(np.bincount(suffix, minlength=self.mask + 1), out=self.first[1:])

    def blocks(self, a, b):
        return (a * 1_000_003 + b) & self.mask


class WuManber:
    """Finds every occurrence of the word windows of texts in other lists of words.

    Words are numbers, windows are places in one array of them: some 20 bytes for a word of the
    texts and 16 at most for a table entry, beside one entry for each distinct word.
    """

    def __init__(self, texts: Sequence[Sequence[bytes]], window: int):
        self.number: dict[bytes, int] = {}
        flat, starts, owners = array("q"), {}, {}
        for owner, words in enumerate(texts):
            size, at = min(window, len(words)), len(flat)
            flat.extend(self.number.setdefault(w, len(self.number) + 1) for w in words)
            if size:
                n = len(words) - size + 1
                starts.setdefault(size, []).append(np.arange(at, at + n))
                owners.setdefault(size, []).append(np.full(n, owner, np.int32))
        self.flat, places = flat, np.array(flat, np.int64)
        self.classes = [(_Class(size, np.concatenate(starts[size]).astype(np.int32), places), np.concatenate(owners[size])) for size in sorted(starts)]

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(first word, words, text) of each occurrence of a text's window, by length and then by position."""
        number, flat, n = self.number.get, self.flat, len(words)
        for tables, owners in self.classes:
            length, mask = tables.length, tables.mask
            end = length - 1
            shift = tables.shift if length > 1 else None
            while end < n:
                b = number(words[end])
                if length == 1:
                    if b is None:
                        end += 1
                        continue
                    bucket = b & mask
                else:
                    a = number(words[end - 1]) if b is not None else None
                    if a is None:  # a window that holds an unknown word can't begin before it
                        end += length if b is None else length - 1
                        continue
                    bucket = (a * 1_000_003 + b) & mask
                    if step := shift[bucket]:
                        end += step
                        continue
                lo, hi = tables.first[bucket], tables.first[bucket + 1]
                if lo < hi:
                    start = end - length + 1
                    ids = array("q", [number(w, 0) for w in words[start : end + 1]])
                    for pattern in tables.order[lo:hi].tolist():
                        at = tables.starts.item(pattern)
                        if flat[at : at + length] == ids:
                            yield start, length, owners.item(pattern)
                end += 1


def finder_of(shared: Broadcast, window: int) -> tuple[WuManber, list]:
    """(finder, item ids) of a broadcast benchmark; a worker keeps it beside the broadcast for its next tasks."""
    built = shared.__dict__.setdefault("_finders", {})
    if window not in built:
        items = shared.value
        built[window] = WuManber([folded_words(text) for _, text in items], window), [item_id for item_id, _ in items]
    return built[window]


_SCHEMA = "doc_id long, text binary, spans array<int>, items array<long>"


def _search(shared, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, names = finder_of(shared, window)
        for batch in batches:
            spans, items = [], []
            for text, old, ids in zip(batch.column("text"), batch.column("spans"), batch.column("items")):
                words = folded_words(text.as_py())
                hit, found = [], set()
                for start, size, owner in finder.find(words):
                    if not hit or hit[-1] != (start, start + size):
                        hit.append((start, start + size))
                    found.add(names[owner])
                found = (found - {None}).union(ids.as_py())
                if hit:
                    flat = old.as_py()
                    hit = merged(hit + list(zip(flat[::2], flat[1::2])))
                    spans.append([x for span in hit for x in span])
                else:
                    spans.append(old.as_py())
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))],
                names=["doc_id", "text", "spans", "items"],
            )

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, flat, ids in zip(batch.column("text"), batch.column("spans").to_pylist(), batch.column("items").to_pylist()):
            names = ",".join(sorted(map(str, ids)))
            rows.append((len(folded_words(text.as_py())), sum(flat[1::2]) - sum(flat[::2]), len(ids), hashlib.sha256(names.encode()).hexdigest()))
        n_words, n_hit, n_items, digest = (list(x) for x in zip(*rows)) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()),
                pa.array(digest, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_()), batch.column("spans"), batch.column("items"),
            ],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"],
        )


def _slices(benchmark: DataFrame, table_bytes: int) -> Iterator[Broadcast]:
    """The benchmark as broadcast lists of (item_id, text), each of about ``table_bytes`` at most."""
    context = benchmark.sparkSession.sparkContext
    items = benchmark.select(long_id(benchmark, "item_id"), as_bytes("text").alias("text")).where("text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    slices = -(-total // table_bytes) or 1
    dealt = items.withColumn("slice", F.pmod(F.xxhash64("text"), F.lit(slices)))
    for number in range(slices):
        yield context.broadcast([(r.item_id, bytes(r.text)) for r in dealt.where(F.col("slice") == number).collect()])


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row for each row of ``docs``: words, words inside any benchmark window, and the items.

    ``spans`` lists the starts and ends (in words, end exclusive) of the merged hit runs, ``items``
    the distinct item ids whose windows occur.  Null or empty texts have no words and no hits; null
    or empty items have no windows; an item without an id still marks words but is not listed;
    repeated items and repeated documents give the same answer each; an empty benchmark hits
    nothing.  Other columns of either table are ignored.

    The documents are read once and never shuffled.  The benchmark's size is measured first: up to
    ``table_bytes`` it is one broadcast table; beyond, it is dealt into as many tables by a hash of
    its text, and the documents pass through one search after another.
    """
    found = docs.select(
        long_id(docs), as_bytes("text").alias("text"),
        F.array().cast("array<int>").alias("spans"), F.array().cast("array<long>").alias("items"),
    )
    for number, shared in enumerate(_slices(benchmark, table_bytes)):
        if number and number % TABLES_AT_ONCE == 0:
            found = checkpoint(found)
        found = in_batches(found).mapInArrow(_search(shared, window), _SCHEMA)
    return in_batches(found).mapInArrow(
        _digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<int>, items array<long>"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs``, in its own columns, without any occurrence of a benchmark window.

    Texts are searched where they are; the benchmark passes as in find_contamination.  Rows with
    null or empty texts stay, as do repeated rows; an empty table gives an empty table.
    """
    names = list(docs.columns)
    for number, shared in enumerate(_slices(benchmark, TABLE_BYTES)):
        if number and number % TABLES_AT_ONCE == 0:
            docs = checkpoint(docs)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder, _ = finder_of(shared, window)
            for batch in batches:
                texts = batch.column(names.index("text"))
                clean = [next(finder.find(folded_words((t.as_py() or "").encode())), None) is None for t in texts]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = in_batches(docs).mapInArrow(run, docs.schema)
    return docs
