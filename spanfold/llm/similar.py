"""Near copies by exact Jaccard similarity of five-word shingles.

Sets are compared only where they can be similar: in one fixed order of all shingles, two sets of
Jaccard similarity t share k of their first n - ceil(t n) + k shingles, so no pair is lost.  k grows
with the set: a text that only shares a passage with others has fewer than k of its first shingles
in any other text and goes no further.  Shingles that a sample shows to be common come last in the
order.  SimHash fingerprints linked through vantage-point shards and star-shaped candidates under
each shared shingle are verified first; what their links leave apart is paired where places in the
order and sizes allow.  Components of the links are found by alternating stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanfold.llm.common import as_bytes, checkpoint, in_batches, long_id, spaced_words
from spanfold.llm.simhash import FEW, components, first_of_each, first_rows, link_fingerprints

WORDS = 5
#: Least similarity of near copies, as a fraction.
LEAST = (4, 5)
#: Texts whose shingles are counted to tell common ones; only the order, and so speed, depends on them.
SAMPLE = 4_096
COMMON = 200_000
#: Texts whose shingles a worker holds at once.
SLICE = 256
#: Bits by which fingerprints of candidates may differ.
RADIUS = 3
STAR_ROUNDS = 2
#: Two sets must share n // EXTRA + 1 of their first shingles, n being the size of the smaller one.
EXTRA = 20
#: What the last round's pairs must share more than one of: n // MORE, at most n // EXTRA.
MORE = 50
#: Rows under a common shingle are looked at in so many parts.
PARTS = 64
SEED = 42


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the lower-cased text's five-word shingles; fewer words are one shingle."""
    words = spaced_words(text.lower()) if text else []
    if not words:
        return np.empty(0, np.uint64)
    parts = [b" ".join(words)] if len(words) < WORDS else map(b" ".join, zip(*(words[i:] for i in range(WORDS))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(x, SEED) for x in parts], np.uint64))


def _name(found: np.ndarray) -> int:
    """Texts with equal sets are one node."""
    return int(np.array([xxhash.xxh64_intdigest(found.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def fingerprint(found: np.ndarray) -> int:
    """Signed 64-bit SimHash of a set of shingles, each counted once; 0 for the empty one."""
    ones = np.unpackbits(found.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(found)).tobytes(), "big", signed=True)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(_name(s), fingerprint(s)) for s in (shingles(x.as_py()) for x in batch.column("text"))]
        columns = [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *columns], names=["doc_id", "text_key", "node", "fp"])


def _all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column("text"):
            yield pa.RecordBatch.from_arrays([pa.array(shingles(x.as_py()).view(np.int64))], names=["key"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            found = [shingles(x.as_py()) for x in batch.column("text")[at : at + SLICE]]
            sets = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)]), np.concatenate(found).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in found], pa.int64()), sets], names=["node", "set"])


def prefix(found: np.ndarray, common: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set, n // EXTRA more than one shared with each similar set would need, and which of them are common."""
    n = len(found)
    most = n - -(-LEAST[0] * n // LEAST[1]) + n // EXTRA + 1
    if not len(common) or n == 0:
        return found[:most], np.zeros(min(n, most), bool)
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    order = np.where(common[at] == found, rank[at], -1)
    first = np.argsort(order, kind="stable")[:most]
    return found[first], order[first] >= 0


def _prefixes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = shared.value
        given: set[int] = set()  # a text that stands often gives its prefix once a task
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                keys, often, names, sizes, places = [np.empty(0, np.uint64)], [np.empty(0, bool)], [], [], []
                for x in batch.column("text")[at : at + SLICE]:
                    found = shingles(x.as_py())
                    if (name := _name(found)) in given:
                        continue
                    if len(given) < FEW:
                        given.add(name)
                    for to, part in zip((keys, often), prefix(found, common, rank)):
                        to.append(part)
                    names.append(np.full(len(keys[-1]), name, np.int64))
                    sizes.append(np.full(len(keys[-1]), len(found), np.int32))
                    places.append(np.arange(len(keys[-1]), dtype=np.int32))
                if names:
                    columns = [np.concatenate(keys).view(np.int64), *map(np.concatenate, (places, names, sizes, often))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "at", "node", "size", "often"])  # what differs from row to row comes first and compresses better

    return run


def _common(texts: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(common shingles, their places from the rarest) by a sample of the texts."""
    some = texts.where(F.pmod(F.col("text_key"), F.lit(max(1, total // SAMPLE))) == 0).select("text")
    counts = in_batches(some).mapInArrow(_all, "key long").groupBy("key").count().where("count > 2")
    rows = counts.orderBy(F.desc("count"), "key").limit(COMMON).collect()
    keys = np.array([r.key for r in reversed(rows)], np.int64).view(np.uint64)
    by_key = np.argsort(keys)
    return keys[by_key], by_key


def _verified(pairs: DataFrame, texts: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar; the sets of their texts are shuffled once."""
    pairs = checkpoint(pairs.distinct())
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = checkpoint(ends.join(reps, "node").select("doc_id", "text_key"))
    wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    on = F.expr("t.doc_id <=> w.doc_id and t.text_key = w.text_key")
    sets = in_batches(texts.alias("t").join(wanted.alias("w"), on, "left_semi").select("text")).mapInArrow(_sets, "node long, set array<long>").dropDuplicates(["node"])
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    sure = shared * LEAST[1] >= LEAST[0] * (F.size("sa") + F.size("sb") - shared)
    return checkpoint(both.where(sure).select("a", "b"))


_FIT = f"least(a_size, b_size) * {LEAST[1]} >= greatest(a_size, b_size) * {LEAST[0]}"
#: What two similar sets have in common at least: t / (1 + t) of both sizes.
_NEEDED = f"({LEAST[0]} * (a_size + b_size) + {sum(LEAST) - 1}) div {sum(LEAST)}"
#: Sets that have m shingles in common share 1 + e of them among the first n - m + 1 + e of either; i and j are places there.
_EARLY = f"a_size - i + {{0}} >= {_NEEDED} and b_size - j + {{0}} >= {_NEEDED}"


def _print_pairs(prints: DataFrame) -> DataFrame:
    """(x, y): candidates whose fingerprints are equal or linked through the vantage-point shards; (node, fp) rows."""
    first = checkpoint(prints.groupBy("fp").agg(F.min("node").alias("y")))
    links = link_fingerprints(first.select("fp"), RADIUS)
    ends = links.join(first.select(F.col("fp").alias("a"), F.col("y").alias("x")), "a").join(first.select(F.col("fp").alias("b"), "y"), "b")
    return ends.select("x", "y").unionByName(prints.join(first, "fp").select(F.col("node").alias("x"), "y"))


def _near_names(links: DataFrame) -> DataFrame:
    """(node, group): nodes of one group are connected; two hops only, so not all connected nodes are in one."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("group")).select(F.col("a").alias("node"), F.least("a", "group").alias("group"))
    beside = both.join(least, both.b == least.node).groupBy("a").agg(F.min("group").alias("group"))
    return checkpoint(beside.join(least.withColumnRenamed("group", "own"), F.col("a") == F.col("node")).select("node", F.least("group", "own").alias("group")))


def _apart(left: DataFrame) -> DataFrame:
    """x, a_size, y, b_size of the sets in different groups that may be similar; y is the smaller one.

    What they have in common is at least 4/5 of the larger and 8/9 of the smaller set, so the
    smaller one is found under its first ninth and a fiftieth more only.
    """
    share = lambda p, q: f"at <= size - ({p} * size + {q - 1}) div {q} + size div {MORE}"
    one = left.where(share(LEAST[0], LEAST[1])).select("key", F.col("node").alias("x"), F.col("size").alias("a_size"), F.col("at").alias("i"), F.col("group").alias("g"))
    two = left.where(share(2 * LEAST[0], sum(LEAST))).select("key", F.col("node").alias("y"), F.col("size").alias("b_size"), F.col("at").alias("j"), F.col("group").alias("h"))
    pairs = one.join(two, "key").where("g <> h and (a_size > b_size or a_size = b_size and x > y)").where(_FIT).where(_EARLY.format(f"b_size div {MORE}"))
    counted = pairs.groupBy("x", "a_size", "y", "b_size").agg(F.count("*").alias("shared"))
    return counted.where(f"shared > b_size div {MORE}").drop("shared")  # every key that such a pair shares is here


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, copies, group of the first row of each distinct set of shingles in ``docs``.

    Rows are in one group when a chain of pairs with Jaccard similarity of at least LEAST connects
    them.  Texts without a word are equal.
    """
    texts = docs.select(long_id(docs), F.xxhash64(as_bytes("text")).alias("text_key"), as_bytes("text").alias("text"))
    rows = checkpoint(in_batches(texts).mapInArrow(_nodes, "doc_id long, text_key long, node long, fp long"))
    reps = checkpoint(first_rows(rows, "node"))
    common = docs.sparkSession.sparkContext.broadcast(_common(texts, rows.count()))
    found = in_batches(texts.select("text")).mapInArrow(_prefixes(common), "key long, at int, node long, size int, often boolean")
    # Under a common shingle there may be any number of rows: they stay, and no task sees them all.
    part = F.when(F.col("often"), F.pmod(F.xxhash64("node"), F.lit(PARTS))).otherwise(0)
    by_key = Window.partitionBy("key", "part")
    found = found.withColumn("part", part).withColumn("lo", F.min("node").over(by_key)).withColumn("hi", F.max("node").over(by_key))
    keys = checkpoint(found.where("often or lo <> hi").select("key", "at", "node", "size").distinct())
    # A partner may be smaller by a fifth, and then its own first shingles set how many are shared.
    enough = keys.groupBy("node", "size").agg(F.count("*").alias("shared")).where(f"shared > ((4 * size + 4) div 5) div {EXTRA}").select("node")
    keys = checkpoint(keys.join(enough, "node", "left_semi"))
    links, left = None, keys
    for number in range(STAR_ROUNDS + 1):
        if number < STAR_ROUNDS:
            # First the set with the fewest rarer shingles, as what others were made from has; then any.
            place = F.struct(F.col("at") if number == 0 else F.lit(0), F.xxhash64("node", F.lit(number)))
            first = left.groupBy("key").agg(F.min(F.struct(place.alias("place"), "node", "size", "at")).alias("first"))
            pairs = left.join(first, "key").select(
                F.col("node").alias("x"), F.col("size").alias("a_size"), F.col("at").alias("i"), F.col("first.node").alias("y"), F.col("first.size").alias("b_size"), F.col("first.at").alias("j")
            ).where(_EARLY.format(0))
        else:
            pairs = _apart(left)
        pairs = pairs.where(_FIT).select("x", "y")
        if number == 0:
            pairs = pairs.unionByName(_print_pairs(checkpoint(rows.select("node", "fp").distinct())))
        found = _verified(pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), texts, reps)
        links = found if links is None else links.unionByName(found)
        if number < STAR_ROUNDS:
            left = keys.join(_near_names(links), "node", "left").select("key", "at", "node", "size", F.coalesce("group", "node").alias("group"))
            apart = left.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("key")
            left = checkpoint(left.join(apart, "key", "left_semi"))
    return reps.join(components(links), "node", "left").select("doc_id", "text_key", "copies", F.coalesce("root", "node").alias("group"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, in its own columns, with one row of each group of near copies.

    Of a group the row of least id stays (null last, then by text); null and empty texts are near
    copies of each other; rows without an id or with a shared one stand for their own texts; an
    empty table gives an empty table.
    """
    return first_of_each(docs, similar_groups(docs))
