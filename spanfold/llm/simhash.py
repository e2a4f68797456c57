"""SimHash near-duplicates linked through vantage-point trees.

A tree of vantage points, built on a bounded sample, cuts the distinct fingerprints into shards by
their Hamming distance to each vantage point.  A fingerprint is stored in the one shard that owns
it and asked in every other shard that the triangle bound cannot rule out.  Each shard answers
through a tree of its own and returns a spanning forest of its links, never all pairs of a group.
Components of the forests are found by alternating large and small stars on DataFrames.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfold.llm.common import as_bytes, checkpoint, in_batches, long_id, spaced_words

log = logging.getLogger(__name__)
SEED = 42
#: Distinct fingerprints that one shard is meant to own (8 MB).  Small shards cost traffic: the more
#: there are, the more of them every fingerprint is asked in.
SHARD = 1 << 20
#: Fingerprints the driver sees to place the vantage points: so many for each shard, this many at least.
SAMPLE, SAMPLED = 16_384, 64
#: A fingerprint is hot if its rows are more than one in so many; there are fewer of them than that.
HOT_SHARE = 1_000
#: Keys that are sent to every task, once counted, rather than shuffled with the texts they pick.
FEW = 1_000_000
_LEAF = 96
_CELLS = 4_000_000


def fingerprint(text: bytes | None, words_in_shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the lower-cased text's word shingles; 0 when there is no word."""
    words = spaced_words(text.lower()) if text else []
    if not words:
        return 0
    if len(words) < words_in_shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_in_shingle))))
    digest, ones, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    hashes = [digest(s, SEED) for s in shingles]
    for at in range(0, len(hashes), 65_536):
        block = np.array(hashes[at : at + 65_536], dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
        total += len(block)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def _fingerprints(words_in_shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), words_in_shingle) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(found, pa.int64())], names=["doc_id", "text_key", "fp"])

    return run


def distances(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class VantageTree:
    """Vantage points with a distance each: inside is at most that far, outside is farther."""

    def __init__(self, points: np.ndarray, leaf: int, radius: int, rng: np.random.Generator):
        self.points, self.radius, self.leaves = points, radius, 0
        self.root = self._build(np.arange(len(points)), leaf, rng)

    def _build(self, rows: np.ndarray, leaf: int, rng: np.random.Generator):
        best = None
        if len(rows) > leaf:
            some = rows if len(rows) <= 512 else rng.choice(rows, 512, replace=False)
            for vantage in self.points[rng.choice(rows, min(8, len(rows)), replace=False)]:
                d = distances(self.points[some], vantage)
                at = np.cumsum(np.bincount(d, minlength=66 + self.radius))
                for cut in range(64):
                    inside = at[cut] / len(d)
                    if 0.3 <= inside <= 0.7:
                        doubt = (at[cut + self.radius] - (at[cut - self.radius] if cut >= self.radius else 0)) / len(d)
                        cost = doubt + 0.5 * abs(inside - 0.5)
                        if best is None or cost < best[0]:
                            best = cost, vantage, cut
            if best is None:  # many at one distance: any cut that parts them
                d = distances(self.points[rows], vantage)
                cut = int(np.median(d))
                cut -= int(cut >= d.max())
                if d.min() <= cut:
                    best = 0.0, vantage, cut
        if best is not None:
            _, vantage, cut = best
            near = distances(self.points[rows], vantage) <= cut
            if near.any() and not near.all():
                return vantage, cut, self._build(rows[near], leaf, rng), self._build(rows[~near], leaf, rng)
        self.leaves += 1
        return self.leaves - 1, rows

    def visit(self, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(leaf, its rows, queries that may have neighbours in it, which of them it owns)."""
        stack = [(self.root, np.arange(len(queries)), np.ones(len(queries), bool))]
        while stack:
            node, asked, own = stack.pop()
            if not len(asked):
                continue
            if len(node) == 2:
                yield node[0], node[1], asked, own
                continue
            vantage, cut, inside, outside = node
            d = distances(queries[asked], vantage)
            left, right = d <= cut + self.radius, d > cut - self.radius
            stack.append((inside, asked[left], own[left] & (d[left] <= cut)))
            stack.append((outside, asked[right], own[right] & (d[right] > cut)))

    def pairs(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row) index arrays of all pairs within the radius."""
        for _, rows, asked, _ in self.visit(queries):
            step = max(1, _CELLS // len(rows))
            for at in range(0, len(asked), step):
                some = asked[at : at + step]
                q, r = np.nonzero(np.bitwise_count(queries[some][:, None] ^ self.points[rows][None, :]) <= self.radius)
                if len(q):
                    yield some[q], rows[r]


class _Sets:
    """Disjoint sets over 0..n-1; a set's root is its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        root = self.parent[x]
        while (up := self.parent[root]) is not None and (up != root).any():
            root = up
        self.parent[x] = root
        return root

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the sets of a[i] and b[i] for all i."""
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def _route(shared, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            shards, rows, visitors = [], [], []
            owner = np.empty(len(fps), np.int64)
            found = [(leaf, asked, own) for leaf, _, asked, own in tree.visit(fps.view(np.uint64))]
            for leaf, asked, own in found:
                owner[asked[own]] = leaf
            for leaf, asked, own in found:
                asked = asked[owner[asked] <= leaf]  # of two shards the later one is asked
                shards.append(np.full(len(asked), leaf))
                rows.append(asked)
                visitors.append(owner[asked] != leaf)
            if shards:
                rows = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(shards), pa.int32()), pa.array(np.concatenate(visitors)), pa.array(fps[rows], pa.int64())], names=["shard", "visitor", "fp"]
                )

    return run


class _Shard:
    def __init__(self, owned: list[np.ndarray], radius: int):
        self.points = np.unique(np.concatenate(owned)) if owned else np.empty(0, np.uint64)
        self.tree = VantageTree(self.points, _LEAF, radius, np.random.default_rng(SEED))
        self.sets = _Sets(len(self.points))
        for q, r in self.tree.pairs(self.points):
            once = q < r
            self.sets.union(q[once], r[once])

    def ask(self, visitors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One link for each visitor that has neighbours; those neighbours become one set."""
        first = np.full(len(visitors), -1)
        for q, r in self.tree.pairs(visitors):
            new = first[q] < 0
            first[q[new]] = r[new]
            self.sets.union(first[q], r)
        some = np.flatnonzero(first >= 0)
        return visitors[some], self.points[first[some]]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        root = self.sets.find(np.arange(len(self.points)))
        some = np.flatnonzero(root != np.arange(len(root)))
        return self.points[some], self.points[root[some]]


def _edges(links: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(side.view(np.int64)) for side in links], names=["a", "b"])


def _link(radius: int):
    """Rows come sorted by shard, owned fingerprints first; only those of one shard are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, owned, shard = None, [], None
        for batch in batches:
            shards, visitors = batch.column("shard").to_numpy(), batch.column("visitor").to_numpy(zero_copy_only=False)
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for number in np.unique(shards):
                if number != at:
                    if owned or shard:
                        yield _edges((shard or _Shard(owned, radius)).links())
                    at, owned, shard = number, [], None
                here = shards == number
                if (mine := fps[here & ~visitors]).size:
                    owned.append(mine)
                if (asking := fps[here & visitors]).size:
                    shard = shard or _Shard(owned, radius)
                    yield _edges(shard.ask(asking))
        if owned or shard:
            yield _edges((shard or _Shard(owned, radius)).links())

    return run


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the component's smallest node.

    Large stars link each node's larger neighbours to its smallest one, small stars link the
    smaller ones; both keep components whole and end in one star for each, after about a
    logarithm of the longest path.  Each round is cut by a checkpoint.
    """
    edges = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        edges = checkpoint(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_anti")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("u").alias("node"), F.col("u").alias("root")))


def fan_out(tree: VantageTree, points: np.ndarray) -> float:
    """Shards that a fingerprint is sent to on average, its own among them."""
    asked = own = 0
    for _, _, queries, owns in tree.visit(points):
        asked, own = asked + len(queries), own + int(owns.sum())
    return (asked + own) / 2 / max(1, own)  # of two shards only one is asked


def link_fingerprints(distinct: DataFrame, radius: int = 3, shard_size: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints (column fp, distinct) within ``radius``.

    The driver sees ``sample`` fingerprints or SAMPLED for each shard, one in 16,384 at most beyond
    the first 16,384; the expected traffic is logged before anything is sent.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    sample = max(sample, SAMPLED * (n // max(shard_size, SHARD)))
    seen = [r.fp for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()]
    points = np.array(seen, dtype=np.int64).view(np.uint64)
    leaf = max(4, int(len(points) * shard_size / max(n, 1)))
    leaf = min(leaf, max(4, len(points) // 8))  # some shards for the cores of a small job
    tree = VantageTree(points, leaf, radius, np.random.default_rng(SEED))
    shards = tree.leaves
    log.info("%d fingerprints, %d shards, each fingerprint sent to %.1f of them", n, shards, fan_out(tree, points))
    tree.points = points[:0]
    routed = distinct.select("fp").mapInArrow(_route(spark.sparkContext.broadcast(tree), radius), "shard int, visitor boolean, fp long")
    dealt = routed.repartition(shards, "shard").sortWithinPartitions("shard", "visitor")
    return dealt.mapInArrow(_link(radius), "a long, b long")


def _fingerprinted(docs: DataFrame, words_in_shingle: int) -> DataFrame:
    """doc_id, text_key, fp of every row."""
    rows = docs.select(long_id(docs), F.xxhash64(as_bytes("text")).alias("text_key"), as_bytes("text").alias("text"))
    return checkpoint(in_batches(rows).mapInArrow(_fingerprints(words_in_shingle), "doc_id long, text_key long, fp long"))


def near_duplicates(docs: DataFrame, radius: int = 3, words_in_shingle: int = 3, shard_size: int = SHARD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest doc_id that can be reached over fingerprints at most
    ``radius`` bits apart.  Null and empty texts have the fingerprint zero, linked like any other.
    Exact copies share a fingerprint and are grouped before any search.  Repeated ids give a row
    each; null ids are kept and never name a component unless it has no other id (then null).  An
    empty table gives an empty table; other columns are ignored.
    """
    rows = _fingerprinted(docs, words_in_shingle)
    distinct = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    nodes = components(link_fingerprints(distinct, radius, shard_size))
    linked = checkpoint(nodes.join(distinct, nodes.node == distinct.fp).select("fp", "root", "first"))
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.join(least, "root").select("fp", "least")
    named = distinct.join(linked, "fp", "left").select("fp", "copies", F.coalesce("least", "first").alias("component_id"))
    # Fingerprints that hold more than a thousandth of all rows are fewer than a thousand: their
    # rows are named by broadcast, where they are, and only the others are shuffled.
    total = distinct.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    named = checkpoint(named.withColumn("hot", F.col("copies") * HOT_SHARE > total))
    hot = F.broadcast(named.where("hot").select("fp", "component_id"))
    cold = rows.join(hot.select("fp"), "fp", "left_anti").join(named.where("not hot").select("fp", "component_id"), "fp")
    found = rows.join(hot, "fp").unionByName(cold)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_rows(rows: DataFrame, key: str) -> DataFrame:
    """``key``, doc_id, text_key, copies of the first row (doc_id, text_key) of each ``key``.

    First is the least id, null last, then the least text key; ``copies`` counts the rows equal in
    both.  Equal rows meet in a partial aggregation, so a hot key is a row from each task.
    """
    counted = rows.groupBy(key, "doc_id", "text_key").agg(F.count("*").alias("copies"))
    me = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", "copies")
    return counted.groupBy(key).agg(F.min(me).alias("me")).select(key, "me.doc_id", "me.text_key", "me.copies")


def first_of_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of ``rows`` (doc_id, text_key, copies, group), in its own columns.

    The row of least id (null last), then text key, stays.  Texts are read where they are; only
    rows that share both with another row are shuffled, and of those that also have equal texts
    the first by its columns stays (columns that can't be ordered, like maps, don't count).
    """
    me = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", "copies")
    kept = checkpoint(rows.groupBy("group").agg(F.min(me).alias("me")).select(F.col("me.doc_id").alias("kept_id"), F.col("me.text_key").alias("kept_key"), "me.copies"))
    few = kept.count() <= FEW
    names = [f"_c{i}" for i in range(len(docs.columns))]  # so no column of the input can clash
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    doc_id, text = names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    on = F.expr(f"cast(d.{doc_id} as long) <=> k.kept_id and xxhash64(cast(cast(d.{text} as string) as binary)) = k.kept_key")

    def chosen(which: str) -> DataFrame:
        some = kept.where(which)
        return held.alias("d").join((F.broadcast(some) if few else some).alias("k"), on, "left_semi")

    found = chosen("copies = 1")
    if not kept.where("copies > 1").isEmpty():
        ordered = [n for n, f in zip(names, docs.schema.fields) if not re.search("map<|variant", f.dataType.simpleString())]
        first = F.min_by(F.struct(*names), F.struct(*ordered)).alias("_row")
        found = found.unionByName(chosen("copies > 1").groupBy(doc_id, text).agg(first).select("_row.*"))
    return found.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])


def keep_one(docs: DataFrame, radius: int = 3, words_in_shingle: int = 3, shard_size: int = SHARD) -> DataFrame:
    """The rows of ``docs``, in its own columns, with one row of each component of ``near_duplicates``.

    The component is that of the row's own fingerprint, so rows without an id and rows that share
    one stand for their own texts.  Of a component the row of least id stays (null last, then by
    text, then by its other columns).  An empty table gives an empty table.
    """
    rows = _fingerprinted(docs, words_in_shingle)
    nodes = components(link_fingerprints(checkpoint(rows.select("fp").distinct()), radius, shard_size))
    grouped = first_rows(rows, "fp").join(nodes.withColumnRenamed("node", "fp"), "fp", "left")
    return first_of_each(docs, grouped.select("doc_id", "text_key", "copies", F.coalesce("root", "fp").alias("group")))
