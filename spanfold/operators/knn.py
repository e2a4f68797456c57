"""Exact k-nearest-neighbour join by squared Euclidean distance, ties by reference index.

Small reference sets are held by every worker as arrays.  Larger ones are cut into boxes: within
each partition key, at the median of the widest dimension, until a box holds a bounded number.  A
query's own box gives it a first k-th distance; a walk over the boxes drops every branch that lies
farther, and only the boxes that are left are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanfold.functions.features import QUANTISED
from spanfold.sources.scratch import scratch, written

K = 5
#: Bytes of references, as numbers of 8 bytes, that every worker may hold; beyond, boxes are joined.
MOST_BYTES = 256 << 20
#: References that a box is meant to hold.
LEAF = 256
#: References that place the cuts between boxes at most; boxes themselves are those of all references.
SAMPLE = 131_072
_LEAST_SAMPLED = 16
_CELLS = 4_000_000
#: Queries and references that are compared in one cell of the brute grid at most, but for the hash's unevenness.
CELL = 131_072, 262_144
#: Queries and references whose distances are held at once there.
_TILE = 256, 4_096


def squared_distance(left: str, right: str, columns: list[str]) -> Column:
    """Unrolled, so that whole-stage code generation keeps it in registers."""
    total = None
    for c in columns:
        gap = F.col(f"{left}.{c}").cast("long") - F.col(f"{right}.{c}").cast("long")
        total = gap * gap if total is None else total + gap * gap
    return total


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The k first candidates of each query; the window's limit also runs before the shuffle."""
    order = Window.partitionBy("query_id").orderBy("dist", "ref_idx")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def box_bound(columns: list[str] = QUANTISED) -> Column:
    """Least squared distance from a query (q) to any point of a box (z)."""
    total = None
    for i, c in enumerate(columns):
        gap = F.greatest(F.col(f"z.lo{i}") - F.col(f"q.{c}"), F.col(f"q.{c}") - F.col(f"z.hi{i}"), F.lit(0)).cast("long")
        total = gap * gap if total is None else total + gap * gap
    return total


class BoxTree:
    """Boxes over references: a tree for each partition key.

    A box is named by its node, or by -1 - key where the sample knew no reference of the key.
    """

    def __init__(self, keys: np.ndarray, points: np.ndarray, leaf: int):
        self.dim: list[int] = []
        self.cut: list[int] = []
        self.children: list[tuple[int, int]] = []
        self.roots = {int(key): self._grow(points[keys == key], leaf) for key in np.unique(keys)}

    def _grow(self, points: np.ndarray, leaf: int) -> int:
        node = len(self.dim)
        self.dim.append(-1)
        self.cut.append(0)
        self.children.append((-1, -1))
        spread = points.max(0).astype(np.int64) - points.min(0)
        widest = int(spread.argmax())
        if len(points) > leaf and spread[widest]:
            values = points[:, widest]
            cut = np.partition(values, (len(values) - 1) // 2)[(len(values) - 1) // 2]
            if cut == values.max():
                cut = values[values < cut].max()
            self.dim[node], self.cut[node] = widest, int(cut)
            self.children[node] = self._grow(points[values <= cut], leaf), self._grow(points[values > cut], leaf)
        return node

    def box_of(self, keys: np.ndarray, points: np.ndarray) -> np.ndarray:
        found = -1 - keys.astype(np.int64)
        stack = [(root, np.flatnonzero(keys == key)) for key, root in self.roots.items()]
        while stack:
            node, rows = stack.pop()
            if len(rows) and self.dim[node] < 0:
                found[rows] = node
            elif len(rows):
                near = points[rows, self.dim[node]] <= self.cut[node]
                left, right = self.children[node]
                stack += [(left, rows[near]), (right, rows[~near])]
        return found

    def fit(self, boxes: np.ndarray, counts: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Set the boxes of all references; a branch's box holds those of its children."""
        n, dims = len(self.dim), low.shape[1]
        self.boxes, self.counts, self.lows, self.highs = boxes, counts, low.astype(np.int64), high.astype(np.int64)
        self.place = {int(b): i for i, b in enumerate(boxes)}
        self.low, self.high, self.filled = np.zeros((n, dims), np.int64), np.zeros((n, dims), np.int64), np.zeros(n, bool)
        for node in reversed(range(n)):  # children come after their parents
            if self.dim[node] < 0:
                if (at := self.place.get(node)) is not None:
                    self.low[node], self.high[node], self.filled[node] = self.lows[at], self.highs[at], True
            elif some := [c for c in self.children[node] if self.filled[c]]:
                self.low[node], self.high[node], self.filled[node] = self.low[some].min(0), self.high[some].max(0), True

    @staticmethod
    def bound(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        gap = np.maximum(np.maximum(low - points, points - high), 0)
        return (gap * gap).sum(-1)

    def walk(self, points: np.ndarray, cutoff: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(box, points that may have a neighbour within their cutoff in it); equality counts, as a tie may win by its index."""
        for at in np.flatnonzero(self.boxes < 0):
            rows = np.flatnonzero(self.bound(points, self.lows[at], self.highs[at]) <= cutoff)
            if len(rows):
                yield int(self.boxes[at]), rows
        stack = [(root, np.arange(len(points))) for root in self.roots.values()]
        while stack:
            node, rows = stack.pop()
            if not self.filled[node]:
                continue
            rows = rows[self.bound(points[rows], self.low[node], self.high[node]) <= cutoff[rows]]
            if len(rows) and self.dim[node] < 0:
                yield node, rows
            elif len(rows):
                stack += [(child, rows) for child in self.children[node]]

    def first_boxes(self, keys: np.ndarray, points: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """(box, points) so that each point is given at least k references, its own box's or else those of the nearest boxes."""
        own = self.box_of(keys, points)
        enough = np.array([self.counts[self.place[b]] >= k if b in self.place else False for b in own.tolist()], bool)
        for box in np.unique(own[enough]):
            yield int(box), np.flatnonzero(enough & (own == box))
        for row in np.flatnonzero(~enough) if len(self.boxes) else ():
            order = np.argsort(self.bound(points[row], self.lows, self.highs), kind="stable")
            for at in order[: 1 + np.searchsorted(np.cumsum(self.counts[order]), k)]:
                yield int(self.boxes[at]), np.array([row])


def _array(batch: pa.RecordBatch | pa.Table, columns: list[str]) -> np.ndarray:
    return np.column_stack([np.asarray(batch.column(c)) for c in columns]).astype(np.int64)


def _add_box(shared, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = shared.value.box_of(batch.column("pkey").to_numpy(zero_copy_only=False), _array(batch, columns))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(boxes, pa.int64())], names=[*batch.schema.names, "box"])

    return run


def _ask(shared, columns: list[str], k: int | None):
    """(box, query, cutoff) rows: the first boxes where ``k`` is given, else all within the cutoff."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            points = _array(batch, columns)
            if k is None:
                cutoff = batch.column("cutoff").to_numpy(zero_copy_only=False)
                found = list(tree.walk(points, cutoff))
            else:
                found = list(tree.first_boxes(batch.column("pkey").to_numpy(zero_copy_only=False), points, k))
            for at in range(0, len(found), 256):
                some = found[at : at + 256]
                rows = batch.take(pa.array(np.concatenate([r for _, r in some])))
                boxes = np.concatenate([np.full(len(r), b) for b, r in some])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(boxes, pa.int64())], names=[*batch.schema.names, "box"])

    return run


def _nearest(shared, k: int, columns: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, labels, points = shared.value
        points = points.astype(np.float64)  # sums stay below 2**53, so products are exact
        squares = (points * points).sum(1)
        most = min(k, len(points))
        step = max(1, _CELLS // max(1, len(points)))
        for frame in frames:
            ids, q = frame["query_id"].to_numpy(), frame[columns].to_numpy(np.float64)
            for at in range(0, len(q) if most else 0, step):
                some = q[at : at + step]
                dist = some @ (-2 * points.T)
                dist += (some * some).sum(1)[:, None]
                dist += squares[None, :]
                # References are in index order: all at or below the k-th distance hold every winner.
                limit = np.partition(dist, most - 1, axis=1)[:, most - 1]
                row, ref = np.nonzero(dist <= limit[:, None])
                order = np.lexsort((ref, dist[row, ref], row))
                row, ref = row[order], ref[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                top = rank < most
                row, ref, rank = row[top], ref[top], rank[top]
                yield pd.DataFrame({"query_id": ids[at + row], "rank": rank + 1, "ref_idx": index[ref], "dist": dist[row, ref].astype(np.int64), "label": labels[ref]})

    return run


def _compared(k: int, columns: list[str]):
    """The k first references of each query of one cell of the grid; every pair is compared, a tile at a time."""

    def run(asked: pa.Table, refs: pa.Table) -> pa.Table:
        refs = refs.sort_by("ref_idx")
        index, labels = (refs.column(c).to_numpy() for c in ("ref_idx", "label"))
        points, ids = _array(refs, columns).astype(np.float64), asked.column("query_id")
        # One product gives a distance less the query's own square; sums stay below 2**53, so all is exact.
        sides = np.vstack([-2 * points.T, (points * points).sum(1)])
        rows, found, far = [], [], []
        for at in range(0, len(ids) if len(index) else 0, _TILE[0]):
            some = _array(asked.slice(at, _TILE[0]), columns).astype(np.float64)
            own, some = (some * some).sum(1), np.column_stack([some, np.ones(len(some))])
            limit = np.full(len(some), np.inf)
            row, ref, dist = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            for start in range(0, len(index), _TILE[1]):
                tile = some @ sides[:, start : start + _TILE[1]]
                if start == 0 and tile.shape[1] >= k:
                    limit = np.partition(tile, k - 1, axis=1)[:, k - 1]
                near = np.flatnonzero(tile <= limit[:, None])  # equality counts, as a tie may win by its index
                r, c = np.divmod(near, tile.shape[1])
                row, ref, dist = np.concatenate([row, r]), np.concatenate([ref, start + c]), np.concatenate([dist, tile.ravel()[near]])
                if len(row) > 4 * k * len(some) or start + _TILE[1] >= len(index):
                    order = np.lexsort((ref, dist, row))
                    row, ref, dist = row[order], ref[order], dist[order]
                    rank = np.arange(len(row)) - np.searchsorted(row, row)
                    full = rank == k - 1
                    limit[row[full]] = dist[full]
                    row, ref, dist = (x[rank < k] for x in (row, ref, dist))
            rows.append(at + row)
            found.append(ref)
            far.append(dist + own[row])
        rows, found, far = (np.concatenate([np.empty(0, kind), *x]) for x, kind in ((rows, np.int64), (found, np.int64), (far, np.float64)))
        return pa.table({"query_id": ids.take(pa.array(rows)), "ref_idx": index[found], "label": labels[found].astype(np.int32), "dist": far.astype(np.int64)})

    return run


class Brute:
    """Compares every pair of a grid of queries and references; the rule for the others.

    A cell of the grid has bounded parts of both and gives k candidates a query, so neither side
    is broadcast and no pair becomes a row.
    """

    def __init__(self, refs: DataFrame, k: int, columns: list[str]):
        self.refs, self.k, self.columns = refs.select("ref_idx", "label", *columns), k, columns
        n, cores = refs.count(), refs.sparkSession.sparkContext.defaultParallelism
        self.parts = max(1, -(-n // CELL[1]), min(4 * cores, n // _TILE[1]))

    def neighbours(self, queries: DataFrame) -> DataFrame:
        kind, asked = dict(queries.dtypes)["query_id"], queries.select("query_id", *self.columns)
        groups = max(1, -(-asked.count() // CELL[0]))

        def dealt(side: DataFrame, key: str, own: str, n: int, other: str, others: int) -> DataFrame:
            """Each row goes to one place by its key, and to all places of the other side."""
            rows = side.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
            return rows.repartition(groups * self.parts, "_group", "_part")

        left = dealt(asked, "query_id", "_group", groups, "_part", self.parts)
        right = dealt(self.refs, "ref_idx", "_part", self.parts, "_group", groups)
        cells = left.groupBy("_group", "_part").cogroup(right.groupBy("_group", "_part"))
        near = cells.applyInArrow(_compared(self.k, self.columns), f"query_id {kind}, ref_idx long, label int, dist long")
        return _ranked(near, self.k).select("query_id", "rank", "ref_idx", "dist", "label")

    def close(self) -> None:
        """Nothing is held."""


class Arrays:
    """Matrix products in workers that hold all references; no shuffle."""

    def __init__(self, refs: DataFrame, k: int, columns: list[str]):
        table = refs.select("ref_idx", "label", *columns).toPandas().sort_values("ref_idx")
        value = table["ref_idx"].to_numpy(np.int64), table["label"].to_numpy(np.int32), table[columns].to_numpy(np.int32)
        self.shared, self.k, self.columns = refs.sparkSession.sparkContext.broadcast(value), k, columns

    def neighbours(self, queries: DataFrame) -> DataFrame:
        kind = dict(queries.dtypes)["query_id"]
        return queries.select("query_id", *self.columns).mapInPandas(_nearest(self.shared, self.k, self.columns), f"query_id {kind}, rank int, ref_idx long, dist long, label int")

    def close(self) -> None:
        self.shared.destroy()


class Boxes:
    """Joins queries with the boxes that may hold a neighbour.

    Of equal vectors only the k of least index can be neighbours, so the others are left out first
    and no box of one point is hot.  The boxes' tree is bounded by SAMPLE and broadcast; references
    and queries are shuffled by box.
    """

    def __init__(self, refs: DataFrame, k: int, columns: list[str], leaf: int = LEAF, sample: int = SAMPLE):
        spark = refs.sparkSession
        self.k, self.columns, self.parts = k, columns, int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = refs.select("ref_idx", "label", (F.col("pkey") if "pkey" in refs.columns else F.lit(0)).cast("int").alias("pkey"), *columns)
        equal = Window.partitionBy("pkey", *columns).orderBy("ref_idx")
        rows = rows.withColumn("_n", F.row_number().over(equal)).where(F.col("_n") <= k).drop("_n")
        rows = written(rows, scratch(spark, "references"))
        n = rows.count()
        some = rows.where(F.pmod(F.xxhash64("ref_idx"), F.lit(max(1, n // sample))) == 0).limit(2 * sample).select("pkey", *columns).toPandas()
        within = max(_LEAST_SAMPLED, leaf * len(some) // max(1, n)) if len(some) < n else leaf
        tree = BoxTree(some["pkey"].to_numpy(), some[columns].to_numpy(), within)
        kinds = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
        cuts = spark.sparkContext.broadcast(tree)
        boxed = rows.mapInArrow(_add_box(cuts, columns), f"{kinds}, box long").repartition(self.parts, "box")
        self.refs = written(boxed, scratch(spark, "boxes"))
        low, high = [F.min(c).alias(f"lo{i}") for i, c in enumerate(columns)], [F.max(c).alias(f"hi{i}") for i, c in enumerate(columns)]
        zones = self.refs.groupBy("box").agg(F.count("*").alias("n"), *low, *high).toPandas()  # a row for each box
        sides = [zones[[f"{side}{i}" for i in range(len(columns))]].to_numpy().reshape(-1, len(columns)) for side in ("lo", "hi")]
        tree.fit(zones["box"].to_numpy(np.int64), zones["n"].to_numpy(np.int64), *sides)
        self.tree, self.shared = tree, spark.sparkContext.broadcast(tree)
        cuts.destroy()

    def _pairs(self, asked: DataFrame, *more: str) -> DataFrame:
        distance = squared_distance("q", "r", self.columns).alias("dist")
        return asked.repartition(self.parts, "box").alias("q").join(self.refs.repartition(self.parts, "box").alias("r"), "box").select("q.query_id", "r.ref_idx", "r.label", distance, *more)

    def asked(self, queries: DataFrame) -> DataFrame:
        """query_id, box, cutoff and the columns of every box that may hold a neighbour of a query."""
        kind = dict(queries.dtypes)["query_id"]
        points = queries.select("query_id", (F.col("pkey") if "pkey" in queries.columns else F.lit(0)).cast("int").alias("pkey"), *self.columns)
        kinds = f"query_id {kind}, pkey int, " + ", ".join(f"{c} int" for c in self.columns)
        points = written(points.select("query_id", "pkey", *[F.col(c).cast("int") for c in self.columns]), scratch(queries.sparkSession, "queries"))
        first = self._pairs(points.mapInArrow(_ask(self.shared, self.columns, self.k), f"{kinds}, box long"))
        far = _ranked(first, self.k).groupBy("query_id").agg(F.max("dist").alias("cutoff"), F.count("*").alias("found"))
        far = far.select("query_id", F.when(F.col("found") >= self.k, F.col("cutoff")).otherwise(F.lit((1 << 62))).alias("cutoff"))
        return points.join(far, "query_id").mapInArrow(_ask(self.shared, self.columns, None), f"{kinds}, cutoff long, box long")

    def neighbours(self, queries: DataFrame) -> DataFrame:
        pairs = self._pairs(self.asked(queries), "q.cutoff")
        near = pairs.where("dist <= cutoff").drop("cutoff")
        return _ranked(near, self.k).select("query_id", "rank", "ref_idx", "dist", "label")

    def close(self) -> None:
        self.shared.destroy()


Index = Brute | Arrays | Boxes


def build(refs: DataFrame, k: int = K, strategy: str = "auto", columns: list[str] = QUANTISED) -> Index:
    """References ready to be searched any number of times.

    ``auto`` counts them: up to MOST_BYTES they go to the workers as arrays, beyond they are cut
    into boxes.  All strategies give the same rows.
    """
    if strategy == "auto":
        most = MOST_BYTES // (8 * (len(columns) + 2))
        strategy = "arrays" if refs.limit(most + 1).count() <= most else "two_phase"
    return {"brute": Brute, "two_phase": Boxes, "arrays": Arrays}[strategy](refs, k, columns)


def neighbours(queries: DataFrame, refs: DataFrame | Index, k: int = K, strategy: str = "auto", columns: list[str] = QUANTISED) -> DataFrame:
    """query_id, rank, ref_idx, dist, label of the k nearest references of every query."""
    index = refs if isinstance(refs, Index) else build(refs, k, strategy, columns)
    return index.neighbours(queries)


def fraud_counts(queries: DataFrame, refs: DataFrame | Index, k: int = K, strategy: str = "auto") -> DataFrame:
    """query_id, fraud_count of every query; missing neighbours count as no fraud."""
    sums = neighbours(queries, refs, k, strategy).groupBy("query_id").agg(F.sum("label").alias("frauds"))
    return queries.select("query_id").join(sums, "query_id", "left").select("query_id", F.coalesce("frauds", F.lit(0)).cast("int").alias("fraud_count"))
