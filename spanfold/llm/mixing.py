"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by the set of sources they belong to.  A flow network carries words from
each such pattern, one arc for each repetition at a convex cost, to the quotas of its sources; the
cheapest flow repeats as little as possible.  Each pattern's documents, in a seeded order, then
form a tape of its repetitions, and each arc to a source takes a stretch of that tape.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanfold.llm.common import as_bytes, checkpoint, in_batches, long_id, renamed, restored, spaced_words

#: The flow is solved on the driver; more patterns than this are refused rather than collected.
MAX_PATTERNS = 50_000
SEED = 17


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> tuple[list[int], int]:
    """(flow on each arc, total) of a cheapest maximum flow; arcs are (from, to, capacity, cost >= 0).

    Shortest distances set node potentials; then blocking flows fill every path of that distance at
    once, so searches number as many as there are different path costs, not as paths.
    """
    head: list[list[int]] = [[] for _ in range(n)]
    to, left, cost = [], [], []
    for a, b, capacity, price in arcs:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            head[x].append(len(to))
            to.append(y)
            left.append(c)
            cost.append(p)
    potential, total = [0] * n, 0
    while True:
        far: list[float] = [float("inf")] * n
        far[source], queue = 0, [(0, source)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in head[x]:
                if left[e] and (nd := d + cost[e] + potential[x] - potential[to[e]]) < far[to[e]]:
                    far[to[e]] = nd
                    heapq.heappush(queue, (nd, to[e]))
        if far[sink] == float("inf"):
            return [left[2 * i + 1] for i in range(len(arcs))], total
        potential = [p + min(d, far[sink]) for p, d in zip(potential, far)]
        tight = lambda e, x: left[e] and cost[e] + potential[x] == potential[to[e]]
        while True:
            level, layer = [-1] * n, [source]
            level[source] = 0
            while layer and level[sink] < 0:
                after = []
                for x in layer:
                    for e in head[x]:
                        if level[to[e]] < 0 and tight(e, x):
                            level[to[e]] = level[x] + 1
                            after.append(to[e])
                layer = after
            if level[sink] < 0:
                break
            at, path, x = [0] * n, [], source
            while True:
                if x == sink:
                    push = min(left[e] for e in path)
                    for e in path:
                        left[e] -= push
                        left[e ^ 1] += push
                    total += push
                    first = next(i for i, e in enumerate(path) if not left[e])
                    x = to[path[first] ^ 1]
                    del path[first:]
                    continue
                while at[x] < len(head[x]) and not (level[to[head[x][at[x]]]] == level[x] + 1 and tight(head[x][at[x]], x)):
                    at[x] += 1
                if at[x] < len(head[x]):
                    path.append(head[x][at[x]])
                    x = to[path[-1]]
                elif path:
                    x = to[path.pop() ^ 1]
                    at[x] += 1
                else:
                    break


def capped_shares(sizes: dict, weights: dict, share: Fraction, most: int) -> dict:
    """Targets by weight of ``share`` of all words; what exceeds ``most`` times a source's size goes to the others by weight."""
    total = share * sum(sizes.values())
    capped: set = set()
    while True:
        free = [s for s in sizes if s not in capped]
        left = total - most * sum(sizes[s] for s in capped)
        weight = sum(weights[s] for s in free)
        target = {s: Fraction(most * sizes[s]) if s in capped else left * weights[s] / weight for s in sizes}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return target
        capped.update(over)


@dataclass(frozen=True)
class Route:
    """Of one pattern: the words on its tape from the last route's end up to ``end`` go to ``source``."""

    pattern: str
    source: str | None
    epoch: int
    within: int


def route_words(patterns: dict[str, tuple[tuple, int]], quotas: dict, most: int) -> list[Route]:
    """Routes of the cheapest flow; ``patterns`` has each key's sources and words.

    The k-th repetition of a pattern costs k - 1 a word, so no repetition begins before all
    patterns that could serve the same quotas are used as often.
    """
    keys, sources = sorted(patterns), sorted(quotas, key=lambda s: (s is None, s or ""))
    at = {s: 1 + len(keys) + i for i, s in enumerate(sources)}
    sink, arcs, uses = 1 + len(keys) + len(sources), [], []
    for i, key in enumerate(keys):
        members, size = patterns[key]
        arcs += [(0, 1 + i, size, k) for k in range(most)]
        for s in members:
            uses.append((len(arcs), key, s))
            arcs.append((1 + i, at[s], most * size, 0))
    arcs += [(at[s], sink, quotas[s], 0) for s in sources]
    flow, _ = min_cost_flow(sink + 1, arcs, 0, sink)
    routes, end = [], dict.fromkeys(keys, 0)
    for arc, key, s in uses:
        if flow[arc]:
            end[key] += flow[arc]
            routes.append(Route(key, s, *divmod(end[key], patterns[key][1])))
    return routes


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pa.array([len(spaced_words(x.as_py())) for x in batch.column("text")], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("name"), batch.column("members"), sizes], names=["doc_id", "name", "members", "size"])


def _name(doc_id: F.Column, text: F.Column) -> F.Column:
    """What orders a document: its id, or a digest of its text where it has none."""
    return F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def _place(seed: int, name: F.Column) -> F.Column:
    """A document's seeded place in the order of its pattern; its first three digits are its bucket."""
    return F.md5(F.concat(F.lit(f"{seed}:"), name))


def _key(members: F.Column) -> F.Column:
    return F.array_join(F.transform(members, lambda s: F.when(s.isNull(), "-").otherwise(F.concat(F.length(s).cast("string"), F.lit(":"), s))), ",")


def measure(docs: DataFrame, members: F.Column) -> DataFrame:
    """doc_id, name, members, size of every row; members are distinct and sorted, null last."""
    picked = docs.select(
        long_id(docs), _name(long_id(docs), F.col("text")).alias("name"),
        F.array_sort(F.array_distinct(F.coalesce(members, F.array(F.lit(None).cast("string"))))).alias("members"),
        as_bytes("text").alias("text"),
    )
    return in_batches(picked).mapInArrow(_sizes, "doc_id long, name string, members array<string>, size long")


@dataclass(frozen=True)
class Plan:
    """What the mix decides: of each source its words and target, and of each pattern its stretches."""

    sizes: dict
    targets: dict
    bounds: dict[str, list[tuple]]
    seed: int


def plan_mix(units: DataFrame, weights: Callable[[list], dict], share: Fraction, most: int, seed: int = SEED) -> Plan:
    """Solve the mix for measured ``units`` (doc_id, name, members, size).

    Only sums are collected: one row for each pattern, then for each end of a route the bucket and
    the document in which it falls.  Buckets split every pattern by the seeded order, so no hot
    source is ever sorted in one task.
    """
    units = units.select(_key(F.col("members")).alias("pattern"), "members", "size", _place(seed, F.col("name")).alias("place")).withColumn("bucket", F.substring("place", 1, 3))
    sums = units.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"), F.first("members").alias("members"))
    sums = checkpoint(sums)
    rows = sums.groupBy("pattern").agg(F.sum("words").alias("words"), F.first("members").alias("members")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sets of sources")
    patterns = {r.pattern: (tuple(r.members), r.words) for r in rows}
    sources = sorted({s for m, _ in patterns.values() for s in m}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(n for m, n in patterns.values() if s in m) for s in sources}
    targets = capped_shares(sizes, weights(sources), share, most) if sum(sizes.values()) else dict.fromkeys(sources, Fraction(0))
    routes = route_words(patterns, {s: int(t) for s, t in targets.items()}, most)
    spark = units.sparkSession
    ends = spark.createDataFrame([(r.pattern, i, r.within) for i, r in enumerate(routes)], "pattern string, route int, within long")
    order = Window.partitionBy("pattern").orderBy("bucket")
    before = sums.select("pattern", "bucket", "words", (F.sum("words").over(order) - F.col("words")).alias("before"))
    inside = "within >= before and within < before + words"
    hit = checkpoint(before.join(F.broadcast(ends), "pattern").where(inside).select("pattern", "bucket", "route", (F.col("within") - F.col("before")).alias("within")))
    # All ends of a pattern's routes may share a bucket; one window then serves them all.
    some = units.join(F.broadcast(hit.select("pattern", "bucket").distinct()), ["pattern", "bucket"], "left_semi")
    some = some.groupBy("pattern", "bucket", "place").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("pattern", "bucket").orderBy("place")
    before = some.select("pattern", "bucket", "place", "words", (F.sum("words").over(order) - F.col("words")).alias("before"))
    found = before.join(F.broadcast(hit), ["pattern", "bucket"]).where(inside)
    cuts = {r.route: (r.place, r.within - r.before, r.words) for r in found.select("route", "place", "within", "before", "words").collect()}
    bounds: dict[str, list[tuple]] = {}
    for i, r in enumerate(routes):
        place, within, words = cuts[i]
        bounds.setdefault(r.pattern, []).append((r.source, r.epoch, place, within, words))
    return Plan(sizes, targets, bounds, seed)


def _bounds_frame(spark, plan: Plan) -> DataFrame:
    kind = "array<struct<source:string,epoch:long,place:string,within:long,words:long>>"
    return spark.createDataFrame(list(plan.bounds.items()), f"pattern string, bounds {kind}")


def _taken(bound: F.Column, size: F.Column, place: F.Column) -> F.Column:
    """Words of a document on its pattern's tape before a route's end."""
    cut = F.floor(size * bound["within"] / bound["words"])
    return size * bound["epoch"] + F.when(place < bound["place"], size).when(place == bound["place"], F.when(size == bound["words"], bound["within"]).otherwise(cut)).otherwise(F.lit(0))


def take(units: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, members, size, taken, by_source (source, words) of every measured unit."""
    spark = units.sparkSession
    units = units.withColumn("pattern", _key(F.col("members"))).withColumn("place", _place(plan.seed, F.col("name")))
    joined = units.join(F.broadcast(_bounds_frame(spark, plan)), "pattern", "left")
    ends = F.transform("bounds", lambda b: F.struct(b["source"].alias("source"), _taken(b, F.col("size"), F.col("place")).alias("end")))
    joined = joined.withColumn("ends", ends)
    parts = F.transform(
        "ends", lambda e, i: F.struct(e["source"].alias("source"), (e["end"] - F.when(i == 0, F.lit(0)).otherwise(F.get("ends", i - 1)["end"])).alias("words"))
    )
    total = F.coalesce(F.try_element_at("ends", F.lit(-1))["end"], F.lit(0)).cast("long")
    return joined.select("doc_id", "members", "size", total.alias("taken"), F.coalesce(F.filter(parts, lambda p: p["words"] > 0), F.array().cast("array<struct<source:string,words:long>>")).alias("by_source"))


def repeating_weights(sources: list) -> dict:
    """3, 1, 2, 3, 1, 2 ... by the sources' order (code points, null last)."""
    return {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}


def mix_single_source(docs: DataFrame, weights=repeating_weights, share: Fraction = Fraction(3, 2), most: int = 2, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, by_source for every row of ``docs``.

    ``size`` counts words between ASCII white space (null text: 0).  Each source is one set of
    documents here, null a source of its own, so the flow meets every target whole: the one
    document at a stretch's end is cut to the words still owed, and rows that share that place
    (equal ids, or no id and equal texts) share the cut.  Empty texts take nothing; an empty table
    gives an empty table; other columns are ignored; the order depends on ids, texts without an id
    and the seed alone, so reruns agree.
    """
    units = checkpoint(measure(docs, F.array(F.col("source").cast("string"))))
    plan = plan_mix(units, weights, share, most, seed)
    spark = docs.sparkSession
    of = spark.createDataFrame([(s, plan.sizes[s], float(t)) for s, t in plan.targets.items()], "source string, source_size long, target double")
    got = take(units, plan).withColumn("source", F.col("members")[0])
    got = got.alias("g").join(F.broadcast(of).alias("s"), F.expr("g.source <=> s.source"))
    return got.select("doc_id", "size", "source_size", "target", "taken", "by_source")


def repeat_documents(docs: DataFrame, weights=repeating_weights, share: Fraction = Fraction(3, 2), most: int = 2, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, in its own columns, as often as the mix takes them.

    Texts stay whole: the document at the end of a source's stretch stands once more if at least
    half of its words are owed still, so a source's words are within half a document of its target.
    Documents the mix doesn't take are gone; null sources are a source; rows without an id are
    placed by their texts; rows at one place (equal ids, or no id and equal texts) are treated
    alike; an empty table gives an empty table.
    """
    units = checkpoint(measure(docs, F.array(F.col("source").cast("string"))))
    plan = plan_mix(units, weights, share, most, seed)
    last = [(k, *b[-1][1:]) for k, b in plan.bounds.items()]
    ends = docs.sparkSession.createDataFrame(last, "pattern string, epoch long, end string, within long, words long")
    held, names = renamed(docs)
    held = held.withColumn("pattern", _key(F.array(F.col(names["source"]).cast("string"))))
    held = held.withColumn("place", _place(seed, _name(F.col(names["doc_id"]).cast("long"), F.col(names["text"]))))
    more = F.expr("place < end or place = end and 2 * within >= words and within > 0")
    copies = (F.col("epoch") + F.when(more, 1).otherwise(0)).cast("int")
    found = held.join(F.broadcast(ends), "pattern").where(copies > 0).withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies)))
    return restored(found, names)
