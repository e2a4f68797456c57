"""Scoring of request streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanfold.functions.features import QUANTISED, with_features
from spanfold.functions.quantise import partition_key, quantised_query
from spanfold.operators.decide import decide
from spanfold.operators.knn import Index, build, fraud_counts
from spanfold.sources.requests import parse_compatible


def to_queries(records: DataFrame, key: str = "id") -> DataFrame:
    """query_id, q0..q13, pkey of flat records; stateless, so it runs on streams too."""
    return with_features(records).select(F.col(key).alias("query_id"), *quantised_query()).withColumn("pkey", partition_key())


def score(queries: DataFrame, refs: DataFrame | Index, strategy: str = "auto") -> DataFrame:
    """query_id, fraud_count, approved, fraud_score, response of every query; ``refs`` may be an index that is built already."""
    return decide(fraud_counts(queries, refs, strategy=strategy))


def score_bodies(requests: DataFrame, refs: DataFrame | Index, strategy: str = "auto") -> DataFrame:
    """Decisions on (request_id, body) rows, malformed bodies included."""
    return score(to_queries(parse_compatible(requests), "request_id"), refs, strategy)


def score_stream(queries: DataFrame, refs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, strategy: str = "auto") -> StreamingQuery:
    """Score a stream of queries batch by batch.

    A ranking window can't run on a stream itself; each micro-batch is a bounded table in which it
    can.  References are made ready once, before the first batch.  With a sink that overwrites its batch number's output, a replayed batch changes nothing.
    """
    index = build(refs, strategy=strategy)
    return (
        queries.writeStream.foreachBatch(lambda batch, number: sink(score(batch, index), number))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def nearest_in_row(queries: DataFrame, refs: DataFrame, k: int = 5, most: int = 10_000) -> DataFrame:
    """query_id, fraud_count without any window or aggregate over rows, for append-mode streams.

    Small references, at most ``most``, become one broadcast row; each query sorts its distances.
    """
    n = refs.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} references; use score_stream")
    points = refs.select(F.struct("ref_idx", "label", F.array(*QUANTISED).alias("v")).alias("r")).agg(F.collect_list("r").alias("refs"))
    rows = queries.join(F.broadcast(points))
    here = F.array(*QUANTISED)

    def near(r):
        gaps = F.zip_with(r["v"], here, lambda a, b: (a - b).cast("long") * (a - b).cast("long"))
        return F.struct(F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x).alias("dist"), r["ref_idx"].alias("ref_idx"), r["label"].alias("label"))

    top = F.slice(F.array_sort(F.transform("refs", near)), 1, k)
    return rows.select("query_id", F.aggregate(top, F.lit(0), lambda s, x: s + x["label"]).alias("fraud_count"))
