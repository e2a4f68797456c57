"""The engine's tables as temporary views, for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from spanfold.plans import adapter
from spanfold.sources.references import zone_map
from spanfold.streaming.scoring import score


def register_views(spark: SparkSession, sf_dir: str) -> list[str]:
    """tx_features, refs, zonemap, queries and scores over a data folder; views are lazy."""
    rows = adapter.vectors(spark, sf_dir)
    refs, asked = adapter.references(rows), adapter.queries(rows)
    views = {"tx_features": rows, "refs": refs, "zonemap": zone_map(refs), "queries": asked, "scores": score(asked, refs)}
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)
    return list(views)
