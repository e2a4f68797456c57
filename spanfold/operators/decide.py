"""Decisions from neighbour counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frauds among five neighbours from which a transaction is declined.
DECLINE = 3


def is_fraud(count: Column) -> Column:
    return count >= DECLINE


def decide(counts: DataFrame, k: int = 5) -> DataFrame:
    """``counts`` (with fraud_count) with approved, fraud_score and the response body."""
    score = F.round(F.col("fraud_count") / F.lit(float(k)), 1)
    rows = counts.withColumns({"approved": ~is_fraud(F.col("fraud_count")), "fraud_score": score})
    return rows.withColumn("response", F.to_json(F.struct("approved", "fraud_score")))
