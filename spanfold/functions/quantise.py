"""Quantised vectors and the partition key of the reference index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanfold.functions.features import FEATURES, QUANTISED

SCALE = 10_000


def quantise_query(value: Column) -> Column:
    """Half-even rounding of a float32 product, kept within 16 bits; the narrowing matters."""
    product = value.cast("float") * F.lit(float(SCALE)).cast("float")
    return F.least(F.greatest(F.rint(product.cast("double")), F.lit(-32768.0)), F.lit(32767.0)).cast("int")


def quantise_reference(value: Column) -> Column:
    """Half-even rounding in double; values up to -1 mean missing, other negatives are zero."""
    inside = F.rint(value * F.lit(float(SCALE)))
    return F.when(value <= -1, -SCALE).when(value <= 0, 0).when(value >= 1, SCALE).otherwise(inside).cast("int")


def quantised_query() -> list[Column]:
    return [quantise_query(F.col(f)).alias(q) for f, q in zip(FEATURES, QUANTISED)]


def quantised_reference() -> list[Column]:
    return [quantise_reference(F.col(f)).alias(q) for f, q in zip(FEATURES, QUANTISED)]


def partition_key() -> Column:
    """Eight bits of q0..q13; one rule for references and queries.

    Bits: 0 has a last transaction, 1 online, 2 card present, 3 unknown merchant, 4-5 bucket of
    the category's risk, 6 amount far above the customer's average, 7 many transactions.
    """
    risk = F.when(F.col("q12") <= 2000, 0).when(F.col("q12") <= 3000, 1).when(F.col("q12") <= 7500, 2).otherwise(3)
    flags = {0: F.col("q5") >= 0, 1: F.col("q9") > 0, 2: F.col("q10") > 0, 3: F.col("q11") > 0, 6: F.col("q2") > 1013, 7: F.col("q8") > 2500}
    key = F.shiftleft(risk, 4)
    for bit, flag in flags.items():
        key = key.bitwiseOR(F.when(flag, 1 << bit).otherwise(0))
    return key.cast("int").alias("pkey")
