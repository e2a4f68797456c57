"""Relational forms of the record's small lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfold.functions.features import DEFAULT_RISK, MCC_RISK


def risk_lookup(rows: DataFrame, column: str = "mcc") -> DataFrame:
    """``rows`` with ``risk``: a left join with ten categories, and the default for others."""
    table = rows.sparkSession.createDataFrame(list(MCC_RISK.items()), "mcc string, risk double")
    return rows.alias("x").join(F.broadcast(table).alias("t"), F.col(f"x.{column}") == F.col("t.mcc"), "left").select("x.*", F.coalesce("t.risk", F.lit(DEFAULT_RISK)).alias("risk"))


def known_merchants(rows: DataFrame, lists: DataFrame, keys: list[str], known: bool = True) -> DataFrame:
    """Rows whose (keys) stand in ``lists``, or those that don't."""
    return rows.join(lists.select(*keys).distinct(), keys, "left_semi" if known else "left_anti")
