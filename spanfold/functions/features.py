"""Feature vector of a transaction: 14 normalised dimensions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 14
FEATURES = [f"f{i}" for i in range(DIMS)]
QUANTISED = [f"q{i}" for i in range(DIMS)]

#: Risk by merchant category, and the risk of any other category (fixed values).
MCC_RISK = {
    "5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80,
    "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50,
}
DEFAULT_RISK = 0.5


def clamp01(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def share(column: str, most: float) -> Column:
    """A value's part of ``most``, kept within 0 and 1."""
    return clamp01(F.col(column).cast("double") / F.lit(float(most)))


def hour_of_day(seconds: Column) -> Column:
    return F.floor(F.pmod(seconds, F.lit(86_400)) / 3600).cast("int")


def day_of_week(seconds: Column) -> Column:
    """Monday is 0.  Days before 1970 are counted towards zero, so they can be negative."""
    days = F.when(seconds < 0, F.ceil(seconds / 86_400)).otherwise(F.floor(seconds / 86_400))
    return ((days + 3) % 7).cast("int")


def mcc_risk(mcc: Column) -> Column:
    """Risk of a category by a literal map; an unknown, short or null one has the default."""
    table = F.create_map(*[F.lit(x) for pair in MCC_RISK.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(mcc, F.lit(""))), F.lit(DEFAULT_RISK))


def merchant_known(merchant: Column, known: Column) -> Column:
    return F.coalesce((merchant != "") & F.array_contains(known, merchant), F.lit(False))


def features() -> list[Column]:
    """f0..f13 from the columns of a flat transaction record (see sources.requests.RECORD).

    Missing scalars count as zero, as in an empty record; a transaction without a last one has -1
    in both dimensions that describe it.
    """
    amount, average = F.col("amount"), F.greatest(F.col("customer_avg"), F.lit(1e-9))
    gap = (F.col("requested_at") - F.col("last_at")).cast("double") / F.lit(60.0) / F.lit(1440.0)
    last = F.col("has_last")
    risk = F.coalesce(F.col("risk"), mcc_risk(F.col("mcc")))
    found = [
        share("amount", 10_000), share("installments", 12), clamp01(amount / average / F.lit(10.0)),
        hour_of_day(F.col("requested_at")) / F.lit(23.0), day_of_week(F.col("requested_at")) / F.lit(6.0),
        F.when(last, clamp01(gap)).otherwise(-1.0), F.when(last, share("last_km", 1000)).otherwise(-1.0),
        share("km_from_home", 1000), share("tx_count_24h", 20),
        F.col("is_online").cast("int").cast("double"), F.col("card_present").cast("int").cast("double"),
        F.when(F.col("known"), 0.0).otherwise(1.0), risk, share("merchant_avg", 10_000),
    ]
    return [c.cast("double").alias(name) for c, name in zip(found, FEATURES)]


def with_features(records: DataFrame) -> DataFrame:
    """Records with f0..f13; defaults stand in for missing values before any arithmetic."""
    zero = {
        "amount": 0.0, "installments": 0, "requested_at": 0, "customer_avg": 0.0, "tx_count_24h": 0, "merchant_avg": 0.0, "km_from_home": 0.0,
        "is_online": False, "card_present": False, "last_at": 0, "last_km": 0.0, "has_last": False,
    }
    kinds = dict(records.dtypes)
    filled = records.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(kinds[c])) for c, v in zero.items()})
    if "known" not in kinds:
        filled = filled.withColumn("known", merchant_known(F.col("merchant_id"), F.col("known_merchants")))
    if "risk" not in kinds:
        filled = filled.withColumn("risk", F.lit(None).cast("double"))
    return filled.select("*", *features())
