"""Transactions, references and evaluation rows derived from a data folder's ``events``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanfold.functions.features import FEATURES, with_features
from spanfold.functions.quantise import partition_key, quantised_query, quantised_reference
from spanfold.sources.scratch import scratch, written

MCC_OF = {"click": "5411", "view": "5812", "purchase": "5912", "signup": "7995"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a wall-clock time, whatever the session's zone is."""
    return F.unix_date(F.to_date(ts)).cast("long") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts)).cast("long")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat transaction record for each event, with event_id and label (k % 5 = 0; an event without k has 0).

    Averages divide whole cents, so they don't depend on the order of addition.
    """
    events = read_table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", seconds(F.col("ts")).alias("sec"),
        F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("k"), F.round(F.col("value") * 100).cast("long").alias("cents"),
    )
    user = Window.partitionBy("user_id")
    day = user.orderBy("sec").rangeBetween(-86_400, 0)
    of_k = events.groupBy("k").agg(F.sum("cents").alias("k_cents"), F.count("*").alias("k_n"))
    mcc = F.lit("0000")
    for kind, code in MCC_OF.items():
        mcc = F.when(F.col("event_type") == kind, code).otherwise(mcc)
    merchant = F.concat(F.lit("m"), F.col("k").cast("string"))
    rows = events.withColumns({
        "user_cents": F.sum("cents").over(user), "user_n": F.count("*").over(user),
        "n_day": F.count("*").over(day), "last_at": F.lag("sec").over(user.orderBy("sec", "event_id")),
    }).join(of_k, "k")
    return rows.select(
        "event_id", F.col("event_id").cast("string").alias("id"), (F.col("k") % 5 == 0).cast("int").alias("label"),
        (F.col("cents") / F.lit(5.0)).alias("amount"), (F.col("k") % 12 + 1).cast("int").alias("installments"), F.col("sec").alias("requested_at"),
        (F.col("user_cents") / F.col("user_n") / F.lit(5.0)).alias("customer_avg"), F.col("n_day").cast("int").alias("tx_count_24h"),
        F.when((F.col("k") + F.col("user_id")) % 4 == 0, F.array(merchant)).otherwise(F.array().cast("array<string>")).alias("known_merchants"),
        merchant.alias("merchant_id"), mcc.alias("mcc"), (F.col("k_cents") / F.col("k_n") / F.lit(5.0)).alias("merchant_avg"),
        (F.col("k") % 2 == 0).alias("is_online"), (F.col("k") % 3 == 0).alias("card_present"),
        (F.col("event_id") * 37 % 1000).cast("double").alias("km_from_home"), F.col("last_at").isNotNull().alias("has_last"),
        "last_at", (F.col("event_id") * 53 % 1000).cast("double").alias("last_km"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_features(records(spark, sf_dir)).select("event_id", "label", *FEATURES)


def references(rows: DataFrame) -> DataFrame:
    """Every event of ``vectors`` as a labelled reference."""
    return rows.select(F.col("event_id").alias("ref_idx"), "label", *quantised_reference()).withColumn("pkey", partition_key())


def queries(rows: DataFrame) -> DataFrame:
    """The events of ``vectors`` whose id is divisible by 20, the query set; its own row is a reference to a query like any other."""
    asked = rows.where("event_id % 20 = 0")
    return asked.select(F.col("event_id").alias("query_id"), F.col("label").alias("expected"), *quantised_query()).withColumn("pkey", partition_key())


def serving(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, references), worked out once and written, as a search reads both several times."""
    rows = written(vectors(spark, sf_dir), scratch(spark, "vectors"))
    return queries(rows), references(rows)


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, body): the records as JSON requests."""
    def stamp(c: str) -> Column:
        day, rest = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(c) / 86_400).cast("int")), F.pmod(F.col(c), F.lit(86_400))
        return F.concat(day.cast("string"), F.format_string("T%02d:%02d:%02dZ", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60))

    rows = records(spark, sf_dir)
    number = lambda c: F.col(c).cast("decimal(20,6)")
    body = F.struct(
        "id", F.struct(number("amount").alias("amount"), "installments", stamp("requested_at").alias("requested_at")).alias("transaction"),
        F.struct(number("customer_avg").alias("avg_amount"), "tx_count_24h", "known_merchants").alias("customer"),
        F.struct(F.col("merchant_id").alias("id"), "mcc", number("merchant_avg").alias("avg_amount")).alias("merchant"),
        F.struct("is_online", "card_present", number("km_from_home").alias("km_from_home")).alias("terminal"),
        F.when(F.col("has_last"), F.struct(stamp("last_at").alias("timestamp"), number("last_km").alias("km_from_current"))).alias("last_transaction"),
    )
    return rows.select("event_id", F.to_json(body).alias("body"))
