"""The labelled reference table: a JSON array of vectors, its validation and its index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanfold.functions.features import DIMS, FEATURES, QUANTISED
from spanfold.functions.quantise import partition_key, quantised_reference

ROW = "vector array<double>, label string"


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """(ref_idx, vector, label) of a JSON array of flat objects in a file, gzip or plain, of any size.

    A row's place in the array is its index, which breaks ties later.  The text is cut after every
    closing brace, so a plain file is read by many tasks; rows are numbered within each block of
    the file, and blocks, in the file's order, go on from one another.  Anything else than objects
    between brackets and commas is an error.
    """
    text = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    body = F.regexp_replace("value", r"^[\[,\s]+", "")
    pieces = text.withColumn("body", body).where(~F.col("body").rlike(r"^[\]\s]*$"))
    blocks = pieces.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))  # a row for each block of the file
    blocks = blocks.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    rows = pieces.join(F.broadcast(blocks), ["file", "block"]).withColumn("row", F.from_json(F.concat("body", F.lit("}")), ROW, {"mode": "FAILFAST"}))
    inside = Window.partitionBy("file", "block").orderBy("at")
    return rows.select((F.col("before") + F.row_number().over(inside) - 1).alias("ref_idx"), "row.vector", "row.label")


def read_numbered_references(spark: SparkSession, path: str) -> DataFrame:
    """The same from tables that carry ref_idx themselves; these read in parallel at any size."""
    return spark.read.schema("ref_idx long, vector array<double>, label string").parquet(path)


def encode_label(label: F.Column) -> F.Column:
    return F.when(label == "fraud", 1).otherwise(0)


def index_references(references: DataFrame) -> DataFrame:
    """ref_idx, q0..q13, label, pkey; a vector that doesn't have 14 numbers is an error."""
    right = F.coalesce((F.size("vector") == DIMS) & F.forall("vector", lambda x: x.isNotNull()), F.lit(False))
    checked = references.withColumn("vector", F.when(right, F.col("vector")).otherwise(F.raise_error(F.lit(f"a reference vector must have {DIMS} numbers"))))
    wide = checked.select("ref_idx", encode_label(F.col("label")).alias("label"), *[F.col("vector")[i].alias(f) for i, f in enumerate(FEATURES)])
    return wide.select("ref_idx", *quantised_reference(), "label").withColumn("pkey", partition_key()).select("ref_idx", *QUANTISED, "label", "pkey")


def zone_map(refs: DataFrame) -> DataFrame:
    """Rows and box of each partition key: pkey, n, lo0..lo13, hi0..hi13 (at most 256 rows)."""
    low = [F.min(q).alias(f"lo{i}") for i, q in enumerate(QUANTISED)]
    high = [F.max(q).alias(f"hi{i}") for i, q in enumerate(QUANTISED)]
    return refs.groupBy("pkey").agg(F.count("*").alias("n"), *low, *high)


def index_totals(refs: DataFrame) -> DataFrame:
    """One row: vectors, partitions and fraud labels of an index."""
    return refs.agg(F.count("*").alias("vectors"), F.countDistinct("pkey").alias("partitions"), F.sum("label").alias("frauds"))


def write_index(refs: DataFrame, path: str) -> None:
    """Write refs by partition key, and the zone map beside them.

    Rows are dealt by key and index, so a key that holds most rows is written by many tasks.
    """
    refs.repartition("pkey", F.pmod(F.col("ref_idx"), F.lit(64))).write.mode("errorifexists").partitionBy("pkey").parquet(f"{path}/refs")
    zone_map(refs).write.mode("errorifexists").parquet(f"{path}/zones")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    refs = spark.read.parquet(f"{path}/refs")
    missing = {"ref_idx", "label", "pkey", *QUANTISED} - set(refs.columns)
    if missing:
        raise ValueError(f"{path} is no index; it lacks {sorted(missing)}")
    return refs, spark.read.parquet(f"{path}/zones")
