"""From raw documents to packed token ids: five stages, each written and read again as Parquet.

quality (7) drops what its classifier rejects; near duplicates (9) keeps one document of each
group; decontamination (3) drops documents that hold benchmark passages; mixing (1) repeats and
drops documents to meet the sources' target weights; packing (6) writes token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanfold.llm import contamination, mixing, packing, quality, similar
from spanfold.llm.common import table
from spanfold.sources.scratch import remove, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; fitted on the rows of ``docs`` that have labels.

    A null or empty text is judged as an empty one; equal texts are judged alike; without any label every document stays.
    """
    known = table(spark, sf_dir, "labels").where(~quality.held_out()).select("doc_id", F.col("quality").alias("label"))
    return quality.keep_accepted(docs, quality.fit(docs, known))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles have a Jaccard similarity of 0.8 or more.

    Candidates come from SimHash fingerprints in vantage-point shards and from shared shingles; all are verified.
    The row of least id stays, null last; null and empty texts are one group; ids may be null or shared.
    """
    return similar.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage; null and empty texts have none, repeated rows are judged alike."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out, always whole, so that sources come near their targets.

    A null source is one of its own; null and empty texts have no words to take; ties are broken by id, then text.
    """
    return mixing.repeat_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of all documents that came here; a null or empty text is its end id alone."""
    return packing.pack_tokens(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: A learned classifier, XXH64 fingerprints and byte-pair ids can't be expressed in DuckDB SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and reread.

    A stage's output is deleted once the next one's is whole.
    """
    at = scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(here := f"{at}/{number}-{name}")
        docs = spark.read.parquet(here)
        if before:
            remove(spark, before)
        before = here
    return docs
