"""What several operators share: words, checkpoints and the tables of a data folder."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanfold.sources.scratch import remove_at_exit, shared_root

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)
_FOLDERS: set[str] = set()
#: Bytes that go to a Python worker at once; a single larger row goes alone.
BATCH_BYTES = 4 << 20
#: Spark SQL's regex for the white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"


def folded_words(text: bytes | None) -> list[bytes]:
    """Words of ``[0-9a-z]`` and non-ASCII characters after A-Z are lower-cased; null has none.

    On UTF-8 bytes one translation does both, as every byte of a non-ASCII character is >= 0x80.
    """
    return text.translate(_FOLD).split() if text else []


def spaced_words(text: bytes | None) -> list[bytes]:
    """Words between runs of ASCII white space (0x20, 0x09-0x0D), which is what bytes.split uses."""
    return text.split() if text else []


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open intervals as disjoint ones in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_id(frame: DataFrame, name: str = "doc_id") -> F.Column:
    """The id column as long; ids are integers, so any other type is an error before a job starts."""
    if (kind := frame.schema[name].dataType.simpleString()) not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"{name} must be an integer column, not {kind}")
    return F.col(f"`{name}`").cast("long").alias(name)


def as_bytes(column: str) -> F.Column:
    return F.col(column).cast("string").cast("binary")


def in_batches(frame: DataFrame) -> DataFrame:
    """``frame``, whose texts go to Python in batches of at most BATCH_BYTES rather than of 10,000 rows or 64 MB.

    Workers and the buffers of their executor keep the room of their largest batch.
    """
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return frame


def checkpoint(frame: DataFrame) -> DataFrame:
    """Cut lineage in the folder of spark.checkpoint.dir; the session's part of it goes when Python ends."""
    spark = frame.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_root(spark))
    if (own := context._jsc.sc().getCheckpointDir().get()) not in _FOLDERS:
        _FOLDERS.add(own)  # Spark names a new folder for every session
        remove_at_exit(spark, own)
    return frame.checkpoint(eager=True)


def renamed(frame: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame under names that no other column has, and those names by the old ones."""
    names = {c: f"_c{i}" for i, c in enumerate(frame.columns)}
    return frame.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def restored(frame: DataFrame, names: dict[str, str]) -> DataFrame:
    return frame.select(*[F.col(n).alias(c) for c, n in names.items()])
