"""Near-duplicate lines by a deletion-neighbourhood join, on DataFrame functions alone.

Two lines are at most one edit apart only if they agree once a character is deleted from one or
both.  Emitting every deletion of every line would multiply the corpus, so deletions go from coarse
to fine: a line first deletes a whole half, survivors that share what is left with another line
delete an eighth, then eight characters, and only within such a block that still matches are
single characters deleted.
Lines of at most 16 characters delete single characters at once.  Equal hashed variants are joined,
the edit distance is verified, and the earliest line stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanfold.llm.common import checkpoint, long_id, renamed, restored

#: Lines of one length class share their cuts; a line that begins a class also belongs to the one before.
_CLASS = 16
#: Tables of at most this many rows of two or three numbers are broadcast once counted; larger ones are joined by shuffle.
MOST_BROADCAST = 1_000_000
_DOCUMENT = ["unnamed", "id", "text_key"]


def _sized(frame: DataFrame) -> DataFrame:
    """A checkpointed table, with a broadcast hint if its counted rows allow."""
    return F.broadcast(frame) if frame.count() <= MOST_BROADCAST else frame


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def _document(doc_id: Column, text: Column) -> list[Column]:
    """What names a document, without nulls: ids in order, null last, then a hash of the text."""
    return [doc_id.isNull().alias("unnamed"), F.coalesce(doc_id, F.lit(0)).cast("long").alias("id"), F.xxhash64(_text(text)).alias("text_key")]


def _lines(docs: DataFrame) -> DataFrame:
    """Every line that has a word: its place, two independent hashes and its length.

    ``place`` orders lines by document and number.
    """
    rows = docs.select(*_document(long_id(docs), F.col("text")), F.posexplode(F.split(_text(F.col("text")), "\n", -1)).alias("line_no", "line"))
    rows = rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(
        F.struct(*_DOCUMENT, "line_no").alias("place"), "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"), F.length("line").alias("n")
    )


def _block_keys(blocks: int) -> Column:
    """array<struct<key, class, block>>: what is left of a line when one of its blocks is deleted.

    Cuts depend on the length class only, from the left before the block and from the right after
    it, so two lines of one class that differ by an edit share the key of a block around the edit.
    """

    def of(number: Column, present: Column) -> list[Column]:
        unit = number * (_CLASS // blocks)
        kept = [(F.left("line", unit * q), F.right("line", unit * (blocks - 1 - q))) for q in range(blocks)]
        return [
            F.when(present, F.struct(F.xxhash64(number, F.lit(q), *parts).alias("key"), number.alias("class"), F.lit(q).alias("block"))) for q, parts in enumerate(kept)
        ]

    number = F.floor(F.col("n") / _CLASS).cast("int")
    long = F.col("n") >= _CLASS
    both = of(number, long) + of(number - 1, long & (F.col("n") % _CLASS == 0) & (number >= 2))
    return F.array_compact(F.array(*both))


def _shared(keys: DataFrame) -> DataFrame:
    """Keys under which at least two different lines stand."""
    found = keys.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"))
    return checkpoint(found.where("lo <> hi").select("key"))


def _still_shared(rows: DataFrame) -> DataFrame:
    """The rows whose key stands under another line too; few enough keys are broadcast."""
    return rows.join(_sized(_shared(rows.select("key", "h1"))), "key", "left_semi")


def near_lines(distinct: DataFrame, lines: DataFrame, least_chars: int) -> DataFrame:
    """(h1, h2) of distinct lines of at least ``least_chars`` characters that are one edit from an earlier such line."""
    halves = distinct.select("h1", "h2", "place", F.explode(F.array_compact(F.array("k0", "k1", "k2", "k3"))).alias("key"))
    short = distinct.where(f"n between {least_chars} and {_CLASS}").select("h1", "h2", "place")
    some = checkpoint(_still_shared(halves).select("h1", "h2", "place").unionByName(short).distinct())
    texts = checkpoint(lines.select("h1", "h2", "place", "line", "n").join(_sized(some), ["h1", "h2", "place"], "left_semi"))
    # An eighth of the line deleted: 2 characters for each class.
    eighths = texts.select("h1", "h2", "place", "line", "n", F.explode(_block_keys(8)).alias("b")).select("*", "b.*").drop("b")
    eighths = checkpoint(_still_shared(eighths).drop("key"))
    # Then blocks of 8 characters within that eighth, and what the length leaves over.
    unit, blocks = 2 * F.col("class"), 2 * F.col("class")
    last = F.when(F.col("block") == 7, blocks - 1).otherwise(F.floor((unit * (F.col("block") + 1) - 1) / 8).cast("int"))
    fine = eighths.withColumn("j", F.explode(F.sequence(F.floor(unit * F.col("block") / 8).cast("int"), last)))
    fine = fine.withColumns({"before": 8 * F.col("j"), "after": 8 * (blocks - 1 - F.col("j"))})
    fine = fine.withColumn("key", F.xxhash64("class", "j", F.left("line", F.col("before")), F.right("line", F.col("after"))))
    near = _still_shared(fine).select("h1", "h2", "place", "line", "n", "before", "after")
    whole = texts.where(f"n between {least_chars} and {_CLASS}").select("h1", "h2", "place", "line", "n", F.lit(0).alias("before"), F.lit(0).alias("after"))
    near = checkpoint(near.unionByName(whole))
    # Single characters within such a block.
    cut = near.select("h1", "h2", "place", "line", F.explode(F.sequence(F.col("before") + 1, F.col("n") - F.col("after"))).alias("at"))
    left, right = F.left("line", F.col("at") - 1), F.substring("line", F.col("at") + 1, F.length("line"))
    cut = cut.select("h1", "h2", "place", "at", F.xxhash64(F.concat(left, right)).alias("variant")).distinct()
    # Deleted at one place and equal: a substitution.  All such lines are one edit from the earliest.
    me = F.struct("place", "h1", "h2")
    first = cut.groupBy("variant", "at").agg(F.min(me).alias("earlier"), F.count("*").alias("lines")).where("lines > 1")
    changed = cut.join(first, ["variant", "at"]).select(me.alias("later"), "earlier").where("later.h1 <> earlier.h1 or later.h2 <> earlier.h2")
    # Deleted and equal to a whole line: an insertion.
    whole = near.select(F.col("h1").alias("variant"), me.alias("whole")).distinct()
    grown = cut.select("variant", me.alias("cut")).join(whole, "variant")
    grown = grown.select(F.greatest("cut", "whole").alias("later"), F.least("cut", "whole").alias("earlier"))
    pairs = changed.unionByName(grown).distinct()
    text = near.select(me.alias("me"), "line").distinct()
    pairs = pairs.join(text.select(F.col("me").alias("later"), F.col("line").alias("a")), "later").join(text.select(F.col("me").alias("earlier"), F.col("line").alias("b")), "earlier")
    long = F.least(F.length("a"), F.length("b")) >= least_chars
    sure = pairs.where(F.levenshtein("a", "b", 1).between(0, 1) & long & (F.col("later.place") > F.col("earlier.place")))
    return checkpoint(sure.select("later.h1", "later.h2").distinct())


def dedup_lines(docs: DataFrame, least_chars: int = 1) -> DataFrame:
    """doc_id, text_key, n_lines, n_kept, kept_lines for every row of ``docs``.

    Lines are cut at line feeds; those without a word are not counted and always stay in the text.
    A line is kept when no equal line stands earlier and no line that is one edit (Levenshtein, in
    characters) from it; with ``least_chars`` lines of fewer characters are compared whole only.
    Earlier means a smaller doc_id (null last), then the smaller hash of the text, then the smaller
    line number.  Being near an earlier line is enough, whether or not that one is kept.
    ``kept_lines`` are the numbers, from 0, of the kept lines of the row's own text.  Rows equal in
    id and text are one document and show the same lines; rows that share an id, or have none, but
    not the text are documents of their own.  Null and empty texts have no lines; an empty table
    gives an empty table; other columns are ignored.

    Copies of a line meet in a partial aggregation, so a line that holds a third of all rows is a
    row from each task; no pairs within a group are made.
    """
    lines = _lines(docs)
    halves = _block_keys(2)
    keyed = lines.withColumn("keys", halves)
    first = keyed.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.min("n").alias("n"), *[F.min(F.get("keys", F.lit(i))["key"]).alias(f"k{i}") for i in range(4)])
    distinct = checkpoint(first)
    dropped = near_lines(distinct, lines, least_chars)
    kept = distinct.select("h1", "h2", "place").join(_sized(dropped), ["h1", "h2"], "left_anti").select("place.*")
    kept = kept.groupBy(*_DOCUMENT).agg(F.array_sort(F.collect_set("line_no")).alias("kept_lines"))
    n = F.size(F.filter(F.split(_text(F.col("text")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    rows = docs.select(long_id(docs), n.alias("n_lines"), *_document(long_id(docs), F.col("text")))
    found = rows.join(kept, _DOCUMENT, "left").withColumn("kept_lines", F.coalesce("kept_lines", F.array().cast("array<int>")))
    return found.select("doc_id", "text_key", "n_lines", F.size("kept_lines").cast("long").alias("n_kept"), "kept_lines")


def drop_lines(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``docs``, in its own columns, without the lines that ``kept`` (from dedup_lines of the same rows) doesn't keep.

    Null texts stay null; a row that ``kept`` doesn't know keeps its whole text.
    """
    chosen = kept.select("doc_id", "text_key", "kept_lines").dropDuplicates(["doc_id", "text_key"])
    held, names = renamed(docs)
    doc_id, text = F.col(names["doc_id"]).cast("long"), F.col(names["text"])
    joined = held.join(chosen, doc_id.eqNullSafe(F.col("doc_id")) & (F.xxhash64(_text(text)) == F.col("text_key")), "left")
    wanted = F.filter(F.split(text.cast("string"), "\n", -1), lambda x, i: F.col("kept_lines").isNull() | ~x.rlike(r"[^\x20\x09-\x0D]") | F.array_contains("kept_lines", i))
    return restored(joined.withColumn(names["text"], F.array_join(wanted, "\n")), names)
