"""Quality rules by distribution divergence, on DataFrame functions alone.

Every document gives counts, a histogram of character classes and one of its language's common
words.  Each language has a reference of both, a fixed table that accepted documents were summed
up in; a document that lies too far from it, by Jensen-Shannon distance, is rejected.  So a verdict
depends on the document alone.  Short documents, whose histograms say little, are spared by
minimum-length guards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfold.llm.common import SPACE, long_id
from spanfold.llm.references import CLASS_SHARES, COMMON, WORD_SHARES

N_COMMON = 20
#: Character classes as regexes, each of which takes single characters; what none of them takes is the last class.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "space": r"[\x20\x09-\x0D]", "stop": "[.,;:!?'\"()-]", "symbol": "[#*$%&|<>]", "other": r"[^\x00-\x7F]"}
#: Characters of the last class or white space; without them a text is short.
_PLAIN = r"[a-z\x20\x09-\x0D]+"

# Thresholds: see README for what they keep and reject among labelled documents.
MOST_CLASS_DISTANCE = 0.22
MOST_WORD_DISTANCE = 0.265
LEAST_CHARS = 500
LEAST_WORDS = 100
#: Distinct repeated windows up to which a text's windows are looked up one by one.
_FEW = 64


def _let(value: F.Column, body) -> F.Column:
    """``body`` of a value that is worked out once for the row, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _windows(rows: DataFrame) -> DataFrame:
    """``rows`` with n_repeat_words: the words inside 3-word windows that occur at least twice.

    Windows are compared by their 64-bit hashes.  Sorted hashes show which of them repeat; the
    places of those, in order, cover three words each less their overlap.
    """
    places = F.sequence(F.lit(0), F.size("w") - 3)
    hashes = F.transform(places, lambda i: F.xxhash64(F.col("w")[i], F.col("w")[i + 1], F.col("w")[i + 2]))
    rows = rows.withColumn("h", F.when(F.size("w") >= 3, hashes).otherwise(F.array().cast("array<long>"))).withColumn("s", F.sort_array("h"))
    rows = rows.withColumn("twice", F.array_distinct(F.filter("s", lambda x, j: (j > 0) & (F.col("s")[F.greatest(j - 1, F.lit(0))] == x))))

    def at_same(pairs: F.Column) -> F.Column:
        last = F.size(pairs) - 1
        same = lambda a, b: pairs[a]["h"] == pairs[b]["h"]
        found = F.filter(F.sequence(F.lit(0), last), lambda j: ((j > 0) & same(F.greatest(j - 1, F.lit(0)), j)) | ((j < last) & same(j, F.least(j + 1, last))))
        return F.sort_array(F.transform(found, lambda j: pairs[j]["i"]))

    looked_up = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.array_contains("twice", F.col("h")[i]))
    paired = _let(F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))), at_same)
    none = F.array().cast("array<int>")
    rows = rows.withColumn("at", F.when(F.size("twice") == 0, none).when(F.size("twice") <= _FEW, looked_up).otherwise(paired))
    covered = F.aggregate(
        "at", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("end")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i + 3 - a["end"])).alias("n"), (i + 3).alias("end")), lambda a: a["n"],
    )
    return rows.withColumn("n_repeat_words", covered.cast("long")).drop("h", "s", "twice", "at")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, language, base counts and both histograms of every row, in one pass over the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lang = F.when(F.col("lang").isin(list(COMMON)), F.col("lang")).otherwise("-")
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def common(k: int) -> F.Column:
        """The language's k-th common word between two spaces; null where it has none."""
        found = F.lit(None).cast("string")
        for key, chosen in COMMON.items():
            found = F.when(F.col("lang") == key, f" {chosen[k]} ").otherwise(found)
        return found

    def times(k: int) -> F.Column:
        """How often the common word stands in the text; with two spaces between words none overlap."""
        cut = F.octet_length("apart") - F.octet_length(F.replace(F.col("apart"), common(k), F.lit("")))
        return F.coalesce((cut / F.octet_length(common(k))).cast("long"), F.lit(0).cast("long"))

    def removed(name: str) -> F.Column:
        return (F.length("rest") - F.length(F.regexp_replace("rest", CLASSES[name] + "+", ""))).cast("long").alias(f"n_{name}")

    rows = docs.select(long_id(docs), lang.alias("lang"), text.alias("text"))
    rows = rows.withColumn("w", F.array_remove(F.split("text", SPACE, -1), "")).withColumn("rest", F.regexp_replace("text", _PLAIN, ""))
    rows = _windows(rows).select(
        "*", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), F.length("text").cast("long").alias("n_chars"),
        F.concat(F.lit(" "), F.lower(F.array_join("w", "  ")), F.lit(" ")).alias("apart"), _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        *[removed(k) for k in CLASSES if k != "space"],
    )
    rows = rows.select("*", F.array(*[times(k) for k in range(N_COMMON)]).alias("common"), (F.col("n_chars") - F.col("word_chars")).alias("n_space"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.withColumn("classes", F.array(*[f"n_{k}" for k in CLASSES]))
    return rows.select(
        "doc_id", "lang", "n_words", "word_chars", F.col("n_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words", "n_chars",
        F.concat(F.array(F.col("n_words") - total("common")), "common").alias("word_counts"), F.concat("classes", F.array(F.col("n_chars") - total("classes"))).alias("class_counts"),
    )


def fit_shares(docs: DataFrame, accepted: DataFrame) -> DataFrame:
    """lang, class_shares, word_shares (parts in 10,000) summed over the documents whose ids ``accepted`` (doc_id) lists.

    With this the tables of llm.references were made; a corpus of another kind needs its own.
    """
    rows = measure(docs).where("n_words >= 50").join(accepted.select("doc_id").distinct(), "doc_id", "left_semi")

    def shares(column: str, n: int) -> F.Column:
        parts = [F.sum(F.col(column)[i]) for i in range(n)]
        total = sum(parts[1:], parts[0])
        return F.array(*[F.round(p * 10_000 / total).cast("int") for p in parts])

    return rows.groupBy("lang").agg(shares("class_counts", len(CLASSES) + 1).alias("class_shares"), shares("word_counts", N_COMMON + 1).alias("word_shares"))


def distance(a: str, b: str) -> F.Column:
    """Jensen-Shannon distance (base 2) of two columns of counts; null when one of them is empty."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)

    def bits(p: F.Column, q: F.Column) -> F.Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    def of(x: F.Column) -> F.Column:
        terms = F.zip_with(F.col(a), F.col(b), lambda p, q: (bits(p / x["a"], q / x["b"]) + bits(q / x["b"], p / x["a"])) / 2)
        return F.when((x["a"] > 0) & (x["b"] > 0), F.sqrt(F.greatest(total(terms), F.lit(0.0))))

    return _let(F.struct(total(F.col(a)).alias("a"), total(F.col(b)).alias("b")), of)


def _by_language(table: dict[str, list[int]]) -> F.Column:
    """The language's row of a table; null where it has none."""
    found = F.lit(None).cast("array<long>")
    for key, shares in table.items():
        found = F.when(F.col("lang") == key, F.array(*[F.lit(x).cast("long") for x in shares])).otherwise(found)
    return found


def judge(docs: DataFrame, most_class: float = MOST_CLASS_DISTANCE, most_word: float = MOST_WORD_DISTANCE, least_chars: int = LEAST_CHARS, least_words: int = LEAST_WORDS) -> DataFrame:
    """Counts, both distances and the verdict for every row of ``docs``.

    ``base_failed`` is set for fewer than 50 words, or when more than half of the words stand in
    repeated 3-word windows.  ``kept`` is false then, and for a document of at least
    ``least_chars`` characters whose class distance is above ``most_class``, or of at least
    ``least_words`` words in a language with common words whose word distance is above
    ``most_word``.  References are fixed tables by language; languages without one share the class
    reference ``-`` and have no word test.

    Null and empty texts have no words and lines, so they fail the base rules; a null language is
    one without common words.  Rows are judged on their own, so repeated ids and ties need no rule;
    other columns are ignored; an empty table gives an empty table.  Nothing is shuffled.
    """
    rows = measure(docs).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    rows = rows.withColumn("class_reference", _by_language(CLASS_SHARES)).withColumn("word_reference", _by_language(WORD_SHARES))
    judged = rows.withColumn("class_distance", distance("class_counts", "class_reference"))
    judged = judged.withColumn("word_distance", F.when(F.col("lang") != "-", distance("word_counts", "word_reference")))
    far = (F.col("n_chars") >= least_chars) & (F.col("class_distance") > most_class) | (F.col("n_words") >= least_words) & (F.col("word_distance") > most_word)
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))
