"""Evaluation of decisions and latencies: counts, weighted error and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def confusion(results: DataFrame) -> DataFrame:
    """One row tp, tn, fp, fn, errors of (approved, expected_approved); a null answer is an error.

    Positive means declined.
    """
    said, right = F.col("approved"), F.col("expected_approved")
    return results.agg(
        F.count_if(~said & ~right).alias("tp"), F.count_if(said & right).alias("tn"), F.count_if(~said & right).alias("fp"),
        F.count_if(said & ~right).alias("fn"), F.count_if(said.isNull()).alias("errors"),
    )


def weighted_error(counts: DataFrame) -> DataFrame:
    """``counts`` with n, weighted_errors, error_rate and failure_rate."""
    rows = counts.withColumn("n", F.expr("tp + tn + fp + fn + errors")).withColumn("weighted_errors", F.expr("fp + 3 * fn + 5 * errors"))
    rate = lambda part: F.when(F.col("n") > 0, F.expr(part) / F.col("n")).otherwise(0.0)
    return rows.withColumns({"error_rate": rate("weighted_errors"), "failure_rate": rate("fp + fn + errors")})


def detection_score(rate: Column, failures: Column, errors: Column) -> Column:
    """-3000 above 15 % failures; else a logarithmic gain less a penalty for absolute errors."""
    gain = F.lit(1000.0) * F.log10(F.lit(1.0) / F.greatest(rate, F.lit(0.001)))
    return F.when(failures > 0.15, -3000.0).otherwise(gain - F.lit(300.0) * F.log10(F.lit(1.0) + errors))


def latency_score(p99: Column) -> Column:
    """0 for no latency, -3000 above two seconds, else logarithmic and at most 3000."""
    return F.when(p99 <= 0, 0.0).when(p99 > 2000, -3000.0).otherwise(F.lit(1000.0) * F.log10(F.lit(1000.0) / F.greatest(p99, F.lit(1.0))))


#: Values that are sorted at once at the end of a percentile's search, and parts of each range before.
_SORTED = 100_000
_PARTS = 1_024


def percentile(rows: DataFrame, column: str, share: float) -> float | None:
    """Exact interpolated percentile of a column's values (nulls and NaN don't count); null without any.

    Every pass counts the values of a range in at most 1,024 parts and goes on with the part that
    holds the place in question; only the last part, of few values or of one value, is sorted.  So
    no task ever holds all distinct values.
    """
    values = rows.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    place = share * (n - 1)
    ranks = sorted({int(place), min(int(place) + 1, n - 1)})

    def at(rank: int) -> float:
        """The value of a rank, counted from 0."""
        lo, hi, before, held = low, high, 0, n
        while held > _SORTED and lo < hi:
            here = values.where(F.col("v").between(lo, hi))
            step = hi / _PARTS - lo / _PARTS
            part = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(step)), F.lit(_PARTS - 1)) if step > 0 else F.lit(0)
            counts = here.groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("lo").collect()
            if len(counts) == 1:  # neighbouring numbers that no step parts
                break
            for r in counts:
                if rank < before + r.n:
                    lo, hi, held = r.lo, r.hi, r.n
                    break
                before += r.n
        if lo == hi:
            return lo
        some = values.where(F.col("v").between(lo, hi)).groupBy("v").agg(F.count("*").alias("n")).orderBy("v").limit(_SORTED + 1).collect()
        for r in some:
            if rank < before + r.n:
                return r.v
            before += r.n
        raise ValueError("the values changed while they were counted")

    found = [at(rank) for rank in ranks]
    return found[0] + (found[-1] - found[0]) * (place - int(place))


def p99(latencies: DataFrame, column: str) -> DataFrame:
    """One row with the exact interpolated 99th percentile; 0 without any value."""
    found = percentile(latencies, column, 0.99)
    return latencies.sparkSession.createDataFrame([(0.0 if found is None else found,)], "p99 double")


def final_scores(counts: DataFrame, latency: DataFrame) -> DataFrame:
    """The whole report of one run from its one-row counts and one-row p99."""
    rows = weighted_error(counts).crossJoin(latency)
    rows = rows.withColumns({
        "p99_score": latency_score(F.col("p99")),
        "detection_score": detection_score(F.col("error_rate"), F.col("failure_rate"), F.col("weighted_errors")),
    })
    return rows.withColumn("final_score", F.col("p99_score") + F.col("detection_score"))


def dataset_stats(entries: DataFrame) -> DataFrame:
    """One row of totals and shares of (is_fraud, is_edge_case)."""
    return entries.agg(
        F.count("*").alias("total"), F.count_if("is_fraud").alias("fraud_count"), F.count_if(~F.col("is_fraud")).alias("legit_count"),
        F.avg(F.col("is_fraud").cast("int")).alias("fraud_rate"), F.avg((~F.col("is_fraud")).cast("int")).alias("legit_rate"),
        F.count_if("is_edge_case").alias("edge_case_count"), F.avg(F.col("is_edge_case").cast("int")).alias("edge_case_rate"),
    )


def read_test_data(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(request, expected_approved) of the entries of test files, each one object, or one object a line."""
    kind = "entries array<struct<request:string,expected_approved:boolean>>"
    return spark.read.schema(kind).json(path, multiLine=not lines).select(F.explode("entries").alias("e")).select("e.*")


def numbered(entries: DataFrame) -> DataFrame:
    """Entries with a number each, by which answers are joined; write them before they are read twice."""
    return entries.withColumn("entry", F.monotonically_increasing_id())


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("errorifexists").json(path)
