"""The engine's queries over a data folder, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanfold.functions.features import FEATURES, QUANTISED, day_of_week, hour_of_day, mcc_risk
from spanfold.functions.quantise import partition_key, quantised_query
from spanfold.operators import evaluate, knn, lookups
from spanfold.operators.decide import decide, is_fraud
from spanfold.plans import adapter
from spanfold.plans.adapter import read_table
from spanfold.sources.references import encode_label, index_totals, zone_map
from spanfold.sources.requests import http_requests, parse_compatible, parse_native
from spanfold.sources.scratch import scratch, written
from spanfold.streaming.scoring import score, score_bodies, score_stream


def features_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.vectors(spark, sf_dir).select("event_id", *[F.round(f, 9).alias(f) for f in FEATURES])


def features_quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.vectors(spark, sf_dir).select("event_id", *quantised_query())


def reference_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.references(adapter.vectors(spark, sf_dir))


def partition_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.vectors(spark, sf_dir).select("event_id", *quantised_query())
    return rows.select("event_id", partition_key())


def zonemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_map(adapter.references(adapter.vectors(spark, sf_dir)))


def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_totals(adapter.references(adapter.vectors(spark, sf_dir)))


def knn_neighbors_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.neighbours(*adapter.serving(spark, sf_dir))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "ref_idx", "dist", "label")


def _scores(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    return score(*adapter.serving(spark, sf_dir), strategy)


def fraud_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, "auto").select("query_id", "fraud_count", "approved", "fraud_score")


def fraud_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, "auto").select("query_id", "response")


def declined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, "auto").where(is_fraud(F.col("fraud_count"))).select("query_id", "fraud_count")


def knn_brute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, "brute").select("query_id", "fraud_count", "approved", "fraud_score")


def knn_two_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, "two_phase").select("query_id", "fraud_count", "approved", "fraud_score")


def box_lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least distance from each query to the box of each partition key, of which there are 256 at most."""
    asked, refs = adapter.serving(spark, sf_dir)
    pairs = asked.alias("q").crossJoin(F.broadcast(zone_map(refs)).alias("z"))
    return pairs.select("q.query_id", F.col("z.pkey").alias("pkey"), knn.box_bound().alias("bound"))


_PARSED = ["event_id", "id", "installments", "tx_count_24h", "merchant_id", "mcc", "is_online", "card_present", "requested_at", "last_at", "has_last"]


def _parsed(rows: DataFrame) -> DataFrame:
    cents = (F.round(F.col("amount") * 5)).cast("long").alias("cents")
    return rows.select(*_PARSED, cents, F.size("known_merchants").alias("n_known"))


def json_extract_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(parse_native(adapter.bodies(spark, sf_dir)).where("valid"))


def json_compatible_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(parse_compatible(adapter.bodies(spark, sf_dir)))


def http_framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw HTTP request for each event, in eight forms, through routes, head, length and limits."""
    n, body = F.col("event_id") % 8, F.col("props")
    post, end = F.lit("POST /fraud-score HTTP/1.1\r\n"), F.lit("\r\n\r\n")
    sized = lambda more: F.concat(post, F.lit("Content-LENGTH: "), (F.octet_length(body) + more).cast("string"), end, body)
    raw = (
        F.when(n == 0, "GET /ready HTTP/1.1\r\n\r\n").when(n == 1, sized(0)).when(n == 2, sized(3)).when(n == 3, F.concat(post, F.lit("Host: a"), end, body))
        .when(n == 4, "GET /x HTTP/1.1\r\n\r\n").when(n == 5, sized(5000)).when(n == 6, F.concat(post, F.lit("Host: a"))).otherwise(F.concat(post, F.repeat(F.lit("x"), 4097)))
    )
    found = http_requests(read_table(spark, sf_dir, "events").select("event_id", raw.alias("raw")))
    return found.select("event_id", "route", "status", "body")


def evaluation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole evaluation: read test files, score their requests, compare by id, write the report and read it back."""
    at, rows = scratch(spark, "evaluation"), written(adapter.vectors(spark, sf_dir), scratch(spark, "vectors"))
    entries = adapter.bodies(spark, sf_dir).where("event_id % 20 = 0").join(rows.select("event_id", "label"), "event_id")
    entry = F.struct(F.col("body").alias("request"), (F.col("label") == 0).alias("expected_approved"))
    files = entries.groupBy(F.expr("event_id div 20000").alias("file")).agg(F.to_json(F.struct(F.collect_list(entry).alias("entries"))).alias("value"))
    files.select("value").write.text(f"{at}/test-data")  # a thousand entries a line
    tests = written(evaluate.numbered(evaluate.read_test_data(spark, f"{at}/test-data", lines=True)), f"{at}/tests")
    said = score_bodies(tests.select(F.col("entry").alias("request_id"), F.col("request").alias("body")), adapter.references(rows))
    answers = tests.join(said, tests.entry == said.query_id, "left")
    evaluate.write_report(evaluate.final_scores(evaluate.confusion(answers), _latency(spark, sf_dir)), f"{at}/report")
    report = spark.read.schema("n long, weighted_errors long, tp long, tn long, fp long, fn long, errors long, final_score double").json(f"{at}/report")
    return report.select("n", "weighted_errors", "tp", "tn", "fp", "fn", "errors", F.round("final_score", 6).alias("final_score"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events")
    return rows.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def merchant_membership_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.records(spark, sf_dir)
    lists = rows.select("event_id", F.explode("known_merchants").alias("merchant_id"))
    return lookups.known_merchants(rows, lists, ["event_id", "merchant_id"]).select("event_id", "merchant_id")


def merchant_membership_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.records(spark, sf_dir)
    lists = rows.select("event_id", F.explode("known_merchants").alias("merchant_id"))
    return lookups.known_merchants(rows, lists, ["event_id", "merchant_id"], known=False).select("event_id", "merchant_id")


def supplier_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers without a returned, discounted line of 50 pieces: the anti form on other tables."""
    lines = read_table(spark, sf_dir, "lineitem").where("l_quantity > 49 and l_discount > 0.085 and l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"))
    return lookups.known_merchants(read_table(spark, sf_dir, "supplier"), lines, ["s_suppkey"], known=False).select("s_suppkey", "s_name")


def mcc_risk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.risk_lookup(adapter.records(spark, sf_dir).select("event_id", "mcc")).select("event_id", "mcc", "risk")


def mcc_risk_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.records(spark, sf_dir).select("event_id", "mcc", mcc_risk(F.col("mcc")).alias("risk"))


def hour_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", adapter.seconds(F.col("o_orderdate")).alias("sec"))
    return rows.select("o_orderkey", "sec", hour_of_day(F.col("sec")).alias("hour"), day_of_week(F.col("sec")).alias("weekday"))


def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "labels")
    name = F.when(F.col("toxic") == 1, "fraud").otherwise("legit")
    return rows.select("doc_id", encode_label(name).alias("label"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, refs = adapter.serving(spark, sf_dir)
    wanted = asked.select("query_id", (F.col("expected") == 0).alias("expected_approved"))
    return wanted.join(decide(knn.fraud_counts(asked, refs)), "query_id", "left")


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_answers(spark, sf_dir))


def _latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.p99(read_table(spark, sf_dir, "events"), "value")


def detection_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = evaluate.final_scores(evaluate.confusion(_answers(spark, sf_dir)), _latency(spark, sf_dir))
    wide = ["error_rate", "failure_rate", "p99", "p99_score", "detection_score", "final_score"]
    return report.select("n", "weighted_errors", *[F.round(c, 6).alias(c) for c in wide])


def latency_p99_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _latency(spark, sf_dir)
    return rows.select(F.round("p99", 6).alias("p99"), F.round(evaluate.latency_score(F.col("p99")), 6).alias("p99_score"))


def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.records(spark, sf_dir).select((F.col("label") == 1).alias("is_fraud"), (~F.col("has_last")).alias("is_edge_case"))
    rates = ["fraud_rate", "legit_rate", "edge_case_rate"]
    return evaluate.dataset_stats(rows).select("total", "fraud_count", "legit_count", "edge_case_count", *[F.round(c, 6).alias(c) for c in rates])


def embedding_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority label (smallest on ties) of the five nearest other embeddings, for every embedding."""
    dims = [f"e{i}" for i in range(64)]
    wide = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].alias(d) for i, d in enumerate(dims)])
    rounded = [F.rint((F.col(d) * F.lit(10_000.0).cast("float")).cast("double")).cast("int").alias(d) for d in dims]
    points = wide.select("vec_id", "label", *rounded)
    asked = points.select(F.col("vec_id").alias("query_id"), *dims)
    found = knn.neighbours(asked, points.withColumnRenamed("vec_id", "ref_idx"), k=6, columns=dims).where("ref_idx <> query_id")
    first = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "label"))), 1, 5).alias("near"))
    votes = first.select("query_id", F.explode("near.label").alias("label")).groupBy("query_id", "label").agg(F.count("*").alias("votes"))
    return votes.groupBy("query_id").agg(F.min_by("label", F.struct(-F.col("votes"), "label")).alias("majority"), F.max("votes").cast("int").alias("votes"))


def streaming_fraud_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query, its requests read back as a file stream and scored batch by batch."""
    at, (asked, refs) = scratch(spark, "stream"), adapter.serving(spark, sf_dir)
    asked = written(asked, f"{at}/in")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    stream = spark.readStream.schema(asked.schema).parquet(f"{at}/in")
    score_stream(stream, refs, sink, f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("query_id", "fraud_count", "approved", "fraud_score")


QUERIES = {f.__name__: f for f in (
    fraud_score, features_vector, features_quantized, reference_index, partition_keys, zonemap, index_summary, knn_neighbors_top5, fraud_response, declined,
    knn_brute, knn_two_phase, box_lower_bound, http_framing, evaluation_run, json_extract_request, json_compatible_request, json_props, merchant_membership_semi, merchant_membership_anti,
    supplier_membership, mcc_risk_lookup, mcc_risk_literal, hour_weekday, label_encode, confusion_matrix, detection_score, latency_p99_score, dataset_stats,
    embedding_knn, streaming_fraud_score,
)}
