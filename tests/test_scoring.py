"""Golden values and edge cases of parsing, features, quantisation, search and evaluation."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanfold.functions.features import FEATURES, QUANTISED, day_of_week, hour_of_day, with_features
from spanfold.functions.quantise import partition_key, quantise_query, quantise_reference
from spanfold.operators import evaluate, knn
from spanfold.operators.decide import decide
from spanfold.sources.references import index_references, read_index, read_references, write_index, zone_map
from spanfold.sources.requests import http_requests, parse_body, parse_compatible, parse_native
from spanfold.streaming.scoring import nearest_in_row, score_bodies, score_stream, to_queries

#: One sample request and its quantised vector (fixed values).
REQUEST = {
    "id": "tx-3576980410", "transaction": {"amount": 384.88, "installments": 3, "requested_at": "2026-03-11T20:23:35Z"},
    "customer": {"avg_amount": 769.76, "tx_count_24h": 3, "known_merchants": ["MERC-009", "MERC-001", "MERC-001"]},
    "merchant": {"id": "MERC-001", "mcc": "5912", "avg_amount": 298.95}, "terminal": {"is_online": False, "card_present": True, "km_from_home": 13.7090520965},
    "last_transaction": {"timestamp": "2026-03-11T14:58:35Z", "km_from_current": 18.8626479774},
}
VECTOR = [385, 2500, 500, 8696, 3333, 2257, 189, 137, 1500, 0, 10000, 0, 2000, 299]
#: Ten labelled sample vectors (fixed values).
SAMPLES = [
    ([0.01, 0.0833, 0.05, 0.8261, 0.1667, -1, -1, 0.0432, 0.25, 0, 1, 0, 0.2, 0.0416], "legit", 4),
    ([0.0109, 0.1667, 0.05, 0.3913, 0.6667, 0.3007, 0.0139, 0.0154, 0.2, 0, 1, 0, 0.15, 0.0282], "legit", 5),
    ([0.0336, 0.1667, 0.05, 0.4348, 0.6667, 0.1278, 0.0008, 0.017, 0.1, 0, 1, 0, 0.2, 0.02], "legit", 5),
    ([0.0415, 0.25, 0.05, 0.7391, 1, 0.2375, 0.0121, 0.0005, 0.2, 0, 1, 0, 0.3, 0.0493], "legit", 21),
    ([0.0291, 0.0833, 0.05, 0.3913, 0.3333, 0.3028, 0.0044, 0.028, 0.1, 0, 1, 0, 0.3, 0.043], "legit", 21),
    ([0.5796, 0.9167, 1, 0.0435, 0, 0.0056, 0.4394, 0.4598, 0.4, 1, 0, 1, 0.85, 0.0032], "fraud", 251),
    ([0.0035, 0.1667, 0.05, 0.4783, 0.8333, 0.2264, 0.001, 0.0488, 0.05, 0, 1, 0, 0.15, 0.0231], "legit", 5),
    ([0.9708, 1, 1, 0.1304, 0.3333, -1, -1, 0.6657, 1, 1, 0, 1, 0.75, 0.0077], "fraud", 234),
    ([0.0092, 0.0833, 0.05, 0.6522, 1, 0.0417, 0.0116, 0.0025, 0.1, 0, 1, 0, 0.15, 0.0101], "legit", 5),
    ([0.3536, 0.5, 1, 0.087, 0.6667, 0.0049, 0.8445, 0.8925, 0.8, 1, 0, 1, 0.85, 0.0035], "fraud", 251),
]


@pytest.fixture(scope="module")
def refs(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("refs") / "references.json.gz"
    with gzip.open(path, "wt") as out:
        json.dump([{"vector": [float(x) for x in v], "label": label} for v, label, _ in SAMPLES], out)
    return index_references(read_references(spark, str(path))).cache()


def bodies(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "request_id int, body string")


def test_references_keep_their_order_and_key(refs, spark, tmp_path):
    rows = refs.orderBy("ref_idx").collect()
    assert [r.pkey for r in rows] == [key for _, _, key in SAMPLES]
    assert [r.label for r in rows] == [int(label == "fraud") for _, label, _ in SAMPLES]
    write_index(refs, str(tmp_path / "index"))
    again, zones = read_index(spark, str(tmp_path / "index"))
    assert sorted(again.select("ref_idx", *QUANTISED, "pkey").collect()) == sorted(refs.select("ref_idx", *QUANTISED, "pkey").collect())
    assert zones.count() == len({key for _, _, key in SAMPLES})


def test_a_reference_without_fourteen_numbers_is_an_error(spark):
    bad = spark.createDataFrame([(0, [1.0] * 13, "fraud")], "ref_idx int, vector array<double>, label string")
    with pytest.raises(Exception, match="14 numbers"):
        index_references(bad).collect()


@pytest.mark.parametrize("parse", [parse_native, parse_compatible])
def test_golden_request(spark, refs, parse):
    row = to_queries(parse(bodies(spark, json.dumps(REQUEST))), "request_id").first()
    assert [row[q] for q in QUANTISED] == VECTOR and row.pkey == 5


@pytest.mark.parametrize("strategy", ["brute", "two_phase", "arrays"])
def test_golden_neighbours(spark, refs, strategy):
    queries = to_queries(parse_compatible(bodies(spark, json.dumps(REQUEST))), "request_id")
    found = knn.neighbours(queries, refs, strategy=strategy).orderBy("rank").collect()
    assert [(r.ref_idx, r.dist) for r in found] == [(4, 27567890), (2, 31969042), (1, 35828288), (6, 42537873), (3, 47476422)]
    assert score_bodies(bodies(spark, json.dumps(REQUEST)), refs, strategy).first().response == '{"approved":true,"fraud_score":0.0}'


def test_strategies_agree_on_ties_and_few_references(spark):
    rng = np.random.default_rng(5)
    for n in (0, 3, 200):
        points = rng.choice([-10000, 0, 1, 5000, 10000], (n + 40, 14)).tolist()
        for p in points[::3]:
            p[:] = points[0]
        kinds = ", ".join(f"{q} int" for q in QUANTISED)
        refs = spark.createDataFrame([(i, i % 2, *p) for i, p in enumerate(points[:n])], f"ref_idx long, label int, {kinds}").withColumn("pkey", partition_key())
        queries = spark.createDataFrame([(i, *p) for i, p in enumerate(points[n:])], f"query_id long, {kinds}").withColumn("pkey", partition_key())
        found = [sorted(map(tuple, knn.neighbours(queries, refs, strategy=s).collect())) for s in ("brute", "two_phase", "arrays")]
        assert found[0] == found[1] == found[2] and len(found[0]) == 40 * min(5, n)
        counts = knn.fraud_counts(queries, refs)
        assert counts.count() == 40 and (n or {r.fraud_count for r in counts.collect()} == {0})


def scored(spark, **changes):
    request = json.loads(json.dumps(REQUEST))
    for path, value in changes.items():
        target = request
        *parents, last = path.split("__")
        for p in parents:
            target = target[p]
        target[last] = value
    row = with_features(parse_compatible(bodies(spark, json.dumps(request)))).first()
    return [row[f] for f in FEATURES]


def test_last_transaction_forms(spark):
    for value in (None, {}):
        assert scored(spark, last_transaction=value)[5:7] == [-1.0, -1.0]
    assert scored(spark, last_transaction={"km_from_current": 10})[5] == 1.0
    assert scored(spark, last_transaction={"timestamp": "2026-03-12T00:00:00Z"})[5:7] == [0.0, 0.0]


def test_guards_and_defaults(spark):
    assert scored(spark, customer__avg_amount=0)[2] == 1.0
    assert scored(spark, customer__avg_amount=0, transaction__amount=0)[2] == 0.0
    assert scored(spark, merchant__mcc="9999")[12] == 0.5 and scored(spark, merchant__mcc="591")[12] == 0.5
    assert scored(spark, customer__known_merchants=[])[11] == 1.0
    row = with_features(parse_compatible(bodies(spark, ""))).first()
    assert [row[f] for f in FEATURES] == [0, 0, 0, 0, 0.5, -1, -1, 0, 0, 0, 0, 1, 0.5, 0]


@pytest.mark.parametrize("change", [
    ("customer", "known_merchants", [f"m{i}" for i in range(6)]), ("customer", "known_merchants", ["123456789"]), ("transaction", "amount", -1),
    ("transaction", "installments", 256), ("transaction", "requested_at", "2026-03-11T20:23:60Z"), ("transaction", "requested_at", "2026-03-11T20:23:35+00:00"),
])
def test_a_refused_value_keeps_what_came_before(spark, change):
    request = json.loads(json.dumps(REQUEST))
    request[change[0]][change[1]] = change[2]
    found = parse_body(json.dumps(request))
    assert not found["whole"] and not found["known"] and found["id"] == "tx-3576980410" and change[1] not in found
    assert not parse_native(bodies(spark, json.dumps(request))).first().valid


def test_compatible_reading():
    assert parse_body('{"transaction":{"amount":"12.5","amount":3}}')["amount"] == 3.0
    assert parse_body('{"transaction":{"amount":"12.5",},}')["amount"] == 12.5
    assert parse_body('{"transaction":{"amount":1e2}}').get("amount") is None
    late = parse_body('{"merchant":{"id":"a","mcc":"5411"},"customer":{"known_merchants":["a"]}} x')
    assert late["merchant_id"] == "a" and not late["whole"] and not late["known"]
    assert parse_body('{"transaction":{"requested_at":"2026-02-31T00:00:00Z"}}')["requested_at"] == parse_body('{"transaction":{"requested_at":"2026-03-03T00:00:00Z"}}')["requested_at"]
    assert parse_body('{"transaction":{"amount":7},"terminal":{"is_online":tr')["amount"] == 7.0
    assert parse_body("}")["whole"] is False and parse_body(None)["whole"] is True


def test_compatible_rows_equal_the_walk(spark):
    """Plain bodies are read natively; they and mutilated ones give what the walk gives."""
    rng, whole = np.random.default_rng(8), json.dumps(REQUEST)
    texts = [whole, whole.replace(" ", ""), whole.replace(" ", "\n\t "), whole + " x", whole + "{}", whole[:-1], "", None, "{}", whole.replace("384.88", '"384.88"'), whole.replace("384.88", "00384.8800"),
             whole.replace("384.88", ".5"), whole.replace("384.88", "5."), whole.replace("384.88", "1.2.3"), whole.replace("384.88", "0.1234567890123456789012"), whole.replace('"MERC-001"]', '"MERC-002"]'),
             whole.replace('"id": "tx-3576980410"', '"id": ":a"'), whole.replace('"mcc"', '"id": "MERC-002", "mcc"'), whole.replace('"mcc"', '"more": 1, "mcc"'), whole.replace("5912", "59\\u0031"), whole.replace('"5912"', "null"),
             json.dumps({**REQUEST, "last_transaction": None}), json.dumps({k: v for k, v in REQUEST.items() if k != "last_transaction"}), whole.replace("3,", "300,", 1), whole.replace("}}", "},}")]
    for _ in range(300):
        at = rng.integers(0, len(whole))
        texts.append(whole[:at] + str(rng.choice(list('{}[]",:.0 ax\\'))) + whole[at + rng.integers(0, 2) :])
    names = ["id", "amount", "installments", "requested_at", "customer_avg", "tx_count_24h", "known_merchants", "merchant_id", "mcc", "merchant_avg", "is_online", "card_present", "km_from_home", "last_at", "last_km", "has_last", "whole", "known"]
    for r in parse_compatible(bodies(spark, *texts)).collect():
        wanted = parse_body(texts[r.request_id])
        assert [r[n] for n in names] == [wanted.get(n) for n in names], texts[r.request_id]
        assert r.risk == (0.2 if wanted["whole"] and wanted.get("mcc") == "5912" else 0.5)


def test_large_arrays_are_read_in_parts(spark, tmp_path):
    rows = [{"vector": [i / 1000, *[0.5] * 13], "label": "fraud" if i % 3 else "legit"} for i in range(1000)]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        assert spark.read.text(str(tmp_path / "a.json")).rdd.getNumPartitions() > 1
        found = read_references(spark, str(tmp_path / "a.json")).orderBy("ref_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.ref_idx, r.vector, r.label) for r in found] == [(i, x["vector"], x["label"]) for i, x in enumerate(rows)]
    (tmp_path / "bad.json").write_text('[{"vector": [1.0], "label": "x"}, oops {"vector": [1.0]}]')
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        read_references(spark, str(tmp_path / "bad.json")).collect()


def test_rounding_is_half_even(spark):
    rows = spark.createDataFrame([(0.00005,), (0.00035,), (0.00025,), (-0.5,), (-1.0,), (2.0,)], "v double")
    assert [r[0] for r in rows.select(quantise_reference(F.col("v"))).collect()] == [0, 4, 2, 0, -10000, 10000]
    assert [r[0] for r in rows.select(quantise_query(F.col("v"))).collect()][3:] == [-5000, -10000, 20000]


def test_clock(spark):
    row = spark.createDataFrame([(0,), (86_400 * 4,), (-1,)], "s long").select(hour_of_day(F.col("s")).alias("h"), day_of_week(F.col("s")).alias("d")).collect()
    assert [tuple(r) for r in row] == [(0, 3), (0, 0), (23, 3)]


def test_http_framing(spark):
    head = "POST /fraud-score HTTP/1.1\r\nContent-LENGTH: {}\r\n\r\n"
    cases = {
        "GET /ready HTTP/1.1\r\n\r\n": "ready", head.format(2) + "{}": "score", head.format(3) + "{}": "need", head.format(5000): "bad",
        "POST /fraud-score HTTP/1.1\r\n\r\n": "bad", "GET /x HTTP/1.1\r\n\r\n": "not_found", "GET /x": "need", "x" * 4097: "bad",
    }
    found = http_requests(spark.createDataFrame(list(enumerate(cases)), "i int, raw string")).orderBy("i").collect()
    assert [r.status for r in found] == list(cases.values()) and found[1].body == "{}"


def test_evaluation_of_a_recorded_run(spark):
    counts = spark.createDataFrame([(24037, 30023, 0, 0, 0)], "tp long, tn long, fp long, fn long, errors long")
    row = evaluate.final_scores(counts, spark.createDataFrame([(3.63873,)], "p99 double")).first()
    assert row.weighted_errors == 0 and row.detection_score == 3000 and round(row.p99_score, 2) == 2439.05
    none = evaluate.weighted_error(evaluate.confusion(spark.createDataFrame([], "approved boolean, expected_approved boolean"))).first()
    assert none.n == 0 and none.error_rate == 0
    slow = evaluate.final_scores(spark.createDataFrame([(0, 8, 1, 1, 0)], counts.schema), spark.createDataFrame([(2500.0,)], "p99 double")).first()
    assert slow.p99_score == -3000 and slow.detection_score == -3000


def test_decisions(spark):
    rows = decide(spark.createDataFrame([(i,) for i in range(6)], "fraud_count int")).orderBy("fraud_count").collect()
    assert [(r.approved, r.fraud_score) for r in rows] == [(True, 0.0), (True, 0.2), (True, 0.4), (False, 0.6), (False, 0.8), (False, 1.0)]


def test_stream_equals_batch(spark, refs, tmp_path):
    kinds = ", ".join(f"{q} int" for q in QUANTISED)
    rng = np.random.default_rng(1)
    queries = spark.createDataFrame([(i, *map(int, rng.integers(0, 10000, 14))) for i in range(30)], f"query_id long, {kinds}").withColumn("pkey", partition_key())
    queries.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = lambda batch, number: batch.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={number}"))
    score_stream(stream, refs, sink, str(tmp_path / "checkpoint")).awaitTermination()
    wanted = sorted(map(tuple, knn.fraud_counts(queries, refs, strategy="brute").collect()))
    assert sorted((r.query_id, r.fraud_count) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == wanted
    assert sorted(map(tuple, nearest_in_row(queries, refs).collect())) == wanted


def clustered(spark, n, m, seed=3):
    """n references and m queries about fifty centres, many of them equal."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 10_000, (50, 14))
    points = np.clip(centres[rng.integers(0, 50, n + m)] + rng.integers(-300, 300, (n + m, 14)), 0, 10_000)
    points[: n // 3] = points[0]
    rows = [[int(x) for x in p] for p in points]
    kinds = ", ".join(f"{q} int" for q in QUANTISED)
    refs = spark.createDataFrame([(i, i % 2, *p) for i, p in enumerate(rows[:n])], f"ref_idx long, label int, {kinds}").withColumn("pkey", partition_key())
    queries = spark.createDataFrame([(i, *p) for i, p in enumerate([*rows[n:], rows[0]])], f"query_id long, {kinds}").withColumn("pkey", partition_key())
    return refs, queries


def test_brute_compares_every_pair_without_a_row_for_each(spark, monkeypatch):
    refs, queries = clustered(spark, 1500, 60)
    wanted = []
    points = [(r.ref_idx, r.label, [r[q] for q in QUANTISED]) for r in refs.collect()]
    for asked in queries.collect():
        near = sorted((sum((asked[q] - x) ** 2 for q, x in zip(QUANTISED, p)), i, label) for i, label, p in points)[:5]
        wanted += [(asked.query_id, rank, i, dist, label) for rank, (dist, i, label) in enumerate(near, 1)]
    for cell, tile in ((knn.CELL, knn._TILE), ((20, 400), (8, 64)), ((20, 400), (8, 3))):
        monkeypatch.setattr(knn, "CELL", cell)
        monkeypatch.setattr(knn, "_TILE", tile)
        found = knn.neighbours(queries, refs, strategy="brute")
        assert sorted(map(tuple, found.collect())) == sorted(wanted)
        assert not any(node in found._jdf.queryExecution().toString() for node in ("CartesianProduct", "NestedLoop", "Broadcast"))


def test_boxes_prune_and_no_box_is_hot(spark):
    refs, queries = clustered(spark, 6000, 60)
    index = knn.Boxes(refs, 5, QUANTISED, leaf=32)
    sizes = index.refs.groupBy("box").count()
    compared = index.asked(queries).join(sizes, "box").agg(F.sum("count")).first()[0]
    assert compared * 5 <= 6000 * 61 and sizes.agg(F.max("count")).first()[0] <= 32
    found = sorted(map(tuple, index.neighbours(queries).collect()))
    assert found == sorted(map(tuple, knn.neighbours(queries, refs, strategy="brute").collect()))
    plan = index.neighbours(queries)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "WindowGroupLimit" in plan


def test_boxes_from_a_sample_and_keys_it_does_not_know(spark):
    refs, queries = clustered(spark, 900, 40)
    index = knn.Boxes(refs, 5, QUANTISED, leaf=8, sample=40)
    assert sorted(map(tuple, index.neighbours(queries).collect())) == sorted(map(tuple, knn.neighbours(queries, refs, strategy="brute").collect()))


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], [5.0] * 9, list(range(1000)), [0.1 * i * i for i in range(777)] + [None, float("nan")], [1e300, -1e300, 0.0]])
def test_percentile_is_exact(spark, monkeypatch, values):
    monkeypatch.setattr(evaluate, "_SORTED", 7)
    monkeypatch.setattr(evaluate, "_PARTS", 4)
    frame = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    plain = [v for v in values if v is not None and v == v]
    for share in (0.0, 0.5, 0.99, 1.0):
        found = evaluate.percentile(frame, "v", share)
        assert found == (pytest.approx(np.quantile(plain, share)) if plain else None)


def test_test_files_and_reports(spark, tmp_path):
    entries = [{"request": {**REQUEST, "id": f"t{i}"}, "expected_approved": i != 1} for i in range(3)]
    (tmp_path / "test.json").write_text(json.dumps({"stats": {"total": 3}, "entries": entries}, indent=1))
    found = evaluate.read_test_data(spark, str(tmp_path / "test.json")).collect()
    assert [json.loads(r.request)["id"] for r in found] == ["t0", "t1", "t2"] and [r.expected_approved for r in found] == [True, False, True]
    evaluate.write_report(spark.range(1), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1
