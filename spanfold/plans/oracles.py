"""DuckDB SQL for the queries of plans.queries.  Literals are cast, as bare ones are decimals."""

from __future__ import annotations

_D = "CAST({} AS DOUBLE)".format
_Q = [f"q{i}" for i in range(14)]


def _clamp(value: str) -> str:
    return f"least(greatest({value}, {_D(0)}), {_D(1)})"


def _share(value: str, most: int) -> str:
    return _clamp(f"CAST({value} AS DOUBLE) / {_D(most)}")


_RECORDS = f"""
e AS (SELECT event_id, user_id, event_type, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS sec, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
of_k AS (SELECT k, CAST(sum(cents) AS BIGINT) AS k_cents, count(*) AS k_n FROM e GROUP BY k),
w AS (SELECT e.*, CAST(sum(cents) OVER (PARTITION BY user_id) AS BIGINT) AS user_cents, count(*) OVER (PARTITION BY user_id) AS user_n,
  count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n_day, lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS last_at FROM e),
r AS (SELECT event_id, CAST(k % 5 = 0 AS INT) AS label, k, cents, sec, last_at, n_day, CAST(cents AS DOUBLE) / {_D(5)} AS amount,
  CAST(user_cents AS DOUBLE) / CAST(user_n AS DOUBLE) / {_D(5)} AS customer_avg, CAST(k_cents AS DOUBLE) / CAST(k_n AS DOUBLE) / {_D(5)} AS merchant_avg,
  (k + user_id) % 4 = 0 AS known, CASE event_type WHEN 'click' THEN '5411' WHEN 'view' THEN '5812' WHEN 'purchase' THEN '5912' WHEN 'signup' THEN '7995' ELSE '0000' END AS mcc,
  CASE event_type WHEN 'click' THEN {_D(0.15)} WHEN 'view' THEN {_D(0.3)} WHEN 'purchase' THEN {_D(0.2)} WHEN 'signup' THEN {_D(0.85)} ELSE {_D(0.5)} END AS risk
  FROM w JOIN of_k USING (k))"""

_F = [
    _share("amount", 10_000), _share("k % 12 + 1", 12), _clamp(f"amount / greatest(customer_avg, {_D(1e-9)}) / {_D(10)}"),
    f"CAST((sec % 86400) // 3600 AS DOUBLE) / {_D(23)}", f"CAST((sec // 86400 + 3) % 7 AS DOUBLE) / {_D(6)}",
    f"CASE WHEN last_at IS NULL THEN {_D(-1)} ELSE {_clamp(f'CAST(sec - last_at AS DOUBLE) / {_D(60)} / {_D(1440)}')} END",
    f"CASE WHEN last_at IS NULL THEN {_D(-1)} ELSE {_share('event_id * 53 % 1000', 1000)} END",
    _share("event_id * 37 % 1000", 1000), _share("n_day", 20), "CAST(CAST(k % 2 = 0 AS INT) AS DOUBLE)", "CAST(CAST(k % 3 = 0 AS INT) AS DOUBLE)",
    f"CASE WHEN known THEN {_D(0)} ELSE {_D(1)} END", "risk", _share("merchant_avg", 10_000),
]
_VECTORS = f"{_RECORDS},\nv AS (SELECT event_id, label, {', '.join(f'{x} AS f{i}' for i, x in enumerate(_F))} FROM r)"


def _query(f: str) -> str:
    return f"CAST(least(greatest(round_even(CAST(CAST({f} AS FLOAT) * CAST(10000 AS FLOAT) AS DOUBLE), 0), -32768), 32767) AS INT)"


def _reference(f: str) -> str:
    return f"CAST(CASE WHEN {f} <= -1 THEN -10000 WHEN {f} <= 0 THEN 0 WHEN {f} >= 1 THEN 10000 ELSE round_even({f} * {_D(10000)}, 0) END AS INT)"


_KEY = (
    "CAST(CAST(q5 >= 0 AS INT) + 2 * CAST(q9 > 0 AS INT) + 4 * CAST(q10 > 0 AS INT) + 8 * CAST(q11 > 0 AS INT) + "
    "16 * CASE WHEN q12 <= 2000 THEN 0 WHEN q12 <= 3000 THEN 1 WHEN q12 <= 7500 THEN 2 ELSE 3 END + 64 * CAST(q2 > 1013 AS INT) + 128 * CAST(q8 > 2500 AS INT) AS INT)"
)
_QUERY_COLUMNS = ", ".join(f"{_query(f'f{i}')} AS q{i}" for i in range(14))
_REFERENCE_COLUMNS = ", ".join(f"{_reference(f'f{i}')} AS q{i}" for i in range(14))
_BOTH = f"""{_VECTORS},
q0_ AS (SELECT event_id AS query_id, label AS expected, {_QUERY_COLUMNS} FROM v WHERE event_id % 20 = 0),
q AS (SELECT *, {_KEY} AS pkey FROM q0_),
refs0 AS (SELECT event_id AS ref_idx, label, {_REFERENCE_COLUMNS} FROM v),
refs AS (SELECT *, {_KEY} AS pkey FROM refs0)"""
_DISTANCE = " + ".join(f"CAST(q.{c} - refs.{c} AS BIGINT) * (q.{c} - refs.{c})" for c in _Q)
_NEAR = f"""{_BOTH},
pairs AS (SELECT query_id, ref_idx, refs.label AS label, {_DISTANCE} AS dist FROM q CROSS JOIN refs),
near AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_idx) AS INT) AS rank, ref_idx, dist, label FROM pairs QUALIFY rank <= 5),
counts AS (SELECT q.query_id, expected, CAST(coalesce(sum(near.label), 0) AS INT) AS fraud_count FROM q LEFT JOIN near USING (query_id) GROUP BY ALL),
scores AS (SELECT query_id, expected, fraud_count, fraud_count < 3 AS approved, round(CAST(fraud_count AS DOUBLE) / {_D(5)}, 1) AS fraud_score FROM counts)"""
_ZONES = f"{_BOTH},\nz AS (SELECT pkey, count(*) AS n, {', '.join(f'min(q{i}) AS lo{i}' for i in range(14))}, {', '.join(f'max(q{i}) AS hi{i}' for i in range(14))} FROM refs GROUP BY pkey)"
_GAPS = [f"CAST(greatest(lo{i} - q{i}, q{i} - hi{i}, 0) AS BIGINT)" for i in range(14)]
_SCORE = "SELECT query_id, fraud_count, approved, fraud_score FROM scores"
_COUNTS = """c AS (SELECT count(*) FILTER (NOT approved AND expected = 1) AS tp, count(*) FILTER (approved AND expected = 0) AS tn,
  count(*) FILTER (NOT approved AND expected = 0) AS fp, count(*) FILTER (approved AND expected = 1) AS fn, count(*) FILTER (approved IS NULL) AS errors FROM scores)"""
_P99 = f"CASE WHEN p99 <= 0 THEN {_D(0)} WHEN p99 > 2000 THEN {_D(-3000)} ELSE {_D(1000)} * log10({_D(1000)} / greatest(p99, {_D(1)})) END"
_PARSED = f"""WITH {_RECORDS} SELECT event_id, CAST(event_id AS VARCHAR) AS id, CAST(k % 12 + 1 AS INT) AS installments, CAST(n_day AS INT) AS tx_count_24h,
  'm' || k AS merchant_id, mcc, k % 2 = 0 AS is_online, k % 3 = 0 AS card_present, sec AS requested_at, last_at, last_at IS NOT NULL AS has_last, cents, CAST(known AS INT) AS n_known FROM r"""
_END = "chr(13) || chr(10) || chr(13) || chr(10)"
_POST = "'POST /fraud-score HTTP/1.1' || chr(13) || chr(10)"
_HTTP = f"""WITH s AS (SELECT event_id, props, event_id % 8 AS n FROM events),
r AS (SELECT event_id, CASE n WHEN 0 THEN 'GET /ready HTTP/1.1' || {_END} WHEN 3 THEN {_POST} || 'Host: a' || {_END} || props WHEN 4 THEN 'GET /x HTTP/1.1' || {_END} WHEN 6 THEN {_POST} || 'Host: a'
  WHEN 7 THEN {_POST} || repeat('x', 4097) ELSE {_POST} || 'Content-LENGTH: ' || (strlen(props) + CASE n WHEN 1 THEN 0 WHEN 2 THEN 3 ELSE 5000 END) || {_END} || props END AS raw FROM s),
h AS (SELECT event_id, raw, strpos(raw, {_END}) AS stop, CASE WHEN starts_with(raw, 'GET /ready ') THEN 'ready' WHEN starts_with(raw, 'POST /fraud-score ') THEN 'score' ELSE 'other' END AS route FROM r),
l AS (SELECT *, TRY_CAST(regexp_extract(lower(left(raw, greatest(stop - 1, 0))), 'content-length:[ \t]*([0-9]*)', 1) AS BIGINT) AS size FROM h),
t AS (SELECT *, CASE WHEN stop = 0 THEN CASE WHEN length(raw) > 4096 THEN 'bad' ELSE 'need' END WHEN route = 'ready' THEN 'ready' WHEN size IS NULL THEN CASE WHEN route = 'score' THEN 'bad' ELSE 'not_found' END
  WHEN size > 4096 THEN 'bad' WHEN length(raw) < stop + 3 + size THEN 'need' WHEN route = 'score' THEN 'score' ELSE 'not_found' END AS status FROM l)
SELECT event_id, route, status, CASE WHEN status = 'score' THEN substr(raw, stop + 4, size) END AS body FROM t"""
_RISK = f"WITH {_RECORDS} SELECT event_id, mcc, risk FROM r"
_DIMS = range(1, 65)

#: The evaluation's requests carry their averages with six digits.
_SENT = _NEAR.replace("q0_ AS (SELECT event_id AS query_id, label AS expected, " + _QUERY_COLUMNS + " FROM v WHERE", "q0_ AS (SELECT event_id AS query_id, label AS expected, " + _QUERY_COLUMNS + " FROM sent WHERE").replace(
    "\nq0_ AS", f"""
sent0 AS (SELECT * REPLACE (CAST(CAST(customer_avg AS DECIMAL(20, 6)) AS DOUBLE) AS customer_avg, CAST(CAST(merchant_avg AS DECIMAL(20, 6)) AS DOUBLE) AS merchant_avg) FROM r),
sent AS (SELECT event_id, label, {', '.join(f'{x} AS f{i}' for i, x in enumerate(_F))} FROM sent0),
q0_ AS"""
)
_RUN = f"""WITH {_SENT}, {_COUNTS},
s AS (SELECT *, tp + tn + fp + fn + errors AS n, fp + 3 * fn + 5 * errors AS weighted_errors, (SELECT quantile_cont(value, 0.99) FROM events) AS p99 FROM c),
u AS (SELECT *, {_P99} AS p99_score, CASE WHEN fp + fn + errors > n * {_D(0.15)} THEN {_D(-3000)} ELSE {_D(1000)} * log10({_D(1)} / greatest(CAST(weighted_errors AS DOUBLE) / n, {_D(0.001)})) - {_D(300)} * log10({_D(1)} + weighted_errors) END AS score FROM s)
SELECT n, weighted_errors, tp, tn, fp, fn, errors, round(p99_score + score, 6) AS final_score FROM u"""

SQL = {
    "fraud_score": f"WITH {_NEAR} {_SCORE}",
    "features_vector": f"WITH {_VECTORS} SELECT event_id, {', '.join(f'round(f{i}, 9) AS f{i}' for i in range(14))} FROM v",
    "features_quantized": f"WITH {_VECTORS} SELECT event_id, {_QUERY_COLUMNS} FROM v",
    "reference_index": f"WITH {_BOTH} SELECT ref_idx, label, {', '.join(_Q)}, pkey FROM refs",
    "partition_keys": f"WITH {_VECTORS}, a AS (SELECT event_id, {_QUERY_COLUMNS} FROM v) SELECT event_id, {_KEY} AS pkey FROM a",
    "zonemap": f"WITH {_ZONES} SELECT * FROM z",
    "index_summary": f"WITH {_BOTH} SELECT count(*) AS vectors, count(DISTINCT pkey) AS partitions, CAST(sum(label) AS BIGINT) AS frauds FROM refs",
    "knn_neighbors_top5": f"WITH {_NEAR} SELECT query_id, rank, ref_idx, dist, label FROM near",
    "fraud_response": f"""WITH {_NEAR} SELECT query_id, '{{"approved":' || approved || ',"fraud_score":' || fraud_score || '}}' AS response FROM scores""",
    "declined": f"WITH {_NEAR} SELECT query_id, fraud_count FROM scores WHERE fraud_count >= 3",
    "knn_brute": f"WITH {_NEAR} {_SCORE}",
    "knn_two_phase": f"WITH {_NEAR} {_SCORE}",
    "streaming_fraud_score": f"WITH {_NEAR} {_SCORE}",
    "box_lower_bound": f"WITH {_ZONES} SELECT query_id, z.pkey AS pkey, {' + '.join(f'{g} * {g}' for g in _GAPS)} AS bound FROM q CROSS JOIN z",
    "http_framing": _HTTP,
    "evaluation_run": _RUN,
    "json_extract_request": _PARSED,
    "json_compatible_request": _PARSED,
    "json_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "merchant_membership_semi": f"WITH {_RECORDS}, l AS (SELECT event_id, 'm' || k AS m FROM r WHERE known) SELECT event_id, 'm' || k AS merchant_id FROM r WHERE EXISTS (SELECT 1 FROM l WHERE l.event_id = r.event_id AND l.m = 'm' || r.k)",
    "merchant_membership_anti": f"WITH {_RECORDS}, l AS (SELECT event_id, 'm' || k AS m FROM r WHERE known) SELECT event_id, 'm' || k AS merchant_id FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.event_id = r.event_id AND l.m = 'm' || r.k)",
    "supplier_membership": "SELECT s_suppkey, s_name FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49 AND l.l_discount > 0.085 AND l.l_returnflag = 'R')",
    "mcc_risk_lookup": _RISK,
    "mcc_risk_literal": _RISK,
    "hour_weekday": "SELECT o_orderkey, CAST(floor(epoch_us(o_orderdate) / 1000000) AS BIGINT) AS sec, CAST(hour(o_orderdate) AS INT) AS hour, CAST(isodow(o_orderdate) - 1 AS INT) AS weekday FROM orders",
    "label_encode": "SELECT doc_id, CAST(CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS INT) AS label FROM labels",
    "confusion_matrix": f"WITH {_NEAR}, {_COUNTS} SELECT * FROM c",
    "detection_score": f"""WITH {_NEAR}, {_COUNTS},
s AS (SELECT tp + tn + fp + fn + errors AS n, fp + 3 * fn + 5 * errors AS weighted_errors, fp + fn + errors AS failed FROM c),
t AS (SELECT *, CASE WHEN n > 0 THEN CAST(weighted_errors AS DOUBLE) / n ELSE 0 END AS error_rate, CASE WHEN n > 0 THEN CAST(failed AS DOUBLE) / n ELSE 0 END AS failure_rate,
  (SELECT quantile_cont(value, 0.99) FROM events) AS p99 FROM s),
u AS (SELECT *, {_P99} AS p99_score, CASE WHEN failure_rate > {_D(0.15)} THEN {_D(-3000)} ELSE {_D(1000)} * log10({_D(1)} / greatest(error_rate, {_D(0.001)})) - {_D(300)} * log10({_D(1)} + weighted_errors) END AS detection_score FROM t)
SELECT n, weighted_errors, round(error_rate, 6) AS error_rate, round(failure_rate, 6) AS failure_rate, round(p99, 6) AS p99, round(p99_score, 6) AS p99_score,
  round(detection_score, 6) AS detection_score, round(p99_score + detection_score, 6) AS final_score FROM u""",
    "latency_p99_score": f"WITH t AS (SELECT quantile_cont(value, 0.99) AS p99 FROM events) SELECT round(p99, 6) AS p99, round({_P99}, 6) AS p99_score FROM t",
    "dataset_stats": f"""WITH {_RECORDS} SELECT count(*) AS total, count(*) FILTER (label = 1) AS fraud_count, count(*) FILTER (label = 0) AS legit_count, count(*) FILTER (last_at IS NULL) AS edge_case_count,
  round(avg(label), 6) AS fraud_rate, round(avg(1 - label), 6) AS legit_rate, round(avg(CAST(last_at IS NULL AS INT)), 6) AS edge_case_rate FROM r""",
    "embedding_knn": f"""WITH p AS (SELECT vec_id, label, {', '.join(f'CAST(round_even(CAST(embedding[{i}] * CAST(10000 AS FLOAT) AS DOUBLE), 0) AS INT) AS e{i}' for i in _DIMS)} FROM embeddings),
d AS (SELECT a.vec_id AS query_id, b.vec_id AS ref_idx, b.label AS label, {' + '.join(f'CAST(a.e{i} - b.e{i} AS BIGINT) * (a.e{i} - b.e{i})' for i in _DIMS)} AS dist FROM p a JOIN p b ON a.vec_id <> b.vec_id),
n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_idx) <= 5),
g AS (SELECT query_id, label, count(*) AS votes FROM n GROUP BY ALL)
SELECT query_id, CAST(label AS INT) AS majority, CAST(votes AS INT) AS votes FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) = 1""",
}
