"""DuckDB SQL for the queries whose operators SQL can express.

Patterns, words, tables and thresholds are written out here once more, so that a wrong one in an
operator shows.
"""

from __future__ import annotations

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_LINE = r"'[^\x20\x09-\x0D]'"

_OP1 = f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_SPACED})) AS BIGINT) AS size, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS place FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s0),
o AS (SELECT *, coalesce(sum(source_size) OVER before, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS free, sum(source_size) OVER () AS total
  FROM s WINDOW before AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT 3 * total - 4 * capped AS num, 2 * free AS den FROM o WHERE (3 * total - 4 * capped) * weight <= 4 * source_size * free ORDER BY CAST(num AS DOUBLE) / den DESC LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN num * weight > 2 * source_size * den THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(num * weight AS DOUBLE) / CAST(den AS DOUBLE) END AS target,
  CAST(CASE WHEN num * weight > 2 * source_size * den THEN 2 * source_size ELSE num * weight // den END AS BIGINT) AS quota FROM s CROSS JOIN l),
c AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS epoch, CASE WHEN source_size > 0 THEN quota % source_size ELSE 0 END AS within,
  sum(size) OVER (PARTITION BY d.source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * epoch + greatest(0, least(size, within - coalesce(before, 0))) AS BIGINT) AS taken FROM c"""

_PLACES = " UNION ALL ".join(
    f"SELECT doc_id, i, '{label}' AS label FROM d, unnest(range(0, greatest(len(w) - {n - 1}, 0))) AS u(i) WHERE w[i + 1 : i + {n}] = [{', '.join(repr(x) for x in phrase)}]"
    for phrase, label in ((["cc", "by"], "cc-by"), (["general", "public", "license"], "gpl"), (["all", "rights", "reserved"], "reserved")) for n in (len(phrase),)
)
_BASE2 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, {_WORD}) AS w FROM documents),
p AS ({_PLACES}),
g AS (SELECT doc_id, count(*) AS n_base, CAST(min(i) AS BIGINT) AS first_word, CAST(max(i) AS BIGINT) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM d LEFT JOIN g USING (doc_id)"""

_OP3 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, {_WORD}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLD}, {_WORD}) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS win FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS u(i) WHERE len(w) >= size),
m AS (SELECT doc_id, i, size, item_id FROM dw JOIN bw USING (size, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + size)) AS u(p) GROUP BY doc_id),
n AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)"""

_OP8 = rf"""WITH l AS (SELECT doc_id, CAST(i - 1 AS INT) AS line_no, x[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents), unnest(range(1, len(x) + 1)) AS u(i)
  WHERE regexp_matches(x[i], {_LINE})),
f AS (SELECT line, length(line) AS n, min((doc_id, line_no)) AS place FROM l GROUP BY line),
c AS (SELECT a.line AS x, b.line AS y, a.n AS m, b.n AS n, a.place AS xp, b.place AS yp FROM f a JOIN f b ON (b.n = a.n OR b.n = a.n + 1) AND a.line <> b.line AND left(a.line, a.n // 2) = left(b.line, a.n // 2)
  UNION SELECT a.line, b.line, a.n, b.n, a.place, b.place FROM f a JOIN f b ON (b.n = a.n OR b.n = a.n + 1) AND a.line <> b.line AND right(a.line, a.n - a.n // 2) = right(b.line, a.n - a.n // 2)),
e AS (SELECT DISTINCT CASE WHEN xp > yp THEN x ELSE y END AS line FROM c, unnest(range(1, n + 1)) AS u(i)
  WHERE left(x, i - 1) = left(y, i - 1) AND substring(x, CASE WHEN m = n THEN i + 1 ELSE i END) = substring(y, i + 1)),
k AS (SELECT place.doc_id AS doc_id, list(place.line_no ORDER BY place.line_no) AS kept_lines FROM (SELECT struct_pack(doc_id := place[1], line_no := place[2]) AS place FROM f WHERE line NOT IN (SELECT line FROM e)) GROUP BY ALL)
SELECT d.doc_id, CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_LINE}))) AS BIGINT) AS n_lines, CAST(coalesce(len(kept_lines), 0) AS BIGINT) AS n_kept, coalesce(kept_lines, []) AS kept_lines
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id"""

_CONTROL = r"'(<</SYS>>|<<SYS>>|\[/INST\]|\[INST\]|</s>|<s>)'"


def _escaped(column: str) -> str:
    """Length of an escaped text: a character more for each backslash and each control string."""
    return f"length({column}) + len(regexp_extract_all({column}, '\\\\')) + len(regexp_extract_all({column}, {_CONTROL}))"


_SAID = "'</s>[INST] ok [/INST]'"
_OP4 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', {_SAID}), (-1, 1, 'assistant', {_SAID})),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, CAST(sum(21 + {_escaped("role")} + {_escaped("text")}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a"""


def _text_sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _distance(a: str, b: str, n: int) -> str:
    """Jensen-Shannon distance of the counts in columns a0.. and b0.., null when one side is empty."""
    totals = [f"CAST({' + '.join(f'{c}{i}' for i in range(n))} AS DOUBLE)" for c in (a, b)]

    def bits(p: str, q: str) -> str:
        return f"CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END"

    shares = [(f"({a}{i} / {totals[0]})", f"({b}{i} / {totals[1]})") for i in range(n)]
    terms = " + ".join(f"({bits(p, q)} + {bits(q, p)}) / 2" for p, q in shares)
    return f"CASE WHEN {totals[0]} > 0 AND {totals[1]} > 0 THEN sqrt(greatest({terms}, 0)) END"


#: Character classes, common words and references of each language (fixed values).
_CLASSES = ["[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", "[.,;:!?'\"()-]", "[#*$%&|<>]", r"[^\x00-\x7F]"]
_COMMON = {
    "en": "the of and a to in it is that was for on with as be at by this had not",
    "de": "der die das und in den von zu mit ist ein im sich des auf für nicht eine dem auch",
    "fr": "de la le et les des en un une du que pour est dans qui par sur au pas plus",
    "es": "de la que el en y a los se del las un por con no una su para es al",
}
_CLASS_SHARES = {
    "en": [138, 5, 1666, 237, 0, 0, 7953], "de": [122, 4, 1546, 217, 0, 381, 7730], "fr": [103, 7, 1668, 237, 0, 905, 7080],
    "es": [118, 7, 1618, 229, 0, 778, 7250], "-": [129, 6, 1641, 233, 0, 292, 7699],
}
_WORD_SHARES = {
    "en": [7731, 550, 286, 232, 138, 168, 117, 78, 105, 92, 68, 78, 65, 57, 52, 48, 42, 48, 45, 0, 0],
    "de": [7685, 547, 285, 98, 233, 164, 143, 116, 98, 80, 53, 46, 49, 76, 67, 64, 59, 46, 46, 47, 1],
    "fr": [7668, 552, 303, 221, 169, 141, 120, 113, 95, 72, 77, 66, 63, 61, 51, 51, 47, 44, 43, 44, 0],
    "es": [7667, 560, 289, 218, 168, 142, 113, 0, 107, 90, 73, 88, 70, 67, 56, 55, 51, 48, 50, 44, 43],
}
_N, _N_COMMON = 7, 20


def _shares(table: dict[str, list[int]], prefix: str) -> str:
    """A reference's rows, lang and one column for each part."""
    names = ", ".join(f"{prefix}{i}" for i in range(len(table["en"])))
    return f"(VALUES {', '.join(f'({_text_sql(k)}, {', '.join(map(str, x))})' for k, x in table.items())}) AS v(lang, {names})"


_LEFT = [f"length(text) - length(regexp_replace(text, {_text_sql(p)}, '', 'g')) AS c{i}" for i, p in enumerate(_CLASSES)]
_PLACE = "CASE lang " + " ".join(f"WHEN '{k}' THEN coalesce(list_position([{', '.join(map(_text_sql, words.split()))}], lower(x)), 0)" for k, words in _COMMON.items()) + " ELSE 0 END"
_OP5 = f"""WITH d AS (SELECT doc_id, CASE WHEN lang IN ('en', 'de', 'fr', 'es') THEN lang ELSE '-' END AS lang, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, regexp_extract_all(text, {_SPACED}) AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_LINE})) AS lines FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM t, unnest(range(1, len(w) - 1)) AS u(i)),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), unnest([i, i + 1, i + 2]) AS u(p) GROUP BY doc_id),
m AS (SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, length(text) AS n_chars, {', '.join(_LEFT)}, list_transform(w, lambda x: {_PLACE}) AS places
  FROM t LEFT JOIN r USING (doc_id)),
h AS (SELECT * EXCLUDE (places), n_chars - ({' + '.join(f'c{i}' for i in range(_N - 1))}) AS c{_N - 1}, {', '.join(f'len(list_filter(places, lambda x: x = {k})) AS w{k}' for k in range(_N_COMMON + 1))},
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
j AS (SELECT h.*, {_distance('c', 'rc', _N)} AS class_distance, CASE WHEN lang <> '-' THEN {_distance('w', 'rw', _N_COMMON + 1)} END AS word_distance
  FROM h LEFT JOIN (SELECT * FROM {_shares(_CLASS_SHARES, 'rc')}) USING (lang) LEFT JOIN (SELECT * FROM {_shares(_WORD_SHARES, 'rw')}) USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(n_chars >= 500 AND class_distance > 0.22 OR n_words >= 100 AND word_distance > 0.265, false) AS kept FROM j"""


def _spans(kind: int, pattern: str, keep: str) -> str:
    """Matches of a pattern (x) as rows, with offsets from the lengths of matches and gaps."""
    p = _text_sql(pattern)
    return f"""SELECT doc_id, {kind} AS kind, stop - length(x) AS start, stop
  FROM (SELECT doc_id, x, CAST(sum(length(gap) + length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS stop
    FROM (SELECT doc_id, unnest(xs) AS x, unnest(list_slice(gaps, 1, len(xs))) AS gap, unnest(range(1, len(xs) + 1)) AS i
      FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS xs, string_split_regex(text, {p}) AS gaps FROM d))) WHERE {keep}"""


_KINDS = "['assign', 'access', 'hex', 'identifier', 'key', 'endpoint']"
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ENDPOINT = r"""https?://[^\s"'<>]+"""
_WEAK = [
    _spans(3, "[A-Za-z0-9]+", "length(x) BETWEEN 16 AND 32 AND regexp_full_match(x, '[A-Z0-9]+') AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Z]')"),
    _spans(4, "[A-Za-z0-9+/]+={0,2}", "regexp_full_match(x, '[A-Za-z0-9+/]{32,}={0,2}') AND regexp_matches(x, '[0-9]')"),
    _spans(5, _ENDPOINT, "true"),
]
_STRONG = [_spans(0, _ASSIGN, f"length(regexp_extract(x, {_text_sql(_ASSIGN)}, 2)) >= 6"), _spans(1, "AKIA[A-Z0-9]{16,}", "true"), _spans(2, "[0-9a-f]{24,}", "true")]
_ALL = " UNION ALL ".join(f"({x})" for x in _STRONG + _WEAK)
_OP10 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS ({_ALL}),
n AS (SELECT w.doc_id, w.kind, w.start, w.stop FROM a w JOIN a p ON w.doc_id = p.doc_id AND w.kind >= 3 AND (w.kind <> p.kind OR w.start <> p.start) AND p.start <= w.stop + 240 AND p.stop >= w.start - 240
  GROUP BY ALL HAVING bool_or((p.start >= w.stop OR p.stop <= w.start) AND CASE w.kind WHEN 3 THEN p.kind IN (0, 2, 4) WHEN 4 THEN p.kind IN (1, 3, 5) ELSE p.kind <> 5 END)
  AND NOT bool_or(p.kind < 3 AND NOT (p.start >= w.stop OR p.stop <= w.start))),
e AS (SELECT doc_id, kind, start, {_KINDS}[kind + 1] || ':' || start || ':' || stop AS s FROM (SELECT * FROM a WHERE kind < 3 UNION ALL SELECT * FROM n)),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(s, ',' ORDER BY start, kind) AS spans FROM e GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""

SQL = {"op1_mixing": _OP1, "licenses_base": _BASE2, "op3_decontamination": _OP3, "op4_chat": _OP4, "op5_divergence": _OP5, "op8_lines": _OP8, "op10_secrets": _OP10}
