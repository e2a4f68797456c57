"""Secret scans with multipart credential linking, on DataFrame functions alone.

Strong patterns are reported wherever they stand.  Weak ones - bare identifiers, bare keys and
endpoints - mean little alone: an interval join looks for complementary parts of a credential
within a scope around each, and only those that have one are reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfold.llm.common import checkpoint, long_id

#: Kinds in the order of their spans at equal starts; the first three are strong.
KINDS = ("assign", "access", "hex", "identifier", "key", "endpoint")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: AKIA and a run of 20 or more in all, and maximal hexadecimal runs of 24 or more.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
#: Weak: upper-case identifiers of letters and digits, keys that hold a digit, and URLs.
IDENTIFIER = r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{16,32}(?![A-Za-z0-9])"
KEY = r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"""https?://[^\s"'<>]+"""
#: Code points between two parts of one credential at most.
SCOPE = 240
_BLOCK = 256


def _let(value: F.Column, body) -> F.Column:
    return F.transform(F.array(value), body)[0]


def _spans(kind: int, pattern: str, sure: F.Column, group: int = 0, least: int = 0) -> F.Column:
    """array<struct<start, kind, end>> of a pattern's leftmost matches, in code points.

    Matches and the pieces between them alternate, so a running sum of their lengths gives the
    offsets; sums run in blocks so that a text of very many matches stays near linear.  ``sure`` is
    a cheap test without which the text has no match.
    """
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    state = "struct<at:int,out:array<struct<start:int,kind:int,end:int>>>"

    def run(m: F.Column) -> F.Column:
        def step(acc: F.Column, i: F.Column) -> F.Column:
            start = acc["at"] + m["gaps"][i]
            end = start + m["sizes"][i]
            one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
            out = F.when(m["values"][i] >= least, F.concat(acc["out"], one)).otherwise(acc["out"])
            return F.struct(end.alias("at"), out.alias("out"))

        def block(acc: F.Column, first: F.Column) -> F.Column:
            inner = F.aggregate(F.sequence(first, F.least(first + _BLOCK - 1, F.size(m["sizes"]) - 1)), F.struct(acc["at"].alias("at"), empty.alias("out")).cast(state), step)
            return _let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,kind:int,end:int>>>").alias("out"))
        whole = F.aggregate(F.sequence(F.lit(0), F.size(m["sizes"]) - 1, F.lit(_BLOCK)), start, block, lambda x: F.flatten(x["out"]))
        return F.when(F.size(m["sizes"]) > 0, whole).otherwise(empty)

    sizes = lambda g: F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(g)), F.length)
    parts = F.struct(sizes(0).alias("sizes"), F.transform(F.split("text", pattern, -1), F.length).alias("gaps"), sizes(group).alias("values"))
    return F.when(sure, _let(parts, run)).otherwise(empty)


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, a digest of the text, and its strong and weak spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(long_id(docs), text.alias("text"))
    has = lambda s: F.col("text").contains(s)
    found = {
        "assign": _spans(0, ASSIGN, F.col("text").rlike(ASSIGN), 2, 6),
        "access": _spans(1, ACCESS, has("AKIA")),
        "hex": _spans(2, HEX, F.col("text").rlike(HEX)),
        "identifier": _spans(3, IDENTIFIER, F.col("text").rlike("[A-Z0-9]{16}")),
        "key": _spans(4, KEY, F.col("text").rlike("[A-Za-z0-9+/]{32}")),
        "endpoint": _spans(5, ENDPOINT, has("http://") | has("https://")),
    }
    return rows.select("doc_id", F.xxhash64("text").alias("digest"), F.length("text").alias("size"), *[c.alias(f"s_{k}") for k, c in found.items()])


def link(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, digest, size, linked: the weak spans that have a complementary part within ``scope``.

    An identifier needs a secret (assign, hex or key); a key needs an identifier (access or bare) or
    an endpoint; an endpoint needs an identifier or a secret.  A weak span that overlaps a strong
    one is that one's text and not reported.  The join is by document and stretch of ``scope``
    code points: a weak span asks the stretches its scope touches, a part stands in those it
    touches, so no task pairs a whole document.  A digest keeps apart documents that share an id.
    """
    key = ["doc_id", "digest", "size"]
    weak = spans.where("size(s_identifier) + size(s_key) + size(s_endpoint) > 0")
    parts = weak.select(*key, F.explode(F.concat(*[f"s_{k}" for k in KINDS])).alias("p")).select(*key, "p.*").distinct()
    stretch = lambda a, b: F.explode(F.sequence(F.floor(a / scope), F.floor(b / scope)))
    asking = parts.where("kind >= 3").withColumn("stretch", stretch(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope))
    standing = parts.withColumn("stretch", stretch(F.col("start"), F.col("end"))).select(*key, "stretch", F.col("start").alias("p_start"), F.col("end").alias("p_end"), F.col("kind").alias("p_kind"))
    on = F.expr(" and ".join(f"a.{c} <=> b.{c}" for c in [*key, "stretch"]) + f" and b.p_start <= a.end + {scope} and b.p_end >= a.start - {scope} and (a.kind <> b.p_kind or a.start <> b.p_start)")
    near = asking.alias("a").join(standing.alias("b"), on).select(*[f"a.{c}" for c in key], "start", "kind", "end", "p_start", "p_end", "p_kind")
    apart = "(p_start >= end or p_end <= start)"
    fits = f"{apart} and case kind when 3 then p_kind in (0, 2, 4) when 4 then p_kind in (1, 3, 5) else p_kind <> 5 end"
    seen = near.groupBy(*key, "start", "kind", "end").agg(F.max(F.expr(f"p_kind < 3 and not {apart}")).alias("strong"), F.max(F.expr(fits)).alias("linked"))
    seen = seen.where("linked and not strong")
    return seen.groupBy(*key).agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))


def _text(spans: F.Column) -> F.Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of ``docs``.

    ``spans`` lists kind:start:end (code points, end exclusive) by start, then kind; ``base_sha256``
    digests the strong ones alone.  Null and empty texts have no spans.  Repeated rows are each
    reported; rows that share an id are told apart by their text; null ids are kept; other columns
    are ignored; an empty table gives an empty table.
    """
    spans = checkpoint(find_spans(docs))
    base = F.array_sort(F.concat("s_assign", "s_access", "s_hex"))
    linked = link(spans, scope)
    on = F.expr("s.doc_id <=> l.doc_id and s.digest = l.digest and s.size = l.size")
    rows = spans.alias("s").join(linked.alias("l"), on, "left")
    every = F.array_sort(F.concat(base, F.coalesce("linked", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return rows.select(
        "s.doc_id", *[F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.sha2(_text(base).cast("binary"), 256).alias("base_sha256"), _text(every).alias("spans")
    )
