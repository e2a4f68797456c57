"""Transaction requests: raw HTTP framing, and JSON bodies in a native and a compatible reading."""

from __future__ import annotations

import re
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Largest head and body that are admitted, in bytes.
MOST_HEAD = MOST_BODY = 4096

#: A flat transaction; times are seconds since 1970 (UTC).
RECORD = (
    "id string, amount double, installments int, requested_at long, customer_avg double, tx_count_24h int, known_merchants array<string>, "
    "merchant_id string, mcc string, merchant_avg double, is_online boolean, card_present boolean, km_from_home double, "
    "has_last boolean, last_at long, last_km double"
)
#: Leaves are read as text and cast by the rules below; a cast by the JSON reader would differ.
BODY = (
    "id string, transaction struct<amount:string,installments:string,requested_at:string>, "
    "customer struct<avg_amount:string,tx_count_24h:string,known_merchants:string>, "
    "merchant struct<id:string,mcc:string,avg_amount:string>, terminal struct<is_online:string,card_present:string,km_from_home:string>, "
    "last_transaction struct<timestamp:string,km_from_current:string>, corrupt string"
)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """(body) of every line of text files, one JSON request a line."""
    return spark.read.text(path).withColumnRenamed("value", "body")


def http_requests(raw: DataFrame, column: str = "raw") -> DataFrame:
    """``raw`` with route, status and body of one HTTP request a row.

    route: ready, score or other.  status: ready, score, not_found, bad (too long, or no length
    where one is needed) or need (incomplete).  Lengths are bytes.
    """
    data = F.col(column).cast("binary")
    text = F.decode(data, "ISO-8859-1")  # a character for each byte
    end = F.instr(text, "\r\n\r\n")
    head = F.substring(text, F.lit(1), F.greatest(end - 1, F.lit(0)))
    digits = F.regexp_extract(F.lower(head), r"content-length:[ \t]*([0-9]*)", 1)
    length = F.when(F.length(digits) > 0, F.when(F.length(F.ltrim(digits, F.lit("0"))) > 9, F.lit(1 << 31)).otherwise(digits.try_cast("bigint")))
    route = F.when(text.startswith("GET /ready "), "ready").when(text.startswith("POST /fraud-score "), "score").otherwise("other")
    rows = raw.withColumns({"_end": end, "_length": length, "route": route, "_size": F.octet_length(data), "_text": text})
    start = F.col("_end") + 4
    short = F.col("_size") < start - 1 + F.col("_length")
    scored = F.col("route") == "score"
    status = (
        F.when(F.col("_end") == 0, F.when(F.col("_size") > MOST_HEAD, "bad").otherwise("need"))
        .when(F.col("route") == "ready", "ready")
        .when(F.col("_length").isNull(), F.when(scored, "bad").otherwise("not_found"))
        .when(F.col("_length") > MOST_BODY, "bad").when(short, "need").when(scored, "score").otherwise("not_found")
    )
    body = F.decode(F.encode(F.substring(F.col("_text"), start, F.col("_length").cast("int")), "ISO-8859-1"), "UTF-8")
    return rows.withColumn("status", status).withColumn("body", F.when(F.col("status") == "score", body)).drop("_end", "_length", "_size", "_text")


def decimal_text(text: Column) -> Column:
    """Digits with at most one dot and at least one digit; signs and exponents are refused."""
    return F.when(text.rlike(r"^(?=.*[0-9])[0-9]*\.?[0-9]*$"), text.try_cast("double"))


def byte_text(text: Column) -> Column:
    value = F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
    return F.when(value <= 255, value)


def flag_text(text: Column) -> Column:
    return F.when(text == "true", True).when(text == "false", False)


def short_text(text: Column, most: int) -> Column:
    return F.when(F.octet_length(text).between(1, most), text)


def epoch_text(text: Column) -> Column:
    """Seconds of 'YYYY-MM-DDTHH:MM:SSZ'; any day up to 31 counts on from its month's first."""
    part = lambda at, n: F.substring(text, at, n).try_cast("int")
    days = F.unix_date(F.make_date(part(1, 4), part(6, 2), F.lit(1))) + part(9, 2) - 1
    fits = text.rlike("^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z$")
    return F.when(fits, days.cast("long") * 86_400 + part(12, 2) * 3600 + part(15, 2) * 60 + part(18, 2))


def merchants_text(text: Column) -> Column:
    """At most five strings of 1 to 8 bytes each; anything else is null."""
    items = F.from_json(text, "array<string>")
    return F.when((F.size(items) <= 5) & F.forall(items, lambda x: F.octet_length(x).between(1, 8)) & ~text.contains("\\"), items)


def parse_native(requests: DataFrame, body: str = "body") -> DataFrame:
    """``requests`` with the columns of RECORD and ``valid``, by Spark's own JSON reader.

    A row is valid when its body is whole JSON and every leaf that is there follows its type's
    rule; leaves of other rows may be null, and such rows belong into quarantine.
    """
    return _native(requests, body).drop("_j")


def _native(requests: DataFrame, body: str) -> DataFrame:
    """parse_native's rows with the parsed document ``_j``."""
    doc = F.from_json(body, BODY, {"columnNameOfCorruptRecord": "corrupt"})
    # A generator keeps the optimizer from moving a filter on ``valid`` below the parser, where it
    # would parse the body anew for every leaf.
    rows = requests.select("*", F.explode(F.array(doc)).alias("_j"))
    leaf = lambda path: F.col(f"_j.{path}")
    found = {
        "id": (leaf("id"), short_text(leaf("id"), 13)),
        "amount": (leaf("transaction.amount"), decimal_text(leaf("transaction.amount"))),
        "installments": (leaf("transaction.installments"), byte_text(leaf("transaction.installments"))),
        "requested_at": (leaf("transaction.requested_at"), epoch_text(leaf("transaction.requested_at"))),
        "customer_avg": (leaf("customer.avg_amount"), decimal_text(leaf("customer.avg_amount"))),
        "tx_count_24h": (leaf("customer.tx_count_24h"), byte_text(leaf("customer.tx_count_24h"))),
        "known_merchants": (leaf("customer.known_merchants"), merchants_text(leaf("customer.known_merchants"))),
        "merchant_id": (leaf("merchant.id"), short_text(leaf("merchant.id"), 8)),
        "mcc": (leaf("merchant.mcc"), short_text(leaf("merchant.mcc"), 4)),
        "merchant_avg": (leaf("merchant.avg_amount"), decimal_text(leaf("merchant.avg_amount"))),
        "is_online": (leaf("terminal.is_online"), flag_text(leaf("terminal.is_online"))),
        "card_present": (leaf("terminal.card_present"), flag_text(leaf("terminal.card_present"))),
        "km_from_home": (leaf("terminal.km_from_home"), decimal_text(leaf("terminal.km_from_home"))),
        "last_at": (leaf("last_transaction.timestamp"), epoch_text(leaf("last_transaction.timestamp"))),
        "last_km": (leaf("last_transaction.km_from_current"), decimal_text(leaf("last_transaction.km_from_current"))),
    }
    valid = F.col("_j").isNotNull() & leaf("corrupt").isNull() & (F.octet_length(body) <= MOST_BODY)
    for text, value in found.values():
        valid = valid & (text.isNull() | value.isNotNull())
    rows = rows.withColumns({name: value for name, (_, value) in found.items()} | {"valid": F.coalesce(valid, F.lit(False))})
    return rows.withColumn("has_last", F.col("last_at").isNotNull() | F.col("last_km").isNotNull())


_SPACE = b" \n\r\t"
_STRING = re.compile(rb'"((?:[^"\\]|\\.)*)"', re.DOTALL)
_BARE = re.compile(rb"[^,} \n\r\t]*")
_JUNK = re.compile(rb'[^{}"]*')
_LIST = re.compile(rb'[^\["\]]+|"(?:[^"\\]|\\.)*"|[\[\]]', re.DOTALL)
_ITEMS = re.compile(rb'\[[ \n\r\t]*(?:"[^"\\]{1,8}"[ \n\r\t]*(?:,[ \n\r\t]*"[^"\\]{1,8}"[ \n\r\t]*){0,4})?\]')
_DECIMAL = re.compile(rb"(?=.*[0-9])([0-9]*)\.?([0-9]*)")
_EPOCH = re.compile(rb"([0-9]{4})-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):([0-5][0-9]):([0-5][0-9])Z")


class _Refused(ValueError):
    """Reading stops here; what was read before stays."""


def _decimal(raw: bytes) -> float:
    if not (found := _DECIMAL.fullmatch(raw)):
        raise _Refused
    return float(found[1] or b"0") + int(found[2][:18] or b"0") * 10.0 ** -len(found[2][:18])


def _byte(raw: bytes) -> int:
    if not re.fullmatch(rb"[0-9]+", raw) or int(raw) > 255:
        raise _Refused
    return int(raw)


def _flag(raw: bytes) -> bool:
    if raw not in (b"true", b"false"):
        raise _Refused
    return raw == b"true"


def _epoch(raw: bytes) -> int:
    if not (found := _EPOCH.fullmatch(raw)):
        raise _Refused
    year, month, day, hour, minute, second = map(int, found.groups())
    shift = 400 if year == 0 else 0  # datetime has no year 0; the calendar repeats every 400 years
    first = date(year + shift, month, 1).toordinal() - 719_163 - (146_097 if shift else 0)
    return (first + day - 1) * 86_400 + hour * 3600 + minute * 60 + second


def _text(most: int):
    def read(raw: bytes) -> str:
        if not 0 < len(raw) <= most:
            raise _Refused
        return raw.decode("utf-8", "replace")

    return read


def _merchants(raw: bytes) -> list[str]:
    if not _ITEMS.fullmatch(raw):
        raise _Refused
    return [x[1].decode("utf-8", "replace") for x in _STRING.finditer(raw)]


_LEAVES = {
    (b"transaction", b"amount"): ("amount", _decimal), (b"transaction", b"installments"): ("installments", _byte),
    (b"transaction", b"requested_at"): ("requested_at", _epoch), (b"customer", b"avg_amount"): ("customer_avg", _decimal),
    (b"customer", b"tx_count_24h"): ("tx_count_24h", _byte), (b"customer", b"known_merchants"): ("known_merchants", _merchants),
    (b"merchant", b"id"): ("merchant_id", _text(8)), (b"merchant", b"mcc"): ("mcc", _text(4)), (b"merchant", b"avg_amount"): ("merchant_avg", _decimal),
    (b"terminal", b"is_online"): ("is_online", _flag), (b"terminal", b"card_present"): ("card_present", _flag), (b"terminal", b"km_from_home"): ("km_from_home", _decimal),
    (b"last_transaction", b"timestamp"): ("last_at", _epoch), (b"last_transaction", b"km_from_current"): ("last_km", _decimal),
}


class _Walk:
    """Reads a body from left to right, so that what precedes a failure is kept."""

    def __init__(self, body: bytes):
        self.body, self.at, self.depth, self.found, self.path = body, 0, 0, {}, [b"", b""]

    def _skip(self) -> bytes:
        while self.body[self.at : self.at + 1] and self.body[self.at] in _SPACE:
            self.at += 1
        return self.body[self.at : self.at + 1]

    def _match(self, pattern: re.Pattern) -> re.Match:
        if not (found := pattern.match(self.body, self.at)):
            raise _Refused
        self.at = found.end()
        return found

    def _close(self) -> None:
        if self.depth <= 0:
            raise _Refused
        self.depth, self.at = self.depth - 1, self.at + 1

    def _value(self) -> bytes | None:
        """The value's bytes, or null where an object opens."""
        first = self._skip()
        if first == b"{":
            self.depth, self.at = self.depth + 1, self.at + 1
            return None
        if first == b'"':
            return self._match(_STRING)[1]
        if first != b"[":
            return self._match(_BARE)[0]
        start, open_ = self.at, 0
        while True:
            token = self._match(_LIST)[0]
            open_ += (token == b"[") - (token == b"]")
            if not open_:
                return self.body[start : self.at]

    def _leaf(self, raw: bytes) -> None:
        if self.depth == 1 and self.path[0] == b"id":
            self.found["id"] = _text(13)(raw)
        elif self.depth == 2 and (leaf := _LEAVES.get((self.path[0], self.path[1]))):
            if not raw:
                raise _Refused
            self.found[leaf[0]] = leaf[1](raw)

    def run(self) -> bool:
        want = "key"
        while self.at < len(self.body):
            if want == "key":
                self._match(_JUNK)
                found = self.body[self.at : self.at + 1]
                if found == b"{":
                    self.depth, self.at = self.depth + 1, self.at + 1
                elif found == b"}":
                    want = "next"
                    self._close()
                    if not self.depth:
                        break
                elif found:
                    name = self._match(_STRING)[1]
                    if self.depth in (1, 2):
                        self.path[self.depth - 1] = name
                    if (after := self._skip()) and after != b":":
                        raise _Refused
                    self.at += 1
                    if self._skip():
                        raw = self._value()
                        if raw is not None:
                            self._leaf(raw)
                            want = "next"
            else:
                after = self._skip()
                if after == b",":
                    self.at, want = self.at + 1, "key"
                elif after == b"}":
                    self._close()
                    if not self.depth:
                        break
                elif after:
                    raise _Refused
        self._skip()
        return self.depth == 0 and self.at >= len(self.body)


def parse_body(body: str | bytes | None) -> dict:
    """A record as the scoring service reads it: fields before a failure stay, others keep defaults."""
    raw = body.encode() if isinstance(body, str) else body or b""
    walk = _Walk(raw)
    try:
        whole = walk.run()
    except _Refused:
        whole = False
    found = walk.found
    known = whole and bool(found.get("merchant_id")) and found["merchant_id"] in found.get("known_merchants", [])
    return found | {"has_last": "last_at" in found or "last_km" in found, "whole": whole, "known": known}


#: Whole, plain bodies: objects of pairs two deep, values without escapes or nulls, lists of strings.
_STRING_OF, _SPACES = r'"[^"\\]*"', r"[ \n\r\t]*+"
_VALUE = rf"(?:{_STRING_OF}|[0-9.]++|true|false|\[{_SPACES}(?:{_STRING_OF}{_SPACES}(?:,{_SPACES}{_STRING_OF}{_SPACES})*+)?\])"


def _object(value: str) -> str:
    pair = rf"{_STRING_OF}{_SPACES}:{_SPACES}{value}{_SPACES}"
    return rf"\{{{_SPACES}(?:{pair}(?:,{_SPACES}{pair})*+)?\}}"


_PLAIN = rf"^{_SPACES}{_object(rf'(?:{_VALUE}|{_object(_VALUE)})')}{_SPACES}$"


def _same_decimal(text: Column) -> Column:
    """A decimal by the compatible rule: whole part plus up to 18 digits of fraction times a power of ten."""
    whole, part = F.split_part(text, F.lit("."), F.lit(1)), F.left(F.split_part(text, F.lit("."), F.lit(2)), F.lit(18))
    power = F.array(*[F.lit(10.0**-n) for n in range(19)])
    value = F.when(whole == "", 0.0).otherwise(whole.try_cast("double")) + F.when(part == "", 0.0).otherwise(part.try_cast("bigint").cast("double") * F.get(power, F.length(part)))
    return F.when(text.rlike(r"^(?=.*[0-9])[0-9]*\.?[0-9]*$"), value)


def parse_compatible(requests: DataFrame, body: str = "body") -> DataFrame:
    """``requests`` with RECORD, ``whole``, ``known`` and ``risk``, by a reading that never rejects a row.

    Only a whole body marks its merchant as known and looks up its category's risk.  A body of the
    plain form, without repeated or unknown keys and with every value valid, is read by Spark's
    reader, as both give the same record then; any other one is walked from left to right.
    """
    from spanfold.functions.features import DEFAULT_RISK, MCC_RISK, mcc_risk, merchant_known

    kind = f"{RECORD}, whole boolean, known boolean, risk double"
    names = [x.split()[0] for x in kind.split(", ")]

    @F.pandas_udf(kind)
    def walk(bodies: pd.Series, plain: pd.Series) -> pd.DataFrame:
        columns: dict[str, list] = {name: [None] * len(bodies) for name in names}
        for at in (~plain.to_numpy(bool)).nonzero()[0]:
            found = parse_body(bodies.iat[at])
            found["risk"] = MCC_RISK.get(found.get("mcc", ""), DEFAULT_RISK) if found["whole"] else DEFAULT_RISK
            for name in names:
                columns[name][at] = found.get(name)
        frame = pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in columns.items()})
        for name, dtype in {"installments": "Int32", "tx_count_24h": "Int32", "requested_at": "Int64", "last_at": "Int64"}.items():
            frame[name] = frame[name].astype(dtype)
        for name in ("amount", "customer_avg", "merchant_avg", "km_from_home", "last_km", "risk"):
            frame[name] = frame[name].astype("Float64")
        return frame

    fields = [x.split()[0] for x in RECORD.split(", ")]
    held = requests.select(F.struct(*[f"`{c}`" for c in requests.columns]).alias("_in"), F.col(body).cast("string").alias("_body"))
    rows = _native(held, "_body")
    decimals = {"amount": "transaction.amount", "customer_avg": "customer.avg_amount", "merchant_avg": "merchant.avg_amount", "km_from_home": "terminal.km_from_home", "last_km": "last_transaction.km_from_current"}
    # Every key of a plain body is one that was found: as many keys as found values and objects.
    j, objects = F.col("_j"), ("transaction", "customer", "merchant", "terminal", "last_transaction")
    kinds = StructType.fromDDL(BODY)
    parts = [j["id"], *[j[o] for o in objects], *[j[o][f.name] for o in objects for f in kinds[o].dataType]]
    found = sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int"))
    plain = F.col("valid") & F.col("_body").rlike(_PLAIN) & (F.regexp_count("_body", F.lit(r'"[ \n\r\t]*:')) == found)
    rows = rows.withColumns({n: _same_decimal(j[p.split(".")[0]][p.split(".")[1]]) for n, p in decimals.items()})
    rows = rows.withColumn("_plain", F.coalesce(plain, F.lit(False)))
    rows = rows.withColumn("_r", walk(F.when(~F.col("_plain"), F.col("_body")), F.col("_plain")))
    native = {**{n: F.col(n) for n in fields}, "whole": F.lit(True), "known": merchant_known(F.col("merchant_id"), F.col("known_merchants")), "risk": mcc_risk(F.col("mcc"))}
    return rows.select("_in.*", *[F.when(F.col("_plain"), native[n]).otherwise(F.col("_r")[n]).alias(n) for n in names])
