"""Rows that fail to parse, set apart with the first reason that holds while the others load.

Two dialects share the typed field constructors. Delimited text is assembled into records quote-aware and read by the strict csv
reader; delivered JSON records are read by a strict RFC 8259 reader, because a csv reader cannot tell whether a JSON object is well
formed. Structural failures are caught before any field is constructed.
"""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# English month abbreviations of dmy_date.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_EMAIL = re.compile(r"[^@\s]+@[^@\s]*\.[^@\s]*(?<!\.)")
_PHONE = re.compile(r"([ \t +()\-./0-9]*?)(?:x[0-9]{0,5})?")
_URL = re.compile(r"https?://\S+", re.I)
_ISO = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})")
_DMY = re.compile(r"([0-9]{2}) ([A-Z][a-z]{2}) ([0-9]{4})")
_WHOLE = re.compile(r"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")


class Number(str):
    """A JSON number as written."""


def _date(y: str, m: int, d: str) -> bool:
    try:
        date(int(y), m, int(d))
        return True
    except ValueError:
        return False


def _whole(text: str) -> bool:
    m = _WHOLE.fullmatch(text)
    if not m:
        return False
    if not m[2] and not m[3]:
        return not text.startswith("-") or m[1] == "0"
    try:
        value = float(text)
    except ValueError:
        return False
    return value >= 0 and value == int(value) if value < 1e300 else True


def is_text(v) -> bool:
    return type(v) is str


def is_int(v) -> bool:
    return _whole(v) if isinstance(v, Number) else type(v) is str and re.fullmatch("[0-9]+", v) is not None


def is_email(v) -> bool:
    return type(v) is str and _EMAIL.fullmatch(v) is not None


def is_phone(v) -> bool:
    if type(v) is not str or not (m := _PHONE.fullmatch(v)):
        return False
    return 7 <= sum(c.isdigit() for c in m[1]) <= 15


def is_url(v) -> bool:
    return type(v) is str and _URL.fullmatch(v) is not None


def is_iso_date(v) -> bool:
    return type(v) is str and (m := _ISO.fullmatch(v)) is not None and _date(m[1], int(m[2]), m[3])


def is_dmy_date(v) -> bool:
    return type(v) is str and (m := _DMY.fullmatch(v)) is not None and m[2] in MONTHS and _date(m[3], MONTHS.index(m[2]) + 1, m[1])


CONSTRUCTORS = {"text": is_text, "int": is_int, "email": is_email, "phone": is_phone, "url": is_url, "iso_date": is_iso_date, "dmy_date": is_dmy_date}


def parse_headers(spec: str | None) -> list[tuple[str, str]] | None:
    """Header:type joined by |; null when the source has no declared record."""
    return [tuple(h.rsplit(":", 1)) for h in spec.split("|")] if isinstance(spec, str) and spec else None


class _Pairs(list):
    pass


def _no_constant(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(object_pairs_hook=_Pairs, parse_int=Number, parse_float=Number, parse_constant=_no_constant, strict=True)


_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))')


def deep_pairs(body: str) -> list[tuple[str, object]] | None:
    """json_pairs for texts nested beyond the interpreter's stack: the same grammar with a stack of its own. Nested values come out as
    empty objects, as no field type takes them."""
    stack: list[str] = []
    pairs: list[tuple[str, object]] = _Pairs()
    want, key, at = "value", "", 0
    while at < len(body):
        m = _TOKEN.match(body, at)
        if not m:
            return None
        at = m.end()
        mark, text, number, word = m.groups()
        value: object = None
        if want in ("key", "key or end") and text is not None:
            if len(stack) == 1:
                key = json.loads(text)
            want = "colon"
            continue
        if want == "colon" and mark == ":":
            want = "value"
            continue
        if want == "next" and mark == ",":
            want = "key" if stack[-1] == "{" else "value"
            continue
        if mark in ("}", "]") and stack and stack[-1] == ("{" if mark == "}" else "[") and (want == "next" or want == ("key or end" if mark == "}" else "value or end")):
            stack.pop()
            if not stack:
                return pairs if at == len(body) else None
            if len(stack) == 1:
                pairs.append((key, _Pairs()))
            want = "next"
            continue
        if want not in ("value", "value or end"):
            return None
        if mark in ("{", "["):
            if not stack and mark == "[":
                return None
            stack.append(mark)
            want = "key or end" if mark == "{" else "value or end"
            continue
        if text is not None:
            value = json.loads(text)
        elif number is not None:
            value = Number(number)
        elif word is not None:
            value = {"true": True, "false": False, "null": None}[word]
        else:
            return None
        if not stack:
            return None
        if len(stack) == 1:
            pairs.append((key, value))
        want = "next"
    return None


def json_pairs(raw: str) -> list[tuple[str, object]] | None:
    """The members of exactly one JSON object in order, repeats included; None when the text is anything else."""
    try:
        body = raw.strip(" \t\n\r")
        if not body.startswith("{"):
            return None
        value, end = _DECODER.raw_decode(body)
    except ValueError:
        return None
    except RecursionError:
        return deep_pairs(body)
    return value if end == len(body) and isinstance(value, _Pairs) else None


def fault(pairs: list[tuple[str, object]] | None, headers: list[tuple[str, str]] | None) -> str | None:
    """broken, fields or value: the first that holds; None for a record that loads."""
    if pairs is None:
        return "broken"
    if headers is None or sorted(k for k, _ in pairs) != sorted(h for h, _ in headers):
        return "fields"
    types = dict(headers)
    return None if all(v is None or (type(v) is str and v == "") or CONSTRUCTORS[types[k]](v) for k, v in pairs) else "value"


def assemble(lines: Iterator[str], quote: str = '"') -> Iterator[str]:
    """Records from physical lines: a line that leaves a quote open is joined with the next ones until it is closed. A quote that
    never closes ends with the input, as one record."""
    held: list[str] = []
    odd = False
    for line in lines:
        held.append(line)
        odd ^= line.count(quote) % 2 == 1
        if not odd:
            yield "\n".join(held)
            held = []
    if held:
        yield "\n".join(held)


def csv_pairs(record: str, headers: list[tuple[str, str]]) -> list[tuple[str, object]] | None:
    """The fields of one delimited record by the strict reader; None on a structural failure or a wrong column count."""
    try:
        rows = list(csv.reader([record] if "\n" not in record else record.splitlines(keepends=True), strict=True))
    except csv.Error:
        return None
    if len(rows) != 1 or len(rows[0]) != len(headers):
        return None
    return [(h, v) for (h, _), v in zip(headers, rows[0])]


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str | None, list | None] = {}
    for pdf in batches:
        reasons, dialects = [], []
        for raw, spec in zip(pdf["raw"], pdf["headers"]):
            if spec not in known:
                known[spec] = parse_headers(spec)
            headers = known[spec]
            reason = fault(json_pairs(raw), headers)
            reasons.append(reason)
            as_csv = None
            if reason == "broken" and headers:
                records = list(assemble(iter(raw.split("\n"))))
                as_csv = csv_pairs(records[0], headers) if len(records) == 1 and records[0] else None
            dialects.append("csv" if as_csv is not None and fault(as_csv, headers) is None else None)
        yield pd.DataFrame({"row_id": pdf["row_id"], "source": pdf["source"], "reason": reasons, "loads_as": dialects})


def judge_records(df: DataFrame, feeds: DataFrame, row_id: str, source: str, raw: str) -> DataFrame:
    """(row_id, source, reason, loads_as) of each row with a non-null raw text; reason is null for rows that load.

    feeds: (source, headers), a dimension of fixed size, broadcast. A source that is unknown or declares no headers fails by
    `fields` once its text is one JSON object. loads_as names csv where a broken text is a sound delimited record of the headers.
    """
    told = feeds.select("source", "headers").dropDuplicates(["source"])
    rows = df.select(F.col(row_id).alias("row_id"), F.col(source).alias("source"), F.col(raw).alias("raw")).filter("raw is not null")
    joined = rows.join(F.broadcast(told), "source", "left").select("row_id", "source", "raw", "headers")
    return joined.mapInPandas(_judge, "row_id string, source string, reason string, loads_as string")


def load_delimited(lines: DataFrame, text: str, headers: str) -> DataFrame:
    """(line, record, fields, reason) of delimited text, one physical line a row: records are assembled quote-aware inside each
    partition (read with wholetext or one file a partition where records may span lines), then judged like JSON ones.
    reason: `broken` for quoting, `fields` for a wrong column count, `value` for a field of another type; null when it loads."""
    spec = parse_headers(headers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = (line for pdf in batches for line in pdf["line"])
        out: list[tuple] = []
        for n, record in enumerate(assemble(stream)):
            try:
                rows = list(csv.reader(record.splitlines(keepends=True) or [""], strict=True))
                values = rows[0] if len(rows) == 1 else []
                pairs = [(h, v) for (h, _), v in zip(spec, values)]
                reason = "fields" if len(values) != len(spec) else fault(pairs, spec)
            except csv.Error:
                values, reason = None, "broken"
            out.append((n, record, values, reason))
            if len(out) >= 2048:
                yield pd.DataFrame(out, columns=["n", "record", "fields", "reason"])
                out = []
        yield pd.DataFrame(out, columns=["n", "record", "fields", "reason"])

    return lines.select(F.coalesce(F.col(text), F.lit("")).alias("line")).mapInPandas(run, "n long, record string, fields array<string>, reason string")
