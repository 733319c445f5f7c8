import json

import pytest

from kinfold.operators import records

HEADERS = "Name:text|Email:email|Phone:phone|Site:url|Badge:int|Day:iso_date|On:dmy_date"
GOOD = {"Name": "Ada", "Email": "a@b.example", "Phone": "+1 (415) 555-1234 x99", "Site": "https://a.example", "Badge": "7", "Day": "2024-02-29", "On": "12 Jun 2024"}


def reason(raw, headers=HEADERS):
    return records.fault(records.json_pairs(raw), records.parse_headers(headers))


def test_good_records_load():
    assert reason(json.dumps(GOOD)) is None
    assert reason(json.dumps(dict.fromkeys(GOOD))) is None
    assert reason(json.dumps(dict.fromkeys(GOOD, ""))) is None
    assert reason(json.dumps(dict(reversed(GOOD.items())))) is None


@pytest.mark.parametrize("raw", ["", "null", "[]", "{", json.dumps(GOOD) + "x", json.dumps(GOOD) * 2, "{'Name': 1}", '{"a": NaN}', '{"a": 01}', '{"a": "\n"}', '{"a": 1,}', '{"a": "\\x41"}', "﻿{}", "[" * 100_000])
def test_broken(raw):
    assert reason(raw) == "broken"


@pytest.mark.parametrize("raw", ["{}", json.dumps({**GOOD, "More": 1}), json.dumps(GOOD)[:-1] + ', "Name": "again"}', json.dumps({**{k: v for k, v in GOOD.items() if k != "On"}, "on": None})])
def test_fields(raw):
    assert reason(raw) == "fields"


@pytest.mark.parametrize("key, value", [("Name", 3), ("Name", ["a"]), ("Name", True), ("Email", "x@y."), ("Email", "a@@b.c"), ("Email", "a b@c.d"), ("Email", "a@nodot"), ("Phone", "12345"), ("Phone", "1234567890123456"), ("Phone", "call me"), ("Phone", 5550123), ("Phone", "5551234567 x123456"), ("Site", "www.a.example"), ("Site", "https://a b"), ("Badge", "-1"), ("Badge", -1), ("Badge", 2.5), ("Badge", "1e3"), ("Badge", True), ("Day", "2025-02-29"), ("Day", "2024/02/29"), ("On", "31 Apr 2025"), ("On", "12 Juni 2024"), ("On", "1 Jun 2024")])
def test_value(key, value):
    assert reason(json.dumps({**GOOD, key: value})) == "value"


def test_judge_keeps_reasons_and_finds_delimited_rows(spark):
    feeds = spark.createDataFrame([("s", "Name:text|Badge:int"), ("none", None)], "source string, headers string")
    rows = [("1", "s", '{"Name": "a", "Badge": 1}'), ("2", "s", "a,7"), ("3", "s", "a,b"), ("4", "s", None), ("5", "none", "{}"), ("6", None, "{}"), ("7", "s", '{"Name": "' + "x" * 200_000 + '", "Badge": 1}'), ("1", "s", "{}")]
    got = sorted((r["row_id"], r["reason"], r["loads_as"]) for r in records.judge_records(spark.createDataFrame(rows, "id string, source string, raw string"), feeds, "id", "source", "raw").collect() if r["reason"])
    assert got == [("1", "fields", None), ("2", "broken", "csv"), ("3", "broken", None), ("5", "fields", None), ("6", "fields", None)]
    assert records.judge_records(spark.createDataFrame([], "id string, source string, raw string"), feeds, "id", "source", "raw").count() == 0


def test_delimited_text_is_assembled_and_judged(spark):
    lines = ["Ada,7", '"multi', 'line",8', "too,many,fields", "Bob,x", '"bad"quote,1', "", '"open,9']
    df = spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1)
    got = [(r["fields"], r["reason"]) for r in records.load_delimited(df, "line", "Name:text|Badge:int").collect()]
    assert got == [(["Ada", "7"], None), (["multi\nline", "8"], None), (["too", "many", "fields"], "fields"), (["Bob", "x"], "value"), (None, "broken"), ([], "fields"), (None, "broken")]


def test_deep_nesting_is_read_with_a_stack_of_its_own():
    from kinfold.operators import records as R

    deep = '{"a": ' + "[" * 200_000 + "]" * 200_000 + ', "b": "x"}'
    assert [k for k, _ in R.json_pairs(deep)] == ["a", "b"] and R.fault(R.json_pairs(deep), [("a", "text"), ("b", "text")]) == "value"
    assert R.json_pairs(deep[:-1]) is None and R.json_pairs(deep.replace('"x"', "x")) is None
    for good in ('{}', '{"a": [1, {"b": null}], "c": "\\u00e9", "a": -0.5e3}', '{"a": {}, "b": []}'):
        assert [(k, None if isinstance(v, (list, dict)) else v) for k, v in R.deep_pairs(good)] == [(k, None if isinstance(v, (list, dict)) else v) for k, v in R.json_pairs(good)]
    for bad in ("", "[]", "{", '{"a"}', '{"a":}', '{"a":1,}', '{,}', '{"a":1}}', '{"a":1 "b":2}', '{"a":[1,]}', '{"a":[1}', '{"a":01}', '{"a":"\n"}', '{"a":NaN}', '1', '{"a":1}x'):
        assert R.deep_pairs(bad) is None and R.json_pairs(bad) is None, bad


def test_addresses_need_a_local_part():
    from kinfold.operators.records import is_email

    assert is_email("a@b.c") and not is_email("@b.c") and not is_email("a@b") and not is_email("a@b.") and not is_email("a b@c.d") and not is_email("a@@b.c")
