"""Objects out of replies that aren't quite JSON."""

import json
import time

from tallygrid.operators import sampling

CASES = {
    '{"a": "plain", "b": []}': ("plain", []),
    'x ```json\n{"a": "fenced"}\n``` y': ("fenced", None),
    '{"a": "including "typos", DIV/0 errors", "b": ["x"]}': ("including \"typos\", DIV/0 errors", ["x"]),
    '{"a": "the "Total" row", "b": ["one "two" three", "four"]}': ('the "Total" row', ['one "two" three', "four"]),
    '{"a": "kept \\"as\\" it is", "b": ["x",],}': ('kept "as" it is', ["x"]),
    '{"a": "both "kinds" here", "b": ["x",],}': ('both "kinds" here', ["x"]),
    '{"a": "ends in a "quote"", "b": []}': ('ends in a "quote"', []),
    '{"b": ["p", "q"], "a": "brackets ]} and [{ "inside""}': ('brackets ]} and [{ "inside"', ["p", "q"]),
    '{"a": "", "b": [""]}': ("", [""]),
    "{}": (None, None),
    '{"a": "broken off", "b": ["x"': None,
    "no braces": None,
    "} {": None,
    "": None,
}


def test_replies(spark):
    rows = spark.createDataFrame([*((k, x) for k, x in enumerate(CASES)), (99, None)], "k int, reply string")
    got = {r["k"]: r["got"] for r in rows.select("k", sampling.parsed_reply(rows["reply"], "a string, b array<string>").alias("got")).collect()}
    for k, (reply, want) in enumerate(CASES.items()):
        assert (None if got[k] is None else (got[k]["a"], got[k]["b"])) == want, reply
    assert got[99] is None


def test_valid_json_stays_as_it_is(spark):
    texts = [json.dumps(x) for x in ({"a": [1, 2, {"b": "c, d: e"}], "f": None}, {"g": {"h": [[], [True]]}, "i": 'j "k" l'})]
    rows = spark.createDataFrame([(t,) for t in texts], "reply string")
    assert [r[0] for r in rows.select(sampling.with_quotes_escaped(rows["reply"])).collect()] == texts


def test_replies_of_many_quotes_take_time_in_proportion(spark):
    reply = '{"a": "x", "b": [' + ", ".join(f'"it "is" {k}"' for k in range(60)) + "]}"
    began = time.time()
    rows = spark.createDataFrame([(reply,)], "reply string")
    assert rows.select(sampling.parsed_reply(rows["reply"], "a string, b array<string>").alias("got")).first()["got"]["b"] == [f'it "is" {k}' for k in range(60)]
    assert time.time() - began < 20
