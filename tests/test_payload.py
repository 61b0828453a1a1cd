"""JSON requests and replies: every kind of body, batch and stream."""

import json

import pytest

from parley.functions.payload import reply_text, request_text
from parley.streaming.annotate import JsonEcho, annotate_requests

SF = "/root/testdata/sf0.001"

REQUESTS = [
    ('{"response": "hi"}', "hi", None), (' {"a": [1], "response": "x\\ny"}\n', "x\ny", None), ('{"response": ""}', "", None),
    ('{"response": 5}', "5", None), ('{"response": {"q": 1}}', '{"q":1}', None), ('{"response": "a", "response": "b"}', "b", None),
    ('{"response": "\\u00e9"}', "é", None), (None, None, "empty"), ("", None, "empty"), (" \n", None, "empty"),
    ('{"response": "a"', None, "malformed"), ('{"response": "a"} x', None, "malformed"), ('{"response": "a"}{}', None, "malformed"),
    ('{"response": "a"}, "x": {}', None, "malformed"), ('{"response": "a"}, {"x": {}}', None, "malformed"), ("hello", None, "malformed"),
    ('[{"response": "a"}]', None, "wrong_type"), ("5", None, "wrong_type"), ('"response"', None, "wrong_type"),
    ("null", None, "wrong_type"), ("{}", None, "missing_field"), ('{"Response": "a"}', None, "missing_field"),
    ('{"response": null}', None, "missing_field"),
]
REPLIES = [
    ('[{"generated_text": "t", "score": 1}]', "t", None), ('[{"generated_text": "t"}, {"generated_text": "u"}]', "t", None),
    ('[{"generated_text": ""}]', "", None), ("[]", None, "no_reply"), ("[null]", None, "missing_field"), ("[{}]", None, "missing_field"),
    ('{"error": "busy"}', None, "wrong_type"), ("[1]", None, "wrong_type"), ('[{"generated_text": "t"}', None, "malformed"),
    ('[{"generated_text": "t"}] z', None, "malformed"), ('[], "x": [1]', None, "malformed"), (None, None, "empty"),
]


@pytest.mark.parametrize("cases,parse", [(REQUESTS, request_text), (REPLIES, reply_text)])
def test_every_body_has_a_defined_result(spark, cases, parse):
    df = spark.createDataFrame([(i, b) for i, (b, _, _) in enumerate(cases)], "id int, body string")
    got = {r.id: (r.x.text, r.x.error) for r in df.select("id", parse("body").alias("x")).collect()}
    assert {cases[i][0]: v for i, v in got.items()} == {b: (t, e) for b, t, e in cases}


def test_requests_keep_what_there_is(spark):
    """Failed requests make no call; a failed reply leaves the other part."""
    class Counting(JsonEcho):
        def __call__(self, prompts):
            assert all(isinstance(p, str) for p in prompts)
            return ["[]" if p == "no summary" else r for p, r in zip(prompts, super().__call__(prompts))]

    texts = ["x" * n for n in range(14)] + ["no summary", "a" * 600 + "\n" + "b" * 600]
    bodies = [json.dumps({"response": t}) for t in texts] + ["{", None]
    df = spark.createDataFrame(list(enumerate(bodies)), "dialogue_id long, body string")
    got = {r.dialogue_id: r for r in annotate_requests(df, Counting()).collect()}
    assert len(got) == len(bodies)
    assert got[16].error == "request: malformed" and got[17].error == "request: empty"
    assert json.loads(got[17].response) == {"error": "request: empty"}
    assert (got[16].sentiment, got[16].summary) == (None, None)
    errors = {got[i].error for i in range(14)}
    assert errors == {None, "sentiment: malformed", "sentiment: no_reply", "sentiment: missing_field"}
    for i in range(1, 14):
        assert got[i].summary == "x" * i and (got[i].sentiment is None) == (got[i].error is not None)
    assert got[14].summary is None and got[14].error in ("summary: no_reply", "sentiment: malformed", "sentiment: no_reply",
                                                         "sentiment: missing_field")
    assert got[15].summary == "a" * 600 + "\n" + "b" * 600
    assert annotate_requests(df.limit(0), Counting()).count() == 0


def test_request_stream_equals_batch(spark):
    import __spark_entry__ as E
    qs = E.queries()
    s, b = (sorted(map(tuple, qs[f"k1_requests_{k}"](spark, SF).collect())) for k in ("stream", "batch"))
    assert s == b and len(s) == 200
