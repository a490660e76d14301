"""Answers of command line services, one a row."""

import json

import pytest
from pyspark.sql import functions as F

from loomscore.functions import events


def result(**more):
    return json.dumps({"type": "result", "is_error": False, "result": "E1", "stop_reason": "end", "session_id": "s1", "total_cost_usd": 0.5, "num_turns": 1, "usage": {"input_tokens": 2, "output_tokens": 7}} | more)


def event(kind, **more):
    return json.dumps({"type": kind} | more)


def message(text):
    return event("item.completed", item={"id": "0", "type": "agent_message", "text": text})


USAGE = {"m1": {"inputTokens": 1, "outputTokens": 1}, "a0": {"inputTokens": 2, "outputTokens": 163, "cacheReadInputTokens": 3148, "cacheCreationInputTokens": 5951, "canonicalModel": "a-0"}}
RESULTS = [
    (result(), ("answered", None, "E1", 2, 7, None)),
    ("warning: x\n" + result(modelUsage=USAGE), ("answered", None, "E1", 9101, 163, "a-0")),  # the last model counts, by its place
    (result(modelUsage={"m": {"outputTokens": 4}}), ("answered", None, "E1", 0, 4, "m")),
    (result(result=None), ("answered", None, "null", 2, 7, None)),
    (result(result={"a": [1]}), ("answered", None, '{"a":[1]}', 2, 7, None)),
    (result(is_error=True, result="Not logged in"), ("permanent", "Not logged in", None, None, None, None)),
    (result(is_error=True, result="Rate limit; login later"), ("permanent", "Rate limit; login later", None, None, None, None)),
    (result(is_error=True, result="Overloaded"), ("transient", "Overloaded", None, None, None, None)),
    (result(is_error=True, result="", terminal_reason="HTTP 529"), ("transient", "HTTP 529", None, None, None, None)),
    (result(is_error=True, result=None), ("permanent", "unknown error", None, None, None, None)),
    ("garbage without an object", ("transient", "no json: garbage without an object", None, None, None, None)),
    (result() + " trailing", ("transient", "no json: " + (result() + " trailing")[-200:], None, None, None, None)),
    ("", ("transient", "no json: ", None, None, None, None)),
]


def rows(spark, cases, fold):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, t string").select("i", fold("t").alias("r")).select("i", "r.*")
    return {r["i"]: r for r in df.collect()}


def test_result_objects(spark):
    got = rows(spark, RESULTS, events.result_object)
    for i, (text, expected) in enumerate(RESULTS):
        assert tuple(got[i][c] for c in ("outcome", "error", "raw_text", "input_tokens", "output_tokens", "response_model")) == expected, text
    assert (got[0]["request_id"], got[0]["cost_usd"], got[0]["num_turns"], got[0]["finish_reason"]) == ("s1", 0.5, 1, "end")


LOG = "\n".join(["Reading input", event("thread.started", thread_id="t1"), event("turn.started"), message("first"), "{broken", "  " + message("last"), event("turn.completed", usage={"input_tokens": 17, "cached_input_tokens": 12, "output_tokens": 11, "reasoning_output_tokens": 3})])
EVENTS = [
    (LOG, ("answered", None, "last", 17, 11, 12, "t1", "turn.completed")),
    (event("error", message="busy") + "\r\n" + message("still"), ("answered", None, "still", None, None, None, None, None)),
    (event("thread.started", thread_id="t"), ("transient", "no message: " + event("thread.started", thread_id="t"), None, None, None, None, None, None)),
    (event("error", message="invalid model"), ("permanent", "invalid model", None, None, None, None, None, None)),
    (event("error", message="invalid model") + "\n" + event("turn.failed", message="Rate limit"), ("transient", "Rate limit", None, None, None, None, None, None)),
    (event("turn.failed", code=5), ("permanent", event("turn.failed", code=5), None, None, None, None, None, None)),
    (event("item.completed", item={"type": "reasoning", "text": "hm"}), ("transient", "no message: " + event("item.completed", item={"type": "reasoning", "text": "hm"}), None, None, None, None, None, None)),
    ("", ("transient", "no message: ", None, None, None, None, None, None)),
]


def test_event_lines(spark):
    got = rows(spark, EVENTS, events.event_lines)
    for i, (text, expected) in enumerate(EVENTS):
        found = tuple(got[i][c] for c in ("outcome", "error", "raw_text", "input_tokens", "output_tokens", "cache_read_input_tokens", "request_id", "finish_reason"))
        assert tuple(None if v is None else v[-200:] if k == 1 and "no message" in (v or "") else v for k, v in enumerate(found)) == tuple(None if v is None else v[-200:] if k == 1 and "no message" in (v or "") else v for k, v in enumerate(expected)), text


@pytest.mark.parametrize("fold", [events.result_object, events.event_lines])
def test_nulls(spark, fold):
    r = spark.range(1).select(fold(F.lit(None).cast("string")).alias("r")).select("r.*").first()
    assert r["outcome"] == "transient" and r["raw_text"] is None
