"""Rewriting of turns and bodies: secrets stay inside, keys don't matter, savings are in characters."""

import json
import random

import pytest
from pyspark.sql import functions as F

from foldmill.operators import gateway as gw
from foldmill.operators.gateway import Policy

SECRET = "api_key=" + "abcdefghijklmnopqrstuvwxyz"
r = random.Random(2)
NOISE = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(4000))
RECORDS = json.dumps([{"id": i, "event": "login", "severity": "high"} for i in range(40)])
TURN = "conv_id long, turn long, role string, text string"


def body(*contents, **more):
    return json.dumps({"messages": [{"role": "user", "content": c} for c in contents], **more})


def requests(spark, rows):
    return spark.createDataFrame(rows, "request_id long, body string")


def test_turns_with_the_same_key_keep_their_texts(spark):
    a, b = "alpha line of text\n" * 60, "beta line of text\n" * 60
    turns = spark.createDataFrame([(1, 0, "user", a), (1, 0, "user", b), (None, None, "user", a)], TURN)
    out = gw.rewrite(turns).collect()
    assert all(x["applied"] for x in out) and ["alpha" in x["new_text"] for x in out] == [True, False, True] and ["beta" in x["new_text"] for x in out] == [False, True, False]


@pytest.mark.parametrize("mode", gw.MODES)
def test_no_secret_gets_out(spark, mode):
    text = f"{SECRET} " + "line of a log\n" * 80
    turns = spark.createDataFrame([(1, 0, "user", text)], TURN)
    x = gw.rewrite(turns, mode).first()
    assert x["blocked"] and not x["applied"] and x["reason"] == "secret" and "abcdefghijkl" not in str(x)
    x = gw.rewrite(turns, policy=Policy(mode, redact=True)).first()
    assert not x["blocked"] and "abcdefghijkl" not in str(x) and "[REDACTED_API_KEY]" in x["new_text"]
    assert "abcdefghijkl" in str(gw.rewrite(turns, policy=Policy(mode, allow_sensitive=True)).select(F.col("blocked"), F.lit(text)).first())
    out = gw.rewrite_requests(requests(spark, [(1, body(text)), (2, body("short"))]), Policy(mode)).orderBy("request_id").collect()
    assert (out[0]["decision"], out[0]["body"], out[0]["rejections"]) == ("blocked", None, ["secret"]) and out[1]["decision"] == "continue" and out[1]["body"] == body("short")
    out = gw.rewrite_requests(requests(spark, [(1, body(text))]), Policy(mode, redact=True)).first()
    assert "abcdefghijkl" not in str(out) and out["warnings"] == ["suspected secrets were redacted"]


def test_modes(spark):
    turns = spark.createDataFrame([(1, 0, "user", NOISE), (1, 1, "assistant", NOISE), (1, 2, "tool", "x")], TURN)
    out = gw.rewrite(turns, "externalized").collect()
    assert [(x["turn"], x["applied"], x["kind"]) for x in out] == [(0, True, "sidecar_ref")]
    assert out[0]["new_text"].split("\n")[1] == "uri=foldmill://sha256/" + out[0]["digest"]
    assert gw.rewrite(turns, "strict").first()["reason"] == "externalized_requires_retrieval"
    allowed = {(x["class"], x["mode"]) for x in gw.decision_table(spark).where("allowed").collect()}
    assert ("externalized_reversible", "strict") not in allowed and ("local_decode_reversible", "local_decode") in allowed
    with pytest.raises(ValueError):
        Policy("loose")


def test_statistics_add_up(spark):
    turns = spark.createDataFrame([(1, 0, "user", NOISE), (1, 1, "user", RECORDS), (2, 0, "tool", f"{SECRET} {NOISE}")], TURN)
    rows = gw.rewrite(turns, "externalized")
    t = {x["conv_id"]: x for x in gw.telemetry(rows).collect()}
    s = gw.stats(rows).collect()
    total = next(x for x in s if (x["kind"], x["class"], x["reason"]) == (None, None, None) and x["n"] == 3)
    assert (t[1]["targets"], t[1]["applied"], t[2]["applied"], t[2]["blocked"]) == (2, 2, 0, 1)
    assert total["saved"] == sum((x["tokens_before"] or 0) - (x["tokens_after"] or 0) for x in t.values()) > 0


def test_bodies_end_to_end(spark):
    rows = [(1, body(RECORDS, "short", system="be good")), (1, body(f"look at {RECORDS} please")), (1, body(RECORDS, "short", system="be good")), (None, None), (3, "nope"), (4, json.dumps({"input": RECORDS}))]
    out = gw.rewrite_requests(requests(spark, rows)).collect()
    by = {(x["request_id"], i): x for i, x in enumerate(sorted(out, key=lambda x: (x["request_id"] or 0, len(x["body"] or ""), x["body"] or "")))}
    first = [x for x in out if x["request_id"] == 1 and x["format"] == "anthropic"]
    assert len(out) == 6 and len(by) == 6 and len(first) == 2 and first[0] == first[1] and first[0]["decision"] == "rewrite" and first[0]["prompt_added"]
    made = json.loads(first[0]["body"])
    assert made["messages"][0]["content"].startswith("<foldmill:") and made["messages"][1]["content"] == "short" and made["system"] == "be good\n\n" + gw.INSTRUCTION
    fact = first[0]["rewrites"][0]
    assert fact["path"] == "messages[0].content" and fact["saved_chars"] == fact["chars_before"] - fact["chars_after"] == len(RECORDS) - len(made["messages"][0]["content"])
    (embedded,) = [x for x in out if x["request_id"] == 1 and x["format"] == "openai"]
    assert "<foldmill:" in embedded["body"] and "look at" not in embedded["body"]
    assert [x["body"] for x in out if x["request_id"] == 3] == ["nope"] and [x["decision"] for x in out if x["request_id"] is None] == ["continue"]
    assert json.loads(next(x["body"] for x in out if x["request_id"] == 4))["input"].startswith("<foldmill:")


def test_columns_of_any_names_pass(spark):
    df = spark.createDataFrame([(1, body(RECORDS), "k", "d", "m")], "request_id long, body string, _key string, decisions string, made string")
    assert gw.rewrite_requests(df).select("_key", "decisions", "made").first() == ("k", "d", "m")
    found = spark.createDataFrame([("t" * 900, "r", "b", "x")], "text string, result string, best string, row string")
    out = gw.rewrite_targets(found)
    assert out.columns[-1] == "_result" and out.select("result", "best", "row").first() == ("r", "b", "x")


def test_envelopes_and_shaping(spark):
    inner = {"messages": [{"role": "user", "content": RECORDS}], "reasoning_effort": "high"}
    rows = requests(spark, [(1, json.dumps({"event": "e", "request": inner})), (2, json.dumps({"body": inner})), (3, json.dumps(inner)), (4, "{}")])
    out = gw.request_hook(rows, Policy(shaping=True, verbosity="terse", effort_routing=True)).orderBy("request_id").collect()
    assert [x["decision"] for x in out] == ["rewrite"] * 3 + ["continue"] and {x["hook"]["name"] for x in out} == {"foldmill.request_rewrite"}
    for x in out[:3]:
        made = json.loads(x["request"])
        assert made["reasoning_effort"] == "low" and gw.HINT in made["messages"][0]["content"] and x["telemetry"]["rewrite_count"] == 1
    plain = gw.request_hook(rows, Policy(shaping=True)).orderBy("request_id").first()
    assert gw.HINT not in plain["request"] and json.loads(plain["request"])["reasoning_effort"] == "high"
