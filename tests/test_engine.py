"""The choice among encodings: within the row, all of them, whatever the keys."""

import json
import random

import pytest
from pyspark.sql import functions as F

from foldmill.operators import analytical, batches, engine
from foldmill.operators.engine import Codec, Config, best, candidates, decoded

RECORDS = [{"id": f"AX-{i}", "event": "login", "severity": "high"} for i in range(30)]
REPEATED = "\n".join(["a line that is repeated", "short", "another"] * 30 + ["a unique line at the end"])
r = random.Random(1)
NOISE = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(4000))


def payloads(spark, rows):
    return spark.createDataFrame(rows, "payload_id long, text string")


def test_rows_keep_their_own_payloads(spark):
    rows = [(1, json.dumps(RECORDS)), (1, REPEATED), (None, "tiny"), (None, NOISE), (2, None), (3, "")]
    for config in (Config(), Config(reversible_only=True), Config(estimate=lambda c: F.length(c))):
        out = best(payloads(spark, rows), config).collect()
        assert [(x["payload_id"], x["text"]) for x in out] == rows
        back = {x["text"]: x["d"] for x in best(payloads(spark, rows), config).withColumn("d", decoded(F.col("payload"))).collect()}
        assert json.loads(back[rows[0][1]]) == RECORDS and back["tiny"] == "tiny" and back[None] is None and back[""] == ""
        kinds = {x["text"]: x["kind"] for x in out}
        assert kinds["tiny"] == kinds[None] == kinds[""] == "none" and kinds[NOISE] == "sidecar_ref" and kinds[rows[0][1]] in ("schema_rows", "shape_rows")


def test_nothing_is_shuffled(spark):
    plan = best(payloads(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_the_choice_is_the_least_candidate(spark):
    rows = [(i, t) for i, t in enumerate([json.dumps(RECORDS), REPEATED, NOISE, "word " * 900, "<a>" + "<b x='1'>y</b>" * 9 + "</a>", "[REDACTED_API_KEY] " + NOISE])]
    made = candidates(payloads(spark, rows)).where("not reversible or round_trip").collect()
    assert {x["kind"] for x in made} >= {"schema_rows", "json_table", "pattern_hash", "log_templates", "grammar", "xml_shape_rows", "xml_path"}
    for x in best(payloads(spark, rows)).collect():
        own = [(c["tokens"], engine.RANK[c["kind"]], c["kind"], c["payload"]) for c in made if c["payload_id"] == x["payload_id"] and ("[REDACTED_" not in x["text"] or "[REDACTED_" in c["payload"])]
        least = min(own)
        assert (x["tokens"], x["kind"], x["payload"]) == (least[0], least[2], least[3]) or (x["kind"] == "none" and least[0] > x["raw_tokens"])


def test_json_goes_by_its_compact_text(spark):
    spaced = json.dumps(RECORDS, indent=4)
    out = best(payloads(spark, [(1, spaced), (2, "{broken"), (3, "[1]")])).collect()
    assert out[0]["raw_tokens"] == len(json.dumps(RECORDS, separators=(",", ":"))) // 4
    assert out[1]["payload"] == "{broken" and out[2]["payload"] == "[1]"


def test_knobs(spark):
    big = [(1, REPEATED)]
    assert best(payloads(spark, big), Config(minimum_chars=10**6)).first()["kind"] == "none"
    assert "transport_deflate" not in [x["kind"] for x in candidates(payloads(spark, big)).collect()]
    assert "transport_deflate" in [x["kind"] for x in candidates(payloads(spark, big), Config(transport=True)).collect()]
    assert best(payloads(spark, [(1, json.dumps(RECORDS[:1]))]), Config(allow_expansion=True)).first()["kind"] != "none"
    for bad in ({"chars_per_token": 0}, {"minimum_chars": -1}, {"delimiters": ()}):
        with pytest.raises(ValueError):
            Config(**bad)
    table = candidates(payloads(spark, [(1, json.dumps(RECORDS))]), Config(delimiters=("~",)), ["json_table"]).first()
    assert 'delimiter="~"' in table["payload"]


def test_own_encodings_compete(spark):
    engine.register(Codec("shout", lambda t: t.startswith("quiet"), lambda t: F.lit("<foldmill:shout_v1>"), lambda p: F.lit("quiet " * 40), True))
    try:
        assert best(payloads(spark, [(1, "quiet " * 40)])).first()["kind"] == "shout"
        assert best(payloads(spark, [(1, "quiet " * 41)])).first()["kind"] != "shout"  # it doesn't read back
    finally:
        del engine.CODECS["shout"], engine.RANK["shout"]


def test_every_encoding_has_a_rank_and_a_class(spark):
    names = [*engine.CODECS, *batches.NAMES]
    assert set(names) == set(engine.RANK) - {"session_delta", "binary"}
    got = spark.createDataFrame([(n,) for n in ["none", *names]], "k string").select("k", engine.reversibility(F.col("k")).alias("c")).collect()
    assert {x["k"]: x["c"] for x in got}["grammar"] == "prompt_readable_reversible" and dict(got)["ci_output"] == "lossy_analytical" and dict(got)["transport_deflate"] == "local_decode_reversible"


def test_tree_detectors():
    assert batches.tests(json.dumps({"base": "a", "current": "b"}))["session_delta"] and batches.tests(json.dumps(RECORDS))["schema_rows"]
    assert not any(v for k, v in batches.tests("[1").items()) and not any(batches.tests(None).values()) and batches.tests("<a><b/><b/><b/></a>")["xml_shape_rows"]


def test_blobs_keep_the_text_around_them(spark):
    text = "x " + "A" * 200 + " y " + "B" * 170 + "=="
    out = spark.createDataFrame([(text,)], "text string").select(analytical.blobs(F.col("text"))[1].alias("x")).first()["x"]
    assert out.startswith("x <blob0:base64 chars=200 ") and " y <blob1:base64 chars=172 " in out
