"""Prompts, bundles, plugins, the corpus and its reports, files."""

import json

import pytest
from pyspark.sql import functions as F

from foldmill.operators import measure, packaging
from foldmill.operators.engine import RANK, Config
from foldmill.sources import corpus, payloads

RECORDS = json.dumps([{"id": i, "event": "log|in", "severity": "high"} for i in range(40)])
SECRET = "api_key=" + "abcdefghijklmnopqrstuvwxyz"


def test_every_kind_has_a_prompt(spark):
    rows = {(x["kind"], x["verbosity"]): x["system_prompt"] for x in packaging.prompts(spark).collect()}
    assert len(rows) == 3 * (len(RANK) + 1)
    for kind in RANK:
        if kind != "binary":
            assert f"<foldmill:{kind}_v1>" in rows[kind, "minimal"] and "\n" not in rows[kind, "minimal"].split(":")[0]
        assert len(rows[kind, "minimal"]) < len(rows[kind, "standard"]) < len(rows[kind, "debug"])
    with pytest.raises(ValueError):
        packaging.prompt("grammar", "loud")
    own = spark.createDataFrame([("json_table", '<foldmill:json_table_v1> delimiter="~" x'), ("none", "t")], "kind string, payload string")
    got = {x["kind"]: x["system_prompt"] for x in packaging.with_prompt(own).collect()}
    assert "between '~'" in got["json_table"] and got["none"] == ""


def test_bundles(spark):
    df = spark.createDataFrame([(h, t) for h in [*packaging.HARNESSES, "Anthropic", "other"] for t in ("", None, "sum up")], "h string, task string")
    out = {(x["h"], x["task"]): x["b"] for x in df.select("h", "task", packaging.bundle(F.col("h"), F.lit("rules"), F.lit("data"), F.col("task")).alias("b")).collect()}
    assert out["other", ""]["content"] is None and out["Anthropic", "sum up"] == out["claude", "sum up"] and out["claude", ""] == out["claude", None]
    for h in packaging.HARNESSES:
        assert "rules" in out[h, "sum up"]["content"] and "data" in out[h, ""]["content"] and "sum up" in out[h, "sum up"]["content"] and "TASK" not in out[h, ""]["content"].upper()
    assert json.loads(out["claude", "sum up"]["data"]) == {"system": "rules", "messages": [{"role": "user", "content": "data\n\nUser task:\nsum up"}]}
    assert json.loads(out["gemini", ""]["data"])["system_instruction"] == {"parts": [{"text": "rules"}]}
    packaging.register_harness("mine", lambda prompt, payload, task: (payload, F.struct(payload.alias("p"))))
    assert spark.range(1).select(packaging.bundle(F.lit("MINE"), F.lit("r"), F.lit("d"), F.lit("")).alias("b")).first()["b"]["data"] == '{"p":"d"}'


def test_prepare(spark):
    rows = [("short", "user_input", ""), (RECORDS, "user_input", "count"), (f"{SECRET} {RECORDS}", "user_input", ""), (None, "user_input", None), ("z" * 40, "tool_output", "")]
    df = spark.createDataFrame(rows, "text string, source string, task string")
    out = packaging.prepare(df, "claude", threshold=30).collect()
    p = [x["prepared"] for x in out]
    assert [x["reason"] for x in p] == ["below_threshold", None, "secret", "below_threshold", "no_codec"] and [x["changed"] for x in p] == [False, True, False, False, False]
    assert p[1]["strategy"] in ("schema_rows", "shape_rows") and "USER TASK:\ncount" in p[1]["content"] and p[2]["content"] is None and p[0]["content"] == "short"
    red = packaging.prepare(df, "claude", threshold=30, redact_secrets=True).collect()[2]["prepared"]
    assert red["redacted"] and "abcdefghijkl" not in red["content"]


def test_prepare_requests(spark):
    body = json.dumps({"messages": [{"role": "user", "content": RECORDS}, {"role": "assistant", "content": RECORDS}, {"role": "tool", "content": [{"type": "text", "text": RECORDS}]}], "k": 1})
    bad = json.dumps({"messages": [{"role": "user", "content": f"{SECRET} {RECORDS}"}]})
    out = {x["request_id"]: x for x in packaging.prepare_requests(spark.createDataFrame([(1, body), (2, bad), (3, "{}")], "request_id long, body string"), "openai").collect()}
    made = json.loads(out[1]["body"])
    assert made["messages"][0]["content"].startswith("DEVELOPER:") and made["messages"][1]["content"] == RECORDS and isinstance(made["messages"][2]["content"], list) and len(out[1]["rewrites"]) == 1
    assert (out[2]["body"], out[2]["blocked"], out[3]["body"]) == (None, True, "{}")
    turns = spark.createDataFrame([("user", RECORDS), ("assistant", RECORDS), ("tool", RECORDS)], "role string, text string")
    assert [(x["role"], x["prepared"]["changed"]) for x in packaging.prepare_turns(turns).collect()] == [("user", True), ("tool", True)]


def test_corpus_and_reports(spark, tmp_path):
    made = corpus.generated(spark, 26)
    assert [x["kind"] for x in made.collect()] == corpus.BUCKETS * 2 and made.where("text is null").count() == 0
    json.loads(made.where("kind = 'openapi'").first()["text"])
    rows = measure.facts(made, Config(reversible_only=True, transport=True))
    total = measure.summary(rows).where("kind is null and strategy is null").first()
    assert total["n"] == 26 and total["failed"] == total["grew"] == 0 and total["median_pct_tokens"] > 85
    report = measure.summary(rows).where("kind is not null").select("kind", "n")
    for form in ("markdown", "csv", "json"):
        measure.write_report(report, str(tmp_path / form), form, ["kind"])
    text = spark.read.text(str(tmp_path / "markdown"), wholetext=True).first()[0]
    assert text.split("\n")[:3] == ["| kind | n |", "|-|-|", "| blob | 2 |"] and spark.read.csv(str(tmp_path / "csv"), header=True).count() == 12
    with pytest.raises(ValueError):
        measure.write_report(report, str(tmp_path / "x"), "xml", ["kind"])
    for _ in range(2):
        measure.proof_log(report, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).where("logged_at is not null").count() == 24


def test_older_figures(spark):
    df = spark.createDataFrame([(RECORDS,), ("[]",), ("text",), (None,)], "text string")
    out = [x["s"] for x in df.select(measure.table_savings(F.col("text")).alias("s")).collect()]
    assert out[0]["standard_tokens"] == len(RECORDS) // 4 and out[0]["optimized_tokens"] < out[0]["standard_tokens"] and out[1:] == [None] * 3


def test_files(spark, tmp_path):
    (tmp_path / "b-1.json").write_text('{"a": 1}')
    (tmp_path / "a-1.txt").write_text("é\nx")
    (tmp_path / "c.bin").write_bytes(b"\xff\xfe")
    (tmp_path / "d.json").write_text("{broken")
    rows = payloads.from_files(spark, str(tmp_path)).collect()
    assert [(x["path"].rsplit("/", 1)[1], x["kind"], x["is_json"]) for x in rows] == [("a-1.txt", "text", False), ("b-1.json", "json", True), ("c.bin", "binary", False), ("d.json", "text", False)]
    assert rows[0]["text"] == "é\nx" and rows[2]["text"] is None and bytes(rows[2]["raw"]) == b"\xff\xfe"
    assert [(x["kind"], x["text"]) for x in corpus.from_folder(spark, str(tmp_path)).collect()] == [("a", "é\nx"), ("b", '{"a": 1}'), ("d", "{broken")]
