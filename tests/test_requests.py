"""Request bodies, reports and streams against SQL and hand-made cases."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from foldmill.operators import requests as rq
from foldmill.plans.requests import QUERIES, SQL
from foldmill.operators.phrases import session_delta_decode
from foldmill.streaming import requests as st

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents", "events"):
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
    assert mine == sorted(map(str, con.sql(f"select {', '.join(cols)} from ({SQL[name]})").fetchall()))


BODIES = [
    {"system": "s", "messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "tool_result", "content": "b"}, {"type": "tool_result", "content": [{"type": "text", "text": "c"}]}]}, {"role": "assistant", "content": "no"}]},
    {"input": "d"},
    {"input": ["e", {"role": "developer", "content": [{"type": "input_text", "text": "f"}]}, {"content": "g"}, {"role": "system", "content": "no"}]},
    {"messages": [{"role": "tool", "content": "<foldmill:x"}, {"role": ["odd"], "content": "no"}, None, 3]},
    {"other": 1},
]


def test_shapes(spark):
    raw = [(i, json.dumps(b)) for i, b in enumerate(BODIES)] + [(8, None), (9, "not json")]
    df = spark.createDataFrame(raw, "request_id int, body string")
    found = {(r.request_id, r.path): (r.source, r.text) for r in rq.body_targets(df, 0).collect()}
    assert found == {
        (0, "messages[0].content[0].text"): ("user_text", "a"), (0, "messages[0].content[1].content"): ("tool_result", "b"), (0, "messages[0].content[2].content[0].text"): ("tool_result", "c"),
        (1, "input"): ("user_text", "d"), (2, "input[0]"): ("user_text", "e"), (2, "input[1].content[0].text"): ("developer_text", "f"), (2, "input[2].content"): ("user_text", "g"),
    }
    changed = rq.write_back(df, rq.body_targets(df, 0).withColumn("text", F.upper("text")))
    again = {(r.request_id, r.path): r.text for r in rq.body_targets(changed, 0).collect()}
    assert again == {k: t.upper() for k, (_, t) in found.items()}
    assert dict(changed.where("request_id > 7").collect()) == {8: None, 9: "not json"}
    kinds = [r[0] for r in df.orderBy("request_id").select(rq.body_format("body")).collect()]
    assert kinds == ["anthropic", "openai", "openai", "openai", "unknown", "unknown", "unknown"]


@pytest.mark.parametrize("first", [False, True])
def test_instruction(spark, first):
    df = spark.createDataFrame([(json.dumps(b),) for b in [{"system": [], "messages": []}, {"system": "s", "messages": []}, {"input": "x"}, {"z": 1}]] + [(None,)], "body string")
    out = [r[0] and json.loads(r[0]) for r in df.select(rq.with_instruction(F.col("body"), 'Say "ok"', first)).collect()]
    text = 'Say "ok"'
    assert out[0]["system"] == [{"type": "text", "text": text}] and out[1]["system"] == (f"{text}\n\ns" if first else f"s\n\n{text}")
    assert out[2]["instructions"] == text and out[3] == {"z": 1} and out[4] is None


def test_embedded_json(spark):
    texts = ["a {b [1, 2] c", "none", "", None, "{" * 3000]
    rows = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(rq.embedded_json("t")).collect()]
    assert tuple(rows[0]) == ("[1, 2]", 5, 11, "a {b  c") and all(r["json"] is None and r["start"] is None for r in rows[1:])


def test_stream_writes_each_original_once(spark, tmp_path):
    text = "line of the log\n" * 60
    rows = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text), (2, 0, "tool", text + "x"), (3, 0, "user", "short"), (4, 0, "user", "api_key=" + "abcdefghijklmnopqrstuvwxyz " + text)], "conv_id long, turn long, role string, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        st.rewrite_stream(stream, out, str(tmp_path / "cp"), once=True).awaitTermination()
        st.counter_stream(spark, out, str(tmp_path / "cp2"), once=True).awaitTermination()
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = spark.read.schema(st.STORE).parquet(f"{out}/store")
    assert store.count() == 2 and {x["prefix"] for x in store.collect()} == {x["digest"][:2] for x in store.collect()}
    written = spark.read.schema(st.REWRITES).parquet(f"{out}/rewrites").collect()
    assert len(written) == 6 and sum(x["blocked"] for x in written) == 2 and not any("abcdefghijkl" in str(x) for x in [*written, *store.collect()])
    assert st.counters(spark, out).where("kind is null and class is null and reason is null").agg(F.max("n")).first()[0] == 6
    assert spark.read.parquet(f"{out}/counters").agg(F.sum("n")).first()[0] == 6
    found = st.lookup(spark, f"{out}/store", spark.createDataFrame([(written[0]["digest"] or "x",), ("missing",)], "digest string")).collect()
    assert {x["text"] is None for x in found if x["digest"] == "missing"} == {True}


def test_stream_of_differences(spark, tmp_path):
    schema = "conv_id long, turn long, text string"
    spark.createDataFrame([(1, 1, "a\nc"), (1, 0, "a\nb"), (2, 0, None)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    for k in range(2):
        stream = st.delta_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        stream.writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        spark.createDataFrame([(1, 2, "a\nd")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    by = {(x["conv_id"], x["turn"]): x["payload"] for x in got}
    assert by[1, 0] is None and by[2, 0] is None and session_delta_decode("a\nb", by[1, 1]) == "a\nc" and session_delta_decode("a\nc", by[1, 2]) == "a\nd"
