"""Encodings of trees, phrases and logs read back; queries agree with their SQL."""

import json
import os

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldmill.functions.text import tally
from foldmill.operators import dictionary as di
from foldmill.operators import phrases as ph
from foldmill.operators import summaries as su
from foldmill.operators import trees as tr
from foldmill.plans.structured import QUERIES, SQL

SF = "/root/testdata/sf0.001"

ROWS = [{"id": i, "service": "api", "severity": ["low", "high"][i % 2], "name": f"node-{i * i}"} for i in range(40)]
NEST = {"cluster": "c", "services": {f"s{i}": {"metadata": {"name": f"s{i}", "odd key.[0]": None}, "spec": {"replicas": i * i, "image": ["web", {}]}} for i in range(24)}}


@pytest.mark.parametrize("kind", list(tr.JSON))
@pytest.mark.parametrize("value", [ROWS, NEST, [NEST, NEST], {"items": ROWS}, [1, [], {}], [{"a": "x|y\\", "b": "line\nbreak", "c": None}] * 3], ids=range(6))
def test_trees_read_back(kind, value):
    text = json.dumps(value)
    payload = tr.encode(kind, text)
    assert payload is None or tr.round_trip(kind, text, payload)


def test_atom_dict_gives_up_where_a_list_would_read_back_as_an_object():
    pairs = {"items": [["name-of-this", i] for i in range(60)]}
    assert tr.atom_dict({"rows": [pairs, pairs]}) is None
    for v in ({"rows": [pairs, pairs]}, [["a-long-key", 1]] * 60, {"e": [], "items": ROWS}):
        made = tr.atom_dict(v)
        assert made is None or tr.canonical(tr.atom_dict_decode(made)) == tr.canonical(v)


@pytest.mark.parametrize("kind,value", [("schema_rows", ROWS), ("json_table", ROWS), ("shape_rows", NEST), ("path_dict_rows", NEST), ("tree_dict", [NEST, NEST]), ("atom_dict", {"items": ROWS}), ("json_path", NEST)])
def test_trees_take_their_shape(kind, value):
    payload = tr.encode(kind, json.dumps(value))
    assert payload and tr.round_trip(kind, json.dumps(value), payload)


_leaf = st.none() | st.booleans() | st.integers() | st.text(max_size=8)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.text(max_size=5), _leaf, min_size=1, max_size=4), min_size=1, max_size=5))
def test_json_path_any_keys(v):
    assert tr.round_trip("json_path", json.dumps(v), tr.encode("json_path", json.dumps(v)))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6).flatmap(lambda n: st.lists(st.fixed_dictionaries({"a": _leaf, "b|~": _leaf}), min_size=n, max_size=n)))
def test_record_lists(v):
    text = json.dumps(v)
    for kind in ("json_table", "schema_rows"):
        payload = tr.encode(kind, text)
        assert payload is None or tr.round_trip(kind, text, payload)


def test_xml():
    text = "<r a='1'>" + "".join(f"<i k='{n}'><n>x{n}</n><m>same</m></i>" for n in range(5)) + "</r>"
    assert tr.round_trip("xml_shape_rows", text, tr.encode("xml_shape_rows", text))
    assert "/r[0]/i[2]/n[0]/text()=x2" in tr.encode("xml_path", text)
    assert tr.encode("xml_path", "<!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>") is None
    assert tr.encode("xml_path", "<a") is None


def test_not_json():
    assert [tr.encode(k, t) for k in tr.JSON for t in (None, "", "{", "3")] == [None] * 28


@pytest.mark.parametrize("kind", ["meta_tokens", "token_lz", "grammar", "domain_table", "transport_deflate"])
@pytest.mark.parametrize("text", ["the quick brown fox jumps over the lazy dog, né. " * 80, "# head\n" + "aa " * 700, "naïve 漢字 " * 200], ids=range(3))
def test_texts_read_back(kind, text):
    payload = ph.TEXT[kind][0](text)
    assert payload is None or ph.TEXT[kind][1](payload) == text


def test_phrases_save():
    text = "the quick brown fox jumps over the lazy dog. " * 80
    assert all(len(ph.TEXT[k][0](text)) < len(text) / 2 for k in ("meta_tokens", "token_lz", "grammar"))
    assert ph.meta_tokens(text + "§1§") is None and ph.grammar(text + "¤") is None


def test_code_tokens():
    text = "import os\n\n\n" + "".join(f"def function_{i}(value):\n    return value + {i}\n" for i in range(30))
    assert ph.code_tokens_decode(ph.code_tokens(text)) == text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "", "-x", "+y", "@@ -1 +1 @@"]), max_size=12), st.lists(st.sampled_from(["a", "b", "", "-x", "+y"]), max_size=12))
def test_session_delta(a, b):
    base, current = "\n".join(a), "\n".join(b)
    payload = ph.session_delta(base, current)
    assert ph.session_delta_decode(base, payload) == current
    assert ph.session_delta_decode(base + "?", payload) is None


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "text string").select(f(F.col("text")).alias("x")).first()["x"]


def test_logs_and_paragraphs(spark):
    text = "\n".join(f"2024-01-0{i % 9} ERROR service=auth request=req-{i} failed user={i}" for i in range(40))
    assert one(spark, one(spark, text, su.log_templates), su.log_templates_decode) == text
    assert one(spark, text + "\n{v0} 1", su.log_templates) is None and one(spark, "a\nb\nc", su.log_templates) is None
    out = one(spark, text + "\nno level ERRORS here\nWARNINGS", su.log_summary).split("\n")
    assert 'levels={"ERROR":40}' in out[1] and out[2:5] == ["@top_templates", "40x {v0} ERROR {v1} {v2} failed {v3}", "1x no level ERRORS here"]
    # Examples go by the letters, not by words, and there are 30 at most.
    assert out[out.index("@examples") + 1 :] == text.split("\n")[:30] and one(spark, "WARNINGS\n" * 3, su.log_summary).count("WARNINGS") == 4
    part = ["p" * 50, "q" * 50, "p" * 50, "r" * 50]
    assert one(spark, one(spark, "\n\n".join(part), di.dedupe), di.dedupe_decode) == "\n\n".join(part)


def test_resource_summaries(spark):
    plan = json.dumps({"resource_changes": [{"address": "a.b", "type": "t", "change": {"actions": ["delete", "create"]}}, {"address": "c"}, {"address": "d", "change": {}}, {"address": "e", "change": {"actions": ["delete", "create"]}}]})
    assert one(spark, plan, su.terraform_plan).split("\n")[1:] == ['counts={"delete+create":2,"?":1,"":1}', "@changes", "delete+create a.b type=t", "? c type=", " d type=", "delete+create e type="]
    assert one(spark, "Plan: 1\n  + x\ny", su.terraform_plan).split("\n")[2:] == ["@changes", "Plan: 1", "  + x"]
    docs = "apiVersion: v1\nkind: Pod\nmetadata:\n  name: n\n  namespace: s\n  image: a:1\n---\nx: 1\n---\n{\"kind\": \"Job\", \"image\": \"b\"}"
    assert one(spark, docs, su.k8s_yaml).split("\n")[3:] == ["Pod s/n images=a:1", "Job default/? images=b"]
    api = json.dumps({"swagger": "2", "info": {"title": "T"}, "paths": {"/a": {"get": {"operationId": "x", "tags": ["p", "q"], "responses": {"200": {}, "404": {}}}, "x-foo": 1}, "/b": {"POST": {}}}, "components": {"schemas": {"Z": {}, "A": {}}}})
    assert one(spark, api, su.openapi).split("\n")[1:] == ["title=T", "@operations", "GET /a id=x tags=p,q res=200,404", "POST /b id= tags= res=", "@schemas", "A,Z"]
    assert one(spark, '{"paths": 1}', su.openapi) is None and one(spark, "text", su.openapi) is None
    text = "\n\n".join(["the alpha beta gamma", "beta beta other", "none of this", "alpha alpha alpha beta"])
    assert one(spark, text, su.extractive).split("\n")[3:] == ["alpha alpha alpha beta", "the alpha beta gamma", "beta beta other"]
    assert one(spark, "", su.extractive).split("\n")[1].startswith("paragraphs=0 words=0 ")


def test_tally_counts_in_order_of_first_appearance(spark):
    items = ["b", "a", "b", "c", "a", "b", ""]
    out = spark.createDataFrame([(items,), ([],)], "x array<string>").select(tally(F.col("x")).alias("t")).collect()
    assert [(g["item"], g["n"], list(g["at"])) for g in out[0]["t"]] == [("b", 3, [0, 2, 5]), ("a", 2, [1, 4]), ("c", 1, [3]), ("", 1, [6])] and out[1]["t"] == []


def test_xml_paths_read_back():
    text = '<a x="1=2"><b>one</b><b y="3"><c>two</c></b></a>'
    assert tr.decode("xml_path", tr.encode("xml_path", text)) == text and tr.round_trip("xml_path", "<a><b/></a>", tr.encode("xml_path", "<a><b/></a>")) is False


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t.removesuffix('.parquet')} as from '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
    assert mine == sorted(map(str, duck.sql(f"select {', '.join(cols)} from ({SQL[name]})").fetchall()))


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_runs_and_reads_back(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows
    assert all(r.round_trip for r in rows if "round_trip" in r)
