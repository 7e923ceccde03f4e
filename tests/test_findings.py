"""Cases of the reviewer's findings: rows as SQL splits them, fast paths against slow ones, memory of batches."""

import json
import random
import re
import xml.etree.ElementTree as ET
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldmill.functions import rowwise
from foldmill.functions import text as tx
from foldmill.functions.detect import TEXT, TOKEN
from foldmill.operators import batches, grams
from foldmill.operators import phrases as ph
from foldmill.operators import summaries as su
from foldmill.operators import trees as tr
from foldmill.plans import catalogue, encodings, structured

ODD = ["", "a", "a\n", "\n", "a\r\nb\rc", "x y\x85z\x1c", " [1]", "　{}", "\t[1]", None, "a line that repeats\n" * 9, "seven\n" * 7, "one\x0btwo three\n\n"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at, duck = str(tmp_path_factory.mktemp("odd")), duckdb.connect()
    rows = [(i, t) for i, t in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame(rows, "conv_id long, text string").write.parquet(f"{at}/conversations.parquet")
    for t in ("documents", "pages", "conversations"):
        duck.sql(f"create view {t} as from '{at}/{t}.parquet/*.parquet'")
    return at, duck


@pytest.mark.parametrize("name", ["feature_profile", "line_dictionary", "line_histogram", "detector_matrix", "pattern_hash_encode", "pattern_hash_roundtrip"])
def test_odd_lines_as_sql_splits_them(spark, odd, name):
    at, duck = odd
    queries, sql = {**catalogue.QUERIES, **encodings.QUERIES}, {**catalogue.SQL, **encodings.SQL}
    df = queries[name](spark, at)
    cols = sorted(df.columns)
    mine = sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
    assert mine == sorted(map(str, duck.sql(f"select {', '.join(cols)} from ({sql[name]})").fetchall()))


ORDER = '<order id="1">' + "".join(f'<line n="{i}"><flag>{f}</flag></line>' for i, f in enumerate("AB<R".replace("<", "N") * 9)) + "</order>"
XMLS = [
    ORDER, "<a><b/><b/><b/></a>", "<a x='1&amp;2' y='&lt;&#10;&quot;'>t<b k='v'> u </b>w<b k='z&gt;'>&amp;</b><b k=''> </b>\n</a>", "<n:a xmlns:n='urn:x'><n:b n:k='1'>1</n:b><n:b n:k='2'>2</n:b><n:b n:k='3'/></n:a>",
    "<a><b>1</b><b x='1'>2</b><b>3</b></a>", "<a><b><c/></b><b><c>2</c></b><b><c>é </c></b></a>", "<a><b>1</b><c>2</c><b>3</b></a>", "<a>1</a>", "<a><b x='1' y='2'/><b y='2' x='1'/><b x='1' y='2'/></a>",
]


@pytest.mark.parametrize("text", XMLS)
def test_xml_rows_are_those_of_the_plain_way(text):
    root = tr._xml_tree(tr._xml(text))
    shapes = [tr.leaves(k) for k in root[4]]
    payload = tr.xml_shape_rows(text)
    if len(shapes) < 3 or len({k[0] for k in root[4]}) > 1 or any([p for p, _ in s] != [p for p, _ in shapes[0]] for s in shapes):
        assert payload is None
    else:
        head = json.loads(payload.split("\n")[1])
        for s, r in zip(shapes, payload.split("\n")[3:], strict=True):
            assert {**head["constants"], **dict(zip(head["paths"], json.loads(r), strict=True))} == {tr.path_text(p): x for p, x in s}
        assert tr.xml_shape_rows_decode(payload) == ET.tostring(tr._xml(text), encoding="unicode")
    assert tr._xml_text(tr._xml(text)) == ET.tostring(tr._xml(text), encoding="unicode")


def test_xml_paths_are_read_once_for_all_rows(monkeypatch):
    payload, read, n = tr.xml_shape_rows(ORDER), tr.path_steps, []
    monkeypatch.setattr(tr, "path_steps", lambda p: n.append(p) or read(p))
    assert tr.xml_shape_rows_decode(payload) == ORDER
    assert len(n) <= 12  # a path of a leaf each, not one for each row


def test_xml_path_back_without_the_slow_writer(monkeypatch):
    payload = tr.xml_path(ORDER)
    monkeypatch.setattr(ET, "tostring", None)
    assert tr.xml_path_decode(payload) == ORDER


def slow_grammar(found: list[str]) -> tuple[list, list]:
    seq, rules = list(found), []
    while len(rules) < ph.RULES:
        count = Counter(zip(seq, seq[1:]))
        gain = {p: (n - 1) * (ph.cost(p[0]) + ph.cost(p[1])) for p, n in count.items() if n >= 3}
        best = max(gain, key=gain.get, default=None)
        if best is None or gain[best] <= ph.cost(ph.dump(list(best))) + 2:
            break
        out, i = [], 0
        while i < len(seq):
            hit = tuple(seq[i : i + 2]) == best
            out.append(f"¤{len(rules)}¤" if hit else seq[i])
            i += 1 + hit
        seq = out
        rules.append(list(best))
    return rules, seq


@pytest.mark.parametrize("seed", range(12))
def test_grammar_is_that_of_the_slow_way(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["a", "bb", " ", "  ", "é", "日", ".", "\n", "word_1", "another"][: 3 + seed % 8]) for _ in range(900))
    found = re.findall(r"\s+|[A-Za-z0-9_./:@=-]+|[^\w\s]|\w", text)
    made = ph.grammar(text)
    if len(found) < 150:
        assert made is None
    else:
        rules, seq = slow_grammar(found)
        assert made == (ph._payload("grammar", "rules=" + ph.dump(rules), "body=" + ph.dump(seq)) if rules else None)
        assert made is None or ph.grammar_decode(made) == text


def test_grammar_counts_all_places_once(monkeypatch):
    sorts, unique, argsort = [], np.unique, np.argsort
    monkeypatch.setattr(np, "unique", lambda *a, **k: sorts.append(1) or unique(*a, **k))
    monkeypatch.setattr(np, "argsort", lambda *a, **k: sorts.append(1) or argsort(*a, **k))
    assert len(json.loads(ph.grammar("one two, three four. five! " * 90).split("\n")[1][6:])) > 3
    assert len(sorts) == 1  # before, one for each rule


def test_phrases_are_looked_for_once_for_both_encodings(monkeypatch):
    looks, repeats = [], ph._repeats
    monkeypatch.setattr(ph, "_repeats", lambda t: looks.append(t) or repeats(t))
    text = "é alpha beta gamma delta epsilon日 zeta eta theta. " * 40 + "é"
    a, b = ph.meta_tokens(text), ph.token_lz(text)
    assert a and b and ph.phrases_decode(a) == ph.phrases_decode(b) == text
    assert len(looks) == 1


def test_phrases_go_over_a_text_once(monkeypatch):
    """Steps and tokens come from one pass; before, the text was cut up twice, token by token."""
    n, tokens = [], ph.TOKENS

    class Counted:
        search = staticmethod(tokens.search)

        def finditer(self, t):
            return map(lambda m: n.append(1) or m, tokens.finditer(t))

    monkeypatch.setattr(ph, "TOKENS", Counted())
    assert ph._repeats("one two three four five six seven, " * 30)
    assert not n


def test_batches_are_worked_on_in_pieces(spark, monkeypatch):
    """Python values of a piece, not of a batch, are held at a time: each piece is given out before the next one is begun."""
    seen = []
    monkeypatch.setattr(batches, "made", lambda t, *a: seen.append(t) or {"is_json": False, "baseline": t, "made": []})
    caught = {}

    class Payloads:
        columns = ["text"]
        schema = None

        def withColumn(self, *a):
            return self

        def mapInArrow(self, run, schema):
            caught["run"] = run

    batches.with_parsed(Payloads(), "_parsed", [], ["|"], 4.0, True)
    out = caught["run"](iter([pa.record_batch({"text": ["x" * 1000] * 3000})]))
    assert next(out).num_rows == len(seen) <= 256  # before, all 3,000
    assert sum(b.num_rows for b in out) + 256 == len(seen) == 3000


def test_rows_of_any_width_in_pieces(spark):
    texts = [None, "", "a", "é" * 70_000, *("x" * 9_000_000 for _ in range(2)), *map(str, range(700))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").coalesce(1)
    got = df.select("i", rowwise.by_row(lambda t: None if t is None else t[::-1], "string", F.col("text")).alias("r")).collect()
    assert {x["i"]: x["r"] for x in got} == {i: t and t[::-1] for i, t in enumerate(texts)}
    assert max(n for _, n in rowwise.pieces(1000, 9e6)) == 1 and sum(n for _, n in rowwise.pieces(1000, 10)) == 1000


#: Near the thresholds of the detectors, and of what the old patterns and those of SQL tell apart.
SPACES = ["a" * 159, "x" + "a/+9" * 40, "é" * 33 + "b" * 160 + "=", "b" * 200, "日" * 81 + "q" * 159 + " " + "q" * 161]
EDGES = SPACES + [
    *("w " * n for n in (74, 75, 76, 249, 250, 251, 499, 500)), *(" w" * n + "\n" for n in (59, 60, 75, 498, 499, 500)), *("é.日" * n for n in (119, 120, 149, 150, 300)), "٣é_ ‿x̂\x85\x0b\u2003-" * 40, "ab_é. " * 70,
    "x\nFaIlEd", "x\ntrace", "x\nTRACEBAC\u212a", "x\npaſsed", "exit code", "a\nEXIT CODE 1", "tailed\nrrror:", "\nPyTest", "12|a", "a\n  7|", "a\r12|", "a\n@@", "a @@", "@@", "diff --git", "b\r\ndiff --git", "[read_file]",
    "<A\n", "<a", "< body", "<BODY", "line\n" * 30 + " class\t", "line\n" * 30 + "def", "line\n" * 20 + "import", "# " + "x" * 398, "# " + "x" * 397, *("p" * 41 + s for s in ("\n\n", "\n \n")), *((("q" * 41 + s) * 4) for s in ("\n\n", "\n\t\n", "\n", "\n\r\n")), "INFO\n" * 20, "xINFO\n" * 20, "kind apiVersion Pod", "kind apiVersion pod",
]


def test_detectors_are_those_of_the_plain_patterns(spark):
    """What the detectors said before, in Python: blocks, byte searches and counts that end early say the same."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGES)], "i long, text string")
    t = F.col("text")
    n = F.regexp_count(t, F.lit(TOKEN))
    parts = F.filter(F.transform(F.split(t, r"\n\s*\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x) > 40)
    plain = {
        "blob_ref": t.rlike("[A-Za-z0-9+/]{160,}={0,2}"), "ci_output": F.contains(t, F.lit("\n")) & F.lower(t).rlike("failed|traceback|error:|pytest|passed|exit code"), "token_lz": n >= 120, "grammar": n >= 150,
        "extractive": F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")) >= 500, "tool_output": t.rlike(r"(?md)^\s*\d+\||\[terminal\]|\[read_file\]|^@@|^diff --git"), "html_visible": t.rlike(r"(?i)<html|<body|<div|<table|<a\s"),
        "domain_table": (F.length(t) >= 400) & t.rlike("apiVersion:|kind:|metadata:|# |<html|<body"), "k8s_yaml": F.contains(t, F.lit("apiVersion")) & F.contains(t, F.lit("kind")) & t.rlike("metadata|Deployment|Service|Pod|ConfigMap"),
        "dedupe": F.coalesce(F.when(F.contains(t, F.lit("\n")), (F.size(parts) >= 4) & (F.size(F.array_distinct(parts)) < F.size(parts))), F.lit(False)),
    }
    got = df.select("i", *(F.struct(TEXT[k](t).alias("own"), v.alias("plain")).alias(k) for k, v in plain.items())).collect()
    assert not [(k, EDGES[r["i"]][:50], r[k]) for r in got for k in plain if r[k]["own"] != r[k]["plain"]]
    for k in plain:
        assert len({r[k]["own"] for r in got}) == 2, k


def test_detectors_take_lines_and_space_as_sql(spark, odd):
    """A carriage return begins no line, a vertical tab is no space; before, they did and were."""
    got = spark.createDataFrame([("a\r@@",), ("a\u2028diff --git",), ("w\x0b" * 600,), ("<a\x0b",)], "text string").select("text", *(TEXT[k](F.col("text")).alias(k) for k in ("tool_output", "extractive", "html_visible"))).collect()
    assert not any(any(r[1:]) for r in got)


def test_views_of_small_tables_are_made_in_many_tasks(spark):
    assert encodings._dealt(spark.range(10).coalesce(1)).rdd.getNumPartitions() >= 4  # before, one split


def test_strip_takes_space_at_both_ends_only(spark):
    texts = ["", " ", "\t\x0ba b\r\n\f", "a\u00a0", "a \u2028", "é \n x"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).select(tx.strip(F.col("text"))).collect()]
    assert got == [t.strip(" \t\n\x0b\f\r") for t in texts]


def test_paragraphs_ranked_without_sorting_words(spark, monkeypatch):
    """Counted in a table they come as they do from the columns, ties, odd letters and odd space included; the query doesn't sort words any more."""
    texts = ["", "\n\n", None, "the best of words\n\nwords words best\n \t\n\x0b words-and_more WORDS", "aaaa\n\naaaa\n\nbbbb", "\u212aelvin kelvin\n\n\u0130abcd i\u0307abcd abcd", "é日 émile mile\r\n\r\nmile\x85\n\nMILE 1abcd_", "x\n\n" * 9, "Σ ΑΣ abcΣ abcd\n\n\u00a0abcd", *EDGES]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "payload_id long, text string")
    own = lambda c: F.transform(c, lambda x: F.struct(x["less"].alias("less"), x["at"].alias("at")))
    got = df.select(own(su.best_paragraphs(F.col("text"), 3)).alias("a"), own(F.slice(su.paragraph_scores(F.col("text")), 1, 3)).alias("b")).collect()
    assert not [(r["a"], r["b"]) for r in got if r["a"] != r["b"]]
    assert any(len(r["a"] or []) == 3 for r in got)
    monkeypatch.setattr(su, "paragraph_scores", None)
    monkeypatch.setattr(encodings, "outlined", lambda *a: df.where("payload_id = 3"))
    assert [r["place"] for r in encodings.extractive_topk(spark, "").orderBy("pos").collect()] == [1, 0, 2]  # 8, 5 and 4


def _odd_texts() -> list[str]:
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(r.choices(words, k=n))
    log = "\n".join(f"2026-01-02 ERROR user={i} deadbeef{i % 7:02d} failed with code {i % 3}" for i in range(90))
    lines = "\n".join(r.choices([prose(6) for _ in range(9)], k=200))
    return [
        prose(120), prose(700), prose(4000), "\n\n".join(prose(60) for _ in range(30)), "\n".join(prose(8) for _ in range(100)), log, lines, lines.replace("\n", "\n\n"), lines.replace("\n", "---\n"),
        "ab cd " * 900, "one two three four five six seven " * 200, "x" * 3500, "\n" * 3100, ("word " * 30 + "\n\n") * 40, prose(700) + " [REDACTED_TOKEN] " + prose(10), "ab [REDACTED_X] " * 300, "é ü ∑ 𝄞 " * 500, log[:2990], "",
    ]


def test_the_choice_is_the_least_of_all_candidates(spark):  # what isn't made for the choice would have lost
    from foldmill.functions.detect import RANK
    from foldmill.operators import engine

    texts = _odd_texts()
    own = spark.createDataFrame(list(enumerate(texts)), "payload_id long, text string")
    for config in (engine.Config(), engine.Config(reversible_only=True, allow_expansion=True, chars_per_token=3.5)):
        want = {i: ("none", int(max(1, len(t) // config.chars_per_token)) if t else 0) for i, t in enumerate(texts)}
        found: dict = {}
        for c in engine.candidates(own, config).collect():
            redacted = "[REDACTED_" in c.text and "[REDACTED_" not in c.payload
            if (c.round_trip or not c.reversible) and not redacted and (config.allow_expansion or c.tokens <= want[c.payload_id][1]):
                found.setdefault(c.payload_id, []).append((c.tokens, RANK[c.kind], c.kind))
        want |= {i: (min(x)[2], min(x)[0]) for i, x in found.items()}
        assert {r.payload_id: (r.kind, r.tokens) for r in engine.best(own, config).collect()} == want


def test_hopeless_candidates_are_not_made(monkeypatch):  # F6, F7
    prose = _odd_texts()[2]
    for kind in ("meta_tokens", "token_lz"):
        monkeypatch.setitem(ph.TEXT, kind, (None, None))
    got = batches.made(prose, ["meta_tokens", "token_lz", "grammar"], ["|"], 4.0, True, ["sidecar_ref", "extractive", "chunk_store", "pattern_hash"], False)
    assert got["made"] == [] and {"meta_tokens", "token_lz", "grammar", "extractive", "chunk_store", "pattern_hash"} <= set(got["lost"])


def test_bounds_hold():  # no payload is shorter than what was counted, and a phrase that saves enough has a beginning that repeats
    for text in _odd_texts():
        for make in (ph.meta_tokens, ph.token_lz, ph.grammar):
            made = make(text)
            assert made is None or len(made) >= ph.trigrams(text)
        if (made := ph.grammar(text)) is not None:
            assert ph.grammar(text, len(made) + 1) == made
        assert ph.may_repeat(text) or not any(len(p) >= ph.PHRASE_CHARS and (n - 2) * ph.cost(p) - n > ph.PHRASE_GAIN for p, n in ph._repeats(text).items())
    for cost in range(3, 3000):
        need = next(n for n in range(3, 99) if (n - 2) * cost - n > ph.PHRASE_GAIN)
        assert any(4 * cost >= n and need >= times for n, times in ph.BEGINNINGS)


@pytest.mark.parametrize("kind", ["schema_rows", "json_table", "json_path", "shape_rows"])
def test_records_go_to_python_once(spark, kind):  # encoder and decoder had a worker each
    plan = structured.QUERIES[f"{kind}_roundtrip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_xml_paths_of_a_known_form_are_filled_in(monkeypatch):  # every payload was cut into elements and written again
    values = ["7", "x<&>\"'", " é ", "a=b", "𐎀0𐎀", "", "12"]
    texts = [f'<o i="{i}"><l n="{{}}"><f>{{}}</f></l><l n="3"/></o>'.format(*(v.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;") for v in (values[i % 7], values[(i * 3) % 7]))) for i in range(49)]
    want = [tr._xml_path_back(tr.xml_path(t).split("\n")[1:]) for t in texts]
    assert [tr.xml_path_decode(tr.xml_path(t)) for t in texts] == want
    assert tr.xml_path_decode("<foldmill:xml_path_v1>\n/a[0]/@x=1\n/a[0]/@x=2") == '<a x="2" />'
    slow, n = tr._xml_path_back, []
    monkeypatch.setattr(tr, "_xml_path_back", lambda lines: n.append(1) or slow(lines))
    for i in range(9):
        assert tr.xml_path_decode(f"<foldmill:xml_path_v1>\n/q[0]/@i={i}\n/q[0]/r[0]/text()=a{i}") == f'<q i="{i}"><r>a{i}</r></q>'
    assert len(n) == 2  # the first, and the form's making


@pytest.mark.parametrize("heaviest", [1, 7, 1024])
@pytest.mark.parametrize("name", ["ngram_topk", "bigram_gain"])
def test_top_runs_are_those_of_sql(spark, tmp_path, monkeypatch, name, heaviest):  # every run was counted by its words; with few buckets at first, the rest is looked into
    r = random.Random(heaviest)
    common = "the same five words again and_again\n" * 3
    texts = [None, "", "a b c", "OneKelvin two-3 x9 x9 x9 x9", "ab cd", "ab cd ef " * 300, common, "Über ÉCOLE ab-cd ef_gh éab cd"]
    texts += [" ".join(r.choices(["ab", "cd", "extraordinarily", "long_words_too", "e-f", "gh9"], k=r.randint(0, 9))) + r.choice(["", common, " _ab cd"]) for _ in range(600)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(grams, "HEAVIEST", heaviest)
    duck = duckdb.connect()
    duck.sql(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    df = encodings.QUERIES[name](spark, str(tmp_path))
    want = duck.sql(f"select {', '.join(df.columns)} from ({encodings.SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) >= 30


def test_top_runs_of_no_text(spark):
    none = spark.createDataFrame([(None,), ("a b",), ("",)], "text string")
    assert grams.top_runs(none, 2, 5, lambda c: c, "n", [F.desc("n"), "gram"]).collect() == []


def test_runs_are_weighed_in_a_table_of_fixed_size(spark):  # F13, F17
    text = " ".join(f"w{i}x w{i * 7}y" for i in range(300_000))
    own = spark.createDataFrame([(text,)], "text string")
    got = grams._weights(own, 2, None).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).first()
    assert got["n"] <= grams.BUCKETS < got["w"] == 599_999  # nearly as many different pairs
