"""A corpus to measure with, made by expressions over spark.range: thirteen buckets of payloads; and files of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kind of each bucket, by case number modulo 13; how many parts each payload has.
BUCKETS = ["json_table", "json_table", "nested_json", "xml", "logs", "ci", "openapi", "terraform", "k8s", "html", "markdown", "code", "blob"]
SERVICES, TESTCASES, PASSED, WARNINGS, PATHS, CHANGES, DEPLOYMENTS, CARDS, SECTIONS, FUNCTIONS, BLOB_BYTES = 6, 12, 120, 40, 24, 80, 40, 80, 24, 120, 4096


def _upto(n) -> Column:
    return F.sequence(F.lit(0), (F.lit(n) if isinstance(n, int) else n) - 1)


def _s(*parts) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def _pick(values: list[str], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(i, F.lit(len(values))).cast("int"))


def _two(i: Column) -> Column:
    return F.lpad(i.cast("string"), 2, "0")


def _each(n, f, sep: str = "\n") -> Column:
    return F.array_join(F.transform(_upto(n), f), sep)


def _stamp(i: Column, step: int) -> Column:
    return _s("2026-01-15T", _two(i % 24), ":", _two(i * step % 60), ":00Z")


def _entries(n: int, key, value) -> Column:
    return F.map_from_entries(F.transform(_upto(n), lambda i: F.struct(key(i), value(i))))


def _text(c: Column) -> dict[str, Column]:
    record = lambda i: F.struct(
        _s("evt-", F.lpad(c.cast("string"), 4, "0"), "-", F.lpad(i.cast("string"), 4, "0")).alias("id"), _stamp(i, 7).alias("timestamp"), _pick(["auth", "db", "gateway", "billing", "search"], c + i * 2).alias("service"),
        _pick(["login_timed_out", "query_was_slow", "call_succeeded"], c * 3 + i).alias("event"), _pick(["CRITICAL", "WARNING", "INFO"], c + i).alias("severity"), (F.lit(50) + (c * 17 + i * 31) % 950).alias("latency_ms"), _pick(["us-east-1", "us-west-2", "eu-central-1"], c + i).alias("region"),
    )
    service = lambda k: F.struct(
        (F.lit(1) + (c + k) % 5).alias("replicas"), F.transform(_upto(3), lambda j: _s("registry.example.com/svc-", k, ":v", c, ".", j)).alias("images"),
        F.struct((k + 1).cast("string").alias("cpu"), _s(k * 128 + 512, "Mi").alias("memory")).alias("limits"), _entries(6, lambda j: _s("VAR_", j), lambda j: _s("value-", c, "-", k, "-", j)).alias("env"),
    )
    failure = lambda i: F.when((c + i) % 5 == 0, _s('><failure message="assertion failed">expected ', i, ", got ", c, "</failure></testcase>")).otherwise(" />")
    operation = lambda name, i, code, said: F.struct(_s(name, "Resource", i).alias("operationId"), F.array(F.lit("resources")).alias("tags"), F.create_map(F.lit(code), F.struct(F.lit(said).alias("description"))).alias("responses"))
    paths = _entries(PATHS, lambda i: _s("/v1/resource-", i, "/{id}"), lambda i: F.struct(operation("get", i, "200", "ok").alias("get"), operation("create", i, "201", "created").alias("post")))
    a_string = F.struct(F.lit("string").alias("type"))
    schemas = _entries(PATHS, lambda i: _s("Resource", i), lambda i: F.struct(F.lit("object").alias("type"), F.struct(a_string.alias("id"), a_string.alias("name")).alias("properties")))
    actions = lambda i: F.when(i % 3 == 0, F.array(F.lit("create"))).when(i % 3 == 1, F.array(F.lit("update"))).otherwise(F.array(F.lit("delete"), F.lit("create")))
    change = lambda i: F.struct(_s("aws_instance.worker[", i, "]").alias("address"), F.lit("aws_instance").alias("type"), F.struct(actions(i).alias("actions")).alias("change"))
    deployment = lambda i: _s("apiVersion: apps/v1\nkind: Deployment\nmetadata:\n  name: app-", c, "-", i, "\n  namespace: bench\nspec:\n  replicas: ", F.lit(1) + i % 5, "\n  template:\n    spec:\n      containers:\n      - name: main\n        image: registry.example.com/app:", i, "\n")
    card = lambda i: _s("<div class='card'><h2>Item ", i, "</h2><a href='/items/", i, "'>Open ", i, "</a><p>", "filler " * 40, "</p></div>")
    line = lambda i: _s(_stamp(i, 13), " ", _pick(["ERROR", "WARN", "INFO"], c + i), " service=svc-", i % 7, " request=req-", c, "-", i % 11, " message=upstream shard ", i % 5, " timed out, will retry")
    return {
        "json_table": F.to_json(F.transform(_upto((F.lit(36) + c % 30).cast("int")), record)),
        "nested_json": F.to_json(F.struct(_s("cluster-", c).alias("cluster"), F.lit("benchmark").alias("namespace"), _entries(SERVICES, lambda k: _s("svc-", k), service).alias("services"))),
        "xml": _s('<testsuite name="suite-', c, f'" tests="{TESTCASES}">', _each(TESTCASES, lambda i: F.concat(_s('<testcase classname="Class', c, '" name="test_', i, '" time="', ((i + 1) / 10).cast("string"), '"'), failure(i)), ""), "</testsuite>"),
        "logs": _each((F.lit(80) + c % 40).cast("int"), line),
        "ci": _s("pytest run ", c, "\n", _each(PASSED, lambda i: _s("PASSED tests/test_", c, "_", i, ".py::test_ok")), "\n", _each(WARNINGS, lambda _: F.lit("WARNING deprecated fixture")), "\nFAILED tests/test_auth.py::test_token_", c, '\nTraceback (most recent call last):\n  File "tests/test_auth.py", line 42, in test_token\nAssertionError: wanted 200, got 401\nexit code 1'),
        "openapi": F.to_json(F.struct(F.lit("3.1.0").alias("openapi"), F.struct(_s("API ", c).alias("title")).alias("info"), paths.alias("paths"), F.struct(schemas.alias("schemas")).alias("components"))),
        "terraform": F.to_json(F.struct(F.transform(_upto(CHANGES), change).alias("resource_changes"))),
        "k8s": _each(DEPLOYMENTS, deployment, "---\n"),
        "html": _s("<html><head><title>Bench ", c, "</title><script>", "x=1;" * 100, "</script></head><body><h1>Bench</h1>", _each(CARDS, card, ""), "</body></html>"),
        "markdown": _each(SECTIONS, lambda i: _s("## Section ", i, "\n", "This part says how the benchmark behaves. " * 80), "\n\n"),
        "code": _s("import json\nimport os\n\n", _each(FUNCTIONS, lambda i: _s("def func_", c, "_", i, "(value):\n    total = value + ", i, "\n    return total\n"), "\n\n")),
        "blob": F.to_json(F.struct(c.alias("id"), F.replace(F.base64(F.lit("x" * BLOB_BYTES).cast("binary")), F.lit("\r\n"), F.lit("")).alias("payload"), F.lit("application/octet-stream").alias("media_type"))),
    }


def generated(spark: SparkSession, n: int = 520) -> DataFrame:
    """payload_id, kind, text of ``n`` payloads, the thirteen buckets in turn."""
    cases = spark.range(n).select(F.col("id").alias("payload_id"), F.get(F.array(*map(F.lit, BUCKETS)), (F.col("id") % len(BUCKETS)).cast("int")).alias("kind"))
    text = F.lit(None).cast("string")
    for kind, made in _text(F.col("payload_id")).items():
        text = F.when(F.col("kind") == kind, made).otherwise(text)
    made = cases.withColumn("text", text)
    # A Python function over a text can't have all of this inside its argument: the texts are made here.
    return made.mapInArrow(lambda batches: batches, made.schema)


def from_folder(spark: SparkSession, path: str) -> DataFrame:
    """path, kind (the file name up to its first - or .), text of the .json, .txt and .xml files of a corpus, by path."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.{json,txt,xml}").select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return files.select("path", F.regexp_extract(name, r"^([^.-]+)", 1).alias("kind"), "text").orderBy("path")
