"""Queries over request bodies and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmill.operators import reports
from foldmill.operators import requests as rq
from foldmill.sources import payloads as src

QUERIES: dict = {}
SQL: dict[str, str] = {}
INSTRUCTION = "Payloads that begin with <foldmill: are encoded."


def bodies(spark: SparkSession, sf: str) -> DataFrame:
    """A chat request for each conversation: request_id, body."""
    turn = F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("m"))
    own = src.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("request_id")).agg(F.array_sort(F.collect_list(turn)).alias("x"))
    return own.select("request_id", F.to_json(F.struct(F.transform("x", lambda t: t["m"]).alias("messages"))).alias("body"))


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_PLACED = "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)"
_IS_TARGET = "role IN ('user', 'tool', 'developer') AND length(text) >= 100 AND NOT contains(text, '<foldmill:')"


@_query(f"SELECT conv_id AS request_id, 'messages[' || i || '].content' AS path, CASE role WHEN 'user' THEN 'user_text' WHEN 'tool' THEN 'tool_result' ELSE 'developer_text' END AS source, sha256(text) AS sha FROM {_PLACED} WHERE {_IS_TARGET}")
def request_body_targets(spark: SparkSession, sf: str) -> DataFrame:
    return rq.body_targets(bodies(spark, sf), 100).select("request_id", "path", "source", F.sha2("text", 256).alias("sha"))


@_query(f"SELECT conv_id AS request_id, i, role, CASE WHEN {_IS_TARGET} THEN sha256(text) ELSE text END AS content FROM {_PLACED}")
def request_write_back(spark: SparkSession, sf: str) -> DataFrame:
    """Targets replaced by their digests inside the bodies, which are then read again."""
    own = bodies(spark, sf)
    made = rq.write_back(own, rq.body_targets(own, 100).withColumn("text", F.sha2("text", 256)))
    turns = F.from_json("body", "messages array<struct<role:string,content:string>>")
    out = made.select("request_id", F.posexplode(turns["messages"]).alias("i", "m"))
    return out.select("request_id", F.col("i").cast("long").alias("i"), "m.*")


@_query(f"""SELECT conv_id AS request_id, CASE WHEN count(*) FILTER (role = 'system') = 0 THEN '{INSTRUCTION}'
  ELSE arg_min(text, turn) FILTER (role = 'system') || chr(10) || chr(10) || '{INSTRUCTION}' END AS system FROM conversations GROUP BY 1""")
def request_instruction(spark: SparkSession, sf: str) -> DataFrame:
    """The system turn of each body after the instruction was added twice (the second time changes nothing)."""
    own = bodies(spark, sf).withColumn("body", rq.with_instruction(rq.with_instruction(F.col("body"), INSTRUCTION), INSTRUCTION))
    turns = F.from_json("body", "messages array<struct<role:string,content:string>>")["messages"]
    return own.select("request_id", F.get(F.filter(turns, lambda m: m["role"] == "system"), F.lit(0))["content"].alias("system"))


@_query("SELECT event_id, props AS json, CAST(4 AS BIGINT) AS start, 'got ok' AS rest FROM events WHERE props IS NOT NULL")
def embedded_json_scan(spark: SparkSession, sf: str) -> DataFrame:
    own = src.table(spark, sf, "events").where("props is not null").select("event_id", rq.embedded_json(F.concat(F.lit("got "), F.col("props"), F.lit("ok"))).alias("x"))
    return own.select("event_id", "x.json", "x.start", "x.rest")


_GROUPS = "count(v) AS n, count(*) FILTER (v < 0) AS n_negative, round(avg(CASE WHEN v >= 0 THEN 1.0 WHEN v < 0 THEN 0.0 END), 4) AS rate_ok, " + ", ".join(f"round(quantile_cont(v, {p}), 4) AS p{int(p * 100)}" for p in (0.25, 0.5, 0.75, 0.95))


@_query(f"SELECT lang, source, {_GROUPS} FROM (SELECT lang, source, length(text) - 400 AS v FROM documents) GROUP BY GROUPING SETS ((lang), (source), ())")
def length_report(spark: SparkSession, sf: str) -> DataFrame:
    """Characters over 400 of documents, by language, by source and in all."""
    own = src.table(spark, sf, "documents").select("lang", "source", (F.length("text") - 400).alias("v"))
    return reports.spread(own, [["lang"], ["source"], []], "v")
