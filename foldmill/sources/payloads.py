"""Payload tables: files of several kinds, and views derived from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text (null where the bytes aren't UTF-8), raw, kind (json where a .json file holds JSON, else text, or binary), is_json (an object or list that parses, in any text) of every file below ``path``, by path."""
    df = spark.read.format("binaryFile").load(path)
    ok = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(ok, F.decode(F.col("content"), "UTF-8"))
    parses = F.coalesce(is_json(text), F.lit(False))
    kind = F.when(~ok, "binary").when(F.col("path").endswith(".json") & parses, "json").otherwise("text")
    return df.select("path", text.alias("text"), F.col("content").alias("raw"), kind.alias("kind"), parses.alias("is_json")).orderBy("path")


def is_json(text: Column) -> Column:
    """Whether a text is a JSON object or list."""
    return is_json_like(text) & F.try_parse_json(text).isNotNull()


def is_json_like(text: Column) -> Column:
    return F.trim(text).rlike(r"^[\[{]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("payload_id"), "text")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log text a day from events: payload_id (yyyymmdd), text; lines in order of event_id."""
    level = F.expr("CASE event_id % 7 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARN' ELSE 'INFO' END")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" "), level, F.lit(" service="), F.col("event_type"), F.lit(" user="), F.col("user_id").cast("string"), F.lit(" ok"))
    own = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyyMMdd").cast("long").alias("payload_id"), F.struct("event_id", line.alias("line")).alias("x"))
    return own.groupBy("payload_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))


LOGS_SQL = """v_logs AS (SELECT CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS payload_id,
  string_agg(strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' ' || CASE event_id % 7 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARN' ELSE 'INFO' END || ' service=' || event_type || ' user=' || user_id || ' ok', chr(10) ORDER BY event_id) AS text
  FROM events GROUP BY 1)"""


def ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test log for each customer from orders: payload_id (custkey), text."""
    line = F.concat(F.expr("CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'PASSED' ELSE 'WARNING' END"), F.lit(" tests/test_"), F.col("o_orderkey").cast("string"))
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("payload_id"), F.struct("o_orderkey", line.alias("line")).alias("x"))
    return own.groupBy("payload_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))


CI_SQL = """v_ci AS (SELECT o_custkey AS payload_id,
  string_agg(CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'PASSED' ELSE 'WARNING' END || ' tests/test_' || o_orderkey, chr(10) ORDER BY o_orderkey) AS text
  FROM orders GROUP BY 1)"""
