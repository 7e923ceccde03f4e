"""Benchmarks of encodings: a fact for each payload, grouped figures, tables for people, and lines of JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmill.functions.security import has_secret, redact
from foldmill.functions.text import est_tokens, pct_saved
from foldmill.operators import batches, trees
from foldmill.operators.engine import CODECS, Config, chosen, decoded, reversibility


def facts(payloads: DataFrame, config: Config = Config(reversible_only=True)) -> DataFrame:
    """payload_id, kind, strategy, class, raw and encoded chars and tokens, pct_chars, pct_tokens, round_trip (null where restoring needs the store, or the form is lossy) of payloads (payload_id, kind, text)."""
    out = chosen(payloads.select("payload_id", "kind", "text"), config)
    base, sent, strategy = F.col("best.baseline"), F.col("best.payload"), F.col("best.kind")
    restores = [k for k in [*CODECS, *batches.NAMES] if k in batches.NAMES or CODECS[k].decode]
    back = F.when(strategy == "none", True).when(strategy.isin(restores), F.coalesce(decoded(sent) == base, F.lit(False)))
    raw, made = F.length(base).cast("long"), F.length(sent).cast("long")
    return out.select(
        "payload_id", "kind", strategy.alias("strategy"), reversibility(strategy).alias("class"), raw.alias("raw_chars"), made.alias("chars"), F.col("best.raw_tokens").alias("raw_tokens"), F.col("best.tokens").alias("tokens"),
        pct_saved(raw, made).alias("pct_chars"), pct_saved(F.col("best.raw_tokens"), F.col("best.tokens")).alias("pct_tokens"), back.alias("round_trip"),
    )


def summary(rows: DataFrame, places: int = 4) -> DataFrame:
    """Figures of facts by kind, by strategy and in all: n, medians of the savings, payloads that grew, round trips that failed."""
    median = lambda c: F.round(F.percentile(c, F.lit(0.5)), places)
    return rows.groupingSets([["kind"], ["strategy"], []], "kind", "strategy").agg(
        F.count(F.lit(1)).alias("n"), median("pct_chars").alias("median_pct_chars"), median("pct_tokens").alias("median_pct_tokens"),
        F.count_if(F.col("tokens") > F.col("raw_tokens")).alias("grew"), F.count_if(~F.col("round_trip")).alias("failed"),
    )


def markdown(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row, text: a report (few rows, as of summary()) as a Markdown table, ordered by ``order``."""
    cells = F.concat(F.lit("| "), F.array_join(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)), " | "), F.lit(" |"))
    head = "| " + " | ".join(rows.columns) + " |\n|" + "-|" * len(rows.columns)
    own = rows.select(F.struct(*order, cells.alias("x")).alias("r")).groupBy().agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return own.select(F.concat_ws("\n", F.lit(head), F.array_join(F.transform("rs", lambda r: r["x"]), "\n")).alias("text"))


def write_report(rows: DataFrame, path: str, form: str, order: list[str]) -> None:
    """A report as markdown, csv or json lines under ``path``."""
    if form == "markdown":
        markdown(rows, order).coalesce(1).write.mode("overwrite").text(path)
    elif form in ("csv", "json"):
        out = rows.orderBy(*order).coalesce(1).write.mode("overwrite")
        out.option("header", True).csv(path) if form == "csv" else out.json(path)
    else:
        raise ValueError("form must be markdown, csv or json")


def append_lines(rows: DataFrame, path: str) -> None:
    """Adds rows as lines of JSON: results, and logs of events (put a time in a column)."""
    rows.write.mode("append").json(path)


def proof_log(events: DataFrame, path: str) -> None:
    """Adds events (any columns) with the time of writing to a log of JSON lines."""
    append_lines(events.withColumn("logged_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")), path)


#: Kinds of secrets that a check plants: text that holds one.
PLANTED = {
    "aws_access_key": "key AKIA" + "ABCDEFGH12345678", "private_key": "-----BEGIN RSA " + "PRIVATE KEY-----", "bearer_token": "Authorization: Bearer " + "abcdefghijklmnop1234",
    "api_key": "api_key=" + "abcdefghijklmnopqrstuvwxyz", "database_url": "postgres://user:pass@host/db", "secret": "secret: " + "abcdefghijklmnopqrst",
}


def security_check(spark: SparkSession) -> DataFrame:
    """kind, found, marked, leaks of planted secrets: found before redaction, marked and gone after it."""
    rows = spark.createDataFrame(list(PLANTED.items()), "kind string, text string").withColumn("red", redact(F.col("text")))
    return rows.select("kind", has_secret(F.col("text")).alias("found"), F.contains("red", F.lit("[REDACTED_")).alias("marked"), has_secret(F.col("red")).alias("leaks"))


def table_savings(records: Column, per_token: float = 4.0, per_million: float = 3.0) -> Column:
    """The older figures for a list of records in JSON: tokens of the JSON with blanks after commas and colons and of its table, what is saved, and the table; nulls where it isn't such a list."""

    @F.pandas_udf("struct<standard:string,optimized:string>")
    def run(texts):
        import pandas as pd

        def one(t):
            is_json, v = batches.read_json(t)
            table = trees.json_table(v) if is_json else None
            return (trees.json.dumps(v, ensure_ascii=False), table) if table else (None, None)

        return pd.DataFrame([one(t) for t in texts], columns=["standard", "optimized"])

    made = run(records)
    least = lambda c: F.greatest(F.lit(1), est_tokens(c, per_token))
    standard, optimized = least(made["standard"]), least(made["optimized"])
    saved = F.round((standard - optimized) * per_million / 1_000_000, 6)
    return F.when(made["optimized"].isNotNull(), F.struct(standard.alias("standard_tokens"), optimized.alias("optimized_tokens"), pct_saved(standard, optimized).alias("percent_saved"), saved.alias("financial_saved_per_run"), made["optimized"].alias("optimized_payload")))
