"""Requests as a stream: rewrites, the store of originals, counters, and differences from turn to turn.

A batch writes to folders of its own number and overwrites them, so that a batch
that runs again after a failure leaves the same rows. Only safe text is stored
or written: a blocked target leaves no text at all. Counters are a streamed
aggregation in complete mode, or an aggregation of what is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foldmill.functions.text import est_tokens
from foldmill.operators.gateway import Policy, rewrite_targets, stats, targets
from foldmill.operators.phrases import session_delta

STORE = "digest string, text string, source string, chars long, preview string, stored_at timestamp, prefix string, batch long"
REWRITES = "conv_id long, turn long, source string, path string, digest string, kind string, class string, applied boolean, blocked boolean, reason string, chars_before long, chars_after long, tokens_before long, tokens_after long, new_text string, batch long"


def _present(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def store_new(texts: DataFrame, store: str, number: int) -> None:
    """Adds the texts (digest, text, source) that the store hasn't got, once each, under batch ``number``; of the store only the prefixes of these digests are read."""
    spark = texts.sparkSession
    new = texts.dropDuplicates(["digest"]).withColumn("prefix", F.substring("digest", 1, 2))
    if _present(spark, store):
        prefixes = [r["prefix"] for r in new.select("prefix").distinct().collect()]  # at most 256
        old = spark.read.schema(STORE).parquet(store).where(F.col("prefix").isin(prefixes) & (F.col("batch") != number))
        new = new.join(old.select("digest"), "digest", "left_anti")
    made = new.select("digest", "text", "source", F.length("text").cast("long").alias("chars"), F.replace(F.substring("text", 1, 120), F.lit("\n"), F.lit("\\n")).alias("preview"), F.current_timestamp().alias("stored_at"), "prefix", F.lit(number).cast("long").alias("batch"))
    made.write.partitionBy("prefix", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(store)


def lookup(spark: SparkSession, store: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (digest) with text, source, chars, preview, stored_at; nulls where the store hasn't got it."""
    return wanted.join(spark.read.schema(STORE).parquet(store).drop("prefix", "batch"), "digest", "left")


def rewrite_stream(turns: DataFrame, out: str, checkpoint: str, mode: str = "externalized", threshold: int = 512, once: bool = False, policy: Policy | None = None) -> StreamingQuery:
    """Rewrites of streamed ``turns`` (conv_id, turn, role, text) under ``out``/rewrites, safe originals once each under ``out``/store."""
    own = policy or Policy(mode=mode, threshold=threshold)

    def each(batch: DataFrame, number: int) -> None:
        made = rewrite_targets(targets(batch, own.threshold), own)
        rows = made.select("conv_id", "turn", "source", "path", "result.*").withColumns({"tokens_before": est_tokens(F.col("safe_text")), "tokens_after": est_tokens(F.col("new_text"))})
        rows.drop("safe_text", "redacted").write.mode("overwrite").parquet(f"{out}/rewrites/batch={number}")
        stored = made.where(F.col("result.safe_text").isNotNull()).select("result.digest", F.col("result.safe_text").alias("text"), "source")
        store_new(stored, f"{out}/store", number)

    running = turns.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (running.trigger(availableNow=True) if once else running).start()


def counters(spark: SparkSession, out: str) -> DataFrame:
    """Counts and savings by kind, class and reason of all that was rewritten so far."""
    return stats(spark.read.schema(REWRITES).parquet(f"{out}/rewrites"))


def counter_stream(spark: SparkSession, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keeps ``out``/counters: n and saved tokens by class and reason over all rewrites, a streamed aggregation in complete mode."""
    rows = spark.readStream.schema(REWRITES).parquet(f"{out}/rewrites")
    made = rows.groupBy("class", "reason").agg(F.count(F.lit(1)).alias("n"), F.count_if("applied").alias("applied"), F.sum(F.coalesce(F.col("tokens_before") - F.col("tokens_after"), F.lit(0))).alias("saved"))

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/counters")

    running = made.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", checkpoint)
    return (running.trigger(availableNow=True) if once else running).start()


def delta_stream(turns: DataFrame) -> DataFrame:
    """conv_id, turn, payload of streamed ``turns`` (conv_id, turn, text): each text as a difference from the one before it in its conversation (null for the first), which the state holds."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("turn", kind="stable")
        base, out = (state.get[0] if state.exists else None), []
        for turn, text in zip(rows["turn"], rows["text"]):
            text = text or ""
            out.append(None if base is None else session_delta(base, text))
            base = text
        state.update((base,))
        yield pd.DataFrame({"conv_id": [key[0]] * len(rows), "turn": rows["turn"].tolist(), "payload": out})

    own = turns.select("conv_id", "turn", F.col("text").cast("string").alias("text"))
    return own.groupBy("conv_id").applyInPandasWithState(run, "conv_id long, turn long, payload string", "base string", "append", GroupStateTimeout.NoTimeout)
