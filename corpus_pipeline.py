"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again before the next.

Every stage but the last returns the columns of documents, for the rows it keeps.
A row is told by its id and its text (128 bits of hashes), so rows that share an
id, or have none, are judged each for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmill.llm._shared import own_names, saved, table
from foldmill.llm.bpe import bpe_encode, default_path
from foldmill.llm.decontaminate import find_contamination
from foldmill.llm.line_dedup import dedup_lines
from foldmill.llm.ngram_join import link_documents
from foldmill.llm.quality_classifier import keep_good, train_quality

#: Parts of the pipeline that SQL can't express: training, hashing of ids by merges. Tested against brute force instead.
ORACLE_SQL = None


def _identity(docs: DataFrame) -> Column:
    """What tells a row: rows with an id come first, in its order, then by hashes of the text; never null itself."""
    text = docs["text"].cast("string")
    return F.struct(docs["doc_id"].isNull().alias("no_id"), docs["doc_id"].alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))


def _named(docs: DataFrame) -> DataFrame:
    """The text under the row's identity, for an operator that asks for doc_id and text."""
    return docs.select(_identity(docs).alias("doc_id"), docs["text"].cast("string").alias("text"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose identity isn't in ``gone`` (doc_id)."""
    (key,) = own_names(docs, "_identity")
    out = docs.withColumn(key, _identity(docs))
    return out.join(gone.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go; the model's expression is a filter of the same scan.

    Null and empty texts are scored like any other; repeated rows stay or go
    together; without usable labels the score is 0.5 and all stay; very long texts
    are read whole; an empty table stays empty; columns of any names pass through.
    """
    return keep_good(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose later repeated runs of lines; documents that lose all their words this way go. n_chars follows the text.

    Null and wordless texts stay as they are; rows with equal id and text count as
    one and stay all; of equal runs the one first by id, text hash and line stays,
    null ids first; an empty table stays empty; columns of any names pass through.
    """
    out = dedup_lines(docs)
    removed = F.col(out.columns[-2])
    out = out.where((removed == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n = F.when(removed > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*((n if c == "n_chars" else F.col(f"`{c}`")).alias(c) for c in docs.columns))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays: the one with the smallest id, of equal ids the one with the least text hash.

    Rows with equal id and text are one document and leave one row. Null ids come
    after all others. Null and wordless texts link with nothing and stay, every row
    of them; an empty table stays empty; columns of any names pass through.
    """
    groups = saved(link_documents(_named(docs)), "pipeline-groups")
    left = saved(_without(docs, groups.where("component_id != doc_id")), "pipeline-firsts")
    again = groups.where("n_shingles > 0 and component_id = doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    (key,) = own_names(docs, "_identity")
    keyed = left.withColumn(key, _identity(left))
    again = saved(again.select(F.col("doc_id").alias(key)), "pipeline-repeats", (groups,))
    one = keyed.join(again, key, "left_semi").dropDuplicates([key])
    return keyed.join(again, key, "left_anti").unionByName(one).select(*(F.col(f"`{c}`") for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go.

    Null and wordless texts have none and stay; rows with equal id and text go or
    stay together, rows that only share an id each for itself; an empty benchmark
    takes nothing away; an empty table stays empty; columns of any names pass through.
    """
    return _without(docs, find_contamination(_named(docs), table(spark, sf_dir, "benchmark")).where("n_hit > 0"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A row for each row: null texts count as empty, empty ones have no tokens;
    other columns are left out.
    """
    return bpe_encode(docs, default_path(), keep_ids=False)


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("decontamination", decontamination), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
