"""Column profiles of record payloads: constants, enumerations, sequences and common prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def profile_columns(cells: DataFrame) -> DataFrame:
    """payload_id, key, n_distinct, constant, enum of cells (payload_id, key, value)."""
    out = cells.groupBy("payload_id", "key").agg(F.count_distinct("value").alias("n_distinct"), F.count(F.lit(1)).alias("n"))
    few = F.least(F.lit(64), F.greatest(F.lit(2), F.floor(F.col("n") / 2)))
    return out.select("payload_id", "key", "n_distinct", (F.col("n_distinct") == 1).alias("constant"), (F.col("n_distinct") <= few).alias("enum"))


def int_sequences(cells: DataFrame) -> DataFrame:
    """payload_id, n, step (null unless three values or more differ by one step throughout) of cells (payload_id, row, value)."""
    d = F.col("value") - F.lag("value").over(Window.partitionBy("payload_id").orderBy("row"))
    out = cells.withColumn("d", d).groupBy("payload_id").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    return out.select("payload_id", "n", F.when((F.col("n") >= 3) & (F.col("lo") == F.col("hi")), F.col("lo")).alias("step"))


def common_prefixes(values: DataFrame, *by: str) -> DataFrame:
    """The longest common prefix of ``value`` in each group: that of its least and greatest value."""
    ends = values.groupBy(*by).agg(F.min("value").alias("a"), F.max("value").alias("b"))
    n = F.expr("size(filter(sequence(1, greatest(1, least(length(a), length(b)))), i -> substr(a, 1, i) = substr(b, 1, i) and i <= length(a) and i <= length(b)))")
    return ends.select(*by, F.expr("a").substr(F.lit(1), n).alias("prefix"))
