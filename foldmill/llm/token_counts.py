"""Token counts by a separator scan over flat token files without an index.

A token file is nothing but token ids of a fixed width, one document after the
other, each ended by the end-of-document id. The scan cuts files into blocks of
equal size wherever documents lie, finds the separators of a block by one
vectorised comparison, and stitches documents that cross blocks by an exclusive
prefix scan (separators so far, place of the last one) over the blocks'
summaries: first within segments of blocks, then over segments, so that even a
single enormous file never meets in one task.

Results by case: empty files and an empty folder give no rows; a document
without tokens counts 0; tokens after the last separator are a last document
with ``terminated`` false; trailing bytes that make no whole token are an error.
Null text is tokenised as empty; repeated rows are documents of their own.
"""

from __future__ import annotations

import base64
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldmill.llm._shared import fresh_path, saved, table

SEGMENT = 1024


def write_token_files(docs: DataFrame, path: str, ranks_path: str, eod_id: int = 50256, dtype: str = "<u2") -> DataFrame:
    """Writes ``docs`` to one token file a partition and returns where each row went: file, ordinal, doc_id.

    Each attempt of a task has a file of its own, which gets its name only when it
    is whole, and its rows name that file: rows and tokens are always those of one
    attempt, whatever order another one read its input in. Files of attempts whose
    rows weren't kept are scanned, too, but no row leads to them.
    """
    import public_tokenizers

    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
    pattern = public_tokenizers.PATTERN

    def run(batches):
        import tiktoken

        coder = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        fs, folder = pafs.FileSystem.from_uri(path)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        fs.create_dir(folder, recursive=True)
        part, n, out = f"{folder}/.{name}", 0, None
        try:
            for batch in batches:
                for row in range(0, batch.num_rows, 512):
                    piece = batch.slice(row, 512)
                    out = out or fs.open_output_stream(part)
                    for text in piece.column(1).to_pylist():
                        out.write(np.array([*coder.encode_ordinary(text or ""), eod_id], dtype).tobytes())
                    k = piece.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([name] * k), pa.array(range(n, n + k), pa.int64()), piece.column(0)], names=["file", "ordinal", "doc_id"])
                    n += k
        finally:
            if out:
                out.close()
        if out:
            fs.move(part, f"{folder}/{name}")

    kind = docs.schema["doc_id"].dataType.simpleString()
    return saved(docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, f"file string, ordinal long, doc_id {kind}"), "token-rows")


def token_files(spark: SparkSession, path: str, width: int) -> DataFrame:
    """name and bytes of the .bin files in a folder (names beginning with . or _ are unfinished or hidden)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(p) if s.isFile()] if fs.exists(p) else []
    found = [(n, k) for n, k in found if n.endswith(".bin") and n[0] not in "._"]
    if odd := [n for n, k in found if k % width]:
        raise ValueError(f"not a whole number of {width}-byte tokens: {odd[:5]}")
    return spark.createDataFrame(found, "file string, bytes long")


def count_tokens(spark: SparkSession, path: str, eod_id: int = 50256, dtype: str = "<u2", block_tokens: int = 1 << 21) -> DataFrame:
    """file, ordinal, start, n_tokens, terminated of every document in the token files of ``path``."""
    width = np.dtype(dtype).itemsize
    blocks = (
        token_files(spark, path, width)
        .select("file", (F.col("bytes") / width).cast("long").alias("n"))
        .where("n > 0")
        .select("file", "n", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("n") - 1) / block_tokens).cast("long"))).alias("block"))
    )

    def scan(batches):
        fs, folder = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for file, n, block in zip(*(c.to_pylist() for c in batch.columns)):
                start = block * block_tokens
                with fs.open_input_file(f"{folder}/{file}") as f:
                    f.seek(start * width)
                    tokens = np.frombuffer(f.read(min(block_tokens, n - start) * width), dtype)
                seps = np.flatnonzero(tokens == eod_id).astype(np.int64) + start
                last = int(seps[-1]) if len(seps) else None
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([block]), pa.array([len(tokens)], pa.int64()), pa.array([len(seps)], pa.int64()), pa.array([last], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(seps)], pa.int32()), pa.array(seps))],
                    names=["file", "block", "n_tokens", "n_seps", "last", "seps"],
                )

    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    scanned = saved(blocks.repartition(spread).mapInArrow(scan, "file string, block long, n_tokens long, n_seps long, last long, seps array<long>"), "token-blocks")
    short = scanned.select("file", "block", (F.col("block") / SEGMENT).cast("long").alias("segment"), "n_tokens", "n_seps", "last")
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    segments = short.groupBy("file", "segment").agg(F.sum("n_seps").alias("n"), F.max("last").alias("last"))
    w = before("file", "segment")
    segments = segments.select("file", "segment", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"), F.coalesce(F.max("last").over(w), F.lit(-1)).alias("prev"))
    w = before("file", "segment", "block")
    carried = short.select("file", "segment", "block", F.sum("n_seps").over(w).alias("in_base"), F.max("last").over(w).alias("in_prev")).join(segments, ["file", "segment"])
    carried = carried.select("file", "block", (F.col("base") + F.coalesce("in_base", F.lit(0))).alias("base"), F.coalesce("in_prev", "prev").alias("prev"))
    docs = scanned.where("n_seps > 0").join(carried, ["file", "block"]).select("file", "base", "prev", "seps", F.posexplode("seps").alias("k", "sep"))
    start = F.when(F.col("k") == 0, F.col("prev")).otherwise(F.expr("get(seps, k - 1)")) + 1
    docs = docs.select("file", (F.col("base") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("sep") - start).alias("n_tokens"), F.lit(True).alias("terminated"))
    tail = short.groupBy("file").agg(F.sum("n_seps").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.sum("n_tokens").alias("n"))
    tail = tail.where("n > start").select("file", "ordinal", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"))
    return docs.unionByName(tail)


def default_ranks() -> str:
    import public_tokenizers

    return os.path.splitext(public_tokenizers.path("byte_bpe_50k.json"))[0] + ".tiktoken"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, from flat token files of the whole table."""
    path = fresh_path(spark, "tokens")
    rows = write_token_files(table(spark, sf_dir, "documents"), path, default_ranks())
    return rows.join(count_tokens(spark, path), ["file", "ordinal"]).select("doc_id", "n_tokens", "terminated")
