"""The most frequent runs of words, without counting all of them one by one.

Runs are first weighed in a table of fixed size by a hash (``BUCKETS`` sums, each
no less than the weight of any run in it). Only runs of the heaviest buckets are
then counted by their words. Where the last of the runs asked for doesn't beat
the heaviest bucket that was left out, the runs of every bucket that could still
hold a better one are counted, so the result is exact for any text. A task holds
a table and a piece of a batch, however long its input is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmill.functions.rowwise import pieces

WORD = re.compile("[a-z][a-z0-9_-]+")
#: Sums of the table, a power of two, and how many of the heaviest are looked into first.
BUCKETS, HEAVIEST = 1 << 18, 1024
#: Of the lengths of words (an array) what a word of a run weighs.
Weigh = Callable[[np.ndarray], np.ndarray]


def _runs(batches, n: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """Of pieces of texts: the words, where a run of ``n`` begins, its bucket, and the length of each word."""
    for batch in batches:
        for begin, rows in pieces(batch.num_rows, batch.nbytes / max(1, batch.num_rows)):
            found = [WORD.findall(t) for t in batch.column(0).slice(begin, rows).to_pylist() if t]
            words = [w for x in found for w in x]
            if len(words) < n:
                continue
            known = {w: i for i, w in enumerate(dict.fromkeys(words))}
            number = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            # The same in every process; words that share a value only share buckets.
            value = np.fromiter((crc32(w.encode()) for w in known), np.uint64, len(known)) * np.uint64(0x9E3779B97F4A7C15)
            wide = np.fromiter(map(len, known), np.int64, len(known))[number]
            text = np.repeat(np.arange(len(found)), [len(x) for x in found])
            value, last = value[number] ^ value[number] >> np.uint64(31), len(words) - n + 1
            h = value[:last].copy()
            for i in range(1, n):
                h = h * np.uint64(0xD6E8FEB86659FD93) + value[i : i + last]
            h = (h ^ h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
            at = np.flatnonzero(text[:last] == text[n - 1 :])
            if len(at):
                yield words, at, (h[at] >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), wide


def _weights(lower: DataFrame, n: int, weigh: Weigh | None) -> DataFrame:
    """bucket, weight: sums over all runs."""

    def run(batches):
        table = np.zeros(BUCKETS, np.int64)
        for _, at, bucket, wide in _runs(batches, n):
            if weigh is None:
                table += np.bincount(bucket, minlength=BUCKETS)
            else:
                each = weigh(wide)
                table += np.bincount(bucket, sum(each[at + i] for i in range(n)), BUCKETS).astype(np.int64)
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(table[some])], names=["bucket", "weight"])

    return lower.mapInArrow(run, "bucket int, weight long").groupBy("bucket").agg(F.sum("weight").alias("weight"))


def _counts(lower: DataFrame, n: int, buckets: list[int]) -> DataFrame:
    """gram, n: numbers of the runs of some buckets."""
    marks = np.zeros(BUCKETS, bool)
    marks[buckets] = True

    def run(batches):
        for words, at, bucket, _ in _runs(batches, n):
            count = Counter(" ".join(words[i : i + n]) for i in at[marks[bucket]].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["gram", "n"])

    return lower.mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def top_runs(texts: DataFrame, n: int, k: int, ranked: Callable[[DataFrame], DataFrame], score: str, order: list[Column | str], weigh: Weigh | None = None) -> DataFrame:
    """The first ``k`` rows by ``order`` of ``ranked`` of the counts (gram, n) of all runs of ``n`` words of ``texts`` (text). ``order`` begins with ``score``, descending, which must be no more than the weights of the run's occurrences in all: a run weighs its words' ``weigh``, or 1. The rows are found when this is called; both scans read all texts."""
    lower = texts.select(F.lower("text").alias("text"))
    weights = _weights(lower, n, weigh).persist()
    try:
        heavy = weights.orderBy(F.desc("weight"), "bucket").limit(HEAVIEST).collect()
        best = lambda buckets: ranked(_counts(lower, n, buckets)).orderBy(*order).limit(k)
        made = best([r["bucket"] for r in heavy])
        rows = made.collect()
        # A run in another bucket scores no more than the least of these.
        if len(heavy) == HEAVIEST and (len(rows) < k or rows[-1][score] <= heavy[-1]["weight"]):
            least = rows[-1][score] if len(rows) == k else 0
            rows = best([r["bucket"] for r in weights.where(F.col("weight") >= least).select("bucket").collect()]).collect()
    finally:
        weights.unpersist()
    return texts.sparkSession.createDataFrame(rows, made.schema)
