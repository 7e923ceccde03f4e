"""What the operators share: tables, the shared folder, word and shingle hashes."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables written so far and not removed yet: path and the session that wrote it.
_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in local mode may it be unset; then it is a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="foldmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/foldmill/{name}-{uuid.uuid4().hex[:12]}"
    _written[path] = spark
    return path


def saved(df: DataFrame, name: str, after: tuple[DataFrame, ...] = ()) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, and a lost executor costs no more than a reread.

    Tables of ``after`` (results of this function) aren't needed any more once ``df`` is written, and are removed.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    for old in after:
        remove(old.saved_at)
    out = spark.read.schema(schema).parquet(path)
    out.saved_at = path
    return out


def remove(path: str) -> None:
    """Deletes a table or folder that this module named."""
    spark = _written.pop(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files that no frame needs any more (it goes by the JVM's garbage collection)."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


@atexit.register
def _remove() -> None:
    """What results may still be read from stays until the driver ends."""
    for path in list(_written):
        try:
            remove(path)
        except Exception:  # the session may be gone by now
            return


def spread_join(rows: DataFrame, keyed: DataFrame, key: str | list[str], size: str, most: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``keyed``, which has one row a key and, as ``size``, the key's number of rows.

    Keys with more than a share 1 / ``most`` of all rows, fewer than ``most`` by
    count, are broadcast, so that no task gets all rows of a hot key; the others are dealt by key.
    """
    total = keyed.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * most > total
    if keyed.where(is_hot).isEmpty():
        return rows.join(keyed, key)
    if isinstance(key, str):
        hot = F.col(key).isin([r[0] for r in keyed.where(is_hot).select(key).collect()])
        rest = rows.where(~hot)
    else:
        rest = rows.join(F.broadcast(keyed.where(is_hot).select(*key)), key, "left_anti")
    return rest.join(keyed.where(~is_hot), key).unionByName(rows.join(F.broadcast(keyed.where(is_hot)), key))


def own_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted``, each with underscores before it until no column of ``df`` has that name in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on, Arrow batches of this session hold ``rows`` rows at most: whole texts in batches of Spark's 10,000 take much of a small executor's memory, in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < conf_int(spark, key, 10_000) <= rows:
        spark.conf.set(key, str(rows))


class WordHashes(dict):
    """64-bit xxh3 of words (bytes), kept for the words seen lately; the memo is emptied when it is full, so memory is bounded."""

    most = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        v = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = v
        return v

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent 64-bit hashes of every ``k`` consecutive word hashes (of all words, where there are fewer; none for none)."""
    n = len(h)
    if not n:
        return h
    k = min(k, n)
    acc = np.full(n - k + 1, np.uint64(k), np.uint64)
    for j in range(k):
        acc = (acc ^ h[j : n - k + 1 + j]) * _MIX
        acc ^= acc >> _SHIFT
    return acc


def as_bytes(col: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


#: Separators of words, as fixed: code points 32 and 9 to 13. bytes.split() and bytes.isspace() go by the same six.
SPACES = b" \t\n\r\x0b\x0c"


def ascii_lower(c):
    """A-Z lower-cased and nothing else (lower() would change other letters, too)."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def conf_int(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))
