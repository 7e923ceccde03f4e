"""Benchmark decontamination by a prefix-filtered set join.

An item's windows (its runs of ``window`` words; the whole of a shorter item)
are sets of shingles of five words (fewer in a shorter window). Shingles are
ordered by rarity, counted over all documents. Containment of a window asks for
all of its shingles, so its necessary prefix is one: the rarest. Documents join
on that shingle; the place of the shingle in the window fixes where the window
must begin and end in the document (positional and length bounds), and the
words there are compared with the window's.

Only Bloom filters of bounded size are broadcast: one of the benchmark's
shingles for the count, one of the prefix shingles for the join. Everything
that they let pass is joined and verified exactly, so their errors cost work
and never change a result.

Results by case: null or wordless texts have no words and are never hit; items
without words, and items without an id, are ignored; repeated items count once
by id; repeated rows of ``docs`` give repeated results; texts are read whole;
empty tables give no rows, or no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldmill.llm._shared import WordHashes, as_bytes, saved, shingles, table

#: Fixed value: what isn't part of a word once A-Z are lower-cased, byte by byte.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
SHINGLE = 5
#: Bits of a Bloom filter: 16 for each entry, within these bounds whatever the benchmark's size.
BLOOM_BITS = (1 << 16, 1 << 27)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class Bloom:
    """Two bits a hash in a bitmap of bounded size."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 64 - 1)

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be in the filter."""
        at = np.flatnonzero(self._has(h & self.mask))
        return at[self._has((h[at] >> np.uint64(32)) & self.mask)] if len(at) else at

    def _has(self, slot):
        return (self.bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def bloom_of(hashes: DataFrame, n: int) -> Bloom:
    """Filter of the one column ``h`` of ``hashes``, put together by the executors; at most BLOOM_BITS come to the driver."""
    bits = 1 << int(np.clip(np.ceil(np.log2(max(n, 1) * 16)), *np.log2(BLOOM_BITS)))
    slots = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(bits - 1), F.shiftrightunsigned("h", 32).bitwiseAND(bits - 1))).alias("s"))
    words = slots.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return Bloom(out)


def _windows(items: DataFrame, window: int) -> DataFrame:
    """item, words (joined by blanks), size, and the hashes of the shingles of every window of every item."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                words = words_of(text)
                n = min(window, len(words))
                seen = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else ()
                rows = [(item, b" ".join(w).decode(), n, shingles(hashes.of(list(w)), SHINGLE).view(np.int64).tolist()) for w in sorted(seen)]
                if rows:
                    a, b, c, d = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c, pa.int32()), pa.array(d, pa.list_(pa.int64()))], names=["item", "words", "size", "hs"])

    own = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return saved(own.mapInArrow(run, "item string, words string, size int, hs array<long>"), "bench-windows")


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted), spans (array of start and end in words, apart) for every row of ``docs``."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    windows = _windows(items, window)
    sizes = sorted({min(SHINGLE, r["size"]) for r in windows.select("size").distinct().collect()})
    entries = windows.select(F.explode("hs").alias("h")).distinct()
    common = spark.sparkContext.broadcast(bloom_of(entries, entries.count()))

    def counts(batches):
        hashes, bloom, found = WordHashes(), common.value, {}
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                own = hashes.of(words_of(text))
                for s in sizes:
                    h = shingles(own, s) if len(own) >= s else own[:0]
                    for v in h[bloom.hits(h)].view(np.int64).tolist():
                        found[v] = found.get(v, 0) + 1
            if len(found) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["h", "n"])
                found = {}
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["h", "n"])

    rarity = texts.select("text").mapInArrow(counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    distinct = windows.groupBy("words").agg(F.first("size").alias("size"), F.first("hs").alias("hs"))
    placed = distinct.select("words", "size", F.posexplode("hs").alias("off", "h")).join(rarity, "h", "left")
    # A shingle that no document has keeps its window out of all of them.
    least = placed.groupBy("words", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "off")).alias("m")).where("m.n > 0")
    index = saved(least.select("words", "size", F.col("m.h").alias("h"), F.col("m.off").alias("off")), "bench-prefixes")
    chosen = spark.sparkContext.broadcast(bloom_of(index.select("h").distinct(), index.count()))

    def candidates(batches):
        hashes, bloom, reach = WordHashes(), chosen.value, window
        names = ["doc", "doc_id", "n_words", "h", "pos", "lo", "near"]
        for batch in batches:
            out = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                words = words_of(text)
                doc = xxhash.xxh3_128_digest((text or b"") + b"\0" + str(doc_id).encode())
                row = [doc, doc_id, len(words)]
                rows = [[*row, None, None, None, None]]
                own = hashes.of(words)
                for s in sizes:
                    h = shingles(own, s) if len(own) >= s else own[:0]
                    for i in bloom.hits(h).tolist():
                        lo = max(0, i - reach)
                        rows.append([*row, int(h[i].view(np.int64)), i, lo, b" ".join(words[lo : i + reach]).decode("utf-8", "replace")])
                for o, v in zip(out, zip(*rows)):
                    o += v
            kinds = [pa.binary(), batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=names)

    found = saved(texts.mapInArrow(candidates, f"doc binary, doc_id {kind}, n_words long, h long, pos long, lo long, near string"), "bench-candidates")
    start, here = F.col("pos") - F.col("off"), F.split("near", " ")
    pairs = found.where("h is not null").join(index, "h").where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
    pairs = pairs.where(F.array_join(F.slice(here, (start - F.col("lo") + 1).cast("int"), F.col("size")), " ") == F.col("words"))
    hits = saved(pairs.select("doc", start.alias("start"), (start + F.col("size")).alias("end"), "words").distinct(), "bench-hits")
    by_start = Window.partitionBy("doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(by_start), F.lit(0).cast("long"))
    spans = hits.select("doc", "start", "end").distinct().withColumn("reached", reached).where("end > reached")
    spans = spans.select("doc", F.greatest("start", "reached").alias("start"), "end")
    spans = spans.groupBy("doc").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    named = hits.select("doc", "words").distinct().join(windows.select("words", "item").distinct(), "words")
    named = named.select("doc", "item").distinct().groupBy("doc").agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    out = found.where("h is null").select("doc", "doc_id", "n_words").join(spans.join(named, "doc"), "doc", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), "spans")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return digest(found)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS win, least(10, len(ws)) AS size
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sz AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS win
       FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sz WHERE len(ws) >= size)),
hit AS (SELECT DISTINCT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.ws), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
