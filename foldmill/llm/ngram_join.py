"""N-gram Jaccard join by vertical partitioning, and its connected groups.

A document is the set of its five-word shingles (64-bit hashes). Documents with
equal sets are one class and are handled once.

1. The global order of n-grams is cut into fragments (ranges of hashes), whose
   number grows with the input. Every block of documents sends a fragment each
   n-gram of its own once; the fragment finds those that other blocks have too,
   and the partial counts of the fragments are summed per document. A document
   can reach similarity t only if a share t of its n-grams occurs in other
   classes; the rest is done with.
2. For what is left, n-grams are ordered by exact frequency, rare ones first,
   and the prefix filter makes buckets of classes that share a prefix n-gram.
   Buckets are cut into chunks of bounded size; each pair of chunks is a group of
   its own, and each pair of classes is compared in its first common bucket.
3. In a group the n-grams are ordered by frequency and cut into fragments. Each
   fragment counts the overlaps of all pairs apart (rare n-grams through their
   places, frequent ones as a product of two matrices), and the counts are summed
   per pair. Pairs never become rows: sums of links for each class leave a group,
   and a spanning forest of the pairs that link.
4. Where links needn't be counted, a few pivots of each bucket are paired with its
   other members first, counted fragment by fragment and summed, and merge
   groups; after that, members of a bucket's largest group are compared with those
   outside it only. So a group of k near copies costs far fewer than k * k pairs.

N-grams that hold a large share of all places are joined by broadcast of their
counts (fewer than 1,000 n-grams by definition), never dealt to one task.

Results by case: null and wordless texts have 0 shingles and link with nothing;
with fewer than ``k`` words the whole sequence is one shingle; repeated rows and
equal texts share a class; ids are compared as they are, a null id is never the
smallest; texts are read whole, and a set is held as one row, cut into fragments
only to be compared; an empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldmill.llm._shared import WordHashes, as_bytes, conf_int, release, saved, shingles, small_batches, spread_join, table
from foldmill.llm.decontaminate import BLOOM_BITS, Bloom

BLOCK_NGRAMS = 1_000_000
BLOCK_DOCS = 60_000
#: Fragments that a pair's overlap is counted in.
PARTS = 4
#: Pivots of a bucket, round by round, before what is left of it is settled.
PIVOTS = [1, 2]
#: N-grams of a chunk of a bucket, and its members.
CHUNK, MEMBERS = 400_000, 256
#: Bits of a fragment's number: so few at least, and so many at most (a fragment of 100 TB of text holds some million n-grams then).
FRAGMENT_BITS = (4, 22)


def shingle_set(text: bytes | None, hashes: WordHashes, k: int = 5) -> np.ndarray:
    return np.unique(shingles(hashes.of((text or b"").lower().split()), k))


def fingerprint(own: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return xxhash.xxh3_128_digest(own.tobytes())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", docs["text"].cast("string").alias("text"))


def _classes(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, fp (null for the empty set), n of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, hashes, k) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())], names=["doc_id", "fp", "n"])

    return saved(_texts(docs).mapInArrow(run, f"doc_id {kind}, fp binary, n long"), "ngram-classes")


def _hopeful(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """fp, n of the classes of which a share of ``percent`` of the n-grams may occur in other classes (never too few)."""
    parts = docs.rdd.getNumPartitions()
    bits = int(np.clip(np.ceil(np.log2(max(1, parts) * 4)), *FRAGMENT_BITS))

    def blocks(batches):
        """Rows (fragment, block, names, data): a block's distinct n-grams as 5 bytes each with their document's ordinal; under fragment -1-x, the block's documents."""
        hashes, seen, task, at = WordHashes(), set(), TaskContext.get().partitionId(), 0
        sets, total = [], 0

        def flush():
            nonlocal sets, total, at
            if not sets:
                return
            block = (task << 20) + at
            at += 1
            sizes = np.array([len(s) for s in sets], np.uint32)
            names = b"".join(fingerprint(s) for s in sets)
            g, o = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
            sets, total = [], 0
            order = np.argsort(g, kind="stable")
            g, o = g[order], o[order]
            first = np.r_[True, g[1:] != g[:-1]]
            many = np.r_[~first[1:], False] | ~first  # found twice in this block: known to be shared without asking
            shared = np.bincount(o[many], minlength=len(sizes)).astype(np.uint32)
            rows = [(-1 - block % (1 << bits), block, len(sizes), np.concatenate([sizes, shared]).tobytes() + names, b"")]
            g, o, many = g[first], o[first], many[first]
            o[many] = 0xFFFF
            fragment = (g >> np.uint64(64 - bits)).astype(np.int32)
            edge = np.r_[np.flatnonzero(np.r_[True, fragment[1:] != fragment[:-1]]), len(g)]
            low = (g & np.uint64((1 << 40) - 1)).view(np.uint8).reshape(-1, 8)[:, :5]
            del order, first, many, g
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                by = np.argsort(o[a:b], kind="stable")
                rows.append((int(fragment[a]), block, b - a, low[a:b][by].tobytes(), o[a:b][by].tobytes()))
            for i in range(0, len(rows), 256):
                cols = list(zip(*rows[i : i + 256]))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())], names=["f", "block", "n", "a", "b"])

        for batch in batches:
            for text in as_bytes(batch.column(0)):
                own = shingle_set(text, hashes, k)
                if not len(own) or (fp := fingerprint(own)) in seen:
                    continue
                seen.add(fp)
                sets.append(own)
                total += len(own)
                if total >= BLOCK_NGRAMS or len(sets) >= BLOCK_DOCS:
                    yield from flush()
        yield from flush()

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one fragment: how many n-grams of each document other blocks have, too."""
        f = key[0].as_py()
        got = [(block, n, a, b) for batch in batches for block, n, a, b in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "a", "b")))]
        names = ["block", "head", "n", "a", "b"]
        if f < 0:
            rows = [(block, True, n, a, b) for block, n, a, b in got]
        else:
            low = [np.frombuffer(a, np.uint8).reshape(-1, 5) for _, _, a, _ in got]
            grams = np.zeros((sum(map(len, low)), 8), np.uint8)
            grams[:, :5] = np.concatenate(low)
            _, back, count = np.unique(grams.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
            shared, rows, at = count[back] > 1, [], 0
            for block, n, _, b in got:
                o = np.frombuffer(b, np.uint16)[shared[at : at + n]]
                at += n
                own, times = np.unique(o[o != 0xFFFF], return_counts=True)
                if len(own):
                    rows.append((block, False, len(own), own.tobytes(), times.astype(np.uint32).tobytes()))
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())], names=names)

    def total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one block: the documents whose n-grams are shared enough."""
        head, sums = None, np.zeros(BLOCK_DOCS + 1, np.int64)
        for batch in batches:
            for is_head, n, a, b in zip(*(batch.column(c).to_pylist() for c in ("head", "n", "a", "b"))):
                if is_head:
                    head = (n, a)
                else:
                    sums[np.frombuffer(a, np.uint16)] += np.frombuffer(b, np.uint32)
        n, a = head
        own = np.frombuffer(a[: 8 * n], np.uint32).astype(np.int64)
        sizes, known = own[:n], own[n:] + sums[:n]
        keep = np.flatnonzero(100 * known >= percent * sizes)
        fps = [a[8 * n + 16 * i : 8 * n + 16 * i + 16] for i in keep.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(sizes[keep], pa.int64())], names=["fp", "n"])

    spread = max(conf_int(docs.sparkSession, "spark.sql.shuffle.partitions", 200), 1)
    sent = _texts(docs).select("text").mapInArrow(blocks, "f long, block long, n long, a binary, b binary").repartition(spread, "f")
    met = sent.groupBy("f").applyInArrow(meet, "block long, head boolean, n long, a binary, b binary")
    out = met.groupBy("block").applyInArrow(total, "fp binary, n long")
    return saved(out.distinct(), "ngram-hopeful")


def _sets(docs: DataFrame, hopeful: DataFrame, k: int) -> DataFrame:
    """cid, fp, n, grams of the hopeful classes. A Bloom filter of bounded size picks texts; the join after it is exact."""
    spark = docs.sparkSession
    slots = spark.sparkContext.broadcast(_fp_bloom(hopeful))

    def run(batches):
        hashes, bloom, seen = WordHashes(), slots.value, set()
        for batch in batches:
            out = []
            for text in as_bytes(batch.column(0)):
                own = shingle_set(text, hashes, k)
                if not len(own) or (fp := fingerprint(own)) in seen:
                    continue
                if len(bloom.hits(np.frombuffer(fp[:8], np.uint64))):
                    seen.add(fp)
                    out.append((fp, own.view(np.int64)))
                if len(out) >= 512:
                    yield pack(out)
                    out = []
            if out:
                yield pack(out)

    def pack(rows):
        offsets = np.r_[0, np.cumsum([len(s) for _, s in rows])].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([f for f, _ in rows], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([s for _, s in rows])))], names=["fp", "grams"])

    found = _texts(docs).select("text").mapInArrow(run, "fp binary, grams array<long>").join(hopeful, "fp", "left_semi").dropDuplicates(["fp"])
    return saved(found.select(F.monotonically_increasing_id().alias("cid"), "fp", F.size("grams").alias("n"), "grams"), "ngram-sets")


def _fp_bloom(hopeful: DataFrame) -> Bloom:
    """Filter of the first 64 bits of fingerprints."""
    n = hopeful.count()
    bits = 1 << int(np.clip(np.ceil(np.log2(max(n, 1) * 16)), *np.log2(BLOOM_BITS)))

    def run(batches):
        for batch in batches:
            h = np.frombuffer(b"".join(f[:8] for f in batch.column(0).to_pylist()), np.uint64)
            s = np.unique(np.concatenate([h, h >> np.uint64(32)]) & np.uint64(bits - 1))
            word, bit = (s >> np.uint64(6)).astype(np.int64), np.uint64(1) << (s & np.uint64(63))
            at = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else word
            yield pa.RecordBatch.from_arrays([pa.array(word[at]), pa.array(np.bitwise_or.reduceat(bit, at).view(np.int64) if len(at) else np.zeros(0, np.int64))], names=["w", "b"])

    words = hopeful.select("fp").mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return Bloom(out)


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """token, cid, n, pos, lone (n-grams no other class has): places of shared n-grams in the prefix of the classes that can still reach the threshold; pos counts in the global order, rare first."""
    need = F.ceil(F.col("n") * percent / 100)
    grams = sets.select("cid", "n", F.explode("grams").alias("token"))
    # N-grams that hold a thousandth of all places or more, so fewer than 1,000, take their count from a broadcast; all others count where they meet.
    total = sets.agg(F.sum("n")).first()[0] or 0
    hot = grams.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where((F.col("c") > 1) & (F.col("c") * 1000 > total)).collect()
    is_hot = F.col("token").isin([r["token"] for r in hot])
    shared = grams.where(~is_hot).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("c > 1")
    if hot:
        counts = F.broadcast(sets.sparkSession.createDataFrame(hot, "token long, c long"))
        shared = shared.unionByName(grams.where(is_hot).join(counts, "token"))
    ranked = shared.select("cid", "n", "token", F.row_number().over(Window.partitionBy("cid").orderBy("c", "token")).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("cid")).alias("m"))
    ranked = ranked.where(F.col("m") >= need).select("token", "cid", "n", (F.col("n") - F.col("m") + F.col("r") - 1).cast("int").alias("pos"), (F.col("n") - F.col("m")).cast("int").alias("lone"))
    prefixes = saved(ranked.where(F.col("pos") <= F.col("n") - need), "ngram-prefixes")
    sizes = saved(prefixes.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "ngram-sizes")
    return saved(spread_join(prefixes, sizes, "token", "size").drop("size"), "ngram-members", (prefixes, sizes))


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node reachable) of every node in ``edges`` (a, b): parents are least neighbours, chains are halved, groups contracted."""
    labels = None
    while True:
        both = edges.select("a", "b").where("a != b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a != b"))
        up = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "cc-parents")
        while True:
            top = up.select(F.col("node").alias("label"), F.col("label").alias("top"))
            nxt = saved(up.join(top, "label").select("node", F.col("top").alias("label"), (F.col("top") != F.col("label")).alias("moved")), "cc-jump")
            if nxt.where("moved").isEmpty():
                break
            up = nxt.select("node", "label")
        if labels is None:
            labels = up
        else:
            again = up.select(F.col("node").alias("label"), F.col("label").alias("top"))
            labels = saved(labels.join(again, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "cc-labels")
        a, b = up.select(F.col("node").alias("a"), F.col("label").alias("la")), up.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        edges = saved(edges.join(a, "a").join(b, "b").where("la != lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "cc-edges")
        if edges.isEmpty():
            return labels


def _linked(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs (a, na, b, nb) that link: overlaps are counted in each fragment apart and summed."""
    left = parts.select(F.col("cid").alias("a"), "part", F.col("grams").alias("ga"))
    right = parts.select(F.col("cid").alias("b"), "part", F.col("grams").alias("gb"))
    counted = pairs.join(left, "a").join(right, ["b", "part"]).select("a", "na", "b", "nb", F.size(F.array_intersect("ga", "gb")).alias("o"))
    o = F.col("o")
    return counted.groupBy("a", "b").agg(F.sum("o").alias("o"), F.first("na").alias("na"), F.first("nb").alias("nb")).where(100 * o >= percent * (F.col("na") + F.col("nb") - o)).select("a", "b")


def _mixed(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of the buckets that hold more than one group, with their group's label."""
    now = members.withColumn("label", F.col("cid"))
    if labels is not None:
        now = members.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    now = saved(now, "ngram-labelled")
    mixed = now.groupBy("token").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count(F.lit(1)).alias("size")).where("l0 != l1").select("token", "size")
    mixed = saved(mixed, "ngram-mixed-tokens")
    return saved(spread_join(now, mixed, "token", "size").drop("size"), "ngram-mixed", (now, mixed))


def overlaps(lists: pa.ListArray, wide: int = 4096, rare: int = 24) -> np.ndarray:
    """How many values each pair of lists (sets) has in common. Values are ordered by frequency and cut into fragments; partial counts are summed per pair."""
    m = len(lists)
    total = np.zeros((m, m))
    values, back, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), np.asarray(lists.value_lengths()))
    order = np.argsort(-count, kind="stable")
    place = np.empty(len(values), np.int64)
    place[order] = np.arange(len(values))
    code, times = place[back], count[back]
    few = (times > 1) & (times <= rare)
    if few.any():
        by = np.lexsort((owner[few], code[few]))
        c, o, cells = code[few][by], owner[few][by], np.zeros(m * m, np.int64)
        for d in range(1, rare):  # places d apart that hold the same value
            same = np.flatnonzero(c[d:] == c[:-d])
            if not len(same):
                break
            cells += np.bincount(o[same] * m + o[same + d], minlength=m * m)
        total += cells.reshape(m, m) + cells.reshape(m, m).T
    many = np.flatnonzero(times > rare)
    c, o = code[many], owner[many]
    for begin in range(0, int((count > rare).sum()), wide):
        own = (c >= begin) & (c < begin + wide)
        part = np.zeros((m, wide), np.float32)
        part[o[own], c[own] - begin] = 1
        total += part @ part.T  # exact: whole numbers of at most ``wide``
    np.fill_diagonal(total, 0)
    return total


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that keep all that ``linked`` (symmetric) connects."""
    left, out = linked.any(1), []
    while left.any():
        todo = [int(left.argmax())]
        left[todo[0]] = False
        while todo:
            x = todo.pop()
            found = np.flatnonzero(linked[x] & left)
            left[found] = False
            out += [(x, y) for y in found.tolist()]
            todo += found.tolist()
    return out


def _settled(members: DataFrame, sets: DataFrame, percent: int, rows: DataFrame | None = None) -> DataFrame:
    """a, b, links: pairs that link, enough of them to merge all groups of a bucket that link (links null).

    With ``rows`` (cid, rows), and each member a group of its own, also classes
    (a) and how many rows of other classes link with them (links; b null).

    A bucket is cut into chunks of about CHUNK n-grams and MEMBERS members; each
    pair of chunks is settled apart, so memory is bounded however large the
    bucket. A pair belongs to the first bucket that both are in; members without
    such a pair are left out before sets are sent, and the prefixes, which tell,
    are a fraction of the sets. A bucket's largest group has chunks of its own,
    which aren't paired with one another.
    """
    every = rows is not None

    def first_met(before: pa.ListArray) -> np.ndarray:
        """Pairs that an earlier bucket has, too."""
        return overlaps(before) > 0

    def ask(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members with a partner of another group that they meet here first and that the bounds allow."""
        own = pa.Table.from_batches(list(batches))
        label, n, lone, pos, chunk = (own.column(c).to_numpy().astype(np.int64) for c in ("label", "n", "lone", "pos", "chunk"))
        # Before the place of a common n-gram only shared ones can match, behind it at most what is left of either.
        most = np.minimum.outer(pos - lone, pos - lone) + np.minimum.outer(n - pos, n - pos)
        ok = (label[:, None] != label) & ((100 + percent) * most >= percent * np.add.outer(n, n))
        if key[1].as_py() != key[2].as_py():
            ok &= chunk[:, None] != chunk
        if ok.any():
            ok &= ~first_met(own.column("before").combine_chunks())
        kept = own.take(pa.array(np.flatnonzero(ok.any(1)), pa.int64())).select(["token", "i", "j", "cid", "label", "n", "chunk", "before"])
        yield from kept.combine_chunks().to_batches() or [pa.RecordBatch.from_pylist([], schema=kept.schema)]

    def settle(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches(list(batches))
        cid, label, n, chunk = (own.column(c).to_numpy().astype(np.int64) for c in ("cid", "label", "n", "chunk"))
        common = overlaps(own.column("grams").combine_chunks())
        linked = (100 * common >= percent * (np.add.outer(n, n) - common)) & (label[:, None] != label)
        if key[1].as_py() != key[2].as_py():
            linked &= chunk[:, None] != chunk
        if linked.any():
            linked &= ~first_met(own.column("before").combine_chunks())
        edges = [(int(cid[x]), int(cid[y]), None) for x, y in forest(linked)]
        if every:
            links = linked @ own.column("rows").to_numpy().astype(np.int64)
            edges += [(int(cid[x]), None, int(links[x])) for x in np.flatnonzero(links)]
        cols = list(zip(*edges)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "links"])

    # Buckets with the same members ask for the same comparisons: one of them stays (alike in number and two 64-bit digests).
    alike = members.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "cid")).alias("y"))
    one = saved(alike.groupBy("k", "x", "y").agg(F.min("token").alias("token")).select("token", F.col("k").alias("size")), "ngram-buckets")
    members = saved(spread_join(members, one, "token", "size").drop("size"), "ngram-places", (one,))
    groups = members.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"))
    shape = groups.groupBy("token").agg(F.sum("k").alias("size"), F.sum("w").alias("weight"), F.max(F.struct("k", "label", "w")).alias("main"))
    chunks = lambda k, w: F.ceil(F.greatest(k / MEMBERS, w / CHUNK))
    if every:
        shape = shape.select("token", "size", F.lit(None).cast("long").alias("main"), F.lit(0).cast("long").alias("n_main"), chunks(F.col("size"), F.col("weight")).alias("n_rest"))
    else:
        shape = shape.select("token", "size", F.col("main.label").alias("main"), chunks(F.col("main.k"), F.col("main.w")).alias("n_main"), chunks(F.col("size") - F.col("main.k"), F.col("weight") - F.col("main.w")).alias("n_rest"))
    shape = saved(shape, "ngram-shapes")
    at = F.when(F.col("label") == F.col("main"), F.pmod(F.xxhash64("cid"), F.col("n_main"))).otherwise(F.col("n_main") + F.pmod(F.xxhash64("cid"), F.col("n_rest")))
    placed = spread_join(members, shape, "token", "size").withColumn("chunk", at.cast("int"))
    # Of each member: its buckets in the global order, so that each place knows the buckets before it.
    spot = F.struct("pos", "token", "chunk", F.col("n_main").cast("int").alias("low"), (F.col("n_main") + F.col("n_rest") - 1).cast("int").alias("last"))
    places = placed.groupBy("cid").agg(F.first("label").alias("label"), F.first("n").alias("n"), F.first("lone").alias("lone"), F.array_sort(F.collect_list(spot)).alias("at"))
    each = places.select("cid", "label", "n", "lone", F.col("at.token").alias("tokens"), F.posexplode("at").alias("k", "x"))
    pairs = F.expr("transform(sequence(if(x.chunk < x.low, x.low, 0), x.last), c -> struct(least(c, x.chunk) as i, greatest(c, x.chunk) as j))")
    cut = each.select(F.col("x.token").alias("token"), "cid", "label", "n", "lone", F.col("x.pos").alias("pos"), F.col("x.chunk").alias("chunk"), F.slice("tokens", F.lit(1), F.col("k")).alias("before"), F.explode(pairs).alias("p"))
    cut = cut.select("token", "p.i", "p.j", "cid", "label", "n", "lone", "pos", "chunk", "before")
    asked = saved(cut.groupBy("token", "i", "j").applyInArrow(ask, "token long, i int, j int, cid long, label long, n int, chunk int, before array<long>"), "ngram-asked", (members, shape))
    sent = asked.join(sets.select("cid", "grams"), "cid")
    if every:
        sent = sent.join(rows, "cid")
    return saved(sent.groupBy("token", "i", "j").applyInArrow(settle, "a long, b long, links long"), "ngram-settled", (asked,))


def _pivots(now: DataFrame, score: DataFrame, many: int) -> DataFrame:
    """token, size, a, na, pa, sa, la: ``many`` pivots of each bucket at most, the ones with the most shared prefix of as many parts of the bucket."""
    own = now.join(score, "cid")
    part = F.pmod(F.xxhash64("cid"), F.lit(many))
    top = own.groupBy("token", part.alias("part")).agg(F.max(F.struct("score", "cid", "n", "pos", "lone", "label")).alias("t"), F.count(F.lit(1)).alias("k"))
    return top.groupBy("token").agg(F.sum("k").alias("size"), F.collect_list(F.struct(F.col("t.cid").alias("a"), F.col("t.n").alias("na"), F.col("t.pos").alias("pa"), F.col("t.lone").alias("sa"), F.col("t.label").alias("la"))).alias("ps"))


def _merged_by_pivots(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Links found by pivots, and the labels they give."""
    parts = saved(sets.select("cid", F.explode(F.expr(f"transform(sequence(0, {PARTS - 1}), p -> named_struct('part', p, 'grams', filter(grams, g -> shiftrightunsigned(g, 62) = p)))")).alias("x")).select("cid", "x.*").where("size(grams) > 0"), "ngram-parts")
    score = saved(members.groupBy("cid").agg((F.count(F.lit(1)) / F.first("n")).alias("score")), "ngram-scores")
    labels, edges = None, None
    for many in PIVOTS:
        now = _mixed(members, labels)
        pivots = saved(_pivots(now, score, many), "ngram-pivots")
        b = now.select("token", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("lone").alias("sb"), F.col("label").alias("lb"))
        met = spread_join(b, pivots, "token", "size").select("b", "nb", "pb", "sb", "lb", F.explode("ps").alias("p")).select("b", "nb", "pb", "sb", "lb", "p.*")
        most_common = F.least(F.col("pa") - F.col("sa"), F.col("pb") - F.col("sb")) + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
        pairs = met.where((F.col("la") != F.col("lb")) & ((100 + percent) * most_common >= percent * (F.col("na") + F.col("nb"))))
        flip = F.col("a") > F.col("b")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.when(flip, F.col("nb")).otherwise(F.col("na")).alias("na"), F.greatest("a", "b").alias("b"), F.when(flip, F.col("na")).otherwise(F.col("nb")).alias("nb")).distinct()
        pairs = saved(pairs, "ngram-pairs", (now, pivots))
        found = saved(_linked(pairs, parts, percent), "ngram-links", (pairs,))
        if not found.isEmpty():
            edges = found if edges is None else edges.union(found)
            labels = components(edges)
        release(members.sparkSession)
    return edges, labels


def link_documents(docs: DataFrame, k: int = 5, percent: int = 80, links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``: rows link at a Jaccard similarity of ``percent`` or more. With ``links`` also n_links, the number of other rows that the row links with (equal ones are counted, too)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = _classes(docs, k)
    hopeful = _hopeful(docs, k, percent)
    sets = _sets(docs, hopeful, k)
    release(spark)
    members = _prefixes(sets, percent)
    release(spark)
    same = saved(rows.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "ngram-first")
    if links:
        edges, heavy = None, saved(sets.select("cid", "fp").join(same.select("fp", "rows"), "fp"), "ngram-rows")
        rest = _settled(members.withColumn("label", F.col("cid")), sets, percent, heavy.select("cid", "rows"))
    else:
        edges, labels = _merged_by_pivots(members, sets, percent)
        rest = _settled(_mixed(members, labels), sets, percent)
    found = rest.where("b is not null").select("a", "b")
    labels = components(found if edges is None else edges.union(found))
    named = labels.join(sets.select(F.col("cid").alias("node"), "fp"), "node").join(same.select("fp", "first"), "fp")
    least = named.groupBy("label").agg(F.min("first").alias("group"))
    grouped = saved(named.join(least, "label").select("fp", "group"), "ngram-groups")
    # Of the classes, those with a link or with several rows: all others are told by their own row.
    told = same.join(grouped, "fp", "left")
    cols = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("group", "first", "doc_id").alias("component_id")]
    if links:
        counted = rest.where("links is not null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
        told = told.join(heavy.join(counted, "cid").select("fp", "links"), "fp", "left")
        cols.append((F.coalesce("links", F.lit(0).cast("long")) + F.coalesce(F.col("rows") - 1, F.lit(0).cast("long"))).alias("n_links"))
    told = saved(told.where("rows > 1 or group is not null"), "ngram-told", (grouped,))
    return spread_left(rows, told).select(*cols)


def spread_left(rows: DataFrame, told: DataFrame) -> DataFrame:
    """``rows`` with what is told of their classes (by fp); a class that holds a large share of the rows is broadcast."""
    total = told.agg(F.sum("rows")).first()[0] or 0
    hot = F.broadcast(told.where(F.col("rows") * 1000 > total))
    rest = rows.where("fp is null").unionByName(rows.where("fp is not null").join(hot.select("fp"), "fp", "left_anti"))
    return rest.join(told.where(F.col("rows") * 1000 <= total), "fp", "left").unionByName(rows.join(hot, "fp"), allowMissingColumns=True)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"), links=True)
