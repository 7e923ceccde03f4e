"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A run is a sequence of consecutive lines with words. From every line, forwards
and backwards, the shortest run of at least ``min_words`` words is a window, and
the least line hash in it is its minimum (the first of equal ones). Only the
places of minima are fingerprints, so of many short lines few are kept: (hash,
document, place). Any run of ``min_words`` words holds whole windows, so equal
runs have equal fingerprints at equal places: that is winnowing's guarantee.

Fingerprints that occur at one place only are done with. From each place of the
others the match is extended to the left and to the right: a window is told by its
fingerprint and by the line hashes on either side of it, and windows that agree
in all three are copies. Only documents with such places are read again for that.
Overlapping windows make up longer runs. Of equal runs the first by (doc_id, text
hash, line) stays, and the lines of later ones are deleted.

So a line goes if, and only if, it lies in a run of at least ``min_words`` words
that also begins at an earlier place. A run that overlaps its own copy loses
only the later part.

Texts without a deleted line aren't shuffled: a bitmap of bounded size, made of
the keys of documents that lose lines, is broadcast; what it lets pass is joined exactly.

Results by case: null text stays null; lines without words take no part, and go
only between deleted lines of one run; rows repeated with equal id and text count
as one document and get equal results; a null doc_id comes first; a text may lose
all its lines and becomes empty; texts are read whole, and one with very many
lines is one window partition of small rows; an empty table gives no rows. Other
columns pass through, whatever their names: columns of this module take other ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldmill.llm._shared import own_names, saved, spread_join, table

WORD = r"[^\x20\x09-\x0D]+"
_KEY = ["d", "k1", "k2"]
#: The bitmap's words (64 bits each): at most so many rows of two numbers are broadcast, whatever the input.
BITMAP_WORDS = 1 << 17


def _key(docs: DataFrame) -> list[Column]:
    text = docs["text"].cast("string")
    return [docs["doc_id"].alias("d"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _line_hashes(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def _same(a: str, b: str) -> Column:
    """Keys of the frames named ``a`` and ``b`` are equal; null ids are equal, too."""
    return F.col(f"{a}.k1").eqNullSafe(F.col(f"{b}.k1")) & F.col(f"{a}.k2").eqNullSafe(F.col(f"{b}.k2")) & F.col(f"{a}.d").eqNullSafe(F.col(f"{b}.d"))


def windows_of(docs: DataFrame, min_words: int) -> DataFrame:
    """d, k1, k2, first, last, at (place of the minimum), m1, m2 (its hash) of every window, once for each document."""
    text = docs["text"].cast("string")
    lines = docs.select(*_key(docs), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    lines = lines.select(*_KEY, "pos", F.regexp_count("line", F.lit(WORD)).alias("w"), _line_hashes(F.col("line")).alias("h")).where("w > 0")
    lines = lines.repartition(*_KEY).dropDuplicates([*_KEY, "pos"])
    doc = Window.partitionBy(*_KEY)
    lines = lines.withColumn("e", F.sum("w").over(doc.orderBy("pos"))).withColumn("s", F.col("e") - F.col("w"))
    ahead, behind = doc.orderBy("s").rangeBetween(0, min_words - 1), doc.orderBy("e").rangeBetween(1 - min_words, 0)

    def over(frame):
        least = F.min(F.struct("h", "pos")).over(frame)
        words = F.max("e").over(frame) - F.min("s").over(frame)
        return F.struct(F.min("pos").over(frame).alias("first"), F.max("pos").over(frame).alias("last"), words.alias("words"), least.alias("least"))

    windows = lines.select(*_KEY, over(ahead).alias("a"), over(behind).alias("b")).select(*_KEY, F.explode(F.array("a", "b")).alias("x")).select(*_KEY, "x.*")
    windows = windows.where(F.col("words") >= min_words).select(*_KEY, "first", "last", F.col("least.pos").alias("at"), F.col("least.h.h1").alias("m1"), F.col("least.h.h2").alias("m2"))
    return windows.dropDuplicates([*_KEY, "first", "last"])


def repeated_runs(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """Deleted runs as d, k1, k2 (the document) and runs (array of first and last line, from 0, apart and in order)."""
    windows = saved(windows_of(docs, min_words), "line-windows")
    places = windows.groupBy(*_KEY, "at").agg(F.first("m1").alias("m1"), F.first("m2").alias("m2"))
    shared = places.groupBy("m1", "m2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("m1", "m2")
    # Windows around places of shared fingerprints, a row for each document.
    around = windows.join(shared, ["m1", "m2"], "left_semi").groupBy(*_KEY).agg(F.collect_list(F.struct("first", "last", "at", "m1", "m2")).alias("ws"))
    hashes = F.transform(F.split(docs["text"].cast("string"), "\n", -1), lambda x: F.when(x.rlike(WORD), _line_hashes(x)))
    again = docs.where(docs["text"].isNotNull()).select(*_key(docs), hashes.alias("hs")).dropDuplicates(_KEY)
    matched = around.alias("a").join(again.alias("b"), _same("a", "b")).select("a.*", "b.hs")
    matched = matched.select(*_KEY, "hs", F.explode("ws").alias("x")).select(*_KEY, "hs", "x.*")
    # The match is extended both ways; lines without words don't count.
    side = lambda start, n: F.xxhash64(F.filter(F.slice("hs", start, n), lambda h: h.isNotNull()))
    left, right = side(F.col("first") + 1, F.col("at") - F.col("first")), side(F.col("at") + 2, F.col("last") - F.col("at"))
    extended = saved(matched.select(*_KEY, "first", "last", "m1", "m2", left.alias("left"), right.alias("right")), "line-matches", (windows,))
    content, place = ["m1", "m2", "left", "right"], F.struct(*_KEY, "first")
    earliest = extended.groupBy(*content).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first_place")).where("n > 1")
    # A passage that very many documents share is dealt over all tasks.
    later = spread_join(extended, saved(earliest, "line-first"), content, "n").where(place != F.col("first_place")).select(*_KEY, "first", "last").distinct()
    doc = Window.partitionBy(*_KEY)
    so_far = F.max("last").over(doc.orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("new", F.when(F.coalesce(F.col("first") > so_far + 1, F.lit(True)), 1).otherwise(0))
    later = later.withColumn("run", F.sum("new").over(doc.orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0)))
    runs = later.groupBy(*_KEY, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return saved(runs.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs")), "line-runs", (extended,))


def dedup_lines(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """``docs`` with text without later repeated runs, and three more columns: numbers of lines and of removed lines, and the runs.

    They are the last three, named _n_lines, _n_removed, _runs, with more underscores before a name that ``docs`` has.
    """
    runs = repeated_runs(docs, min_words)
    n_lines, n_removed, spans = own_names(docs, "_n_lines", "_n_removed", "_runs")
    text = docs["text"].cast("string")
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    names = list(docs.columns)
    word = lambda k: F.pmod(F.shiftright(F.col(k), 6), F.lit(BITMAP_WORDS))
    bit = lambda k: F.expr(f"shiftleft(1L, cast({k} & 63 as int))")
    bitmap = F.broadcast(runs.groupBy(word("k1").alias("word")).agg(F.bit_or(bit("k1")).alias("bits")))
    keyed = docs.select(*_key(docs), text.alias("text"), row).withColumn("word", word("k1")).join(bitmap, "word", "left")
    may = F.col("bits").isNotNull() & (F.col("bits").bitwiseAND(bit("k1")) != 0)
    # Texts that may lose lines are dealt by key at every size; all others stay where they are.
    found = keyed.where(may).alias("a").join(runs.hint("merge").alias("b"), _same("a", "b"), "left").select("row", "text", "runs")
    out = keyed.where(~F.coalesce(may, F.lit(False))).select("row", "text", F.lit(None).cast(runs.schema["runs"].dataType).alias("runs")).unionByName(found)
    kept = F.expr("transform(sequence(0, size(runs)), i -> struct(if(i = 0, 0, runs[i - 1].last + 1) as s, if(i = size(runs), size(lines), get(runs, i).first) as e))")
    out = out.withColumn("lines", F.when(F.col("runs").isNotNull(), F.split("text", "\n", -1))).withColumn("kept", F.when(F.col("runs").isNotNull(), kept))
    joined = F.expr("array_join(flatten(transform(kept, k -> slice(lines, k.s + 1, k.e - k.s))), '\n')")
    removed = F.expr("aggregate(runs, 0L, (n, r) -> n + r.last - r.first + 1)")
    count = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    own = F.when(F.col("runs").isNull(), F.col("text")).otherwise(joined)
    return out.select(
        *((own if c == "text" else F.col("row").getField(c)).alias(c) for c in names),
        F.coalesce(count, F.lit(0)).cast("long").alias(n_lines), F.coalesce(removed, F.lit(0).cast("long")).alias(n_removed),
        F.coalesce("runs", F.array().cast("array<struct<first:int,last:int>>")).alias(spans),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    n_lines, n_removed, runs = out.columns[-3:]
    spans = F.array_join(F.transform(runs, lambda r: F.concat(r["first"].cast("string"), F.lit(":"), (r["last"] + 1).cast("string"))), ",")
    return out.select("doc_id", F.col(n_lines).alias("n_lines"), F.col(n_removed).alias("n_removed"), spans.alias("removed"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


OP10_SQL = r"""
WITH l AS (SELECT doc_id, i - 1 AS pos, ls[i] AS line, len(ls) AS n_lines, len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) AS w
           FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
s AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS e, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) - w AS s FROM l WHERE w > 0),
win AS (SELECT doc_id, min(pos) OVER f AS a, max(pos) OVER f AS b, max(e) OVER f - min(s) OVER f AS words, list(line) OVER f AS c FROM s
        WINDOW f AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING)
        UNION
        SELECT doc_id, min(pos) OVER g, max(pos) OVER g, max(e) OVER g - min(s) OVER g, list(line) OVER g FROM s
        WINDOW g AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 19 PRECEDING AND CURRENT ROW)),
ok AS (SELECT doc_id, a, b, md5(array_to_string(c, chr(10))) AS c FROM win WHERE words >= 20),
rk AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY doc_id, a) AS k FROM ok),
gone AS (SELECT DISTINCT l.doc_id, l.pos FROM l JOIN rk ON l.doc_id = rk.doc_id AND l.pos BETWEEN rk.a AND rk.b WHERE rk.k > 1),
isl AS (SELECT doc_id, min(pos) AS a, max(pos) + 1 AS b FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM gone) GROUP BY doc_id, g),
sp AS (SELECT doc_id, string_agg(a || ':' || b, ',' ORDER BY a) AS removed, sum(b - a) AS n FROM isl GROUP BY doc_id),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) AS text FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos WHERE gone.pos IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(sp.n, 0) AS BIGINT) AS n_removed, coalesce(sp.removed, '') AS removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(kept.text, '')) END AS text_sha256
FROM documents d LEFT JOIN sp USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
