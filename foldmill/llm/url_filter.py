"""URL filters by a sort-merge range join with a sweep.

A host written backwards (org.example.www) puts all subdomains of a rule's host
into one interval of keys. URLs and rules are cut into ranges of keys by
splitters from a bounded sample, and each range is a task of its own; a rule goes to each range its interval meets,
a URL to exactly one (page key included, so that one busy host, even one busy
URL, is split like any other run of rows). Each range is sorted and swept once
with a stack of the rules' hosts that are open at the current key; among the
rules of the open hosts whose path begins the URL's path, the longest wins.

Results by case: a null URL or one without :// has empty host and path, no rule,
and the default verdict; repeated rows are judged alike; an empty rule table
gives the default everywhere, an empty page table no rows; of equal rules, block
wins; other columns of the input are ignored. Length ties between
rules go to the longer host.
"""

from __future__ import annotations

import bisect
import itertools

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmill.llm._shared import ascii_lower, table

SAMPLE = 20_000


def _parts(pages: DataFrame, url: str) -> DataFrame:
    u = F.col(url).cast("string")
    at = F.instr(u, "://")
    rest = F.coalesce(F.when(at > 0, u.substr(at + 3, F.length(u))), F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.select("page_id", host.alias("host"), path.alias("path"))


def key_of(host):
    """Labels in reverse order, each followed by a character below all others, so that a host's subdomains follow it directly."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\u0001"), F.lit("\u0001"))


def _cuts(keys: DataFrame, ranges: int) -> list[tuple[bytes, int]]:
    """Where the keys (k, h) are cut into about equal ranges.

    About SAMPLE keys are asked for in all, however many partitions there are: a
    hash picks a share of the different keys that follows from their number of rows,
    equal keys are counted where they are, and one task keeps 2 * SAMPLE of them at
    most. They decide where ranges end, never what is judged.
    """
    share = SAMPLE / max(keys.count(), 1)
    # Another hash than h, which would pick keys by their place in a range.
    chosen = keys if share >= 1 else keys.where(F.pmod(F.xxhash64(F.lit(5), "k", "h"), F.lit(1 << 40)) < int(share * (1 << 40)))
    found = chosen.groupBy("k", "h").agg(F.count(F.lit(1)).alias("n")).repartition(1).limit(2 * SAMPLE).collect()
    found = sorted((r["k"].encode(), r["h"], r["n"]) for r in found)
    ends = list(itertools.accumulate(n for _, _, n in found))
    return sorted({found[bisect.bisect_left(ends, ends[-1] * i / ranges)][:2] for i in range(1, ranges)}) if found else []


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``; ``rules`` has host, path, verdict."""
    spark = pages.sparkSession
    ranges = ranges or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = pages.schema["page_id"].dataType.simpleString()
    urls = _parts(pages, url).withColumn("k", key_of("host"))
    cuts = _cuts(urls.select("k", F.xxhash64("page_id", "path").alias("h")), ranges)

    def deal(batches):
        for batch in batches:
            keys, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            part = [bisect.bisect_right(cuts, (k.encode(), h)) for k, h in zip(keys, own)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *batch.columns], names=["part", *batch.schema.names])

    blank = F.lit(None)
    first, last = ("k string, h long, page_id " + kind), "host string, path string, rule boolean, verdict string"
    dealt = urls.select("k", F.xxhash64("page_id", "path").alias("h"), "page_id", "host", "path", F.lit(False).alias("rule"), blank.cast("string").alias("verdict"))
    dealt = dealt.mapInArrow(deal, f"part int, {first}, {last}")
    own = rules.select(ascii_lower(F.col("host").cast("string")).alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("verdict").cast("string").alias("verdict"))
    own = own.where("host is not null and verdict is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    own = own.select(key_of("host").alias("k"), F.lit(0).cast("long").alias("h"), blank.cast(kind).alias("page_id"), "host", "path", F.lit(True).alias("rule"), "verdict")

    def copies(batches):
        least, most = -(1 << 63), 1 << 63
        for batch in batches:
            keys = [k.encode() for k in batch.column(0).to_pylist()]
            spans = [(bisect.bisect_right(cuts, (k, least)), bisect.bisect_right(cuts, (k + b"\xff", most))) for k in keys]
            take = [i for i, (a, b) in enumerate(spans) for _ in range(a, b + 1)]
            part = [p for a, b in spans for p in range(a, b + 1)]
            for s in range(0, len(take), 10_000):
                piece = batch.take(pa.array(take[s : s + 10_000], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(part[s : s + 10_000], pa.int32()), *piece.columns], names=["part", *batch.schema.names])

    events = dealt.unionByName(own.mapInArrow(copies, f"part int, {first}, {last}"))
    # UTF-8 strings sort by their bytes, as the keys in cuts do; a rule sorts before the URLs of its own host.
    events = events.repartitionById(ranges, F.col("part")).sortWithinPartitions("part", "k", F.desc("rule"))

    def sweep(batches):
        now, stack = None, []  # (key, host, {path: verdict}, path lengths from long to short)
        for batch in batches:
            got = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            out = []
            for part, k, page, host, path, rule, verdict in zip(*(got[n] for n in ("part", "k", "page_id", "host", "path", "rule", "verdict"))):
                if part != now:
                    now, stack = part, []
                while stack and not k.startswith(stack[-1][0]):
                    stack.pop()
                if rule:
                    if not stack or stack[-1][0] != k:
                        stack.append((k, host, {}, []))
                    stack[-1][2][path] = verdict
                    if len(path) not in stack[-1][3]:
                        stack[-1][3].append(len(path))
                        stack[-1][3].sort(reverse=True)
                    continue
                best = None
                for _, h, paths, sizes in reversed(stack):
                    n = next((n for n in sizes if n <= len(path) and path[:n] in paths), None)
                    if n is not None and (best is None or len(h) + n > best[0]):
                        best = (len(h) + n, h + path[:n], paths[path[:n]])
                out.append((page, host, path, best and best[1], best[2] if best else default))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field("page_id").type), *(pa.array(c, pa.string()) for c in cols[1:])], names=["page_id", "host", "path", "rule", "verdict"])

    return events.mapInArrow(sweep, f"page_id {kind}, host string, path string, rule string, verdict string")


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP5_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UP}', '{_LOW}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rhost, rpath, rv) AS (VALUES {", ".join(map(str, RULES))}),
m AS (SELECT p.page_id, p.host, p.path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rv, length(rhost || rpath)) AS rv
      FROM p LEFT JOIN r ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)
      GROUP BY p.page_id, p.host, p.path)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.rv, 'allow') AS verdict
FROM p JOIN m ON p.page_id IS NOT DISTINCT FROM m.page_id AND p.host = m.host AND p.path = m.path
"""
