"""Reversible dictionary encodings of text, as expressions over one row.

Repeats are found by sorting within the row and distinct items keep the order
of first appearance, so nothing is shuffled. Each encoder returns a column with
the payload, null where it gives up; each decoder undoes it from the payload.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldmill.functions.text import let, marker, numbered, paragraphs, preview, rows as lines_of, runs, sha16, spread, tally


def pattern_hash(text: Column) -> Column:
    """Lines of more than 8 characters that repeat become #0, #1, ...; without any, the text itself."""
    is_known = lambda g: (g["n"] > 1) & (F.length(g["item"]) > 8)

    def coded(groups: Column, known: Column) -> Column:
        named = F.transform(known, lambda g, k: F.struct(g["at"].alias("at"), F.concat(F.lit("#"), k.cast("string")).alias("v")))
        plain = F.transform(F.filter(groups, lambda g: ~is_known(g)), lambda g: F.struct(g["at"].alias("at"), g["item"].alias("v")))
        rows = spread(F.concat(named, plain), lambda g, k: g["v"])
        return F.array_join(F.concat(F.array(F.lit(marker("pattern_hash")), F.lit("@dict")), numbered(F.transform(known, lambda g: g["item"]), "#", "="), F.array(F.lit("@rows")), rows), "\n")

    out = lambda groups: let(F.filter(groups, is_known), lambda known: F.when(F.size(known) > 0, coded(groups, known)).otherwise(text))
    return let(tally(lines_of(text)), out)


def pattern_hash_decode(payload: Column) -> Column:
    """Reads the dictionary from the payload's own @dict section."""

    def rows(lines: Column, known: Column, at: Column) -> Column:
        own = F.slice(lines, at + 1, F.size(lines))
        return F.transform(own, lambda x: F.when(x.rlike(r"^#\d+$"), F.coalesce(F.get(known, F.substring(x, 2, 10).try_cast("int")), x)).otherwise(x))

    def decoded(lines: Column, at: Column) -> Column:
        known = F.transform(F.slice(lines, 3, F.greatest(at - 3, F.lit(0))), lambda x: F.regexp_replace(x, r"(?s)^#\d+=", ""))
        return F.array_join(let(known, lambda k: rows(lines, k, at)), "\n")

    out = let(lines_of(payload), lambda lines: let(F.array_position(lines, "@rows").cast("int"), lambda at: decoded(lines, at)))
    return F.when(payload.startswith(marker("pattern_hash")), out).otherwise(payload)


def _segments(text: Column, seps: list[str]) -> tuple[Column, Column]:
    sep, parts = F.lit(seps[-1]), F.split(text, seps[-1], -1)
    for s in reversed(seps[:-1]):
        sep = F.when(F.contains(text, F.lit(s)), F.lit(s)).otherwise(sep)
        parts = F.when(F.contains(text, F.lit(s)), F.split(text, s, -1)).otherwise(parts)
    return sep, parts


def _indexed(text: Column, seps: list[str], name: str, ident: str, as_map: bool) -> Column:
    sep, parts = _segments(text, seps)
    quoted = F.concat(F.lit('"'), F.replace(sep, F.lit("\n"), F.lit("\\n")), F.lit('"'))

    def coded(groups: Column, n: Column) -> Column:
        ids = spread(groups, lambda g, k: F.concat(F.lit(ident), k.cast("string")))
        known = F.transform(groups, lambda g: g["item"])
        shown = F.to_json(F.map_from_entries(F.transform(known, lambda x, i: F.struct(F.concat(F.lit(ident), i.cast("string")), x)))) if as_map else F.to_json(known)
        out = F.concat_ws("\n", F.lit(marker(name)), F.concat(F.lit("sep="), quoted), F.concat(F.lit("dict="), shown), F.concat(F.lit("seq="), F.array_join(ids, ",")))
        return F.when(F.size(known) > n * 0.8, text).otherwise(out)

    return let(parts, lambda p: let(tally(p), lambda groups: coded(groups, F.size(p))))


def _unindexed(payload: Column, name: str, kind: str, pick) -> Column:
    def joined(lines: Column, known: Column) -> Column:
        sep = F.replace(F.regexp_extract(F.get(lines, F.lit(1)), '^sep="(.*)"$', 1), F.lit("\\n"), F.lit("\n"))
        ids = F.split(F.substring(F.get(lines, F.lit(3)), 5, 1 << 30), ",")
        return F.concat_ws("", F.transform(ids, lambda i, k: F.concat(F.when(k > 0, sep).otherwise(""), pick(known, i))))

    known = lambda lines: F.from_json(F.substring(F.get(lines, F.lit(2)), 6, 1 << 30), kind)
    out = let(F.split(payload, "\n", -1), lambda lines: let(known(lines), lambda k: joined(lines, k)))
    return F.when(payload.startswith(marker(name)), out).otherwise(payload)


def separator_segments(text: Column) -> Column:
    return _indexed(text, ["\n\n", "---\n", "\n"], "separator_segments", "", False)


def separator_segments_decode(payload: Column) -> Column:
    return _unindexed(payload, "separator_segments", "array<string>", lambda known, i: F.get(known, i.try_cast("int")))


def chunk_store(text: Column) -> Column:
    return _indexed(text, ["\n\n", "\n"], "chunk_store", "c", True)


def chunk_store_decode(payload: Column) -> Column:
    """Chunks are numbered in their order, so the map's values are an array."""

    def joined(lines: Column, known: Column) -> Column:
        sep = F.replace(F.regexp_extract(F.get(lines, F.lit(1)), '^sep="(.*)"$', 1), F.lit("\\n"), F.lit("\n"))
        ids = F.transform(F.split(F.substring(F.get(lines, F.lit(3)), 5, 1 << 30), ","), lambda i: F.substring(i, 2, 20).try_cast("int"))
        return F.concat_ws("", F.transform(ids, lambda i, k: F.concat(F.when(k > 0, sep).otherwise(""), F.get(known, i))))

    known = lambda lines: F.map_values(F.from_json(F.substring(F.get(lines, F.lit(2)), 6, 1 << 30), "map<string,string>"))
    out = let(F.split(payload, "\n", -1), lambda lines: let(known(lines), lambda k: joined(lines, k)))
    return F.when(payload.startswith(marker("chunk_store")), out).otherwise(payload)


def dedupe(text: Column) -> Column:
    """Paragraphs by digest: &sha=text at first, *sha from then on."""
    first = lambda g: F.transform(g["at"], lambda a: F.struct(a.alias("at"), F.when(a == g["first"], F.concat(F.lit("&"), sha16(g["item"]), F.lit("="), g["item"])).otherwise(F.concat(F.lit("*"), sha16(g["item"]))).alias("v")))
    rows = F.transform(F.array_sort(F.flatten(F.transform(tally(paragraphs(text)), first))), lambda x: x["v"])
    return F.array_join(F.concat(F.array(F.lit(marker("dedupe")), F.lit("@chunks")), rows), "\n")


def dedupe_decode(payload: Column) -> Column:
    """The chunks between blank lines, where each is one line; of chunks of several lines only the first line comes back."""
    entry = lambda x, i: F.when(x.startswith("&") | x.startswith("*"), F.struct(F.substring(x, 2, 16).alias("sha"), i.alias("at"), F.when(x.startswith("&"), F.substring(x, 19, 1 << 30)).alias("text")))

    def joined(s: Column) -> Column:
        whole = lambda r: F.transform(F.slice(s, r["begin"] + 1, r["n"]), lambda x: F.struct(x["at"].alias("at"), F.get(s, r["begin"])["text"].alias("text")))
        return F.array_join(F.transform(F.array_sort(F.flatten(F.transform(runs(s, lambda x: x["sha"]), whole))), lambda x: x["text"]), "\n\n")

    lines = F.split(payload, "\n", -1)
    rows = F.filter(F.transform(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), entry), lambda x: x.isNotNull())
    return F.when(payload.startswith(marker("dedupe")), let(F.array_sort(rows), joined)).otherwise(payload)


def sidecar_ref(text: Column) -> Column:
    head = F.concat(F.lit("sha256="), F.sha2(text, 256), F.lit(" chars="), F.length(text).cast("string"))
    return F.concat_ws("\n", F.lit(marker("sidecar_ref")), head, F.concat(F.lit("preview="), preview(text, 400)))
