"""Text expressions: lines, digests, previews and token estimates as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends, as fixed: the ones that end a line in universal-newline splitting.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\x{2028}\x{2029}]"


def marker(name: str) -> str:
    """First line of every encoded payload."""
    return f"<foldmill:{name}_v1>"


def split_lines(text: Column) -> Column:
    """Lines of a text; one empty line at the end is dropped, and an empty text has none."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def rows(text: Column) -> Column:
    """What stands between line feeds, and nothing else: the empty text is one empty row, and a line feed at the end begins another."""
    return F.split(text, "\n", -1)


def sha16(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def preview(text: Column, n: int) -> Column:
    return F.replace(F.substring(text, 1, n), F.lit("\n"), F.lit("\\n"))


def est_tokens(text: Column, per_token: float = 4.0) -> Column:
    """Characters by ``per_token``, one at least, none for the empty text."""
    n = F.length(text)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / per_token))).cast("long")


def pct_saved(raw: Column, optimized: Column) -> Column:
    return F.when(raw > 0, F.round((raw - optimized) * 100.0 / raw, 2)).otherwise(0.0)


def cost(tokens: Column, per_million: float = 3.0) -> Column:
    return F.round(tokens * per_million / 1_000_000, 9)


def numbered(items: Column, prefix: str, sep: str) -> Column:
    """Array of prefix, place from 0, separator, item."""
    return F.transform(items, lambda x, i: F.concat(F.lit(prefix), i.cast("string"), F.lit(sep), x))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, even where ``f`` uses it inside other lambdas (those would compute an expression for each element)."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Words of a text, and those that are too common to count.
WORD = "[A-Za-z][A-Za-z0-9_-]+"
STOP_WORDS = ["the", "and", "for", "with", "that", "this", "from", "are", "was", "were", "into", "have", "has"]


def array_of(kind: str) -> Column:
    """An empty array."""
    return F.array().cast(f"array<{kind}>")


def runs(ordered: Column, key: Callable[[Column], Column]) -> Column:
    """Of an array in the order of ``key``: where each run of equal keys begins, and its length."""
    begins = F.transform(ordered, lambda x, i: F.when(F.coalesce(key(x) != key(F.get(ordered, i - 1)), F.lit(True)), i))
    return let(F.filter(begins, lambda i: i.isNotNull()), lambda b: F.transform(b, lambda x, k: F.struct(x.alias("begin"), (F.coalesce(F.get(b, k + 1), F.size(ordered)) - x).alias("n"))))


def tally(items: Column) -> Column:
    """Different items in the order of first appearance: structs of first, n, item, at (all places). It sorts, so long rows cost no square."""

    def counted(s: Column) -> Column:
        of = lambda r: F.struct(F.get(s, r["begin"])["at"].alias("first"), r["n"].alias("n"), F.get(s, r["begin"])["item"].alias("item"), F.transform(F.slice(s, r["begin"] + 1, r["n"]), lambda x: x["at"]).alias("at"))
        return F.array_sort(F.transform(runs(s, lambda x: x["item"]), of))

    return let(F.array_sort(F.transform(items, lambda x, i: F.struct(x.alias("item"), i.alias("at")))), counted)


def spread(groups: Column, value: Callable[[Column, Column], Column]) -> Column:
    """For each place in a tally the value of its group (struct, number), in the order of the places."""
    each = F.flatten(F.transform(groups, lambda g, k: let(value(g, k), lambda v: F.transform(g["at"], lambda a: F.struct(a.alias("at"), v.alias("v"))))))
    return F.transform(F.array_sort(each), lambda x: x["v"])


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def paragraphs(text: Column) -> Column:
    """Texts between blank lines, stripped; empty ones are left out."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n", -1), strip), lambda p: p != "")


def json_counts(names: Column, counts: Column) -> Column:
    """A JSON object of numbers by name, in order."""
    return F.concat(F.lit("{"), F.array_join(F.zip_with(names, counts, lambda k, n: F.concat(F.lit('"'), F.replace(F.replace(k, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('":'), n.cast("string"))), ","), F.lit("}"))
