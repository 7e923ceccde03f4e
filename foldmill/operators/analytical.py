"""Analytical summaries of text (lossy): counts, outlines and selected lines, as expressions over one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldmill.functions.text import let, marker, sha16, split_lines

#: Log variables, as fixed.
VARIABLE = r"([A-Za-z_]+)=([^\s]+)|\b\d{1,4}(?:[-:/]\d{1,4})+(?:Z)?\b|\b\d+\b|[0-9a-f]{8,}\b"
LEVEL = r"\b(ERROR|WARN|WARNING|INFO|DEBUG|TRACE|CRITICAL)\b"


def _n(c: Column) -> Column:
    return c.cast("string")


def _payload(name: str, *parts: Column) -> Column:
    return F.array_join(F.concat(F.array(F.lit(marker(name))), *parts), "\n")


def template(line: Column) -> tuple[Column, Column]:
    """A log line with its variables numbered {v0}, {v1}, ..., and the variables."""
    values = F.regexp_extract_all(line, F.lit(VARIABLE), F.lit(0))
    gaps = F.split(line, VARIABLE, -1)
    text = let(F.size(gaps), lambda n: F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.when(i < n - 1, F.concat(F.lit("{v"), _n(i), F.lit("}"))).otherwise(""))), ""))
    return text, values


def ci_counts(text: Column) -> dict[str, Column]:
    lines = split_lines(text)
    failed = F.filter(lines, lambda x: x.rlike("FAILED|ERROR|Traceback|AssertionError|exit code|Exception"))
    return {
        "lines": F.size(lines).cast("long"), "passed": F.size(F.filter(lines, lambda x: x.rlike(r"\bPASSED\b|\bpassed\b"))).cast("long"),
        "warnings": F.size(F.filter(lines, lambda x: F.contains(F.lower(x), F.lit("warning")))).cast("long"), "failures": F.size(failed).cast("long"), "_failed": failed,
    }


def ci_output(text: Column) -> Column:
    c = ci_counts(text)
    head = F.concat(F.lit("lines="), _n(c["lines"]), F.lit(" passed_lines="), _n(c["passed"]), F.lit(" warnings="), _n(c["warnings"]), F.lit(" failures="), _n(c["failures"]), F.lit(" sha="), sha16(text))
    more = F.when(c["failures"] > 80, F.array(F.concat(F.lit("... "), _n(c["failures"] - 80), F.lit(" more failure/error lines omitted")))).otherwise(F.array().cast("array<string>"))
    return _payload("ci_output", F.array(head, F.lit("@important")), F.slice(c["_failed"], 1, 80), more)


def clean_html(x: Column) -> Column:
    out = F.regexp_replace(x, "<[^>]+>", "")
    for name, char in {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&middot;": "·", "&copy;": "©", "&amp;": "&"}.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(out)


def html_parts(text: Column) -> dict[str, Column]:
    link = r"""(?is)<a[^>]+href=['\"]([^'\"]+)['\"][^>]*>(.*?)</a>"""
    return {
        "title": clean_html(F.regexp_extract(text, r"(?is)<title[^>]*>(.*?)</title>", 1)),
        "headings": F.transform(F.regexp_extract_all(text, F.lit(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"), F.lit(1)), clean_html),
        "links": F.zip_with(F.transform(F.regexp_extract_all(text, F.lit(link), F.lit(2)), clean_html), F.regexp_extract_all(text, F.lit(link), F.lit(1)), lambda a, h: F.concat(a, F.lit(" -> "), h)),
    }


def html_visible(text: Column) -> Column:
    p = html_parts(text)
    head = F.concat(F.lit("title="), p["title"], F.lit(" links="), _n(F.size(p["links"])), F.lit(" sha="), sha16(text))
    return _payload("html_visible", F.array(head, F.lit("@headings")), F.slice(p["headings"], 1, 80), F.array(F.lit("@links")), F.slice(p["links"], 1, 120))


def markdown_outline(text: Column) -> Column:
    lines = split_lines(text)
    fences = ((F.length(text) - F.length(F.replace(text, F.lit("```"), F.lit("")))) / 6).cast("long")
    bullets = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*] ")))
    head = F.concat(F.lit("lines="), _n(F.size(lines)), F.lit(" code_blocks="), _n(fences), F.lit(" bullets="), _n(bullets), F.lit(" sha="), sha16(text))
    return _payload("markdown_outline", F.array(head, F.lit("@outline")), F.slice(F.filter(lines, lambda x: x.startswith("#")), 1, 200))


def code_symbols(text: Column) -> Column:
    lines = split_lines(text)
    rx = r"(?m)^\s*(def|class|function|const|interface|type|func)\s+([^(:={\s]+)"
    names = F.zip_with(F.regexp_extract_all(text, F.lit(rx), F.lit(1)), F.regexp_extract_all(text, F.lit(rx), F.lit(2)), lambda k, n: F.concat(k, F.lit(" "), n))
    imports = F.transform(F.filter(lines, lambda x: x.rlike(r"^\s*(import|from|package)\b")), F.trim)
    head = F.concat(F.lit("lines="), _n(F.size(lines)), F.lit(" sha="), sha16(text))
    return _payload("code_symbols", F.array(head, F.lit("@imports")), F.slice(imports, 1, 80), F.array(F.lit("@symbols")), F.slice(names, 1, 200))


def tool_output(text: Column) -> Column:
    lines = split_lines(text)
    errors = F.filter(lines, lambda x: x.rlike("(?i)error|failed|traceback|exception"))
    diffs = F.filter(lines, lambda x: x.rlike(r"^(diff --git|@@|\+|-)"))
    rows = F.filter(lines, lambda x: x.rlike(r"^\s*\d+\|"))
    chosen = F.when(F.size(errors) > 0, F.slice(errors, 1, 80)).when(F.size(diffs) > 0, F.slice(diffs, 1, 120)).when(F.size(rows) > 0, F.slice(rows, 1, 120)).otherwise(F.slice(lines, 1, 80))
    head = F.concat(F.lit("lines="), _n(F.size(lines)), F.lit(" numbered="), _n(F.size(rows)), F.lit(" diff_lines="), _n(F.size(diffs)), F.lit(" errors="), _n(F.size(errors)), F.lit(" sha="), sha16(text))
    return _payload("tool_output", F.array(head, F.lit("@selected")), chosen)


def blobs(text: Column) -> tuple[Column, Column]:
    """Base64 runs, and the text with each replaced by a numbered reference."""
    rx = r"[A-Za-z0-9+/]{160,}={0,2}"
    found, gaps = F.regexp_extract_all(text, F.lit(rx), F.lit(0)), F.split(text, rx, -1)
    ref = lambda b, i: F.concat(F.lit("<blob"), _n(i), F.lit(":base64 chars="), _n(F.length(b)), F.lit(" sha16="), sha16(b), F.lit(">"))
    out = let(found, lambda f: F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.when(i < F.size(f), ref(F.get(f, i), i)).otherwise(""))), ""))
    return found, out


def blob_ref(text: Column) -> Column:
    found, out = blobs(text)
    listed = F.transform(found, lambda b, i: F.struct(F.concat(F.lit("blob"), _n(i)).alias("id"), F.length(b).alias("chars"), F.floor(F.length(F.rtrim(b, F.lit("="))) * 3 / 4).alias("bytes_est"), sha16(b).alias("sha16")))
    return F.concat_ws("\n", F.lit(marker("blob_ref")), F.concat(F.lit("blobs="), F.to_json(listed)), out)
