"""Detectors: one boolean column for each encoding, so that branches are filters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldmill.functions.text import let, paragraphs

Test = Callable[[Column], Column]
#: Occurrences of a fixed ASCII string, without a pattern; bytes are counted, which costs nothing.
_count = lambda t, s: (F.octet_length(t) - F.octet_length(F.replace(t, F.lit(s), F.lit("")))) / len(s)
#: Lines as SQL counts them: what stands between line feeds.
_lines = lambda t: _count(t, "\n") + 1
#: Whether a text holds one of some fixed strings: a byte search each, where a pattern would try all at every place.
_any = lambda t, *words: reduce(lambda a, b: a | b, (F.contains(t, F.lit(w)) for w in words))
#: Whether a line begins with a fixed string.
_line_start = lambda t, s: t.startswith(s) | F.contains(t, F.lit("\n" + s))
#: Token pattern of the phrase encodings, as fixed.
TOKEN = r"(?U)\s+|[A-Za-z0-9_./:@=-]+|[^\w\s]"
#: White space as SQL's patterns take it.
_SPACE = r"\t\n\f\r "
_LEVELS = ["ERROR", "WARN", "INFO", "DEBUG", "TRACE", "CRITICAL"]


def _at_least(t: Column, unit: str, n: int, flags: str = "") -> Column:
    """Whether ``unit``, which gives back nothing, stands ``n`` times (a multiple of ten) at the beginning: the search ends there, keeps no match, and goes ten deep at a time."""
    return t.rlike(rf"{flags}\A(?:(?>(?:{unit}){{10}})){{{n // 10}}}")


def _tokens(n: int) -> Test:
    """The matches of TOKEN, each behind the letters that no token covers."""
    return lambda t: _at_least(t, r"[\w&&[^A-Za-z0-9_]]*+(?:\s++|[A-Za-z0-9_./:@=-]++|[^\w\s])", n, "(?U)")


def _ci_words(t: Column) -> Column:
    """The words in the lower-cased text; lower-casing costs, so it is done where the words could be. (The Kelvin sign is the one other character whose small letter is in them.)"""
    return t.rlike(r"[EFPTefpt](?:[Aa](?i:iled|ssed)|[Rr](?i:ror:|acebac[k\u212A])|[Yy](?i:test)|[Xx](?i:it code))") & F.lower(t).rlike("failed|traceback|error:|pytest|passed|exit code")


def _paragraphs(t: Column) -> Column:
    return F.filter(paragraphs(t), lambda c: F.length(c) > 40)


def _repeated(t: Column) -> Column:
    """Long paragraphs that repeat, of four or more; what parts them is a line feed before white space."""
    many = F.when(_any(t, *("\n" + c for c in "\n \t\r\f\v")), let(_paragraphs(t), lambda p: (F.size(p) >= 4) & (F.size(F.array_distinct(p)) < F.size(p))))
    return F.coalesce(many, F.lit(False))


def _has_run(t: Column) -> Column:
    """A run of 160 covers a whole block of 80, of those that the text is cut into; only a text with such a block is searched everywhere."""
    return t.rlike(r"(?s)\A(?:.{80})*?[A-Za-z0-9+/]{80}") & t.rlike(r"[A-Za-z0-9+/]{160}")


#: Detectors of text payloads, in the order in which equal costs are ranked; thresholds and words are fixed values. Those of records and trees are in operators/batches.py.
TEXT: dict[str, Test] = {
    "blob_ref": _has_run,
    "sidecar_ref": lambda t: F.length(t) >= 3000,
    "terraform_plan": lambda t: F.contains(t, F.lit("Terraform will perform")) | F.contains(t, F.lit("resource_changes")) | F.contains(t, F.lit("Plan:")),
    "k8s_yaml": lambda t: F.contains(t, F.lit("apiVersion")) & F.contains(t, F.lit("kind")) & _any(t, "metadata", "Deployment", "Service", "Pod", "ConfigMap"),
    "ci_output": lambda t: F.contains(t, F.lit("\n")) & _ci_words(t),
    "tool_output": lambda t: _any(t, "[terminal]", "[read_file]") | _line_start(t, "@@") | _line_start(t, "diff --git") | (F.contains(t, F.lit("|")) & t.rlike(rf"(?md)^[{_SPACE}]*\d+\|")),
    "html_visible": lambda t: F.contains(t, F.lit("<")) & t.rlike(rf"(?i)<(?:html|body|div|table|a[{_SPACE}])"),
    "markdown_outline": lambda t: _count(t, "\n#") >= 3,
    "code_symbols": lambda t: (_lines(t) >= 30) & t.rlike(rf"(?md)^[{_SPACE}]*(def|class|function|const|interface|type|package|func)[{_SPACE}]"),
    "domain_table": lambda t: (F.length(t) >= 400) & _any(t, "apiVersion:", "kind:", "metadata:", "# ", "<html", "<body"),
    "code_tokens": lambda t: (_lines(t) >= 20) & t.rlike(rf"(?md)^[{_SPACE}]*(def|class|import|from)\b"),
    "dedupe": _repeated,
    "chunk_store": lambda t: (F.length(t) >= 1200) & (F.contains(t, F.lit("\n\n")) | (_count(t, "\n") >= 20)),
    "separator_segments": lambda t: (F.length(t) >= 500) & (F.contains(t, F.lit("\n\n")) | F.contains(t, F.lit("---\n")) | (_count(t, "\n") >= 20)),
    "log_summary": lambda t: (_lines(t) >= 20) & _any(t, *_LEVELS) & t.rlike(r"\b(ERROR|WARN|WARNING|INFO|DEBUG|TRACE|CRITICAL)\b"),
    "log_templates": lambda t: _lines(t) >= 8,
    "xml_path": lambda t: F.ltrim(t).startswith("<") & t.endswith(">"),
    "meta_tokens": lambda t: F.length(t) >= 700,
    "token_lz": _tokens(120),
    "grammar": _tokens(150),
    "pattern_hash": lambda t: F.contains(t, F.lit("\n")),
    "transport_deflate": lambda t: F.length(t) >= 600,
    "extractive": lambda t: _at_least(t, rf"[{_SPACE}]*+[^{_SPACE}]++", 500),
}
#: Fixed value: rank among candidates of equal cost, for all encodings, detectors over trees included.
RANK = {k: i for i, k in enumerate(["session_delta", "blob_ref", "sidecar_ref", "openapi", "terraform_plan", "k8s_yaml", "ci_output", "tool_output", "html_visible", "markdown_outline", "code_symbols", "domain_table", "code_tokens", "dedupe", "chunk_store", "separator_segments", "log_summary", "log_templates", "shape_rows", "schema_rows", "tree_dict", "path_dict_rows", "atom_dict", "xml_shape_rows", "json_table", "json_path", "xml_path", "meta_tokens", "token_lz", "grammar", "pattern_hash", "transport_deflate", "binary", "extractive"])}


def detect(text: Column, names: list[str] | None = None) -> list[Column]:
    return [TEXT[k](text).alias(k) for k in names or TEXT]
