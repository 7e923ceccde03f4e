"""Secret findings and redaction as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of secrets and their patterns, in the order of redaction.
PATTERNS = {
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "bearer_token": r"Bearer\s+[A-Za-z0-9._\-]{16,}",
    "api_key": r"(?i)(api[_-]?key|token|secret)\s*[=:]\s*['\"]?[A-Za-z0-9._\-]{16,}",
    "database_url": r"[a-z]+://[^\s:]+:[^\s@]+@[^\s]+",
}


def findings(text: Column) -> Column:
    """Array of kind, value: pattern by pattern, matches in order."""
    def one(kind: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    each = [one(kind) for kind in PATTERNS]
    return F.concat(*each)


def redact(text: Column) -> Column:
    return reduce(lambda t, kv: F.regexp_replace(t, kv[1], f"[REDACTED_{kv[0].upper()}]"), PATTERNS.items(), text)


def has_secret(text: Column) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(rx) for rx in PATTERNS.values()))


def gate(df: DataFrame, text: str = "text", redact_secrets: bool = False, allow: bool = False, strict: bool = False) -> DataFrame:
    """Adds ``blocked`` and ``safe_text``: payloads with secrets are redacted, let through, or blocked; ``strict`` fails the query instead."""
    found = has_secret(F.col(text))
    if redact_secrets:
        return df.withColumns({"blocked": F.lit(False), "safe_text": redact(F.col(text))})
    if allow:
        return df.withColumns({"blocked": F.lit(False), "safe_text": F.col(text)})
    safe = F.when(found, F.raise_error(F.lit("payload holds a secret")) if strict else F.lit(None).cast("string")).otherwise(F.col(text))
    return df.withColumns({"blocked": found, "safe_text": safe})
