"""Request bodies in JSON: format, text targets, write-back by path, instructions, JSON inside text.

Shapes differ by row, so bodies are read by Arrow batches of Python, a row at a
time; what follows from the targets is relational. Bodies that are null or not a
JSON object have no targets and stay as they are.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

#: Roles whose text is a target; all others are left alone.
SOURCES = {"user": "user_text", "tool": "tool_result", "developer": "developer_text"}
#: A text that holds this is encoded already.
MARK = "<foldmill:"
_STEP = re.compile(r"([A-Za-z_]+)|\[(\d+)\]")


def _read(body: str | None) -> dict | None:
    try:
        found = json.loads(body) if body else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _write(body: dict) -> str:
    return json.dumps(body, ensure_ascii=False, separators=(",", ":"))


def _kind(body: dict) -> str:
    if "messages" in body and ("system" in body or "anthropic-version" in body):
        return "anthropic"
    return "openai" if "messages" in body or "input" in body else "unknown"


def _blocks(items: list, path: str, source: str, types: tuple[str, ...], nested: bool):
    for j, block in enumerate(items):
        if not isinstance(block, dict):
            continue
        here = f"{path}[{j}]"
        if block.get("type") in types and isinstance(block.get("text"), str):
            yield f"{here}.text", source, block["text"]
        elif nested and block.get("type") == "tool_result":
            inner = block.get("content")
            if isinstance(inner, str):
                yield f"{here}.content", "tool_result", inner
            elif isinstance(inner, list):
                yield from _blocks(inner, f"{here}.content", "tool_result", ("text",), False)


def _found(body: dict):
    """path, source, text of every text that a request may have encoded."""
    claude = _kind(body) == "anthropic"
    types = ("text",) if claude else ("text", "input_text")
    turns = [("messages", body.get("messages"), None)]
    if not claude:
        turns.append(("input", body.get("input"), "user_text"))
    for key, items, default in turns:
        if default and isinstance(items, str):
            yield key, default, items
        for i, item in enumerate(items if isinstance(items, list) else ()):
            if default and isinstance(item, str):
                yield f"{key}[{i}]", default, item
            if not isinstance(item, dict) or item.get("role") in ("assistant", "system"):
                continue
            role = item.get("role")
            source = SOURCES.get(role, default) if isinstance(role, str) else default
            content, path = item.get("content"), f"{key}[{i}].content"
            if source and isinstance(content, str):
                yield path, source, content
            elif source and isinstance(content, list):
                yield from _blocks(content, path, source, types, claude)


@F.pandas_udf(ArrayType(StructType().add("path", StringType()).add("source", StringType()).add("text", StringType())))
def _targets(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: [dict(zip(("path", "source", "text"), t)) for t in _found(_read(b) or {})])


@F.pandas_udf(StringType())
def body_format(bodies: pd.Series) -> pd.Series:
    """anthropic, openai or unknown."""
    return bodies.map(lambda b: _kind(_read(b) or {}))


def body_targets(requests: DataFrame, threshold: int = 512) -> DataFrame:
    """request_id, path, source, text of the targets of ``requests`` (request_id, body) that are long enough and not encoded yet."""
    found = requests.select("request_id", F.explode(_targets("body")).alias("t")).select("request_id", "t.*")
    return found.where((F.length("text") >= threshold) & ~F.contains("text", F.lit(MARK)))


def _put(body: dict, path: str, text: str) -> None:
    """Sets the text at ``path``, where there is a text now; other paths are passed over."""
    steps = [name or int(place) for name, place in _STEP.findall(path)]
    at = body
    try:
        for step in steps[:-1]:
            at = at[step]
        if isinstance(at[steps[-1]], str):
            at[steps[-1]] = text
    except (KeyError, IndexError, TypeError):
        return


@F.pandas_udf(StringType())
def patched(bodies: pd.Series, changes: pd.Series) -> pd.Series:
    def one(body, own):
        found = _read(body)
        if found is None or own is None or not len(own):
            return body
        for c in own:
            _put(found, c["path"], c["text"])
        return _write(found)

    return pd.Series([one(b, c) for b, c in zip(bodies, changes)], dtype=object)


@F.pandas_udf(StringType())
def unwrapped(payloads: pd.Series) -> pd.Series:
    """The request of an envelope (an object under request or body), or the payload itself."""

    def one(raw):
        found = _read(raw)
        inner = next((found[k] for k in ("request", "body") if isinstance(found.get(k), dict)), None) if found else None
        return raw if inner is None else _write(inner)

    return payloads.map(one, na_action="ignore")


def shaped(body: Column, hint: str, first: bool = False, effort: bool = False) -> Column:
    """``body`` with a hint on the length of answers in its system part and, with ``effort``, low reasoning effort where it names one."""

    @F.pandas_udf(StringType())
    def lowered(bodies: pd.Series) -> pd.Series:
        def one(raw):
            found = _read(raw)
            if found is None or not ("reasoning_effort" in found or isinstance(found.get("reasoning"), dict)):
                return raw
            if "reasoning_effort" in found:
                found["reasoning_effort"] = "low"
            else:
                found["reasoning"]["effort"] = "low"
            return _write(found)

        return bodies.map(one, na_action="ignore")

    out = with_instruction(body, hint, first)
    return lowered(out) if effort else out


def write_back(requests: DataFrame, changes: DataFrame) -> DataFrame:
    """``requests`` with the texts of ``changes`` (request_id, path, text) put into their bodies; one shuffle by request_id."""
    own = changes.groupBy("request_id").agg(F.collect_list(F.struct("path", "text")).alias("_changes"))
    return requests.join(own, "request_id", "left").withColumn("body", patched("body", "_changes")).select(*requests.columns)


def _joined(old: str, new: str, first: bool) -> str:
    return "\n\n".join(x for x in ((new, old) if first else (old, new)) if x)


def _added(holder: dict, key: str, new: str, first: bool) -> None:
    """Adds a text to a string or to a list of blocks."""
    old = holder.get(key)
    if isinstance(old, list):
        old.insert(0 if first else len(old), {"type": "text", "text": new})
    else:
        holder[key] = _joined(old if isinstance(old, str) else "", new, first)


def with_instruction(body: Column, text: str, first: bool = False) -> Column:
    """``body`` with an instruction in its system part, at the end or at the beginning; a body that has the text already stays."""

    @F.pandas_udf(StringType())
    def run(bodies: pd.Series) -> pd.Series:
        def one(raw):
            found = _read(raw)
            if found is None or _kind(found) == "unknown":
                return raw
            turns = found.get("messages")
            if _kind(found) == "anthropic":
                holder, key = found, "system"
            elif isinstance(turns, list):
                holder, key = next((m for m in turns if isinstance(m, dict) and m.get("role") == "system"), None), "content"
                if holder is None:
                    holder = {"role": "system", "content": ""}
                    turns.insert(0, holder)
            else:
                holder, key = found, "instructions"
            if text in json.dumps(holder.get(key), ensure_ascii=False) or text in str(holder.get(key)):
                return raw
            _added(holder, key, text, first)
            return _write(found)

        return bodies.map(one, na_action="ignore")

    return run(body)


@F.pandas_udf(StructType().add("json", StringType()).add("start", LongType()).add("end", LongType()).add("rest", StringType()))
def embedded_json(texts: pd.Series) -> pd.DataFrame:
    """The first object or list in a text: its JSON as it stands there, where it begins and ends (code points, end exclusive), and the text around it; nulls without one."""
    rows, decoder = [], json.JSONDecoder()
    for text in texts:
        row = (None, None, None, None)
        for m in re.finditer(r"[\[{]", text or ""):
            try:
                _, end = decoder.raw_decode(text, m.start())
            except (ValueError, RecursionError):
                continue
            row = (text[m.start() : end], m.start(), end, (text[: m.start()] + text[end:]).strip())
            break
        rows.append(row)
    return pd.DataFrame(rows, columns=["json", "start", "end", "rest"]).astype({"start": "Int64", "end": "Int64"})
