"""Encodings that columns can't say, all in one Arrow call: records, trees, XML, phrases, grammars, code, deflation.

A batch is parsed once; each payload's candidates are encoded, decoded again and
compared (JSON and XML in canonical form, so that 1, 1.0 and true differ).
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmill.functions.detect import RANK
from foldmill.functions.rowwise import by_row, pieces
from foldmill.functions.text import marker
from foldmill.operators import phrases as ph
from foldmill.operators import trees as tr
from foldmill.operators.summaries import EXTRACTS, split_paragraphs as paragraphs

_BROKEN = (ValueError, KeyError, IndexError, TypeError, AttributeError, RecursionError, ArithmeticError, SyntaxError)
_TREES = ["shape_rows", "schema_rows", "tree_dict", "path_dict_rows", "atom_dict", "json_table", "json_path"]
_XML = ["xml_shape_rows", "xml_path"]
#: Deflation and indexes take JSON by its compact text; phrases and code take texts.
_EITHER = ["domain_table", "transport_deflate"]
_TEXTS = ["code_tokens", "meta_tokens", "token_lz", "grammar"]
#: From that length on a text is referred to.
SIDECAR_CHARS = 3000
NAMES = [*_TREES, *_XML, *_EITHER, *_TEXTS]
#: Payloads of these have as many characters as their text has different runs of three, at least; of those by the second half as many.
_NAMED, _PARTED = ("meta_tokens", "token_lz", "grammar", "pattern_hash", "dedupe"), ("chunk_store", "separator_segments", "log_templates")
#: Encodings in columns that ``lost`` may name.
BOUNDED = ("pattern_hash", "dedupe", *_PARTED, "extractive")
#: What may make a template differ from its line.
_VALUES = re.compile(r"[=0-9]|[a-f]{8}")
_TYPE = "struct<is_json:boolean,baseline:string,lost:array<string>,made:array<struct<kind:string,rank:int,payload:string,round_trip:boolean>>>"

_ARROW = pa.struct([("is_json", pa.bool_()), ("baseline", pa.string()), ("lost", pa.list_(pa.string())), ("made", pa.list_(pa.struct([("kind", pa.string()), ("rank", pa.int32()), ("payload", pa.string()), ("round_trip", pa.bool_())])))])


def read_json(text: str | None):
    """(whether it is a JSON object or list, the value)."""
    head = (text or "").lstrip()[:1]
    if head in ("[", "{"):
        try:
            return True, json.loads(text)
        except (ValueError, RecursionError):
            pass
    return False, None


def _encode(kind: str, value, base: str, is_json: bool, delimiters: Sequence[str], most: float | None = None) -> tuple[str | None, bool]:
    """Payload (None where the encoding gives up, or can't have less than ``most`` characters) and whether it reads back."""
    if kind in _TREES:
        payload = tr.json_table(value, delimiters) if kind == "json_table" else tr.JSON[kind][0](value)
        return payload, payload is not None and tr.canonical(tr.JSON[kind][1](payload)) == tr.canonical(value)
    if kind in _XML:
        payload = tr.encode(kind, base)
        return payload, bool(payload is not None and tr.round_trip(kind, base, payload))
    if kind == "domain_table" and not is_json and not (len(base) >= 400 and any(x in base for x in ("apiVersion:", "kind:", "metadata:", "# ", "<html", "<body"))):
        return None, False
    if kind == "domain_table" and is_json and not (isinstance(value, dict) and value.keys() & {"openapi", "swagger", "resource_changes"}):
        return None, False
    encode, decode = ph.TEXT[kind]
    payload = ph.grammar(base, most) if kind == "grammar" else encode(base)
    return payload, payload is not None and decode(payload) == base


def lost(text: str, rivals: Sequence[str], most: float) -> list[str]:
    """Of ``rivals`` and of encodings by phrases those that give up or have ``most`` characters or more: what a payload must have is counted, which costs less than to make it."""
    out = []
    if "sidecar_ref" in rivals and len(text) >= SIDECAR_CHARS:
        runs = ph.trigrams(text)
        out += _NAMED if runs >= most else ()
        out += _PARTED if runs >= 2 * most else ()
        # Every line is written once.
        if runs < 2 * most and "---\n" not in text and sum(map(len, set(text.split("\n")))) >= most:
            out += ["pattern_hash", "dedupe", "chunk_store", "separator_segments"]
    if "extractive" in rivals:
        wide = sorted(map(len, paragraphs(text)))
        if sum(wide[: max(EXTRACTS[0], min(EXTRACTS[1], len(wide) // 5))]) >= most:
            out.append("extractive")
    if "log_templates" in rivals and "log_templates" not in out:
        lines = text.split("\n")
        # A line without values is its own template.
        if sum(not _VALUES.search(x) for x in set(lines)) > 0.85 * len(lines):
            out.append("log_templates")
    return out


def reference_chars(text: str) -> int:
    """Length of the payload of sidecar_ref."""
    return len(marker("sidecar_ref")) + len("\nsha256= chars=\npreview=") + 64 + len(str(len(text))) + min(400, len(text)) + text.count("\n", 0, 400)


def made(text: str | None, names: Sequence[str], delimiters: Sequence[str], per_token: float, best_only: bool, rivals: Sequence[str] = (), expands: bool = True) -> dict:
    """``rivals`` are the encodings in columns that compete, too; ``expands``: a payload may have more tokens than the text. With ``best_only``, what is certain to lose against a reference or the text isn't made, and lost names it."""
    is_json, value = read_json(text)
    base = tr.dump(value) if is_json else text
    out, tokens = [], lambda n: max(1, int(n / per_token))
    caps = [tokens(len(base))] if best_only and not expands and base else []
    # Marks of what was redacted may rule out the reference.
    if best_only and "sidecar_ref" in rivals and not is_json and base and len(base) >= SIDECAR_CHARS and "[REDACTED_" not in base:
        caps.append(tokens(reference_chars(base)))
    # So many characters are more tokens than the least of them.
    most = per_token * (min(caps) + 1) if caps else None
    beaten = [] if most is None or is_json else lost(base, rivals, most)
    for kind in names if text else ():
        if (kind in _TREES and not is_json) or (kind in _XML + _TEXTS and is_json) or kind in beaten:
            continue
        try:
            payload, same = _encode(kind, value, base, is_json, delimiters, most)
        except _BROKEN:  # not of this form, or the form can't carry it: no candidate
            continue
        if payload is not None:
            out.append((kind, RANK[kind], payload, same))
    if best_only:
        redacted = "[REDACTED_" in (base or "")
        ok = [c for c in out if c[3] and not (redacted and "[REDACTED_" not in c[2])]
        out = [min(ok, key=lambda c: (tokens(len(c[2])) if c[2] else 0, c[1]))] if ok else []
    return {"is_json": is_json, "baseline": base, "lost": beaten, "made": [dict(zip(("kind", "rank", "payload", "round_trip"), c)) for c in out]}


def with_parsed(payloads: DataFrame, name: str, names: Sequence[str], delimiters: Sequence[str], per_token: float, best_only: bool, rivals: Sequence[str] = (), expands: bool = True) -> DataFrame:
    """All columns of ``payloads`` and, under ``name``, a struct for its text: is_json, baseline, lost, made (the candidates of ``names``; the one of least cost only, with ``best_only``). For the rest see ``made``."""
    names, delimiters, at = list(names), list(delimiters), payloads.columns.index("text")

    def run(batches):
        for batch in batches:
            for begin, n in pieces(batch.num_rows, batch.nbytes / max(1, batch.num_rows)):
                piece = batch.slice(begin, n)
                rows = [made(t, names, delimiters, per_token, best_only, rivals, expands) for t in piece.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(rows, _ARROW)], names=[*batch.schema.names, name])

    return payloads.mapInArrow(run, payloads.withColumn(name, F.lit(None).cast(_TYPE)).schema)


def restore(payload: str | None) -> str | None:
    if payload is None:
        return None
    for kind in NAMES:
        if payload.startswith(marker(kind)):
            try:
                if kind in ph.TEXT:
                    return ph.TEXT[kind][1](payload)
                return tr.decode(kind, payload)
            except _BROKEN:
                return None
    return None


def restored(payload: Column) -> Column:
    return by_row(restore, "string", payload)



#: Detectors of JSON and XML payloads.
TREE_TESTS = ["session_delta", "openapi", "shape_rows", "schema_rows", "tree_dict", "path_dict_rows", "atom_dict", "xml_shape_rows", "json_table", "json_path"]


def tests(text: str | None) -> dict[str, bool]:
    """Which encodings of records and trees take a payload."""
    is_json, v = read_json(text)
    out = dict.fromkeys(TREE_TESTS, False)
    if is_json:
        n, records = len(tr.dump(v)), tr._is_records(v)
        keys = v.keys() if isinstance(v, dict) else ()
        out |= {
            "session_delta": "base" in keys and "current" in keys, "openapi": ("openapi" in keys or "swagger" in keys) and isinstance(v.get("paths"), dict),
            "shape_rows": tr._family(v) is not None, "schema_rows": records and len(v) >= 3 and all(tr._scalar(x) for r in v for x in r.values()),
            "tree_dict": n >= 700, "path_dict_rows": len(tr.leaves(v)) >= 20, "atom_dict": n >= 500, "json_table": records, "json_path": True,
        }
    elif text and text.lstrip().startswith("<"):
        out["xml_shape_rows"] = tr.encode("xml_shape_rows", text) is not None
    elif text:
        out["atom_dict"] = len(text) >= 500
    return out


def detected(text: Column) -> Column:
    """A struct of TREE_TESTS."""

    @F.pandas_udf("struct<" + ",".join(f"{k}:boolean" for k in TREE_TESTS) + ">")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tests(t) for t in texts], columns=TREE_TESTS)

    return run(text)
