"""Candidates and the choice among them.

Every enabled encoding is an expression over the payload's own row: those that
columns can say run in the JVM, the others in one Arrow call a batch. Candidates
stay in the row, and the choice is the least of an array, so one scan does it all:
nothing is shuffled, and no key is needed.

A text that is a JSON object or list is a JSON payload: its baseline is the
compact JSON, and encodings of records and trees compete; other payloads are
texts. Null text gives kind ``none`` and null payload; equal costs go by RANK;
binary payloads (``raw``) stay as they are, kind ``none``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmill.functions.detect import RANK, TEXT
from foldmill.functions.text import est_tokens, let, pct_saved
from foldmill.operators import analytical as an
from foldmill.operators import batches as ba
from foldmill.operators import dictionary as di
from foldmill.operators import summaries as su

Estimator = Callable[[Column], Column]


@dataclass(frozen=True)
class Codec:
    """An encoding that columns can say. ``decode`` is None where it is lossy, or restores from the store; ``of_json`` where it takes JSON payloads, ``of_text`` where it takes texts."""

    name: str
    test: Callable[[Column], Column]
    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column] | None = None
    reversible: bool = False
    of_json: bool = False
    of_text: bool = True


_JVM = [
    Codec("blob_ref", TEXT["blob_ref"], an.blob_ref, of_json=True),
    Codec("sidecar_ref", TEXT["sidecar_ref"], di.sidecar_ref, reversible=True),
    Codec("openapi", lambda t: F.lit(True), su.openapi, of_json=True, of_text=False),
    Codec("terraform_plan", TEXT["terraform_plan"], su.terraform_plan, of_json=True),
    Codec("k8s_yaml", TEXT["k8s_yaml"], su.k8s_yaml, of_json=True),
    Codec("ci_output", TEXT["ci_output"], an.ci_output),
    Codec("tool_output", TEXT["tool_output"], an.tool_output),
    Codec("html_visible", TEXT["html_visible"], an.html_visible),
    Codec("markdown_outline", TEXT["markdown_outline"], an.markdown_outline),
    Codec("code_symbols", TEXT["code_symbols"], an.code_symbols),
    Codec("dedupe", TEXT["dedupe"], di.dedupe, di.dedupe_decode, True),
    Codec("chunk_store", TEXT["chunk_store"], di.chunk_store, di.chunk_store_decode, True),
    Codec("separator_segments", TEXT["separator_segments"], di.separator_segments, di.separator_segments_decode, True),
    Codec("log_summary", TEXT["log_summary"], su.log_summary),
    Codec("log_templates", TEXT["log_templates"], su.log_templates, su.log_templates_decode, True),
    Codec("pattern_hash", TEXT["pattern_hash"], di.pattern_hash, di.pattern_hash_decode, True),
    Codec("extractive", TEXT["extractive"], su.extractive),
]
_OWN = {c.name: c for c in _JVM}
#: Encodings by name; register() adds to them. Those of ``batches`` run in Python.
CODECS: dict[str, Codec] = {c.name: c for c in _JVM}
CLASSES = {"none": "none", "transport_deflate": "local_decode_reversible", "sidecar_ref": "externalized_reversible", "session_delta": "externalized_reversible", "blob_ref": "externalized_reversible"}


def register(codec: Codec, rank: int | None = None) -> None:
    """Lets an encoding of one's own compete; ``rank`` breaks ties (behind all others by default)."""
    CODECS[codec.name] = codec
    RANK[codec.name] = max(RANK.values()) + 1 if rank is None else rank


@dataclass(frozen=True)
class Config:
    """Knobs of the engine. ``estimate`` is the token estimator, a column of a column; None stands for characters by ``chars_per_token``."""

    cost_per_million: float = 3.0
    chars_per_token: float = 4.0
    minimum_chars: int = 0
    allow_expansion: bool = False
    reversible_only: bool = False
    transport: bool = False
    delimiters: tuple[str, ...] = field(default=("|", "\t", "¦", "~"))
    estimate: Estimator | None = None

    def __post_init__(self):
        if self.chars_per_token <= 0 or self.cost_per_million < 0 or self.minimum_chars < 0:
            raise ValueError("chars_per_token must be positive, cost_per_million and minimum_chars not negative")
        if not self.delimiters:
            raise ValueError("a delimiter is needed")

    def tokens(self, text: Column) -> Column:
        return self.estimate(text) if self.estimate else est_tokens(text, self.chars_per_token)


def is_reversible(kind: str) -> bool:
    return kind in ba.NAMES or CODECS[kind].reversible


def reversibility(kind: Column) -> Column:
    """Class of an encoding, for policies."""
    names = [k for k in [*CODECS, *ba.NAMES] if is_reversible(k) and k not in CLASSES]
    out = F.when(kind.isin(names), "prompt_readable_reversible").otherwise("lossy_analytical")
    for k, v in CLASSES.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def _names(config: Config, names: list[str] | None) -> list[str]:
    own = names or [*CODECS, *ba.NAMES]
    return [k for k in own if (not config.reversible_only or is_reversible(k)) and (config.transport or k != "transport_deflate")]


_KINDS = "struct<kind:string,rank:int,payload:string,tokens:bigint,reversible:boolean,round_trip:boolean>"


def _all(parsed: Column, config: Config, names: list[str]) -> Column:
    """Array of all candidates of a payload that ``batches`` has parsed (is_json, baseline, lost, made)."""
    base, is_json = parsed["baseline"], parsed["is_json"]

    def one(c: Codec) -> Column:
        beaten = F.array_contains(parsed["lost"], c.name) if c.name in ba.BOUNDED and _OWN.get(c.name) is c else F.lit(False)
        fits = ~beaten & c.test(base) & F.when(is_json, F.lit(c.of_json)).otherwise(F.lit(c.of_text)) & (F.length(base) >= config.minimum_chars)

        def made(p: Column) -> Column:
            back = F.lit(None).cast("boolean") if not c.reversible else F.coalesce(c.decode(p) == base, F.lit(False)) if c.decode else F.lit(True)
            return F.when(p.isNotNull(), F.struct(F.lit(c.name).alias("kind"), F.lit(RANK[c.name]).alias("rank"), p.alias("payload"), config.tokens(p).alias("tokens"), F.lit(c.reversible).alias("reversible"), back.alias("round_trip")))

        return F.when(fits, let(c.encode(base), made)).cast(_KINDS)

    jvm = [one(CODECS[k]) for k in names if k in CODECS]
    other = F.filter(F.transform(parsed["made"], lambda m: F.struct(m["kind"].alias("kind"), m["rank"].alias("rank"), m["payload"].alias("payload"), config.tokens(m["payload"]).alias("tokens"), F.lit(True).alias("reversible"), m["round_trip"].alias("round_trip")).cast(_KINDS)), lambda m: F.length(base) >= config.minimum_chars)
    return F.concat(F.filter(F.array(*jvm), lambda c: c.isNotNull()), other) if jvm else other


def _parsed(payloads: DataFrame, config: Config, names: list[str], best_only: bool) -> DataFrame:
    """``payloads`` with a column of what ``batches`` makes of the text, under a name that no column has."""
    return ba.with_parsed(payloads, own_name(payloads, "_parsed"), [k for k in names if k in ba.NAMES], config.delimiters, config.chars_per_token, best_only, [k for k in names if k in _OWN and CODECS[k] is _OWN[k]], config.allow_expansion)


def own_name(df: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def candidates(payloads: DataFrame, config: Config = Config(), names: list[str] | None = None) -> DataFrame:
    """payload_id, text, kind, payload, tokens, reversible, round_trip for each candidate of ``payloads`` (payload_id, text)."""
    own = _names(config, names)
    made = _parsed(payloads.select("payload_id", "text"), config, own, False)
    out = made.select("payload_id", "text", F.explode(_all(F.col("_parsed"), config, own)).alias("c"))
    return out.select("payload_id", "text", "c.kind", "c.payload", "c.tokens", "c.reversible", "c.round_trip")


def chosen(payloads: DataFrame, config: Config = Config(), names: list[str] | None = None) -> DataFrame:
    """All columns of ``payloads`` and, last, a struct of the choice for ``text``: baseline, raw_tokens, kind, payload, tokens; named best, with underscores before it where there is such a column."""
    own = _names(config, names)
    best_only = config.estimate is None
    made = _parsed(payloads, config, own, best_only)
    at, out = made.columns[-1], own_name(payloads, "best")

    def choice(p: Column) -> Column:
        base = p["baseline"]
        raw = config.tokens(base)
        lost = lambda c: F.contains(base, F.lit("[REDACTED_")) & ~F.contains(c["payload"], F.lit("[REDACTED_"))
        ok = F.filter(_all(p, config, own), lambda c: (~c["reversible"] | c["round_trip"]) & ~lost(c))
        least = F.array_min(F.transform(ok, lambda c: F.struct(c["tokens"].alias("tokens"), c["rank"].alias("rank"), c["kind"].alias("kind"), c["payload"].alias("payload"))))

        def kept(b: Column) -> Column:
            use = F.coalesce(b.isNotNull() & (F.lit(config.allow_expansion) | (b["tokens"] <= raw)), F.lit(False))
            pick = lambda a, o: F.when(use, a).otherwise(o)
            return F.struct(base.alias("baseline"), raw.alias("raw_tokens"), pick(b["kind"], F.lit("none")).alias("kind"), pick(b["payload"], base).alias("payload"), pick(b["tokens"], raw).alias("tokens"))

        return let(least, kept)

    return made.select(*(F.col(f"`{c}`") for c in payloads.columns), let(F.col(at), choice).alias(out))


def best(payloads: DataFrame, config: Config = Config(), names: list[str] | None = None) -> DataFrame:
    """payload_id, text, raw_tokens, kind, payload, tokens, pct_saved of every row: the candidate with the fewest estimated tokens, or kind ``none``."""
    out = chosen(payloads.select("payload_id", "text"), config, names)
    out = out.select("payload_id", "text", "best.raw_tokens", "best.kind", "best.payload", "best.tokens")
    return out.withColumn("pct_saved", pct_saved(F.col("raw_tokens"), F.col("tokens")))


def decoded(payload: Column) -> Column:
    """The text or compact JSON of a payload, told by its first line; null where it can't be restored from the payload alone; a text without a marker is itself."""
    name = F.regexp_extract(payload, r"^<foldmill:([a-z0-9_]+)_v1>", 1)
    out = F.when(name == "", payload)
    for c in CODECS.values():
        if c.decode:
            out = out.when(name == c.name, c.decode(payload))
    return out.when(name.isin(ba.NAMES), ba.restored(payload))




__all__ = ["CLASSES", "CODECS", "Codec", "Config", "best", "candidates", "chosen", "decoded", "register", "reversibility"]
