"""Request rewriting: text targets, policies, rewrites of turns and of whole bodies, telemetry, statistics.

Text with a secret never leaves: unless the configuration redacts it or lets it
through, the target is blocked, and a body with a blocked target is not given
out at all. Targets are rewritten within their own row; whole bodies are put
together again by a digest of the request, so requests that share an id don't mix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmill.functions.security import has_secret, redact
from foldmill.functions.text import est_tokens
from foldmill.operators import requests as rq
from foldmill.operators.engine import CLASSES, Config, chosen, own_name, reversibility

MODES = ["strict", "externalized", "local_decode", "lossy_allowed"]
SOURCES = rq.SOURCES
#: Kinds that are sent as a reference to the store.
BY_REFERENCE = ["sidecar_ref", "blob_ref"]
INSTRUCTION = "Texts that begin with <foldmill:NAME_v1> are encoded; read them by their marker. Rows behind @rows belong to the header's columns, constants go to every record, numbers of an enum name its entries, and null cells of a sequence follow from its start and step. A text with foldmill://sha256/DIGEST stands for a stored original: fetch it where its exact words are needed, and don't make them up."
HINT = "Answer briefly. Repeat encoded context only where it is needed, and keep exact values where they are asked for."


@dataclass(frozen=True)
class Policy:
    """How requests are rewritten."""

    mode: str = "strict"
    threshold: int = 512
    redact: bool = False
    allow_sensitive: bool = False
    allow_lossy: bool = False
    instruction: bool = True
    instruction_first: bool = False
    shaping: bool = False
    verbosity: str = "none"
    effort_routing: bool = False

    def __post_init__(self):
        if self.mode not in MODES or self.threshold < 0:
            raise ValueError(f"mode must be one of {MODES}, threshold not negative")

    @property
    def config(self) -> Config:
        return Config(reversible_only=not (self.allow_lossy or self.mode == "lossy_allowed"), transport=self.mode == "local_decode")


def targets(turns: DataFrame, threshold: int = 512) -> DataFrame:
    """conv_id, turn, source, path, text of the turns (conv_id, turn, role, text) that are long enough and not encoded yet."""
    source = F.lit(None).cast("string")
    for role, name in SOURCES.items():
        source = F.when(F.col("role") == role, name).otherwise(source)
    ok = F.col("role").isin(*SOURCES) & (F.length("text") >= threshold) & ~F.contains("text", F.lit(rq.MARK))
    return turns.where(ok).select("conv_id", "turn", source.alias("source"), F.concat(F.lit("messages["), F.col("turn").cast("string"), F.lit("].content")).alias("path"), "text")


def decide(kind_class: Column, mode: Column, lossy: bool = False) -> tuple[Column, Column]:
    """Whether a class of encoding is allowed in a mode, and why."""
    local, outside = kind_class == "local_decode_reversible", kind_class == "externalized_reversible"
    reason = (
        F.when(kind_class == "none", "no_optimization").when(kind_class == "prompt_readable_reversible", "prompt_readable_reversible_allowed")
        .when(outside & (mode != "strict"), "externalized_reversible_allowed").when(outside, "externalized_requires_retrieval")
        .when(local & (mode == "local_decode"), "local_decode_available").when(local, "local_decode_not_available")
        .when((mode == "lossy_allowed") | F.lit(lossy), "lossy_explicitly_allowed").otherwise("lossy_not_allowed")
    )
    return reason.isin("prompt_readable_reversible_allowed", "externalized_reversible_allowed", "local_decode_available", "lossy_explicitly_allowed"), reason


def decision_table(spark: SparkSession) -> DataFrame:
    classes = ["none", "prompt_readable_reversible", "externalized_reversible", "local_decode_reversible", "lossy_analytical"]
    rows = spark.createDataFrame([(c, m) for c in classes for m in MODES], "class string, mode string")
    allowed, reason = decide(F.col("class"), F.col("mode"))
    return rows.withColumns({"allowed": allowed, "reason": reason})


#: Columns that rewrite_targets() adds, in a struct.
RESULT = ["blocked", "redacted", "digest", "kind", "class", "applied", "reason", "chars_before", "chars_after", "safe_text", "new_text"]


def rewrite_targets(found: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """All columns of ``found`` but its text, and, last, a struct of RESULT for each row.

    A blocked target has neither safe nor new text. JSON inside a text is what is
    encoded, where there is any; a rewrite must have fewer characters than the safe text.
    """
    secret = has_secret(F.col("text"))
    blocked = F.lit(False) if policy.redact or policy.allow_sensitive else F.coalesce(secret, F.lit(False))
    safe = F.when(~blocked, F.when(secret, redact(F.col("text"))).otherwise(F.col("text")) if policy.redact else F.col("text"))
    names = [c for c in found.columns if c != "text"]
    row = F.struct(*(found[f"`{c}`"] for c in names)).alias("row") if names else F.struct(F.lit(0).alias("_")).alias("row")
    gated = found.select(row, F.col("text").alias("original"), blocked.alias("blocked"), F.coalesce(secret & F.lit(policy.redact), F.lit(False)).alias("redacted"), safe.alias("safe"))
    inner = gated.withColumn("text", F.coalesce(rq.embedded_json(F.coalesce("safe", F.lit("")))["json"], F.col("safe")))
    own = chosen(inner, policy.config)
    kind, safe = F.col("best.kind"), F.col("safe")
    digest = F.sha2(safe, 256)
    own = own.withColumn("class", reversibility(kind))
    allowed, reason = decide(F.col("class"), F.lit(policy.mode), policy.allow_lossy)
    outside = F.concat_ws("\n", F.lit("<foldmill:external_ref_v1>"), F.concat(F.lit("uri=foldmill://sha256/"), digest), F.concat(F.lit("chars="), F.length(safe).cast("string")))
    sent = F.when(kind.isin(BY_REFERENCE), outside).otherwise(F.col("best.payload"))
    own = own.withColumns({"sent": sent, "ok": allowed & ~F.col("blocked"), "why": F.when(F.col("blocked"), "secret").otherwise(reason)})
    applied = F.coalesce(F.col("ok") & (F.length("sent") < F.length("safe")), F.lit(False))
    new = F.when(applied, F.col("sent")).otherwise(safe)
    made = {
        "blocked": F.col("blocked"), "redacted": F.col("redacted"), "digest": digest, "kind": F.when(~F.col("blocked"), kind), "class": F.when(~F.col("blocked"), F.col("class")),
        "applied": applied, "reason": F.when(F.col("ok") & ~applied, "no_positive_savings").otherwise(F.col("why")),
        "chars_before": F.length("original").cast("long"), "chars_after": F.length(new).cast("long"), "safe_text": safe, "new_text": new,
    }
    result = own_name(found, "result")
    return own.select(*(F.col("row").getField(c).alias(c) for c in names), F.struct(*(made[c].alias(c) for c in RESULT)).alias(result))


def rewrite(turns: DataFrame, mode: str = "strict", threshold: int = 512, policy: Policy | None = None) -> DataFrame:
    """conv_id, turn, kind, class, applied, reason, blocked, digest, chars and tokens before and after, new_text of every target; blocked ones have no text."""
    own = policy or Policy(mode=mode, threshold=threshold)
    out = rewrite_targets(targets(turns, own.threshold), own).select("conv_id", "turn", "result.*")
    before, after = est_tokens(F.col("safe_text")), est_tokens(F.col("new_text"))
    return out.select("conv_id", "turn", "kind", "class", "applied", "reason", "blocked", "digest", "chars_before", "chars_after", before.alias("tokens_before"), after.alias("tokens_after"), "new_text")


def rewrite_requests(requests: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """All columns of ``requests`` (request_id, body), the body rewritten, and format, decision, rewrites, rejections, warnings, prompt_added.

    decision is rewrite, continue, or blocked (then the body is null). Rows with equal
    id and body get equal results; a null or unreadable body has no targets and stays.
    """
    key = own_name(requests, "_key")
    digest = F.sha2(F.concat(F.coalesce(F.col("request_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("body", F.lit(""))), 256)
    keyed = requests.withColumn(key, digest)
    once = keyed.select(F.col(key).alias("request_id"), "body").dropDuplicates(["request_id"])
    found = rewrite_targets(rq.body_targets(once, policy.threshold), policy)
    result = found.columns[-1]
    found = found.select("request_id", "path", "source", f"{result}.*")
    r = F.col
    fact = F.struct("path", "source", r("kind").alias("strategy"), "chars_before", "chars_after", (r("chars_before") - r("chars_after")).alias("saved_chars"), r("class").alias("reversibility_class"), r("digest").alias("stored_digest"))
    warned = F.when(r("redacted"), F.lit("suspected secrets were redacted"))
    told = found.groupBy("request_id").agg(
        F.max("blocked").alias("blocked"), F.array_sort(F.collect_list(F.when(r("applied"), fact))).alias("rewrites"),
        F.array_sort(F.collect_list(F.when(~r("applied"), r("reason")))).alias("rejections"), F.collect_set(warned).alias("warnings"),
        F.collect_list(F.when(r("applied") | r("redacted"), F.struct("path", r("new_text").alias("text")))).alias("changes"),
    )
    told = told.withColumnsRenamed({"request_id": key})
    names = [c for c in requests.columns if c != "body"]
    out = keyed.select(F.struct(*(keyed[f"`{c}`"] for c in names)).alias("row"), "body", key).join(told, key, "left")
    any_left = F.coalesce(F.size("rewrites") > 0, F.lit(False))
    blocked = F.coalesce("blocked", F.lit(False))
    out = out.select("row", blocked.alias("blocked"), any_left.alias("any"), F.coalesce("rewrites", F.array()).alias("rewrites"), F.coalesce("rejections", F.array()).alias("rejections"), F.coalesce("warnings", F.array()).alias("warnings"), rq.body_format("body").alias("format"), F.when(~blocked, F.coalesce(rq.patched(F.col("body"), F.col("changes")), F.col("body"))).alias("body"))
    patched = F.col("body")
    if policy.instruction:
        patched = F.when(F.col("any"), rq.with_instruction(patched, INSTRUCTION, policy.instruction_first)).otherwise(patched)
    out = out.withColumn("made", patched)
    if policy.shaping and policy.verbosity != "none":
        out = out.withColumn("made", rq.shaped(F.col("made"), HINT, policy.instruction_first, policy.effort_routing))
    decision = F.when(F.col("blocked"), "blocked").when(F.col("any"), "rewrite").otherwise("continue")
    added = F.coalesce(F.col("made") != F.col("body"), F.lit(False))
    pick = lambda c: F.col("made").alias(c) if c == "body" else F.col("row").getField(c).alias(c)
    return out.select(*(pick(c) for c in requests.columns), "format", decision.alias("decision"), "rewrites", "rejections", "warnings", added.alias("prompt_added"))


def request_hook(payloads: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """request_id, hook (name, version), decision, request, telemetry of ``payloads`` (request_id, body): a body may be a request or an envelope with one."""
    out = rewrite_requests(payloads.select("request_id", rq.unwrapped(F.col("body")).alias("body")), policy)
    facts = F.struct("format", F.size("rewrites").alias("rewrite_count"), "rewrites", "rejections", "warnings", "prompt_added")
    return out.select("request_id", F.struct(F.lit("foldmill.request_rewrite").alias("name"), F.lit(1).alias("version")).alias("hook"), "decision", F.col("body").alias("request"), facts.alias("telemetry"))


def is_rewritten_route(route: Column) -> Column:
    """Whether requests to a route are rewritten: messages, chat completions and responses, at any prefix."""
    return F.rtrim(route, F.lit("/")).rlike("/(messages|chat/completions|responses)$")


def telemetry(rewrites: DataFrame) -> DataFrame:
    """Totals of each conversation; sums only, since a conversation may be of any length. The rewrites of one request, listed, come with rewrite_requests()."""
    return rewrites.groupBy("conv_id").agg(F.count(F.lit(1)).alias("targets"), F.count_if("applied").alias("applied"), F.count_if("blocked").alias("blocked"), F.sum("tokens_before").alias("tokens_before"), F.sum("tokens_after").alias("tokens_after"))


def stats(rewrites: DataFrame) -> DataFrame:
    """Counts and savings by kind, class and reason, in one pass."""
    return rewrites.groupingSets([["kind"], ["class"], ["reason"], []], "kind", "class", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("tokens_before") - F.col("tokens_after")).alias("saved"))


__all__ = ["CLASSES", "Policy", "decide", "decision_table", "is_rewritten_route", "request_hook", "rewrite", "rewrite_requests", "rewrite_targets", "stats", "targets", "telemetry"]
