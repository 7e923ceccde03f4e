"""Prompts, harness bundles, plugins and manifests: small tables joined to results, and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmill.functions.detect import RANK
from foldmill.functions.security import has_secret, redact
from foldmill.functions.text import marker
from foldmill.operators import requests as rq
from foldmill.operators.engine import Config, chosen, own_name

VERBOSITY = ["minimal", "standard", "debug"]
HARNESSES = ["generic", "claude", "openai", "gemini", "hermes", "codex"]
#: Other names of harnesses.
ALIASES = {"anthropic": "claude"}

_OPENING = ["The context below is written in a compact form that takes fewer tokens.", "Its first line is a marker such as <foldmill:json_table_v1>; read the rest by the rules for that marker.", "Reason over what it says as if it stood there in full.", "Don't speak of the compact form in the answer unless asked."]
_EXACT = ["meta_tokens", "token_lz", "separator_segments", "grammar", "path_dict_rows", "tree_dict", "shape_rows", "atom_dict", "xml_shape_rows", "chunk_store", "code_tokens"]
_SUMMARY = ["ci_output", "log_summary", "blob_ref", "openapi", "terraform_plan", "k8s_yaml", "markdown_outline", "html_visible", "code_symbols", "tool_output", "extractive"]


def rules_for(kind: str, delimiter: str = "|") -> list[str]:
    """How a payload of a kind is read."""
    named = f"{marker(kind)}:"
    if kind == "json_table":
        return [named, "- The line behind the marker names the columns; each line after it is one record.", f"- Cells stand in the order of the columns, between {delimiter!r}.", "- s: begins text, n: a number, j: JSON; a backslash escapes delimiters, line ends and itself."]
    if kind == "schema_rows":
        return [named, "- The header lists the columns of the rows, constants of every record, enums and transforms.", "- Each line behind @rows is an array of cells in the order of the columns.", "- Cells of an enum are places in its list; a sequence follows from start and step, a prefix stands before its cells."]
    if kind == "log_templates":
        return [named, "- @templates numbers the templates, with places {vN}.", "- Each line behind @rows is a template's number and its values, in order."]
    if kind in _EXACT:
        return [f"{named} an exact form with a dictionary, rules or references.", "- Put the entries in place of their signs where exact words matter; nothing is left out."]
    if kind in ("session_delta", "sidecar_ref"):
        return [f"{named} exact only together with the text that its digest names.", "- Digest and preview point to the text; they aren't the text."]
    if kind in ("transport_deflate", "domain_table"):
        return [f"{named} the exact source is deflated and must be inflated locally.", "- Without that, use the readable index only."]
    if kind == "pattern_hash":
        return [named, "- @dict names lines that repeat; @rows is the text with those names in their place."]
    if kind == "json_path":
        return [f"{named} each line is a path, =, and a JSON value."]
    if kind == "xml_path":
        return [f"{named} each line is an element's path with an attribute or its text."]
    if kind == "dedupe":
        return [f"{named} &digest=text is a paragraph, *digest the same one again."]
    if kind in _SUMMARY:
        return [f"{named} a summary, not the whole.", "- Use the counts, excerpts and digests that are shown.", "- Don't make up what isn't shown; ask for the source where exact words are needed."]
    return ["There is nothing to decode."]


def prompt(kind: str, verbosity: str = "standard", delimiter: str = "|") -> str:
    if verbosity not in VERBOSITY:
        raise ValueError(f"verbosity must be one of {VERBOSITY}")
    own = rules_for(kind, delimiter)
    if verbosity == "minimal":
        return " ".join([_OPENING[0], *own])
    if verbosity == "debug":
        own = [*own, "For instance, a|b and below it s:1|s:2 is a record with a = 1 and b = 2."]
    return "\n".join([*_OPENING, "", *own])


def prompts(spark: SparkSession) -> DataFrame:
    """kind, verbosity, system_prompt for every kind, ``none`` included."""
    return spark.createDataFrame([(k, v, prompt(k, v)) for k in ["none", *RANK] for v in VERBOSITY], "kind string, verbosity string, system_prompt string")


def with_prompt(results: DataFrame, verbosity: str = "standard") -> DataFrame:
    """``results`` (kind, payload and others) with system_prompt; empty for kind none. A table's prompt names its own delimiter."""
    table = F.broadcast(prompts(results.sparkSession).where(F.col("verbosity") == verbosity).drop("verbosity"))  # a row for each kind
    own = F.regexp_extract("payload", 'delimiter="(.)"', 1)
    text = F.when(F.col("kind") == "json_table", F.replace("system_prompt", F.lit("'|'"), F.concat(F.lit("'"), F.replace(own, F.lit("\t"), F.lit("\\t")), F.lit("'")))).when(F.col("kind") != "none", F.col("system_prompt")).otherwise("")
    return results.join(table, "kind", "left").withColumn("system_prompt", text)


def bundle(harness: Column, prompt: Column, payload: Column, task: Column) -> Column:
    """content and data (JSON of the request's parts) for a harness, by its name; null for unknown ones."""
    asked = F.coalesce(task, F.lit("")) != ""
    name = F.lower(harness)
    for a, b in ALIASES.items():
        name = F.when(name == a, b).otherwise(name)
    user = F.when(asked, F.concat(payload, F.lit("\n\nUser task:\n"), task)).otherwise(payload)
    end = lambda head: F.when(asked, F.concat(F.lit(head), task)).otherwise("")
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    own = F.when(prompt == "", "No rules are needed.").otherwise(prompt)
    parts = F.struct(own.alias("instructions"), payload.alias("payload"), F.coalesce(task, F.lit("")).alias("task"))
    hermes = F.concat(F.lit("Hermes: the rules below hold here only; don't keep them.\n\nINSTRUCTIONS:\n"), own, F.lit("\n\nPAYLOAD:\n"), payload, end("\n\nUSER_TASK:\n"))
    part = lambda text: F.array(F.struct(text.alias("text")))
    made = {
        "generic": (F.concat(F.lit("CONTEXT_INSTRUCTIONS:\n"), own, F.lit("\n\nPAYLOAD:\n"), payload, end("\n\nUSER_TASK:\n")), parts),
        "claude": (F.concat(F.lit("SYSTEM:\n"), prompt, F.lit("\n\nPAYLOAD:\n"), payload, end("\n\nUSER TASK:\n")), F.struct(prompt.alias("system"), F.array(turn("user", user)).alias("messages"))),
        "openai": (F.concat(F.lit("DEVELOPER:\n"), prompt, F.lit("\n\nUSER:\n"), user), F.struct(F.array(turn("developer", prompt), turn("user", user)).alias("messages"))),
        "gemini": (F.concat(F.lit("SYSTEM_INSTRUCTION:\n"), prompt, F.lit("\n\nCONTENT:\n"), user), F.struct(F.struct(part(prompt).alias("parts")).alias("system_instruction"), F.array(F.struct(F.lit("user").alias("role"), part(user).alias("parts"))).alias("contents"))),
        "hermes": (hermes, F.struct(hermes.alias("hermes_prompt"), F.lit('hermes chat -q "$(cat context.txt)"').alias("suggested_invocation"), own.alias("instructions"), payload.alias("payload"), F.coalesce(task, F.lit("")).alias("task"))),
        "codex": (F.concat(F.lit("CODEX_DEVELOPER_INSTRUCTIONS:\n"), prompt, F.lit("\n\nCODEX_INPUT:\n"), user), F.struct(prompt.alias("instructions"), user.alias("input"), F.array(turn("developer", prompt), turn("user", user)).alias("messages"))),
    }
    content, data = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (c, d) in {**made, **{k: f(prompt, payload, task) for k, f in _ADAPTERS.items()}}.items():
        content, data = F.when(name == k, c).otherwise(content), F.when(name == k, F.to_json(d)).otherwise(data)
    return F.struct(name.alias("harness"), content.alias("content"), data.alias("data"))


#: Harnesses of one's own: name to a function of prompt, payload and task (columns) that gives content and a struct.
_ADAPTERS: dict = {}


def register_harness(name: str, adapter) -> None:
    _ADAPTERS[name.lower()] = adapter


def manifests(spark: SparkSession) -> DataFrame:
    """name, harness, mode, hooks, transparent of the plugins."""
    last = {"generic": ("portable-pre-send", "request_rewrite", False), "claude": ("anthropic-compatible-request-rewrite", "messages_request", True), "openai": ("openai-compatible-request-rewrite", "chat_or_responses_request", True), "gemini": ("gemini-request-rewrite", "generate_content_request", True), "hermes": ("native-agent-hook", "pre_model_request", True), "codex": ("codex-wrapper-or-openai-middleware", "responses_request", False)}
    first = lambda h: ["pre_user_message", "pre_tool_result"] if h == "hermes" else ["pre_user_input", "pre_tool_output"]
    rows = [(f"foldmill-{h}", h, m, [*first(h), hook], t) for h, (m, hook, t) in last.items()]
    return spark.createDataFrame(rows, "name string, harness string, mode string, hooks array<string>, transparent boolean")


def prepare(inputs: DataFrame, harness: str = "generic", threshold: int = 512, redact_secrets: bool = False, allow_sensitive: bool = False, config: Config = Config()) -> DataFrame:
    """``inputs`` (text, source, task and others) with a last column, a struct: changed, content, strategy, reason, redacted.

    Texts under ``threshold`` stay (below_threshold), as do those that no encoding
    shortens (no_codec); a text with a secret is redacted, let through, or blocked
    (then there is no content). Others become the harness's bundle.
    """
    secret = F.coalesce(has_secret(F.col("text")), F.lit(False))
    short = F.coalesce(F.length("text") < threshold, F.lit(True))
    blocked = ~short & secret & F.lit(not (redact_secrets or allow_sensitive))
    safe = F.when(~blocked, F.when(secret & ~short & F.lit(redact_secrets), redact(F.col("text"))).otherwise(F.col("text")))
    row = F.struct(*(inputs[f"`{c}`"] for c in inputs.columns)).alias("row")
    own = inputs.select(row, F.col("task").alias("task"), short.alias("short"), blocked.alias("blocked"), (secret & ~short & F.lit(redact_secrets)).alias("redacted"), safe.alias("safe"), F.when(~short, safe).alias("text"))
    own = chosen(own, config)
    own = with_prompt(own.select("*", F.col("best.kind").alias("kind"), F.col("best.payload").alias("payload")))
    made = bundle(F.lit(harness), F.col("system_prompt"), F.col("payload"), F.col("task"))
    changed = ~F.col("short") & ~F.col("blocked") & (F.col("kind") != "none")
    reason = F.when(F.col("short"), "below_threshold").when(F.col("blocked"), "secret").when(F.col("kind") == "none", "no_codec")
    result = F.struct(changed.alias("changed"), F.when(changed, made["content"]).otherwise(F.col("safe")).alias("content"), F.when(changed, F.col("kind")).alias("strategy"), reason.alias("reason"), F.col("redacted").alias("redacted"))
    return own.select(*(F.col("row").getField(c).alias(c) for c in inputs.columns), result.alias(own_name(inputs, "prepared")))


def prepare_turns(turns: DataFrame, harness: str = "generic", **kwargs) -> DataFrame:
    """prepare() for user and tool turns (role, text and others); other turns and the rest of a request stay as they are."""
    tool = F.when(F.col("role") == "tool", "Interpret compressed tool output.").otherwise("")
    mine = turns.where(F.col("role").isin("user", "tool"))
    source = F.when(F.col("role") == "tool", "tool_output").otherwise("user_input")
    return prepare(mine.withColumns({"source": source, "task": tool}), harness, **kwargs)


def prepare_requests(requests: DataFrame, harness: str = "generic", **kwargs) -> DataFrame:
    """``requests`` (request_id, body) with the texts of user and tool messages prepared, and two more columns: the strategies of the rewrites, and whether the request is blocked (null body)."""
    digest = F.sha2(F.concat(F.coalesce(F.col("request_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("body", F.lit(""))), 256)
    key, strategies, blocked = (own_name(requests, n) for n in ("_key", "rewrites", "blocked"))
    keyed = requests.withColumn(key, digest)
    found = rq.body_targets(keyed.select(F.col(key).alias("request_id"), "body").dropDuplicates(["request_id"]), 0)
    found = found.where(F.col("source").isin("user_text", "tool_result") & F.col("path").rlike(r"^messages\[\d+\]\.content$"))
    tool = F.when(F.col("source") == "tool_result", "Interpret compressed tool output.").otherwise("")
    made = prepare(found.withColumn("task", tool), harness, **kwargs)
    told = made.groupBy("request_id").agg(F.array_sort(F.collect_list(F.when(F.col("prepared.changed"), F.col("prepared.strategy")))).alias(strategies), F.max(F.col("prepared.reason") == "secret").alias(blocked), F.collect_list(F.when(F.col("prepared.changed"), F.struct("path", F.col("prepared.content").alias("text")))).alias("_changes"))
    out = keyed.join(told.withColumnsRenamed({"request_id": key}), key, "left")
    body = F.when(~F.coalesce(blocked, F.lit(False)), rq.patched(F.col("body"), F.col("_changes")))
    return out.select(*(body.alias("body") if c == "body" else F.col(f"`{c}`") for c in requests.columns), F.coalesce(strategies, F.array()).alias(strategies), F.coalesce(blocked, F.lit(False)).alias(blocked))
