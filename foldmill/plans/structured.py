"""Queries over records, trees, rendered resources and phrases. Round trips give back the rows that the payloads were made from, so SQL over the base tables checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldmill.functions.detect import TEXT
from foldmill.operators import engine
from foldmill.operators import phrases as ph
from foldmill.operators import summaries as su
from foldmill.operators import trees as tr
from foldmill.sources import payloads as src

QUERIES: dict = {}
SQL: dict[str, str] = {}


def T():
    return F.col("text")



def _lines(key: str, *parts) -> DataFrame:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, F.concat(*parts).alias("x")))), lambda r: r["x"]), "\n")


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer as a record list: payload_id, text."""
    r = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderpriority").alias("priority"))
    own = src.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("payload_id")).agg(F.array_sort(F.collect_list(r)).alias("r"))
    return own.select("payload_id", F.to_json("r").alias("text"), F.size("r").alias("n"))


def nested(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of a nation as nested objects by name: payload_id, text."""
    t = src.table(spark, sf, "supplier").join(F.broadcast(src.table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    v = F.struct(F.col("s_name").alias("k"), F.struct(F.struct(F.col("s_suppkey").alias("key"), F.lit("default").alias("namespace")).alias("metadata"), F.struct(F.col("n_name").alias("nation"), F.array(F.lit("supplier"), F.col("n_name")).alias("roles")).alias("spec")).alias("v"))
    own = t.groupBy(F.col("s_nationkey").cast("long").alias("payload_id")).agg(F.array_sort(F.collect_list(v), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)).alias("v"))
    return own.select("payload_id", F.to_json(F.struct(F.lit("suppliers").alias("cluster"), F.map_from_entries("v").alias("services"))).alias("text"))


def plans(spark: SparkSession, sf: str) -> DataFrame:
    """A plan in JSON for each brand of parts."""
    action = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("create"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("delete"), F.lit("create"))).otherwise(F.array(F.lit("update")))
    r = F.struct(F.col("p_partkey").alias("_"), F.struct(F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("address"), F.lit("part").alias("type"), F.struct(action.alias("actions")).alias("change")).alias("r"))
    own = src.table(spark, sf, "part").groupBy(F.col("p_brand").alias("payload_id")).agg(F.transform(F.array_sort(F.collect_list(r)), lambda x: x["r"]).alias("resource_changes"))
    return own.select("payload_id", F.to_json(F.struct("resource_changes")).alias("text"))


def manifests(spark: SparkSession, sf: str) -> DataFrame:
    """YAML documents of a nation's suppliers."""
    key = F.col("s_suppkey").cast("string")
    x = _lines("s_suppkey", F.lit("---\napiVersion: v1\nkind: Deployment\nmetadata:\n  name: s-"), key, F.lit("\n  namespace: n-"), F.col("s_nationkey").cast("string"), F.lit("\nspec:\n  image: supplier:"), key)
    return src.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("payload_id")).agg(x.alias("text"))


def api(spark: SparkSession, sf: str) -> DataFrame:
    """An API description for each region."""
    t = src.table(spark, sf, "nation")
    op = F.struct(F.concat(F.lit("read_"), F.col("n_nationkey").cast("string")).alias("operationId"), F.array(F.lit("nation")).alias("tags"), F.create_map(F.lit("200"), F.lit("ok")).alias("responses"))
    p = F.struct(F.concat(F.lit("/nations/"), F.col("n_nationkey").cast("string")).alias("k"), F.create_map(F.lit("get"), op).alias("v"))
    own = t.groupBy(F.col("n_regionkey").cast("long").alias("payload_id")).agg(F.map_from_entries(F.collect_list(p)).alias("paths"))
    return own.select("payload_id", F.to_json(F.struct(F.lit("3.0.0").alias("openapi"), F.struct(F.lit("nations").alias("title")).alias("info"), "paths")).alias("text"))


def _add(name: str, f, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


_RECORDS = "array<struct<key:long,status:string,name:string,priority:string>>"


def _records_back(kind: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        # One call inside the other: both run in one Python worker, and payloads don't go to the JVM and back.
        back = records(spark, sf).where("n >= 3").select("payload_id", F.explode(F.from_json(tr.decoded(kind, tr.encoded(kind, T())), _RECORDS)).alias("r"))
        return back.select("payload_id", "r.*")

    return run


for _k in ("schema_rows", "json_table", "json_path", "shape_rows"):
    _add(f"{_k}_roundtrip", _records_back(_k), "SELECT o_custkey AS payload_id, o_orderkey AS key, o_orderstatus AS status, 'order/' || o_orderkey AS name, o_orderpriority AS priority FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 3)")


def json_table_encode(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("payload_id", F.replace(tr.encoded("json_table", T()), F.lit("\n"), F.lit("\\n")).alias("payload"))


_add("json_table_encode", json_table_encode, """SELECT o_custkey AS payload_id, '<foldmill:json_table_v1> delimiter="|" escape="\\" null="∅"\\nkey|status|name|priority\\n'
  || string_agg('n:' || o_orderkey || '|s:' || o_orderstatus || '|s:order/' || o_orderkey || '|s:' || o_orderpriority, '\\n' ORDER BY o_orderkey) AS payload FROM orders GROUP BY 1""")


def _trees(kinds: tuple[str, ...], view):
    """Of each payload and encoding that takes it: characters of both, whether it reads back."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        made = engine.candidates(view(spark, sf).select("payload_id", "text"), names=list(kinds))
        return made.select("payload_id", "kind", F.length("text").alias("raw_chars"), F.length("payload").alias("chars"), "round_trip")

    return run


_add("nested_tree_encodings", _trees(("shape_rows", "path_dict_rows", "tree_dict", "atom_dict", "json_path"), nested))


def json_leaf_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of the leaves of events.props with counts; the JSON of one level is read as a map in the JVM."""
    pairs = src.table(spark, sf, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return pairs.groupBy(F.concat(F.lit("$."), F.col("k")).alias("path")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("v").alias("n_values"))


_add("json_leaf_paths", json_leaf_paths, "SELECT '$.' || j.key AS path, count(*) AS n, count(DISTINCT j.value) AS n_values FROM events, json_each(props) j GROUP BY 1")


def _summary(kind: str, view, skip: int):
    """Lines of the summary behind its head: payload_id, line."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        made = view(spark, sf).select("payload_id", F.split(getattr(su, kind)(T()), "\n").alias("x"))
        return made.select("payload_id", F.explode(F.slice("x", skip + 1, F.size("x"))).alias("line"))

    return run


_add("terraform_actions", _summary("terraform_plan", plans, 3), "SELECT p_brand AS payload_id, CASE p_size % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'delete+create' ELSE 'update' END || ' part.' || p_partkey || ' type=part' AS line FROM part")
_add("k8s_resources", _summary("k8s_yaml", manifests, 3), "SELECT CAST(s_nationkey AS BIGINT) AS payload_id, 'Deployment n-' || s_nationkey || '/s-' || s_suppkey || ' images=supplier:' || s_suppkey AS line FROM supplier")
_add("openapi_operations", _summary("openapi", api, 1), """SELECT CAST(n_regionkey AS BIGINT) AS payload_id, 'GET /nations/' || n_nationkey || ' id=read_' || n_nationkey || ' tags=nation res=200' AS line FROM nation
  UNION ALL SELECT DISTINCT CAST(n_regionkey AS BIGINT), unnest(['title=nations', '@operations', '@schemas', '']) FROM nation""")


def log_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = src.logs(spark, sf).select("payload_id", F.split(su.log_summary(T()), "\n").alias("x"))
    return out.select("payload_id", F.regexp_extract(F.get("x", F.lit(1)), r"lines=(\d+)", 1).cast("long").alias("n_lines"), F.size(F.filter("x", lambda l: l.rlike(r"^\d+x "))).cast("long").alias("n_templates"))


_add("log_summary", log_summary)


def extractive(spark: SparkSession, sf: str) -> DataFrame:
    return src.documents(spark, sf).where(TEXT["extractive"](T())).select("payload_id", su.extractive(T()).alias("payload"))


_add("extractive", extractive)


def _texts_back(kind: str):
    """Every document through an encoding and back; those that it gives up stay as they are."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        back = F.coalesce(ph.decoded(kind, ph.encoded(kind, T())), T())
        return src.documents(spark, sf).where("text is not null").select("payload_id", F.sha2(back, 256).alias("sha"))

    return run


for _k in ("meta_tokens", "token_lz", "grammar", "domain_table"):
    _add(f"{_k}_roundtrip", _texts_back(_k), "SELECT doc_id AS payload_id, sha256(text) AS sha FROM documents WHERE text IS NOT NULL")


def transport_deflate_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    out = src.documents(spark, sf).select("payload_id", ph.decoded("transport_deflate", ph.encoded("transport_deflate", T())).alias("back"))
    return out.where("back is not null").select("payload_id", F.sha2("back", 256).alias("sha"))


_add("transport_deflate_roundtrip", transport_deflate_roundtrip, "SELECT doc_id AS payload_id, sha256(text) AS sha FROM documents WHERE length(text) >= 600")


def session_delta_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn as a difference from the one before it, applied again: conv_id, turn, sha of what comes back."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    t = src.table(spark, sf, "conversations").withColumn("base", before).where("base is not null and text is not null")
    return t.select("conv_id", "turn", F.sha2(ph.delta_applied(F.col("base"), ph.delta(F.col("base"), T())), 256).alias("sha"))


_add("session_delta_roundtrip", session_delta_roundtrip, "SELECT conv_id, turn, sha256(text) AS sha FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS base FROM conversations) WHERE base IS NOT NULL AND text IS NOT NULL")
