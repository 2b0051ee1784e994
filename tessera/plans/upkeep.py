"""Queries of plans that follow from findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import upkeep as U
from tessera.plans.bindings import files, parts
from tessera.session import table

_TYPE = "CASE p_partkey % 7 WHEN 0 THEN 'stale_capability' WHEN 1 THEN 'phase_status_mismatch' WHEN 2 THEN 'stale_test_baseline' ELSE 'other' END"
_SEVERITY = "CASE WHEN p_size < 5 THEN 'high' WHEN p_size < 20 THEN 'medium' ELSE 'low' END"
_DOC = "CASE WHEN p_partkey % 50 = 0 THEN '(all docs)' WHEN p_partkey % 9 = 0 THEN concat(p_brand, '.md, history/', p_brand, '.md') ELSE concat(p_brand, '.md') END"


def doc_update_plan(spark: SparkSession, d: str) -> DataFrame:
    """AGG-22, TOP-05: parts as issues of documents named by brand; history isn't changed."""
    issues = table(spark, d, "part").select(F.expr(_DOC).alias("doc"), F.expr(_TYPE).alias("type"), F.expr(_SEVERITY).alias("severity"), F.col("p_type").alias("reason"))
    return U.update_plan(issues, ["history/"]).withColumn("reasons", F.array_join("reasons", ","))


def verification_items(spark: SparkSession, d: str) -> DataFrame:
    """GRA-05: nations as changes, their suppliers as models and their rich customers in building as endpoints."""
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("model").alias("type")).unionAll(table(spark, d, "customer").filter("c_mktsegment = 'BUILDING' AND c_acctbal > 9000").select("c_nationkey", F.lit("api_endpoint")))
    return U.verification(rows, "nation").select("nation", F.array_join("items", ",").alias("items"))


def merge_readiness(spark: SparkSession, d: str) -> DataFrame:
    """RUL-23: events as findings of users."""
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "warning").otherwise("info")
    return U.merge_ready(table(spark, d, "events").select("user_id", severity.alias("severity")), "user_id")


def impact_targets(spark: SparkSession, d: str) -> DataFrame:
    """JOI-11: names of nations, paths of parts and names of parts, looked up among modules, files and symbols."""
    part = parts(spark, d).select("p_partkey", "p_name")
    nodes = part.select(F.concat(F.lit("code:module:a/"), "p_partkey", F.lit(".py")).alias("id"), F.lit("f").alias("name"), F.lit("").alias("file_path"))
    nodes = nodes.unionAll(part.filter("p_partkey % 2 = 0").select(F.concat(F.lit("module:a."), "p_partkey"), F.lit("m"), F.lit("")))
    nodes = nodes.unionAll(part.select(F.concat(F.lit("code:function:a/"), "p_partkey", F.lit(".py:"), "p_name"), "p_name", F.concat(F.lit("a/"), "p_partkey", F.lit(".py"))))
    asked = part.select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("a/"), "p_partkey", F.lit(".py"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("a."), "p_partkey")).otherwise(F.col("p_name")).alias("query")).distinct()
    return U.targets(nodes, asked)


def replace_draft(spark: SparkSession, d: str) -> DataFrame:
    """SCA-01: a word replaced in all documents."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    return U.draft(docs, "tion", "TION").select("path", "n", F.sha2("replaced", 256).alias("new_hash"))


def docs_by_phase(spark: SparkSession, d: str) -> DataFrame:
    """RUL-20, SET-02: sizes, by hundreds of bytes, that files of one language have and those of another lack."""
    sizes = lambda lang: files(spark, d).filter(F.col("lang") == lang).select(F.floor(F.col("size") / 100).alias("phase")).distinct()
    return sizes("en").subtract(sizes("de"))


QUERIES = {f.__name__: f for f in (doc_update_plan, verification_items, merge_readiness, impact_targets, replace_draft, docs_by_phase)}
ORACLES = {
    "doc_update_plan": f"""WITH i AS (SELECT unnest(string_split({_DOC}, ',')) AS doc, {_TYPE} AS type, {_SEVERITY} AS severity, p_type FROM part),
        e AS (SELECT CASE WHEN trim(doc) = '(all docs)' THEN 'README.md' ELSE trim(doc) END AS doc, CASE type WHEN 'stale_capability' THEN 0 WHEN 'other' THEN 2 ELSE 1 END AS k, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS p, p_type FROM i)
        SELECT doc, ['capability_boundary', 'status_sync', 'expression_alignment'][min(k) + 1] AS update_kind, ['high', 'medium', 'low'][min(p) + 1] AS priority, count(*) AS n_issues, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS reasons
        FROM e WHERE doc NOT LIKE 'history/%' GROUP BY doc""",
    "verification_items": """WITH r AS (SELECT s_nationkey AS nation, 'm' AS t FROM supplier UNION ALL SELECT c_nationkey, 'a' FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000)
        SELECT nation, concat_ws(',', CASE WHEN bool_or(t = 'a') THEN 'api' END, CASE WHEN bool_or(t = 'm') THEN 'model_compatibility' END, CASE WHEN count(*) > 3 THEN 'regression' END, CASE WHEN count(*) > 5 THEN 'performance' END) AS items FROM r GROUP BY 1""",
    "merge_readiness": "SELECT user_id, count(*) FILTER (event_type = 'error') AS blockers, count(*) FILTER (event_type = 'view') AS warnings, count(*) FILTER (event_type = 'error') = 0 AS ready FROM events GROUP BY 1",
    "impact_targets": """WITH p AS (SELECT * FROM part), s AS (SELECT p_name, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY concat('code:function:a/', p_partkey, '.py:', p_name)) AS k FROM p)
        SELECT concat('a/', p_partkey, '.py') AS query, concat('code:module:a/', p_partkey, '.py') AS id FROM p WHERE p_partkey % 3 = 0
        UNION ALL SELECT concat('a/', p_partkey, '.py'), concat('module:a.', p_partkey) FROM p WHERE p_partkey % 6 = 0
        UNION ALL SELECT concat('a.', p_partkey), concat('module:a.', p_partkey) FROM p WHERE p_partkey % 3 = 1 AND p_partkey % 2 = 0
        UNION ALL SELECT p_name, concat('code:module:a/', p_partkey, '.py') FROM s WHERE k <= 5 AND p_name IN (SELECT p_name FROM p WHERE p_partkey % 3 = 2)""",
    "replace_draft": "SELECT doc_id AS path, ((length(text) - length(replace(text, 'tion', ''))) / 4)::INT AS n, sha256(replace(text, 'tion', 'TION')) AS new_hash FROM documents WHERE contains(text, 'tion')",
    "docs_by_phase": "SELECT floor(octet_length(encode(text)) / 100)::BIGINT AS phase FROM documents WHERE lang = 'en' EXCEPT SELECT floor(octet_length(encode(text)) / 100)::BIGINT FROM documents WHERE lang = 'de'",
}
