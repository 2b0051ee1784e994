"""File catalogue, snapshots and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.operators import snapshot as S
from tessera.plans.bindings import FILE_PATH, files
from tessera.session import table
from tessera.sources import snapshots as N
from tessera.sources.store import fresh_path

#: Bytes above which a file isn't hashed, and what stands for its hash.
LARGEST, OVERSIZED = 1 << 20, " oversized"


def file_catalog(spark: SparkSession, d: str) -> DataFrame:
    """SRC-03, SRC-04, PRJ-01, PRJ-02: path, language, kind, size and hash; above LARGEST bytes a mark stands for the hash."""
    f = files(spark, d)
    return f.select("path", P.language(F.col("path")).alias("language"), P.file_kind(F.col("path")).alias("kind"), "size", F.when(F.col("size") > LARGEST, OVERSIZED).otherwise(F.col("content_hash")).alias("content_hash"))


def language_stats(spark: SparkSession, d: str) -> DataFrame:
    """AGG-02: files by language and kind."""
    return file_catalog(spark, d).groupBy("language", "kind").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))


def listed_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC-06, TOP-02: paths of Markdown documents with fr in them, the first 50 by path."""
    return file_catalog(spark, d).filter("language = 'markdown' AND kind = 'document' AND path LIKE '%/fr/%'").orderBy("path").limit(50).select("path", "size")


def duplicate_content(spark: SparkSession, d: str) -> DataFrame:
    """SNK-01, AGG-06: groups of files with one content, and the least path of each."""
    return files(spark, d).groupBy("content_hash").agg(F.count("*").alias("n_files"), F.min("path").alias("first_path")).filter("n_files > 1")


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = files(spark, d).select("doc_id", "path", "content_hash", "size")
    old = f.filter("doc_id % 10 <> 3")
    new = f.filter("doc_id % 10 <> 7").withColumn("content_hash", F.when(F.col("doc_id") % 6 == 0, F.lit("edited")).otherwise(F.col("content_hash")))
    return old, new


def snapshot_files(spark: SparkSession, d: str) -> DataFrame:
    """SNK-01: what an upsert of a later snapshot does to each path; paths that are gone are removed."""
    old, new = _versions(spark, d)
    return S.upsert(old, new, ["path"], ["content_hash"])


def snapshot_versions(spark: SparkSession, d: str) -> DataFrame:
    """SNK-01 written: the paths and contents of a table after two upserts, and whether its first version has them."""
    path = fresh_path(spark, "snapshot")
    old, new = _versions(spark, d)
    N.upsert(path, old, ["path"], ["content_hash"])
    N.upsert(path, new, ["path"], ["content_hash"], whole=True)
    N.upsert(path, new.filter("doc_id < 0"), ["path"], ["content_hash"])
    first = N.read(spark, path, 0).select("path", "content_hash", F.lit(True).alias("was_first"))
    return N.read(spark, path).select("path", "content_hash").join(first, ["path", "content_hash"], "left").select("path", "content_hash", F.coalesce("was_first", F.lit(False)).alias("was_first"))


def relation_upserts(spark: SparkSession, d: str) -> DataFrame:
    """SNK-03 written: of each order and supplier the last line's discount, after lines came in two lots."""
    path = fresh_path(spark, "relations")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount")
    for lot in (rows.filter("l_linenumber <= 3"), rows.filter("l_linenumber > 3")):
        N.upsert(path, lot, ["l_orderkey", "l_suppkey"], ["l_discount"], order=["l_linenumber", "l_extendedprice", "l_discount"])
    return N.read(spark, path).select("l_orderkey", "l_suppkey", "l_discount")


def snapshot_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """SNK-02: an upsert by id that compares place and lines, and names too."""
    old = table(spark, d, "part").select(F.concat(F.lit("code:"), "p_partkey").alias("id"), F.col("p_brand").alias("file_path"), F.col("p_size").alias("start_line"), "p_name")
    new = old.filter("start_line <> 9").withColumn("start_line", F.when(F.col("file_path") == "Brand#3", F.col("start_line") + 1).otherwise(F.col("start_line")))
    return S.upsert(old, new, ["id"], ["file_path", "start_line", "p_name"]).groupBy("action").agg(F.count("*").alias("n"))


def relation_latest(spark: SparkSession, d: str) -> DataFrame:
    """SNK-03: the last confidence of each order and supplier, by line number, then price."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount")
    return S.latest(rows, ["l_orderkey", "l_suppkey"], ["l_linenumber", "l_extendedprice", "l_discount"])


def relation_append(spark: SparkSession, d: str) -> DataFrame:
    """SNK-04: edges appended without a look at those that are there."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    return rows.unionAll(rows.filter("n_regionkey = 1"))


def audit_latest(spark: SparkSession, d: str) -> DataFrame:
    """SNK-05, TOP-06: the last run of each user and kind, by time, then id."""
    rows = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return S.latest(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def version_diff(spark: SparkSession, d: str) -> DataFrame:
    """JOI-12: prices of parts before and after a change."""
    part = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("version"))
    after = part.filter("p_partkey % 11 <> 0").withColumn("version", F.when(F.col("p_partkey") % 5 == 0, F.col("version") + 1).otherwise(F.col("version")))
    return S.version_diff(part.filter("p_partkey % 13 <> 0"), after, "p_partkey", "version")


def line_diff(spark: SparkSession, d: str) -> DataFrame:
    """JOI-13: each turn's lines against those of the turn two later."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    later = turns.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("after"))
    pairs = turns.join(later, ["conv_id", "turn"]).select(F.concat_ws("-", "conv_id", "turn").alias("key"), F.col("text").alias("before"), "after")
    return S.line_diff(pairs, "key", "before", "after").groupBy("key", "action").agg(F.count("*").alias("n_lines"), F.sum("line").alias("lines"))


def _customers_orders(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders")
    return o.filter("o_orderstatus = 'F'").select("o_custkey"), o.filter("o_orderpriority = '1-URGENT'").select("o_custkey")


def set_difference(spark: SparkSession, d: str) -> DataFrame:
    """SET-01, SET-02: customers with finished orders and no urgent one."""
    a, b = _customers_orders(spark, d)
    return a.subtract(b)


def set_common(spark: SparkSession, d: str) -> DataFrame:
    """SET-03: customers with both."""
    a, b = _customers_orders(spark, d)
    return a.intersect(b)


def set_union(spark: SparkSession, d: str) -> DataFrame:
    """SET-04: customers with either, once each."""
    a, b = _customers_orders(spark, d)
    return a.union(b).distinct()


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """AGG-10, AGG-11: how many documents of each source have a label, and the share in hundredths."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    known = table(spark, d, "labels").select("doc_id", F.lit(1).alias("has")).distinct()
    each = docs.join(known, "doc_id", "left").groupBy("source").agg(F.count("*").alias("expected"), F.count("has").alias("existing"))
    return each.withColumn("percent", F.round(F.col("existing") * 100 / F.col("expected"), 4))


def table_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-01: rows of each table."""
    count = lambda n: table(spark, d, n).agg(F.lit(n).alias("name"), F.count("*").alias("n_rows"))
    return count("nation").unionAll(count("supplier")).unionAll(count("part")).unionAll(count("labels"))


QUERIES = {f.__name__: f for f in (file_catalog, language_stats, listed_files, duplicate_content, snapshot_files, snapshot_versions, snapshot_artifacts, relation_latest, relation_upserts, relation_append, audit_latest, version_diff, line_diff, set_difference, set_common, set_union, coverage, table_counts)}
_FILES = f"f AS (SELECT doc_id, {FILE_PATH} AS path, octet_length(encode(text)) AS size, sha256(text) AS content_hash FROM documents)"
_CATALOG = f"""{_FILES}, c AS (SELECT path, CASE doc_id % 4 WHEN 0 THEN 'markdown' WHEN 1 THEN 'python' WHEN 2 THEN 'text' ELSE 'css' END AS language,
    CASE doc_id % 4 WHEN 0 THEN 'document' WHEN 2 THEN 'document' ELSE 'source' END AS kind, size,
    CASE WHEN size > 1048576 THEN ' oversized' ELSE content_hash END AS content_hash FROM f)"""
_ORDERS = "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' {} SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'"
ORACLES = {
    "file_catalog": f"WITH {_CATALOG} SELECT * FROM c",
    "language_stats": f"WITH {_CATALOG} SELECT language, kind, count(*) AS n_files, sum(size)::BIGINT AS n_bytes FROM c GROUP BY 1, 2",
    "listed_files": f"WITH {_CATALOG} SELECT path, size FROM c WHERE language = 'markdown' AND path LIKE '%/fr/%' ORDER BY path LIMIT 50",
    "duplicate_content": f"WITH {_FILES} SELECT content_hash, count(*) AS n_files, min(path) AS first_path FROM f GROUP BY 1 HAVING count(*) > 1",
    "snapshot_files": f"""WITH {_FILES}, a AS (SELECT path, content_hash AS h FROM f WHERE doc_id % 10 <> 3), b AS (SELECT path, CASE WHEN doc_id % 6 = 0 THEN 'edited' ELSE content_hash END AS h FROM f WHERE doc_id % 10 <> 7)
        SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'inserted' WHEN b.path IS NULL THEN 'removed' WHEN a.h = b.h THEN 'skipped' ELSE 'updated' END AS action FROM a FULL JOIN b ON a.path = b.path""",
    "snapshot_artifacts": "SELECT CASE WHEN p_size = 9 THEN 'removed' WHEN p_brand = 'Brand#3' THEN 'updated' ELSE 'skipped' END AS action, count(*) AS n FROM part GROUP BY 1",
    "snapshot_versions": f"WITH {_FILES} SELECT path, CASE WHEN doc_id % 6 = 0 THEN 'edited' ELSE content_hash END AS content_hash, doc_id % 10 <> 3 AND doc_id % 6 <> 0 AS was_first FROM f WHERE doc_id % 10 <> 7",
    "relation_upserts": "SELECT l_orderkey, l_suppkey, l_discount FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber DESC, l_extendedprice DESC, l_discount DESC) AS k FROM lineitem) WHERE k = 1",
    "relation_latest": "SELECT l_orderkey, l_suppkey, l_linenumber, l_extendedprice, l_discount FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber DESC, l_extendedprice DESC, l_discount DESC) AS k FROM lineitem) WHERE k = 1",
    "relation_append": "SELECT n_nationkey, n_regionkey FROM nation UNION ALL SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey = 1",
    "audit_latest": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "version_diff": """WITH a AS (SELECT p_partkey, p_size AS v FROM part WHERE p_partkey % 13 <> 0), b AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 11 <> 0)
        SELECT * FROM (SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed' WHEN a.v IS DISTINCT FROM b.v THEN 'version_changed' END AS kind, a.v AS old, b.v AS new
        FROM a FULL JOIN b ON a.p_partkey = b.p_partkey) WHERE kind IS NOT NULL""",
    "line_diff": """WITH p AS (SELECT a.conv_id || '-' || a.turn AS key, string_split(a.text, chr(10)) AS x, string_split(b.text, chr(10)) AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2),
        n AS (SELECT key, x, y, unnest(range(1, greatest(len(x), len(y)) + 1)) AS line FROM p), c AS (SELECT key, line, x[line] AS a, y[line] AS b FROM n WHERE x[line] IS DISTINCT FROM y[line])
        SELECT key, action, count(*) AS n_lines, sum(line)::BIGINT AS lines FROM (SELECT key, line, 'remove' AS action FROM c WHERE a IS NOT NULL UNION ALL SELECT key, line, 'add' FROM c WHERE b IS NOT NULL) GROUP BY 1, 2""",
    "set_difference": _ORDERS.format("EXCEPT"),
    "set_common": _ORDERS.format("INTERSECT"),
    "set_union": _ORDERS.format("UNION"),
    "coverage": "SELECT source, count(*) AS expected, count(l.doc_id) AS existing, round(count(l.doc_id) * 100 / count(*), 4) AS percent FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY 1",
    "table_counts": "SELECT 'nation' AS name, count(*) AS n_rows FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'labels', count(*) FROM labels",
}
