"""The model's tables made of the star schema and the text tables.

SQL texts here are of the subset that both engines read, so that queries and their equivalents start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import spread, table

#: Changed files: a path for each part, of every category, and the number of changed lines.
CHANGE_PATH = """concat(
    CASE p_partkey % 5 WHEN 0 THEN 'src/' WHEN 1 THEN 'tests/' WHEN 2 THEN 'docs/' ELSE '' END, lower(p_type), '/',
    CASE WHEN p_partkey % 97 = 0 THEN 'package.json' WHEN p_partkey % 89 = 0 THEN 'requirements.txt'
         WHEN p_partkey % 83 = 0 THEN '.env' WHEN p_partkey % 79 = 0 THEN 'models.py' WHEN p_partkey % 73 = 0 THEN 'Dockerfile'
         ELSE concat(CASE WHEN p_partkey % 7 = 0 THEN 'test_' ELSE '' END, replace(p_name, ' ', '_'), '_', CAST(p_partkey AS VARCHAR(20)),
              CASE p_partkey % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.json' WHEN 3 THEN '.ts'
                   WHEN 4 THEN '.sql' WHEN 5 THEN '.go' WHEN 6 THEN '.css' ELSE '.png' END) END)"""
CHANGES_SQL = f"SELECT p_partkey AS id, {CHANGE_PATH} AS path, p_size * 6 AS n_lines FROM part"
FILE_PATH = "concat(source, '/', lang, '/', CAST(doc_id AS VARCHAR(20)), CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.py' WHEN 2 THEN '.txt' ELSE '.css' END)"
#: Foreign keys as edges.
STAR_EDGES_SQL = """
    SELECT concat('orders:', CAST(o_orderkey AS VARCHAR(20))) AS source_id, concat('customer:', CAST(o_custkey AS VARCHAR(20))) AS target_id, 'placed_by' AS type FROM orders
    UNION ALL SELECT concat('customer:', CAST(c_custkey AS VARCHAR(20))), concat('nation:', CAST(c_nationkey AS VARCHAR(20))), 'lives_in' FROM customer
    UNION ALL SELECT concat('supplier:', CAST(s_suppkey AS VARCHAR(20))), concat('nation:', CAST(s_nationkey AS VARCHAR(20))), 'lives_in' FROM supplier
    UNION ALL SELECT concat('nation:', CAST(n_nationkey AS VARCHAR(20))), concat('region:', CAST(n_regionkey AS VARCHAR(20))), 'part_of' FROM nation"""
STAR_NODES_SQL = """
    SELECT concat('orders:', CAST(o_orderkey AS VARCHAR(20))) AS id, 'function' AS type FROM orders
    UNION ALL SELECT concat('customer:', CAST(c_custkey AS VARCHAR(20))), 'model' FROM customer
    UNION ALL SELECT concat('supplier:', CAST(s_suppkey AS VARCHAR(20))), 'api' FROM supplier
    UNION ALL SELECT concat('nation:', CAST(n_nationkey AS VARCHAR(20))), 'config' FROM nation"""
SUPPLY_EDGES_SQL = """
    SELECT concat('orders:', CAST(l_orderkey AS VARCHAR(20))) AS source_id, concat('supplier:', CAST(l_suppkey AS VARCHAR(20))) AS target_id, 'uses' AS type FROM lineitem"""
#: Trade between nations: from a supplier's to a customer's.
TRADE_SQL = """
    SELECT concat('n', CAST(s_nationkey AS VARCHAR(20))) AS source_id, concat('n', CAST(c_nationkey AS VARCHAR(20))) AS target_id, count(*) AS n
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    WHERE s_nationkey <> c_nationkey GROUP BY s_nationkey, c_nationkey"""


def sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """A text of SQL over tables under sf_dir."""
    for n in names:
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of parts, dealt to tasks."""
    return spread(table(spark, sf_dir, "part"), "p_partkey")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path and n_lines of changed files."""
    return spark.sql(CHANGES_SQL.replace("FROM part", "FROM {part}"), part=parts(spark, sf_dir))


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, STAR_EDGES_SQL, "orders", "customer", "supplier", "nation")


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, STAR_NODES_SQL, "orders", "customer", "supplier", "nation")


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, SUPPLY_EDGES_SQL, "lineitem")


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade edges whose count is at least 1.6 times the mean."""
    counts = sql(spark, sf_dir, TRADE_SQL, "lineitem", "supplier", "orders", "customer")
    level = counts.agg((F.avg("n") * F.lit(1.6)).alias("level"))
    return counts.join(F.broadcast(level), F.col("n") >= F.col("level")).select("source_id", "target_id", "n")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, language of the text, size and hash of documents as files."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.expr(FILE_PATH).alias("path"), F.col("lang"), F.octet_length("text").alias("size"), F.sha2("text", 256).alias("content_hash"))
