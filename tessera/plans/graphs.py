"""Graph queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.plans.bindings import STAR_EDGES_SQL, STAR_NODES_SQL, SUPPLY_EDGES_SQL, TRADE_SQL, star_edges, star_nodes, supply_edges, trade
from tessera.session import table

_TRADE = f"trade AS (SELECT source_id, target_id, n FROM ({TRADE_SQL}) t WHERE n >= 1.6 * (SELECT avg(n) FROM ({TRADE_SQL}) u))"
_STAR = f"e AS ({STAR_EDGES_SQL}), v AS ({STAR_NODES_SQL})"


def supplier_hotspots(spark: SparkSession, d: str) -> DataFrame:
    """AGG-04: suppliers of at least 20 orders."""
    return G.hotspots(supply_edges(spark, d))


def core_targets(spark: SparkSession, d: str) -> DataFrame:
    """AGG-08: the five nodes that most edges lead to."""
    return G.core(star_edges(spark, d))


def edge_orphans(spark: SparkSession, d: str) -> DataFrame:
    """JOI-03: uses of suppliers that aren't among those with a balance above 5000, by supplier."""
    nodes = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"))
    return G.missing(supply_edges(spark, d), nodes, "target_id").groupBy("target_id").agg(F.count("*").alias("n_edges"))


def source_orphans(spark: SparkSession, d: str) -> DataFrame:
    """JOI-02: edges out of orders that aren't open, which aren't nodes here."""
    nodes = star_nodes(spark, d).filter("type <> 'function'").unionByName(table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.concat(F.lit("orders:"), "o_orderkey").alias("id"), F.lit("function").alias("type")))
    return G.missing(star_edges(spark, d), nodes, "source_id").groupBy("type").agg(F.count("*").alias("n_edges"))


def duplicate_edges(spark: SparkSession, d: str) -> DataFrame:
    """AGG-06: pairs of order and supplier that repeat."""
    return G.duplicates(supply_edges(spark, d)).select("source_id", "target_id", "extra")


def fan_in_out(spark: SparkSession, d: str) -> DataFrame:
    """AGG-07 of all nodes of the star."""
    return G.fan(star_edges(spark, d))


def incident_edges(spark: SparkSession, d: str) -> DataFrame:
    """JOI-01: edges at the nations, both ways."""
    ids = table(spark, d, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"))
    return G.incident(star_edges(spark, d), ids).groupBy("type").agg(F.count("*").alias("n_edges"))


def impact_nation(spark: SparkSession, d: str) -> DataFrame:
    """GRA-02, GRA-04: what depends on each nation and region, and the risk."""
    targets = star_edges(spark, d).filter("type IN ('lives_in', 'part_of')").select(F.col("target_id").alias("id")).distinct()
    return G.impact(star_edges(spark, d), star_nodes(spark, d), targets)


def graph_health(spark: SparkSession, d: str) -> DataFrame:
    """GRA-06, AGG-14: findings by rule and severity; regions aren't nodes of the star."""
    return G.health(star_edges(spark, d), star_nodes(spark, d)).groupBy("rule", "severity").agg(F.count("*").alias("n"))


def health_stats(spark: SparkSession, d: str) -> DataFrame:
    """AGG-25, AGG-01: counts of nodes and edges and of edges by kind in one pass each."""
    edges = star_edges(spark, d).agg(F.count("*").alias("n_edges"), F.count_if(F.col("type") == "lives_in").alias("n_lives_in"), F.countDistinct("target_id").alias("n_targets"))
    return edges.crossJoin(star_nodes(spark, d).agg(F.count("*").alias("n_nodes")))


def cycle_nodes(spark: SparkSession, d: str) -> DataFrame:
    """GRA-01 in the strong trade between nations."""
    return G.cycle_nodes(trade(spark, d))


def reach_bounded(spark: SparkSession, d: str) -> DataFrame:
    """GRA-09, an extension: nations within three steps of strong trade from nations 0 to 9."""
    return G.reach(trade(spark, d), spark.range(10).select(F.concat(F.lit("n"), "id").alias("id")), 3)


def external_usage(spark: SparkSession, d: str) -> DataFrame:
    """AGG-05, AGG-09: how many suppliers use each brand of part, brands being packages from outside."""
    uses = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return uses.groupBy(F.concat(F.lit("external:part:"), "p_brand").alias("package")).agg(F.countDistinct("l_suppkey").alias("n_users"))


def alias_targets(spark: SparkSession, d: str) -> DataFrame:
    """JOI-05, JOI-06: edges resolved by id or by name, as two joins; a target that resolves to nothing stays."""
    edges = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("nation:"), "c_nationkey")).when(F.col("c_custkey") % 7 == 0, F.lit("nowhere")).otherwise(F.concat(F.lit("NATION_"), "c_nationkey")).alias("target_id"))
    nodes = table(spark, d, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("node"), "n_name")
    keys = nodes.select(F.col("node").alias("target_id"), "node").unionByName(nodes.select(F.col("n_name").alias("target_id"), "node"))
    return edges.join(keys, "target_id", "left").groupBy("node").agg(F.count("*").alias("n_edges"))


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """JOI-19, GRA-03: for each nation the first five others of its region."""
    a = table(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name")
    # One of the first six may be the nation itself, so six of each region are enough, and no region is paired with itself.
    first = a.withColumn("k", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name", "n_nationkey"))).filter("k <= 6")
    b = first.select(F.col("n_nationkey").alias("other"), "n_regionkey", F.col("n_name").alias("other_name"))
    near = a.join(b, "n_regionkey").filter("n_nationkey <> other").groupBy("n_nationkey").agg(F.slice(F.sort_array(F.collect_list("other_name")), 1, 5).alias("names"))
    return near.select("n_nationkey", F.array_join("names", ",").alias("neighbours"))


def project_map(spark: SparkSession, d: str) -> DataFrame:
    """GRA-07: a node's degree both ways and whether it is a hotspot, for the nodes that others depend on."""
    edges = star_edges(spark, d)
    return G.fan(edges).filter("fan_in > 0").join(G.hotspots(edges, 2).select(F.col("target_id").alias("id"), F.when(F.col("n_sources") >= 5, "R2").otherwise("R1").alias("risk")), "id", "left")


def key_presence(spark: SparkSession, d: str) -> DataFrame:
    """AGG-27: how many events of each type lack each required key of props; a key with a null is there."""
    keys = F.json_object_keys("props")
    lacking = F.array_except(F.array(F.lit("k"), F.lit("line"), F.lit("module")), F.coalesce(keys, F.array()))
    return table(spark, d, "events").select("event_type", F.explode(lacking).alias("key")).groupBy("event_type", "key").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (supplier_hotspots, core_targets, edge_orphans, source_orphans, duplicate_edges, fan_in_out, incident_edges, impact_nation, graph_health, health_stats, cycle_nodes, reach_bounded, external_usage, alias_targets, neighbours, project_map, key_presence)}
_RISK = "CASE WHEN models > 0 AND total > 2 THEN 'R3' WHEN apis > 0 AND total > 1 THEN 'R2' WHEN total > 3 THEN 'R2' WHEN total > 0 THEN 'R1' ELSE 'R0' END"
_FAN = "f AS (SELECT id, sum(o)::BIGINT AS fan_out, sum(i)::BIGINT AS fan_in FROM (SELECT source_id AS id, count(DISTINCT target_id) AS o, 0 AS i FROM e GROUP BY 1 UNION ALL SELECT target_id, 0, count(DISTINCT source_id) FROM e GROUP BY 1) GROUP BY id)"
ORACLES = {
    "supplier_hotspots": f"WITH e AS ({SUPPLY_EDGES_SQL}) SELECT target_id, count(DISTINCT source_id) AS n_sources FROM e GROUP BY 1 HAVING count(DISTINCT source_id) >= 20",
    "core_targets": f"WITH {_STAR} SELECT target_id, count(*) AS n_edges FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "edge_orphans": "SELECT concat('supplier:', l_suppkey) AS target_id, count(*) AS n_edges FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) GROUP BY 1",
    "source_orphans": "SELECT 'placed_by' AS type, count(*) AS n_edges FROM orders WHERE o_orderstatus <> 'O'",
    "duplicate_edges": f"WITH e AS ({SUPPLY_EDGES_SQL}) SELECT source_id, target_id, count(*) - 1 AS extra FROM e GROUP BY 1, 2 HAVING count(*) > 1",
    "fan_in_out": f"WITH {_STAR}, {_FAN} SELECT id, fan_out, fan_in FROM f",
    "incident_edges": f"WITH {_STAR} SELECT type, count(*) AS n_edges FROM (SELECT type FROM e WHERE source_id LIKE 'nation:%' UNION ALL SELECT type FROM e WHERE target_id LIKE 'nation:%') GROUP BY 1",
    "impact_nation": f"""WITH {_STAR}, c AS (SELECT e.target_id, count(DISTINCT e.source_id) AS total, count(DISTINCT e.source_id) FILTER (v.type = 'model') AS models,
        count(DISTINCT e.source_id) FILTER (v.type = 'api') AS apis FROM e LEFT JOIN v ON v.id = e.source_id WHERE e.type IN ('lives_in', 'part_of') GROUP BY 1) SELECT *, {_RISK} AS risk FROM c""",
    "graph_health": f"""WITH {_STAR}, x AS (SELECT 'missing_target' AS rule, 'warning' AS severity, target_id AS s FROM e WHERE target_id NOT IN (SELECT id FROM v) GROUP BY target_id
        UNION ALL SELECT 'missing_source', 'error', source_id FROM e WHERE source_id NOT IN (SELECT id FROM v) GROUP BY source_id
        UNION ALL SELECT 'duplicate_edge', 'warning', source_id || target_id FROM e GROUP BY source_id, target_id, type HAVING count(*) > 1
        UNION ALL SELECT 'hotspot', 'warning', target_id FROM e GROUP BY target_id HAVING count(DISTINCT source_id) >= 20) SELECT rule, severity, count(*) AS n FROM x GROUP BY 1, 2""",
    "health_stats": f"WITH {_STAR} SELECT count(*) AS n_edges, count(*) FILTER (type = 'lives_in') AS n_lives_in, count(DISTINCT target_id) AS n_targets, (SELECT count(*) FROM v) AS n_nodes FROM e",
    "cycle_nodes": f"WITH RECURSIVE {_TRADE}, r AS (SELECT source_id, target_id FROM trade UNION SELECT r.source_id, t.target_id FROM r JOIN trade t ON t.source_id = r.target_id) SELECT DISTINCT source_id AS id FROM r WHERE source_id = target_id",
    "reach_bounded": f"WITH RECURSIVE {_TRADE}, r AS (SELECT 'n' || i AS id, 0 AS steps FROM range(10) s(i) UNION SELECT t.target_id, r.steps + 1 FROM r JOIN trade t ON t.source_id = r.id WHERE r.steps < 3) SELECT id, min(steps) AS steps FROM r GROUP BY 1",
    "external_usage": "SELECT concat('external:part:', p_brand) AS package, count(DISTINCT l_suppkey) AS n_users FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1",
    "alias_targets": """WITH e AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'nation:' || c_nationkey WHEN c_custkey % 7 = 0 THEN 'nowhere' ELSE 'NATION_' || c_nationkey END AS t FROM customer)
        SELECT node, count(*) AS n_edges FROM e LEFT JOIN (SELECT 'nation:' || n_nationkey AS node, n_name FROM nation) n ON t = node OR t = n_name GROUP BY 1""",
    "neighbours": "SELECT a.n_nationkey, array_to_string(list_sort(list(b.n_name))[1:5], ',') AS neighbours FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY 1",
    "project_map": f"WITH {_STAR}, {_FAN} SELECT id, fan_out, fan_in, CASE WHEN fan_in >= 5 THEN 'R2' WHEN fan_in >= 2 THEN 'R1' END AS risk FROM f WHERE fan_in > 0",
    "key_presence": "SELECT event_type, key, count(*) AS n FROM events, (VALUES ('k'), ('line'), ('module')) r(key) WHERE NOT list_contains(json_keys(props), key) GROUP BY 1, 2",
}
