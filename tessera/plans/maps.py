"""Reports over the imports of the tree of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import reports as M
from tessera.plans import sources as S
from tessera.sources.store import written


def map_sections(spark: SparkSession, d: str) -> DataFrame:
    """GRA-07, AGG-03, AGG-05, AGG-07: the sections of the map of the tree, with totals."""
    return M.sections(S.tree_edges(spark, d))


def map_members(spark: SparkSession, d: str) -> DataFrame:
    """AGG-03, AGG-07: what each file imports and what imports it."""
    return M.members(S.tree_edges(spark, d))


def health_counts(spark: SparkSession, d: str) -> DataFrame:
    """GRA-06, AGG-25, AGG-27 of the tree: Go files are no nodes here, second imports come twice, only those of first lines have all metadata."""
    told = F.when(F.col("line") == 1, '{"module": "m", "import_kind": "k", "confidence": 1}').when(F.col("line") == 2, '{"module": null}')
    edges = written(S.tree_edges(spark, d).withColumn("metadata_json", told), "edges")
    nodes = S.tree(spark, d).filter("path NOT LIKE 'srv/%'").select(F.concat(F.lit("code:module:"), "path").alias("id"))
    return M.health_counts(edges.unionAll(edges.filter("line = 2")), nodes)


QUERIES = {f.__name__: f for f in (map_sections, map_members, health_counts)}
_E = f"""e AS ({S.ORACLES["tree_edges"]}), n AS (SELECT CASE WHEN target_id LIKE 'external:%' THEN 'external' WHEN target_id LIKE 'unresolved:%' THEN 'unresolved' ELSE 'internal' END AS class, substr(source_id, 13) AS source,
    CASE WHEN target_id LIKE 'code:module:%' THEN substr(target_id, 13) WHEN target_id LIKE 'external:%' THEN regexp_extract(target_id, '^external:[^:]*:(.*)$', 1) ELSE target_id END AS target FROM e)"""
ORACLES = {
    "map_sections": f"""WITH {_E}, g AS (SELECT class AS section, target AS subject, count(*) AS n_edges, count(DISTINCT source) AS n_files FROM n GROUP BY 1, 2)
        SELECT *, CASE WHEN section = 'internal' AND n_files >= 5 THEN 'R2' WHEN section = 'internal' AND n_files >= 2 THEN 'R1' END AS risk FROM g UNION ALL SELECT 'module', source, count(*), 1, NULL FROM n GROUP BY source
        UNION ALL SELECT 'kind', class, count(*), count(DISTINCT source), NULL FROM n GROUP BY class UNION ALL SELECT 'total', 'all', count(*), count(DISTINCT source), NULL FROM n""",
    "map_members": f"""WITH {_E} SELECT 'imports' AS section, source AS subject, target AS member FROM n UNION ALL SELECT 'imported_by', target, source FROM n WHERE class = 'internal'
        UNION ALL SELECT DISTINCT concat(class, '_importers'), target, source FROM n WHERE class <> 'unresolved'""",
    "health_counts": f"""WITH e0 AS ({S.ORACLES["tree_edges"]}), e AS (SELECT * FROM e0 UNION ALL SELECT * FROM e0 WHERE line = 2), {S._K}, v AS (SELECT concat('code:module:', path) AS id FROM k WHERE k % 4 <> 2),
        r AS (SELECT 'orphan_source' AS rule, 'error' AS severity, count(*) AS n FROM e WHERE source_id NOT IN (SELECT id FROM v) UNION ALL SELECT 'orphan_target', 'warning', count(*) FROM e WHERE target_id NOT IN (SELECT id FROM v) AND NOT regexp_matches(target_id, '^(external|unresolved):')
            UNION ALL SELECT 'missing_metadata', 'warning', count(*) FROM e WHERE line <> 1 UNION ALL SELECT 'external', 'info', count(*) FROM e WHERE target_id LIKE 'external:%' UNION ALL SELECT 'unresolved', 'info', count(*) FROM e WHERE target_id LIKE 'unresolved:%'
            UNION ALL SELECT 'duplicate', 'warning', sum(m - 1) FROM (SELECT count(*) AS m FROM e GROUP BY source_id, target_id, type) UNION ALL SELECT 'hotspot', 'warning', count(*) FROM (SELECT target_id FROM e GROUP BY 1 HAVING count(DISTINCT source_id) >= 20))
        SELECT coalesce(rule, 'all') AS rule, coalesce(severity, 'all') AS severity, sum(n)::BIGINT AS n FROM r WHERE n > 0 GROUP BY GROUPING SETS ((rule, severity), (severity), ())""",
}
