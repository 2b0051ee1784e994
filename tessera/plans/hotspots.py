"""Hotspots over page links: which targets do many pages depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table

HREF = '<a href="([^"]+)"'


def link_edges(pages: DataFrame) -> DataFrame:
    """Distinct (page_id, target) edges of the anchors of a page."""
    targets = F.array_distinct(F.regexp_extract_all(F.col("html"), F.lit(HREF), 1))
    return pages.select("page_id", F.explode(targets).alias("target")).distinct()


def hotspots(edges: DataFrame, source: str, target: str, least: int = 2, high: int = 5) -> DataFrame:
    """AGG-03: targets with at least `least` distinct sources; R2 from `high` sources on, else R1."""
    return (
        edges.groupBy(target).agg(F.countDistinct(source).alias("n_sources"))
        .filter(F.col("n_sources") >= least)
        .withColumn("risk", F.when(F.col("n_sources") >= high, "R2").otherwise("R1"))
    )


def hotspots_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03 over the links of all pages."""
    return hotspots(link_edges(table(spark, sf_dir, "pages")), "page_id", "target")


QUERIES = {"hotspots_links": hotspots_links}
ORACLES = {
    "hotspots_links": """
        SELECT target, count(DISTINCT page_id) AS n_sources,
               CASE WHEN count(DISTINCT page_id) >= 5 THEN 'R2' ELSE 'R1' END AS risk
        FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS target FROM pages)
        GROUP BY target HAVING count(DISTINCT page_id) >= 2""",
}
