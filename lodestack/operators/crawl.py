"""Crawl closure: pages reachable from a root over child and link edges, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.runtime import cut_lineage

MERGE_LEVELS = 8


def edges_of(child_edges: DataFrame, link_edges: DataFrame) -> DataFrame:
    """Distinct ``src, dst`` of both kinds; edges with a null end are dropped."""
    both = child_edges.select("src", "dst").union(link_edges.select("src", "dst"))
    return both.where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def bfs(edges: DataFrame, root: str, max_pages: int | None = None, failed: DataFrame | None = None) -> DataFrame:
    """``page_id, depth`` of every page reachable from ``root``, each once at its least depth.

    Within a level pages are visited in order of id. ``max_pages`` counts attempts, so a page of ``failed``
    (``page_id``) takes one and contributes no edges. Each level is a join of the frontier with the edges and an
    anti-join with what was visited; its lineage is cut.
    """
    spark = edges.sparkSession
    edges = cut_lineage(edges.select("src", "dst").distinct().repartition("src"))
    visited = spark.createDataFrame([(root, 0)], "page_id string, depth int")
    frontier, seen, depth = visited, 1, 0
    while max_pages is None or seen < max_pages:
        depth += 1
        alive = frontier.join(failed.select("page_id"), "page_id", "left_anti") if failed is not None else frontier
        found = edges.join(alive.select(F.col("page_id").alias("src")), "src").select(F.col("dst").alias("page_id")).distinct()
        found = found.join(visited, "page_id", "left_anti").withColumn("depth", F.lit(depth))
        if max_pages is not None:
            found = found.orderBy("page_id").limit(max_pages - seen)
        frontier = cut_lineage(found)
        n = frontier.count()
        if not n:
            break
        seen += n
        visited = visited.unionByName(frontier)  # of written levels, merged now and then to keep the plan short
        if depth % MERGE_LEVELS == 0:
            visited = cut_lineage(visited.coalesce(max(1, spark.sparkContext.defaultParallelism)))
    return visited
