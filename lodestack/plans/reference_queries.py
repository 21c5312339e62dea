"""Queries on references between tables (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestack.operators.references import orphan_references, orphan_report, page_states, wiki_references
from lodestack.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(*_inputs(spark, sf_dir))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(*_inputs(spark, sf_dir))


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages, chunks, links = (table(spark, sf_dir, n) for n in ("pages", "chunks", "page_links"))
    return wiki_references(pages, chunks, links), page_states(pages)


QUERIES = {"p2_found": p2_found, "p2_report": p2_report}

_FOUND_SQL = r"""
WITH pg AS (
  SELECT page_id, version, status, internal_links, try_cast(replace(trim(synced_at), ' ', 'T') AS TIMESTAMPTZ) AS tm,
         trim(page_id, E' \t\n\r') AS raw
  FROM pages),
st AS (
  SELECT CASE WHEN ltrim(raw, '0') = '' THEN '0' ELSE ltrim(raw, '0') END AS id,
         arg_max(coalesce(lower(trim(status)) IN ('trashed', 'deleted'), false), (coalesce(version, -1), coalesce(lower(trim(status)) IN ('trashed', 'deleted'), false))) AS removed,
         min(tm) AS first_synced
  FROM pg WHERE regexp_full_match(raw, '[0-9]+') GROUP BY 1),
links AS (
  SELECT coalesce(page_id, '') || ':' || coalesce(CAST(version AS VARCHAR), '') AS k, tm,
         regexp_replace(l, '^\s+|\s+$', '', 'g') AS l
  FROM (SELECT page_id, version, tm, unnest(internal_links) AS l FROM pg)),
full_links AS (SELECT k, tm, CASE WHEN starts_with(l, '/') THEN 'https://wiki.quillmere.example' || l ELSE l END AS l FROM links),
refs AS (
  SELECT 'pages' AS ref_table, 'internal_links' AS ref_field, k AS ref_key,
         coalesce(nullif(regexp_extract(l, 'pageId=([0-9]+)', 1), ''), nullif(regexp_extract(l, '/pages/([0-9]+)', 1), '')) AS t, tm AS ref_time
  FROM full_links WHERE starts_with(l, 'https://wiki.quillmere.example')
  UNION ALL SELECT 'chunks', 'linked_page_ids', coalesce(id, ''), unnest(linked_page_ids), indexed_at FROM chunks
  UNION ALL SELECT 'chunks', 'page_id', coalesce(id, ''), page_id, indexed_at FROM chunks
  UNION ALL SELECT 'page_links', 'dst', coalesce(CAST(link_id AS VARCHAR), ''), dst, seen_at FROM page_links),
clean AS (
  SELECT ref_table, ref_field, ref_key, ref_time, CASE WHEN ltrim(b, '0') = '' THEN '0' ELSE ltrim(b, '0') END AS target_page_id
  FROM (SELECT *, regexp_replace(t, '^\s+|\s+$', '', 'g') AS b FROM refs) WHERE regexp_full_match(b, '[0-9]+')),
found AS (
  SELECT DISTINCT ref_table, ref_field, ref_key, target_page_id,
    CASE WHEN st.id IS NULL THEN 'missing' WHEN removed THEN 'deleted' WHEN first_synced > ref_time THEN 'late' END AS reason,
    strftime(ref_time AT TIME ZONE 'UTC', '%Y-%m') AS ref_month
  FROM clean LEFT JOIN st ON st.id = target_page_id)
"""

SQL = {
    "p2_found": _FOUND_SQL + "SELECT * FROM found WHERE reason IS NOT NULL",
    "p2_report": _FOUND_SQL + "SELECT ref_table, ref_field, reason, ref_month, count(*) AS n_orphans FROM found WHERE reason IS NOT NULL GROUP BY ALL",
}
