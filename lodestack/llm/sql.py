"""Equivalent SQL of those queries that SQL can express on whole tables."""

from __future__ import annotations

#: Unicode whitespace as a character class.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"

P1_FOUND = rf"""
WITH items AS (
  SELECT 'page' AS item_kind, coalesce(page_id, '') || ':' || coalesce(CAST(version AS VARCHAR), '') AS item_key, content_text AS t, 1400 AS size_limit FROM pages
  UNION ALL SELECT 'parent', coalesce(page_id, '') || ':' || coalesce(CAST(parent_index AS VARCHAR), ''), parent_text, 1400 FROM chunks
  UNION ALL SELECT 'chunk', coalesce(id, ''), chunk, 400 FROM chunks)
SELECT item_kind, item_key, CASE WHEN max(longest) > max(size_limit) THEN 'forced' ELSE 'natural' END AS cut_kind
FROM (SELECT *, list_max(list_transform(regexp_split_to_array(t, '{_SPACE}+'), lambda w: length(w))) AS longest FROM items
      WHERE length(regexp_replace(t, '^{_SPACE}+|{_SPACE}+$', '', 'g')) > size_limit)
GROUP BY 1, 2"""

P4_FOUND = """
WITH v AS (SELECT id, any_value(CAST(dense AS DOUBLE[])) AS v FROM chunks
           WHERE id IS NOT NULL AND len(dense) = 384 AND list_sum(list_transform(dense, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END)) > 0 GROUP BY id),
near AS (SELECT a.id, b.id AS other FROM v a JOIN v b ON a.id <> b.id
         QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.id) <= 5)
SELECT DISTINCT least(id, other) AS chunk_id_a, greatest(id, other) AS chunk_id_b FROM near"""

P5_FOUND = rf"""
WITH cur AS (SELECT page_id, arg_max({{'t': coalesce(title, ''), 'x': content_text}}, coalesce(version, -1)) AS r FROM pages WHERE page_id IS NOT NULL GROUP BY 1),
w AS (SELECT page_id, {_WORDS.format("r.t || ' ' || r.x")} AS w FROM cur WHERE trim(r.x) <> ''),
s AS (SELECT DISTINCT page_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS run FROM w WHERE len(w) > 2),
n AS (SELECT page_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.page_id AS a, b.page_id AS b, count(*) AS o FROM s a JOIN s b ON a.run = b.run AND a.page_id < b.page_id GROUP BY 1, 2)
SELECT a AS page_id_a, b AS page_id_b FROM shared JOIN n x ON x.page_id = a JOIN n y ON y.page_id = b WHERE 3 * o >= x.n + y.n"""

P8_FOUND = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT item_id, {_WORDS.format('item_text')} AS w FROM eval_items WHERE item_id IS NOT NULL AND item_text IS NOT NULL),
dr AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS run FROM d WHERE len(w) >= 12),
ir AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS run FROM i WHERE len(w) >= 12)
"""

P4_NEAREST = """
WITH v AS (SELECT id, any_value(CAST(dense AS DOUBLE[])) AS v FROM chunks
           WHERE id IS NOT NULL AND len(dense) = 384 AND list_sum(list_transform(dense, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END)) > 0 GROUP BY id),
s AS (SELECT a.id, b.id AS neighbour_id, round(list_cosine_similarity(a.v, b.v), 6) AS c FROM v a JOIN v b ON a.id <> b.id)
SELECT id, neighbour_id, CAST(row_number() OVER (PARTITION BY id ORDER BY c DESC, neighbour_id) AS INT) AS rank FROM s QUALIFY rank <= 5"""

P5_GROUPS = P5_FOUND.replace("WITH cur", "WITH RECURSIVE cur", 1).replace("\nSELECT a AS page_id_a", ",\npairs AS (SELECT a AS page_id_a", 1) + """),
cls AS (SELECT page_id, md5(string_agg(run, '|' ORDER BY run)) AS c FROM s GROUP BY 1),
links AS (SELECT x.c AS p, y.c AS q FROM pairs JOIN cls x ON x.page_id = page_id_a JOIN cls y ON y.page_id = page_id_b WHERE x.c <> y.c),
both_ways AS (SELECT p, q FROM links UNION SELECT q, p FROM links),
reach(c, r) AS (SELECT DISTINCT c, c FROM cls UNION SELECT reach.c, q FROM reach JOIN both_ways ON p = r),
least AS (SELECT reach.c, min(page_id) AS group_id FROM reach JOIN cls ON cls.c = reach.r GROUP BY 1),
degree AS (SELECT p AS c, count(DISTINCT q) AS n_links FROM both_ways GROUP BY 1)
SELECT page_id AS key, group_id, coalesce(n_links, 0) AS n_links FROM cls JOIN least USING (c) LEFT JOIN degree USING (c)"""

SQL = {
    "p1_found": P1_FOUND,
    "p4_found": P4_FOUND,
    "p4_nearest": P4_NEAREST,
    "p5_found": P5_FOUND,
    "p5_groups": P5_GROUPS,
    "p8_found": P8_FOUND + "SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (run)",
    "p8_report": P8_FOUND + ", l AS (SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (run)) SELECT e.item_id, max(e.suite) AS suite, count(DISTINCT l.doc_id) AS n_docs FROM eval_items e LEFT JOIN l USING (item_id) WHERE e.item_id IS NOT NULL GROUP BY 1",
}
