"""Queries of the retrieval engine over whole tables, with equivalent SQL where SQL can say them.

Questions are the evaluation passages; vector searches take as queries every row whose id is divisible by 100
(of chunk ids, their last eight hexadecimal digits) and search all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import text as fx
from lodestack.operators import admin, answer, crawl, feedback, retrieval
from lodestack.operators.chunking import chunk_texts
from lodestack.operators.encoders import encode, postings_of
from lodestack.operators.html import parse_pages
from lodestack.operators.upsert import latest_by
from lodestack.plans import pipeline
from lodestack.runtime import cut_lineage, pick_rows, scratch_path, table
from lodestack.sources import ndjson
from lodestack.streaming import feeds

BASE = "https://wiki.quillmere.example"
ROOT = "10000007"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- feedback ---------------------------------------------------------------------------------------------------


@query("SELECT feedback_type, count(*) AS n FROM feedback GROUP BY 1")
def feedback_stats(spark: SparkSession, d: str) -> DataFrame:
    return feedback.feedback_stats(table(spark, d, "feedback"))


@query("SELECT feedback_type, count(*) AS n FROM feedback GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM feedback")
def feedback_stats_total(spark: SparkSession, d: str) -> DataFrame:
    return feedback.feedback_stats_total(table(spark, d, "feedback"))


@query("SELECT count(*) FILTER (feedback_type = 'positive') AS positive, count(*) FILTER (feedback_type = 'negative') AS negative, count(*) AS total FROM feedback")
def feedback_stats_pivot(spark: SparkSession, d: str) -> DataFrame:
    return feedback.feedback_pivot(table(spark, d, "feedback"), ["positive", "negative"])


_RECENT = "SELECT feedback_id, question, feedback_type, user_id FROM feedback {} ORDER BY created_at DESC NULLS LAST, feedback_id LIMIT {}"
_RECENT_COLS = ["feedback_id", "question", "feedback_type", "user_id"]


@query(_RECENT.format("", 50))
def feedback_recent(spark: SparkSession, d: str) -> DataFrame:
    return feedback.recent_feedback(table(spark, d, "feedback"), 50).select(*_RECENT_COLS)


@query(_RECENT.format("WHERE feedback_type = 'positive'", 20))
def feedback_recent_by_type(spark: SparkSession, d: str) -> DataFrame:
    return feedback.recent_feedback(table(spark, d, "feedback"), 20, "positive").select(*_RECENT_COLS)


@query(_RECENT.format("WHERE feedback_type = 'negative'", 20))
def feedback_negative_review(spark: SparkSession, d: str) -> DataFrame:
    return feedback.negative_feedback_for_review(table(spark, d, "feedback")).select(*_RECENT_COLS)


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_event_counts(spark: SparkSession, d: str) -> DataFrame:
    events = feeds.stream_of(spark, f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counts = feeds.windowed_counts(events, "ts", "event_type")
    return feeds.run_to_table(counts).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("SELECT feedback_type, count(*) AS n FROM (SELECT DISTINCT ON (feedback_id) feedback_id, feedback_type FROM feedback ORDER BY feedback_id) GROUP BY 1")
def stream_feedback_counts(spark: SparkSession, d: str) -> DataFrame:
    return feeds.distinct_counts(feeds.stream_of(spark, f"{d}/feedback.parquet"), "feedback_id", "feedback_type", "created_at")


@query("""SELECT time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01') - INTERVAL '30 minutes' * k AS window_start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) s(k) GROUP BY 1, 2""")
def stream_sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    events = feeds.stream_of(spark, f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counts = feeds.windowed_counts(events, "ts", "event_type", "1 hour", slide="30 minutes")
    return feeds.run_to_table(counts).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
  s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM e)
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM s GROUP BY user_id, no""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    events = feeds.stream_of(spark, f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id").where("user_id IS NOT NULL AND ts IS NOT NULL")
    counts = feeds.run_to_table(feeds.session_counts(events, "ts", "user_id"))
    return counts.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


# ---- pages, links, chunks ---------------------------------------------------------------------------------------

_LATEST = "SELECT * FROM pages WHERE page_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY coalesce(version, -1) DESC, coalesce(synced_at, '') DESC) = 1"


@query(f"SELECT page_id, version, title, synced_at FROM ({_LATEST})")
def page_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.latest_pages(table(spark, d, "pages")).select("page_id", "version", "title", "synced_at")


@query("SELECT page_id, version, url, nullif(coalesce(nullif(regexp_extract(url, 'pageId=([0-9]+)', 1), ''), regexp_extract(url, '/pages/([0-9]+)', 1)), '') AS id_of_url FROM pages")
def url_to_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "version", "url", fx.url_to_id(F.col("url")).alias("id_of_url"))


@query(f"SELECT page_id, version, '{BASE}' || '/spaces/' || space_key || '/pages/' || page_id || '/' || replace(title, ' ', '+') AS built FROM pages")
def page_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "version", fx.page_url(fx.base_url(F.lit(BASE + "//")), F.col("space_key"), F.col("page_id"), F.col("title")).alias("built"))


_LINKS = rf"""SELECT page_id, version, CASE WHEN starts_with(l, '/') THEN '{BASE}' || l ELSE l END AS link
  FROM (SELECT page_id, version, regexp_replace(unnest(internal_links), '^\s+|\s+$', '', 'g') AS l FROM pages)"""


@query(f"SELECT DISTINCT * FROM ({_LINKS}) WHERE starts_with(link, '{BASE}') AND (contains(link, 'pageId=') OR contains(link, '/pages/'))")
def link_filter(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "pages").select("page_id", "version", F.explode("internal_links").alias("l"))
    links = links.select("page_id", "version", fx.absolute_link(F.col("l"), BASE).alias("link"))
    return links.where(fx.is_page_link(F.col("link"), BASE)).distinct()


@query("SELECT id, contains(chunk, '| ') OR contains(chunk, '|-') AS shows_table FROM chunks WHERE chunk IS NOT NULL UNION ALL SELECT id, false FROM chunks WHERE chunk IS NULL")
def has_table_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("id", fx.has_table(F.col("chunk")).alias("shows_table"))


@query("SELECT id, coalesce(linked_page_ids, [])[1:10] AS links FROM chunks")
def linked_ids_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("id", fx.linked_ids(F.col("linked_page_ids")).alias("links"))


@query("SELECT count(*) AS n_links, count(DISTINCT id) AS n_chunks, page_id AS linked_page FROM (SELECT id, unnest(linked_page_ids) AS link FROM chunks) JOIN (SELECT DISTINCT page_id FROM pages) ON link = page_id GROUP BY page_id")
def linked_pages(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "chunks").select("id", F.explode("linked_page_ids").alias("page_id"))
    known = table(spark, d, "pages").select("page_id").distinct()
    return links.join(known, "page_id").groupBy(F.col("page_id").alias("linked_page")).agg(F.count("*").alias("n_links"), F.countDistinct("id").alias("n_chunks"))


@query("SELECT c.id, p.parent_text FROM (SELECT DISTINCT id, page_id, parent_index, parent_text FROM chunks) c JOIN (SELECT DISTINCT page_id, parent_index, parent_text FROM chunks) p ON c.page_id = p.page_id AND c.parent_index = p.parent_index AND c.parent_text = p.parent_text")
def child_parent(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    parents = chunks.select("page_id", "parent_index", "parent_text").distinct()
    return chunks.select("id", "page_id", "parent_index", "parent_text").distinct().join(parents, ["page_id", "parent_index", "parent_text"]).select("id", "parent_text")


_SHA = "sha1(unhex('1b671a6440d5491e99b0da01ff1f3341') || CAST(concat_ws('_', page_id, CAST(parent_index AS VARCHAR), CAST(child_index AS VARCHAR)) AS BLOB))"


@query(f"""SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS made
  FROM (SELECT id, {_SHA} AS h FROM chunks)""")
def chunk_uuid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("id", fx.chunk_id(F.col("page_id"), F.col("parent_index"), F.col("child_index")).alias("made"))


@query(r"""SELECT page_id, version, coalesce(regexp_replace(array_to_string(list_transform(list_filter(content_blocks, lambda b: b.type IN ('text', 'header', 'table')),
    lambda b: CASE WHEN b.type = 'table' THEN array_to_string(list_transform(coalesce(b.rows, []), lambda r: array_to_string(r, ' | ')), chr(10)) ELSE coalesce(b.text, '') END), chr(10)), '^\s+|\s+$', '', 'g'), '') AS plain FROM pages""")
def blocks_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "version", fx.blocks_text(F.col("content_blocks")).alias("plain"))


@query()
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    parsed = parse_pages(table(spark, d, "pages"))
    return parsed.select("page_id", F.posexplode("blocks").alias("block_no", "b")).select("page_id", "block_no", "b.type", "b.text", fx.rows_text(F.col("b.rows")).alias("rows_text"))


#: Pages and what they must give: fixed texts, so that the parser is checked against values and not against itself.
_GOLDEN_PAGES = [
    ("headings", "<h1>Top</h1><p>One <b>bold</b> word</p>", "Top\nOne bold word"),
    ("nested", "<div>outer<p>inner</p></div>", "outer inner\ninner"),
    ("table", "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td> 2 </td></tr></table>", "A | B\n1 | 2"),
    ("list", "<ul><li>one</li><li>two</li></ul>", "one\ntwo"),
    ("hidden", "<p>seen</p><script>var x = 1;</script><style>p {}</style>", "seen"),
    ("entities", "<p>a &amp; b&nbsp;c</p>", "a & b\u00a0c"),
    ("blank", "<p> </p><div></div>", ""),
]
_GOLDEN_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{t}')".replace("\n", "' || chr(10) || '") for k, _, t in _GOLDEN_PAGES) + ") g(page_id, text)"


@query(_GOLDEN_SQL)
def html_text_golden(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.createDataFrame([(k, h) for k, h, _ in _GOLDEN_PAGES], "page_id string, content_html string")
    return parse_pages(pages).select("page_id", "text")


@query("""SELECT * FROM (VALUES (0, 0, 'First part.'), (0, 1, 'Second part is longer.'), (1, 0, 'Third' || chr(10) || chr(10) || 'one')) g(parent_index, child_index, child_text)""")
def hier_chunks_golden(spark: SparkSession, d: str) -> DataFrame:
    text = spark.createDataFrame([("t", "First part.\n\nSecond part is longer.\n\nThird\n\none")], "page_id string, content_text string")
    return chunk_texts(text, parent=36, child=24, parent_overlap=0, child_overlap=0).select("parent_index", "child_index", "child_text")


@query()
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return parse_pages(table(spark, d, "pages")).select("page_id", "text", F.size("links").alias("n_links"))


@query()
def hier_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk_texts(table(spark, d, "documents"), key="doc_id", text="text")


@query()
def page_chunks_ingest(spark: SparkSession, d: str) -> DataFrame:
    points = pipeline.ingest(table(spark, d, "pages"))
    return points.select("id", "page_id", "title", "parent_index", "child_index", "chunk", "has_table", F.size("linked_page_ids").alias("n_links"), F.size("dense").alias("dim"), F.size("sparse.indices").alias("n_terms"))


@query("SELECT src, dst FROM page_links WHERE kind = 'child' AND src IS NOT NULL AND dst IS NOT NULL UNION SELECT src, dst FROM page_links WHERE kind = 'link' AND src IS NOT NULL AND dst IS NOT NULL")
def link_edges(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "page_links")
    return crawl.edges_of(links.where("kind = 'child'"), links.where("kind = 'link'"))


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM page_links WHERE src IS NOT NULL AND dst IS NOT NULL),
  r(page_id, depth) USING KEY (page_id) AS (
    SELECT '{ROOT}', 0 UNION SELECT e.dst, min(r.depth) + 1 FROM r JOIN e ON e.src = r.page_id
    WHERE NOT EXISTS (SELECT 1 FROM recurring.r x WHERE x.page_id = e.dst) GROUP BY e.dst)
  SELECT page_id, CAST(depth AS INT) AS depth FROM r""")
def crawl_bfs(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "page_links")
    return crawl.bfs(links.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL"), ROOT)


@query("SELECT count(*) AS n_points, count(DISTINCT vec_id) AS n_ids, count(embedding) AS n_vectors, min(len(embedding)) AS min_len, max(len(embedding)) AS max_len FROM embeddings")
def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return admin.collection_stats(table(spark, d, "embeddings"), "vec_id", "embedding")


@query("SELECT count(*) AS n_points, count(DISTINCT id) AS n_ids, count(dense) AS n_vectors, min(len(dense)) AS min_len, max(len(dense)) AS max_len FROM chunks")
def chunk_collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return admin.collection_stats(table(spark, d, "chunks"), "id", "dense")


@query("SELECT id, page_id, title, chunk, has_table FROM chunks WHERE id IS NOT NULL ORDER BY id LIMIT 1")
def sample_payload(spark: SparkSession, d: str) -> DataFrame:
    return admin.sample_payload(table(spark, d, "chunks"), "id").select("id", "page_id", "title", "chunk", "has_table")


# ---- questions --------------------------------------------------------------------------------------------------


@query("SELECT item_id, md5(concat_ws(':', item_text, '20', 'False')) AS cache_key FROM eval_items")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", fx.cache_key(F.col("item_text"), F.lit(20), F.lit(False)).alias("cache_key"))


@query("SELECT md5(concat_ws(':', question, '20', 'False')) AS cache_key, question AS text FROM feedback WHERE question IS NOT NULL GROUP BY 1, 2")
def query_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.distinct_queries(table(spark, d, "feedback"), "question")


_TERMS = r"SELECT {id} AS id, unnest(regexp_extract_all(lower({text}), '\p{{L}}+')) AS term FROM (SELECT DISTINCT ON ({id}) {id}, {text} FROM {tab} WHERE {id} IS NOT NULL)"
_POSTINGS = "SELECT id, term, count(*) AS tf FROM ({}) GROUP BY 1, 2"
_DOC_POSTINGS = _POSTINGS.format(_TERMS.format(id="doc_id", text="text", tab="documents"))
_ASKED = _POSTINGS.format(_TERMS.format(id="item_id", text="item_text", tab="eval_items"))
_BM25 = f"""WITH p AS ({_DOC_POSTINGS}), l AS (SELECT id, sum(tf) AS len FROM p GROUP BY 1), s AS (SELECT count(*) AS n, sum(len) / count(*) AS avg_len FROM l),
  df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
  w AS (SELECT p.id, p.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS weight FROM p JOIN l USING (id) JOIN df USING (term) CROSS JOIN s),
  q AS ({_ASKED}),
  scored AS (SELECT q.id AS query_id, w.id, round(sum(q.tf * w.weight), 9) AS score FROM q JOIN w USING (term) GROUP BY 1, 2),
  sparse AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank, id, score FROM scored)
"""


@query(_DOC_POSTINGS)
def sparse_postings(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.postings(table(spark, d, "documents"), "doc_id", "text", ids_unique=True)


def _sparse(spark: SparkSession, d: str, k: int) -> DataFrame:
    return retrieval.bm25_topk(table(spark, d, "eval_items"), table(spark, d, "documents"), "doc_id", "text", "item_id", "item_text", k, ids_unique=True)


@query(_BM25 + "SELECT query_id, rank, id, round(score, 6) AS score FROM sparse WHERE rank <= 20")
def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    return _sparse(spark, d, 20).withColumn("score", F.round("score", 6))


_DENSE = """dense AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank, id, score FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS score
    FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0))"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _dense(spark: SparkSession, d: str, k: int) -> DataFrame:
    v = _vectors(spark, d)
    return retrieval.dense_topk(v.where("id % 100 = 0"), v, k, 64)


@query(f"WITH {_DENSE} SELECT query_id, rank, id, round(score, 6) AS score FROM dense WHERE rank <= 20")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d, 20).withColumn("score", F.round("score", 6))


@query("SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE x.vec_id % 100 = 0")
def cosine(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    asked = v.where("id % 100 = 0").select(F.col("id").alias("a"), F.col("vec").alias("va"))
    return asked.join(v.select(F.col("id").alias("b"), F.col("vec").alias("vb")), F.col("a") != F.col("b")).select("a", "b", F.round(fx.cosine(F.col("va"), F.col("vb")), 6).alias("cosine"))


#: A second list per query: other vectors by the Euclidean distance of their unit vectors' first half.
_HALF = """half AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank, id, score FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding[1:32] AS DOUBLE[]), CAST(v.embedding[1:32] AS DOUBLE[])), 9) AS score
    FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0))"""
_FUSE = f"""WITH {_DENSE}, {_HALF}, lists AS (SELECT query_id, id, rank FROM dense WHERE rank <= 40 UNION ALL SELECT query_id, id, rank FROM half WHERE rank <= 40),
  fused AS (SELECT query_id, id, round(sum(1.0 / ({{k}} + rank - 1 + {{base}})), 9) AS score FROM lists GROUP BY 1, 2),
  ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank, id, score FROM fused)
  SELECT query_id, rank, id, round(score, 6) AS score FROM ranked"""


def _two_lists(spark: SparkSession, d: str, k: int = 40) -> list[DataFrame]:
    half = _vectors(spark, d).withColumn("vec", F.slice("vec", 1, 32))
    return [_dense(spark, d, k), retrieval.dense_topk(half.where("id % 100 = 0"), half, k, 32)]


@query(_FUSE.format(k=2, base=0) + " WHERE rank <= 20")
def rrf_fuse_k2(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.rrf_fuse(_two_lists(spark, d), 2, 0, 20).withColumn("score", F.round("score", 6))


@query(_FUSE.format(k=60, base=1) + " WHERE rank <= 20")
def rrf_fuse_k60(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.rrf_fuse(_two_lists(spark, d), 60, 1, 20).withColumn("score", F.round("score", 6))


@query(_FUSE.format(k=2, base=0))
def rrf_full_outer(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.rrf_full_outer(*_two_lists(spark, d)).withColumn("score", F.round("score", 6))


@query(f"WITH {_DENSE}, {_HALF} SELECT query_id, id FROM dense WHERE rank <= 40 INTERSECT SELECT query_id, id FROM half WHERE rank <= 40")
def candidates_in_both(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.in_both(*_two_lists(spark, d))


_UNIQUE = "u AS (SELECT id, any_value(dense) AS dense, any_value(sparse) AS sparse, any_value(chunk) AS chunk, any_value(title) AS title, any_value(url) AS url FROM chunks WHERE id IS NOT NULL GROUP BY id)"
_ASKING = "(('0x' || right(id, 8))::BIGINT % 100 = 0)"
_HYBRID_AT = f"""WITH {_UNIQUE},
  v AS (SELECT id, CAST(dense AS DOUBLE[]) AS v FROM u WHERE len(dense) = 384),
  dn AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT q.id AS query_id, v.id, CASE WHEN list_sum(list_transform(q.v, lambda x: x * x)) = 0 OR list_sum(list_transform(v.v, lambda x: x * x)) = 0 THEN 0 ELSE round(list_cosine_similarity(q.v, v.v), 9) END AS score
    FROM v q, v WHERE {_ASKING.replace('id', 'q.id')})),
  post AS (SELECT id, unnest(sparse.indices) AS term, CAST(unnest(sparse.values) AS DOUBLE) AS weight FROM u),
  sp AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT q.id AS query_id, p.id, round(sum(q.weight * p.weight), 9) AS score FROM post q JOIN post p USING (term) WHERE q.weight <> 0 AND p.weight <> 0 AND {_ASKING.replace('id', 'q.id')} GROUP BY 1, 2)),
  lists AS (SELECT query_id, id, rank FROM dn WHERE rank <= :depth UNION ALL SELECT query_id, id, rank FROM sp WHERE rank <= :depth),
  fused AS (SELECT query_id, id, round(sum(1.0 / (2 + rank - 1)), 9) AS score FROM lists GROUP BY 1, 2),
  hits AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank, id, score FROM fused QUALIFY rank <= :most)
"""
_HYBRID = _HYBRID_AT.replace(":depth", "40").replace(":most", "20")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("id IS NOT NULL")


def _asking(df: DataFrame) -> DataFrame:
    return df.where(F.conv(F.substring("id", -8, 8), 16, 10).cast("long") % 100 == 0)


def _hybrid(spark: SparkSession, d: str, use_mmr: bool = False) -> DataFrame:
    points = _chunks(spark, d).select("id", "dense", "sparse")
    return retrieval.hybrid_search(_asking(points), points, 20, use_mmr)


@query(_HYBRID + "SELECT query_id, rank, id, round(score, 6) AS score FROM hits")
def hybrid_search_top20(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).withColumn("score", F.round("score", 6))


@query(_HYBRID_AT.replace(":depth", "60").replace(":most", "60") + "SELECT query_id, rank, id, round(score, 6) AS score FROM hits")
def hybrid_mmr_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What diversity chooses from: three times the limit."""
    points = _chunks(spark, d).select("id", "dense", "sparse")
    return retrieval.fused_candidates(_asking(points), points, 60, 60).withColumn("score", F.round("score", 6))


@query()
def hybrid_search_mmr(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, use_mmr=True)


@query(f"""WITH {_DENSE}, c AS (SELECT d.query_id, d.id, d.rank, CAST(v.embedding AS DOUBLE[]) AS v, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS rel
    FROM dense d JOIN embeddings v ON v.vec_id = d.id JOIN embeddings q ON q.vec_id = d.query_id WHERE d.rank <= 9),
  s1 AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(0.7 * rel, 9) DESC, rank) = 1),
  c2 AS (SELECT c.*, greatest(0, list_cosine_similarity(c.v, s1.v)) AS near FROM c JOIN s1 USING (query_id) WHERE c.id <> s1.id),
  s2 AS (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(0.7 * rel - 0.3 * near, 9) DESC, rank) = 1),
  c3 AS (SELECT c2.query_id, c2.id, c2.rank, c2.rel, greatest(c2.near, list_cosine_similarity(c2.v, s2.v)) AS near FROM c2 JOIN s2 USING (query_id) WHERE c2.id <> s2.id),
  s3 AS (SELECT * FROM c3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(0.7 * rel - 0.3 * near, 9) DESC, rank) = 1)
  SELECT query_id, CAST(1 AS INT) AS rank, id FROM s1 UNION ALL SELECT query_id, 2, id FROM s2 UNION ALL SELECT query_id, 3, id FROM s3""")
def mmr_top3(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return retrieval.mmr(_dense(spark, d, 9), v.where("id % 100 = 0"), v, 3).select("query_id", "rank", "id")


@query(_HYBRID + "SELECT query_id, rank, id, round(score, 6) AS score FROM hits WHERE rank <= 5")
def rerank_passthrough(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.rerank_passthrough(_hybrid(spark, d)).withColumn("score", F.round("score", 6))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("id", F.col("chunk").alias("text"))


_RERANKED = r"""t AS (SELECT id, list_distinct(coalesce(regexp_extract_all(lower(chunk), '\p{L}+'), [])) AS t FROM u),
  re AS (SELECT h.query_id, h.id, CASE WHEN len(q.t) = 0 THEN 0 ELSE round(len(list_intersect(q.t, x.t)) / len(q.t), 9) END AS score FROM hits h JOIN t q ON q.id = h.query_id JOIN t x ON x.id = h.id),
  best AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank, id, score FROM re QUALIFY rank <= 5)
"""


def _reranked(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d)
    return cut_lineage(retrieval.rerank_lexical(_hybrid(spark, d), _asking(texts).dropDuplicates(["id"]), texts))


@query(_HYBRID + "," + _RERANKED + "SELECT query_id, rank, id, round(score, 6) AS score FROM best")
def rerank_lexical(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d).withColumn("score", F.round("score", 6))


def _payload(spark: SparkSession, d: str) -> DataFrame:
    best = _reranked(spark, d)
    return best.join(pick_rows(_chunks(spark, d), best, "title", "url", "chunk"), "id")


_FIRST = "src AS (SELECT query_id, rank, title, url FROM best JOIN u USING (id) QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY rank) = 1)"


@query(_HYBRID + "," + _RERANKED + "," + _FIRST + " SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS source_no, title, url FROM src")
def sources_dedup(spark: SparkSession, d: str) -> DataFrame:
    return answer.sources_of(_payload(spark, d))


_ENTRY = "'Source: [' || coalesce(title, 'None') || '](' || coalesce(url, 'None') || ')' || chr(10) || coalesce(chunk, 'None') || chr(10) || chr(10)"


@query(_HYBRID + "," + _RERANKED + f"SELECT query_id, string_agg({_ENTRY}, '' ORDER BY rank) AS context FROM best JOIN u USING (id) GROUP BY 1")
def context_build(spark: SparkSession, d: str) -> DataFrame:
    return answer.context_of(_payload(spark, d))


_STRICT_SQL = "'" + answer.STRICT_PROMPT.replace("'", "''").replace("{context}", "' || coalesce(context, '') || '").replace("{question}", "' || coalesce(chunk, '') || '") + "'"


@query(_HYBRID + "," + _RERANKED + f", ctx AS (SELECT query_id, string_agg({_ENTRY}, '' ORDER BY rank) AS context FROM best JOIN u USING (id) GROUP BY 1) SELECT u.id AS query_id, {_STRICT_SQL} AS prompt FROM u LEFT JOIN ctx ON ctx.query_id = u.id WHERE {_ASKING.replace('id', 'u.id')}")
def prompt_build(spark: SparkSession, d: str) -> DataFrame:
    questions = _asking(_texts(spark, d)).dropDuplicates(["id"]).select(F.col("id").alias("query_id"), F.col("text").alias("question"))
    return answer.prompts(questions, answer.context_of(_payload(spark, d)), template=answer.STRICT_PROMPT)


_TURNS = """turns AS (SELECT coalesce(user_id, 'none') || ':' || coalesce(strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d'), 'none') AS conv_id, created_at, feedback_id, question, answer
    FROM (SELECT DISTINCT ON (feedback_id) * FROM feedback WHERE feedback_id IS NOT NULL ORDER BY feedback_id))"""


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Two turns per entry; entries without time are conversations of their own and the last in order."""
    rows = table(spark, d, "feedback").where("feedback_id IS NOT NULL").dropDuplicates(["feedback_id"])
    conv = F.concat(F.coalesce("user_id", F.lit("none")), F.lit(":"), F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit("none")))
    pair = F.array(F.struct(F.lit(0).alias("part"), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit(1).alias("part"), F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    turn = F.struct(F.col("created_at").isNull().alias("no_time"), "created_at", "feedback_id", "m.part")
    return rows.select(conv.alias("conv_id"), "created_at", "feedback_id", F.explode(pair).alias("m")).select("conv_id", turn.alias("turn"), "m.role", "m.content")


@query(f"""WITH {_TURNS}, t AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY created_at IS NULL DESC, created_at DESC, feedback_id DESC) <= 10)
  SELECT conv_id, string_agg('User: ' || coalesce(question, '') || chr(10) || 'Assistant: ' || coalesce(answer, ''), chr(10) ORDER BY created_at NULLS LAST, feedback_id) AS history FROM t GROUP BY 1""")
def chat_history(spark: SparkSession, d: str) -> DataFrame:
    return answer.history_of(_turns(spark, d))


@query(f"WITH {_TURNS} SELECT conv_id, 2 * count(*) - 1 AS n_before FROM turns GROUP BY 1")
def previous_turns(spark: SparkSession, d: str) -> DataFrame:
    return answer.previous_turns(_turns(spark, d)).groupBy("conv_id").agg(F.count("*").alias("n_before"))


@query(f"WITH {_TURNS} SELECT conv_id, count(*) AS n_queries, 2 * count(*) AS n_messages FROM turns GROUP BY 1")
def session_counters(spark: SparkSession, d: str) -> DataFrame:
    return answer.session_counters(_turns(spark, d))


@query(r"""SELECT feedback_id AS query_id, array_to_string(regexp_extract_all(coalesce(answer, ''), '\S+\s*|\s+'), '') AS answer FROM (SELECT DISTINCT ON (feedback_id) * FROM feedback WHERE feedback_id IS NOT NULL ORDER BY feedback_id) WHERE coalesce(answer, '') <> ''""")
def ndjson_events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "feedback").where("feedback_id IS NOT NULL").dropDuplicates(["feedback_id"]).select(F.col("feedback_id").alias("query_id"), "answer", "sources")
    listed = rows.select("query_id", F.posexplode("sources").alias("source_no", "s")).select("query_id", "source_no", "s.title", "s.url")
    path = scratch_path(spark, "events")
    ndjson.write_events(answer.answer_events(rows.select("query_id", "answer"), listed), path)
    return answer.fold_events(ndjson.read_events(spark, path))


@query()
def encoded_documents(spark: SparkSession, d: str) -> DataFrame:
    points = encode(table(spark, d, "documents").select("doc_id", "text"), "text")
    return points.select("doc_id", F.size("dense").alias("dim"), F.size("sparse.indices").alias("n_terms"), F.round(F.aggregate("dense", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("squared_norm"))


@query("SELECT term, count(DISTINCT id) AS n_chunks, round(sum(weight), 3) AS total FROM (SELECT id, unnest(sparse.indices) AS term, CAST(unnest(sparse.values) AS DOUBLE) AS weight FROM (SELECT id, any_value(sparse) AS sparse FROM chunks WHERE id IS NOT NULL GROUP BY id)) WHERE weight <> 0 GROUP BY 1")
def vector_postings(spark: SparkSession, d: str) -> DataFrame:
    posted = postings_of(latest_by(_chunks(spark, d).select("id", "sparse"), ["id"], F.lit(1)))
    return posted.groupBy("term").agg(F.countDistinct("id").alias("n_chunks"), F.round(F.sum(F.col("weight").cast("double")), 3).alias("total"))


@query()
def answer_pipeline(spark: SparkSession, d: str) -> DataFrame:
    chunks = cut_lineage(pipeline.ingest(table(spark, d, "pages")))  # encoded once, read by several branches
    questions = table(spark, d, "eval_items").select(F.col("item_id").cast("string").alias("query_id"), F.col("item_text").alias("question"))
    return pipeline.answer_questions(questions, chunks, ids_unique=True)["answers"]
