"""End-to-end plans: ingestion of pages into a chunk collection, and answering batches of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.config import settings
from lodestack.functions.text import chunk_id, has_table, linked_ids, url_to_id
from lodestack.operators import answer as ans
from lodestack.operators.chunking import chunk_texts
from lodestack.operators.encoders import encode
from lodestack.operators.html import parse_pages
from lodestack.operators.retrieval import distinct_queries, hybrid_search, rerank_by, rerank_lexical, rerank_passthrough
from lodestack.operators.upsert import latest_by, read_table, upsert_table
from lodestack.runtime import cut_lineage, pick_rows


def latest_pages(pages: DataFrame) -> DataFrame:
    """The current row of each page: highest version, then latest sync."""
    return latest_by(pages.where("page_id IS NOT NULL"), ["page_id"], F.coalesce("version", F.lit(-1)), F.coalesce("synced_at", F.lit("")), F.xxhash64("title", "content_text"))


def pages_from_html(raw: DataFrame, base: str | None = None) -> DataFrame:
    """Raw pages (``page_id, content_html`` and more) with ``content_blocks``, ``content_text`` and ``internal_links``, row by row."""
    made = {"content_blocks": "blocks", "content_text": "text", "internal_links": "links"}
    parsed = parse_pages(raw, base=base or settings().wiki_base, keep=[c for c in raw.columns if c not in made])
    return parsed.select(*(c for c in raw.columns if c not in made), *(F.col(v).alias(k) for k, v in made.items()))


def chunk_pages(pages: DataFrame) -> DataFrame:
    """Chunks of pages with deterministic ids and the page's title, url and linked ids; pages without text have none.

    ``pages``: one row per ``page_id``. The page's few fields ride through the chunker's key, so nothing is joined.
    """
    conf = settings()
    links = linked_ids(F.array_compact(F.transform(F.coalesce("internal_links", F.array().cast("array<string>")), lambda u: url_to_id(u))), conf.max_links)
    carried = F.to_json(F.struct("page_id", "title", "url", links.alias("linked_page_ids")))
    cut = chunk_texts(pages.select(carried.alias("page"), "content_text"), key="page", parent=conf.parent_size, child=conf.child_size, parent_overlap=conf.parent_overlap, child_overlap=conf.child_overlap)
    p = F.from_json("page", "page_id string, title string, url string, linked_page_ids array<string>")
    rows = cut.withColumn("p", p)
    return rows.select(
        chunk_id(F.col("p.page_id"), F.col("parent_index"), F.col("child_index")).alias("id"), "p.page_id", "p.title", "p.url", "parent_index", "child_index", "parent_text",
        F.col("child_text").alias("chunk"), "p.linked_page_ids", has_table(F.col("child_text")).alias("has_table"),
    )


def ingest(pages: DataFrame, path: str | None = None, replace_page: bool = True, dense: str = "hashing-dense", sparse: str = "hashing-sparse") -> DataFrame:
    """Pages to encoded chunks; with ``path`` they are upserted there by id.

    ``replace_page`` removes all earlier chunks of the pages at hand, so that nothing stale is left of a page that
    has shrunk or become empty; otherwise chunks are only added and overwritten.
    """
    latest = latest_pages(pages)
    points = encode(chunk_pages(latest), "chunk", dense, sparse)
    if path is not None:
        upsert_table(points, path, ["id"], ["page_id"] if replace_page else None, latest.select("page_id") if replace_page else None, bucket_by=["page_id"])
        return read_table(points.sparkSession, path)
    return points


def answer_questions(
    questions: DataFrame, chunks: DataFrame, limit: int | None = None, top_k: int | None = None, use_mmr: bool = False, rerank: str | Callable = "lexical", histories: DataFrame | None = None, dim: int | None = None,
    generator: Callable | None = None, ids_unique: bool = False, dense: str = "hashing-dense", sparse: str = "hashing-sparse",
) -> dict[str, DataFrame]:
    """Hits, sources, contexts, prompts, answers and events for ``query_id, question`` rows.

    Each different question is encoded once. ``chunks`` is read by several branches: hand in a written table.
    ``rerank``: "lexical", "none", or a scorer as of ``rerank_by``. ``generator``: a callable from a list of prompts to
    a list of answers; without one the best chunk is the answer. ``ids_unique`` says that no chunk is repeated. Limits not
    given are those of the settings. The hits are searched first and written; then only the chunks they name are looked up.
    """
    conf = settings()
    limit, top_k, dim = limit or conf.search_limit, top_k or conf.top_k, dim or conf.dense_dim
    asked = questions.where("question IS NOT NULL")
    unique = distinct_queries(asked, "question", limit, use_mmr)
    encoded = cut_lineage(encode(unique.select(F.col("cache_key").alias("id"), "text"), "text", dense, sparse))
    found = cut_lineage(hybrid_search(encoded.select("id", "dense", "sparse"), chunks, limit, use_mmr, dim, conf.rrf_k, conf.rrf_base, conf.mmr_lambda, ids_unique))
    payload = cut_lineage(pick_rows(chunks, found, "title", "url", "chunk"))  # at most ``limit`` chunks a question
    texts, wanted = payload.select("id", F.col("chunk").alias("text")), encoded.select("id", "text")
    best = rerank_passthrough(found, top_k) if rerank == "none" else rerank_lexical(found, wanted, texts, top_k) if rerank == "lexical" else rerank_by(found, wanted, texts, rerank, top_k)
    keyed = asked.select("query_id", "question").join(encoded.select(F.col("id").alias("cache_key"), F.col("text").alias("question")), "question")
    hits = cut_lineage(best.withColumnRenamed("query_id", "cache_key").join(payload, "id").join(keyed.select("query_id", "cache_key"), "cache_key").drop("cache_key"))
    sources, contexts = ans.sources_of(hits), ans.context_of(hits)
    prompted = ans.prompts(asked, contexts, histories)
    given = ans.generate(prompted.join(hits.select("query_id").distinct(), "query_id", "left_semi"), generator) if generator else ans.extractive_answers(hits)
    answers = asked.select("query_id").join(given, "query_id", "left").select("query_id", F.coalesce("answer", F.lit(ans.NO_HITS)).alias("answer"))
    return {"hits": hits, "sources": sources, "contexts": contexts, "prompts": prompted, "answers": answers, "events": ans.answer_events(answers, sources)}


def health(spark: SparkSession) -> DataFrame:
    """One row that says whether the session can run a job."""
    return spark.range(1).select(F.lit("ok").alias("status"), F.lit(spark.version).alias("spark_version"))
