"""Queries of the training-data operators and, where SQL can say it, their equivalents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import knn, leakage, markup, mixing, near_duplicates, pii, qa_pairs, reading_level, split
from lodestack.llm.sql import SQL  # noqa: F401 - read by the entry module
from lodestack.runtime import table


#: Vocabulary file that the registered queries count tokens by; the operator takes any.
TOKENIZER = os.environ.get("LODESTACK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, chunks = _tables(spark, sf_dir, "pages", "chunks")
    return split.oversized_items(split.split_items(split.wiki_items(pages, chunks), with_text=False))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, chunks = _tables(spark, sf_dir, "pages", "chunks")
    return split.split_items(split.unique_items(split.wiki_items(pages, chunks)))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa_pairs.broken_pairs(table(spark, sf_dir, "feedback"))


def p3_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    feedback = table(spark, sf_dir, "feedback")
    return qa_pairs.defect_profile(feedback, qa_pairs.broken_pairs(feedback))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.neighbour_pairs(knn.nearest_vectors(table(spark, sf_dir, "chunks")))


def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and ranks; cosines are left out, as vectors of 16 bits a value leave their sixth digit open."""
    return knn.nearest_vectors(table(spark, sf_dir, "chunks")).select("id", "neighbour_id", "rank")


def _page_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = near_duplicates.current_pages(table(spark, sf_dir, "pages"))
    return near_duplicates.near_duplicates(pages, "page_id", "title", "content_text", near_duplicates.PAGE_WIDTH, near_duplicates.PAGE_SIMILARITY)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.pairs_of(*_page_links(spark, sf_dir)).select(F.col("key_a").alias("page_id_a"), F.col("key_b").alias("page_id_b"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups_of(*_page_links(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, feedback, names = _tables(spark, sf_dir, "pages", "feedback", "name_parts")
    return pii.types_found(pii.redact_fields(pii.wiki_fields(pages, feedback), names, with_text=False))


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, feedback, names = _tables(spark, sf_dir, "pages", "feedback", "name_parts")
    return pii.redact_fields(pii.wiki_fields(pages, feedback), names).distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, chunks = _tables(spark, sf_dir, "pages", "chunks")
    return markup.notations_found(markup.clean_markup(markup.wiki_texts(pages, chunks), with_text=False))


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, chunks = _tables(spark, sf_dir, "pages", "chunks")
    return markup.clean_markup(markup.wiki_texts(pages, chunks)).distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(*_tables(spark, sf_dir, "documents", "eval_items"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leak_report(p8_found(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(*_tables(spark, sf_dir, "documents", "mix_targets"), TOKENIZER)[0]


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(*_tables(spark, sf_dir, "documents", "mix_targets"), TOKENIZER)[1]


def p9_report_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as there are: small sources reach their cap, and what they lack goes to their siblings first."""
    return mixing.mix_sources(*_tables(spark, sf_dir, "documents", "mix_targets"), TOKENIZER, whole=True)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_level.reading_levels(*_tables(spark, sf_dir, "documents", "level_samples")).select("doc_id", "reading_level")


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_level.level_profile(reading_level.reading_levels(*_tables(spark, sf_dir, "documents", "level_samples")))


QUERIES = {
    "p1_found": p1_found, "p1_pieces": p1_pieces,
    "p3_found": p3_found, "p3_profile": p3_profile,
    "p4_found": p4_found, "p4_nearest": p4_nearest,
    "p5_found": p5_found, "p5_groups": p5_groups,
    "p6_found": p6_found, "p6_redacted": p6_redacted,
    "p7_found": p7_found, "p7_clean": p7_clean,
    "p8_found": p8_found, "p8_report": p8_report,
    "p9_mix": p9_mix, "p9_report": p9_report, "p9_report_whole": p9_report_whole,
    "p10_found": p10_found, "p10_profile": p10_profile,
}


