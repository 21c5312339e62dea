"""Feedback store: append, counts, and recent entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_feedback(entries: DataFrame) -> DataFrame:
    """Entries as they are stored: with an id, server time, and ``feedback`` as ``feedback_type``; extra columns fall away.

    ``entries``: ``question, answer, feedback, sources`` and optionally ``user_id, comment``.
    """
    optional = [(F.col(c) if c in entries.columns else F.lit(None)).cast("string").alias(c) for c in ("user_id", "comment")]
    return entries.select(F.uuid().alias("feedback_id"), "question", "answer", F.col("feedback").alias("feedback_type"), "sources", *optional, F.current_timestamp().alias("created_at"))


def save_feedback(entries: DataFrame, path: str) -> DataFrame:
    """Append entries to the store and return them with their ids.

    The store is partitioned for its two ways of access, by type and by day, and sorted by time inside a file, so that
    statistics of a type and the latest entries read their own files only.
    """
    from lodestack.runtime import cut_lineage

    stored = cut_lineage(new_feedback(entries))  # ids are drawn once
    placed = stored.withColumn("by_type", F.coalesce("feedback_type", F.lit(""))).withColumn("day", F.to_date("created_at"))
    placed.repartition("by_type", "day").sortWithinPartitions("created_at").write.mode("append").partitionBy("by_type", "day").parquet(path)
    return stored


def read_feedback(spark: SparkSession, path: str, feedback_type: str | None = None, since: str | None = None) -> DataFrame:
    """The stored entries, of one type or from a day on where given; other partitions are not read."""
    rows = spark.read.parquet(path)
    if feedback_type:
        rows = rows.where(F.col("by_type") == feedback_type)
    if since:
        rows = rows.where(F.col("day") >= F.lit(since).cast("date"))
    return rows.drop("by_type", "day")


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """``feedback_type, n``."""
    return feedback.groupBy("feedback_type").agg(F.count("*").alias("n"))


def feedback_stats_total(feedback: DataFrame) -> DataFrame:
    """Counts per type and a row ``total``, which is 0 for an empty store."""
    return feedback_stats(feedback).unionByName(feedback.agg(F.lit("total").alias("feedback_type"), F.count("*").alias("n")))


def feedback_pivot(feedback: DataFrame, kinds: list[str]) -> DataFrame:
    """One row with a count per given kind and the total."""
    return feedback.agg(*(F.count_if(F.col("feedback_type") == k).alias(k) for k in kinds), F.count("*").alias("total"))


def recent_feedback(feedback: DataFrame, limit: int = 50, feedback_type: str | None = None) -> DataFrame:
    """The latest entries; 0 is no limit, a null or empty type no filter; ties by id."""
    rows = feedback.where(F.col("feedback_type") == feedback_type) if feedback_type else feedback
    rows = rows.orderBy(F.col("created_at").desc(), "feedback_id")
    return rows.limit(limit) if limit else rows


def negative_feedback_for_review(feedback: DataFrame, limit: int = 20) -> DataFrame:
    return recent_feedback(feedback, limit, "negative")
