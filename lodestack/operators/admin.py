"""Inspection of a vector collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collection_stats(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Points, distinct ids, usable vectors, and least and greatest vector length."""
    n = F.size(vec_col)
    return vectors.agg(
        F.count("*").alias("n_points"), F.countDistinct(id_col).alias("n_ids"), F.count(vec_col).alias("n_vectors"),
        F.min(F.when(F.col(vec_col).isNotNull(), n)).cast("long").alias("min_len"), F.max(F.when(F.col(vec_col).isNotNull(), n)).cast("long").alias("max_len"),
    )


def sample_payload(points: DataFrame, id_col: str) -> DataFrame:
    """The payload of one point, that of the least id, without its vectors."""
    payload = [f.name for f in points.schema.fields if f.name not in ("dense", "sparse", "embedding")]
    return points.select(*payload).where(F.col(id_col).isNotNull()).orderBy(id_col).limit(1)
