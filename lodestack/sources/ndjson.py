"""Event streams as text files of one JSON object a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_events(events: DataFrame, path: str) -> None:
    """``query_id, seq, event`` as lines, in order inside each query; a query's lines stay in one file."""
    line = F.to_json(F.struct("query_id", "seq", "event"))
    events.repartition("query_id").sortWithinPartitions("query_id", "seq").select(line.alias("value")).write.mode("overwrite").text(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, seq, event`` of the lines; lines that cannot be read are skipped."""
    parsed = spark.read.text(path).select(F.from_json("value", "query_id string, seq int, event string").alias("e"))
    return parsed.where("e.query_id IS NOT NULL").select("e.*")
