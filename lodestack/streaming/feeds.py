"""Structured Streaming: feedback counts and continuous page ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.upsert import latest_by, upsert_table
from lodestack.runtime import scratch_path


def stream_of(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet file, or a folder of them, as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rstrip("/").rpartition("/")
    single = spark.read.format("binaryFile").load(path).limit(2).select("path").collect()
    if len(single) == 1 and single[0][0].rstrip("/").endswith("/" + name):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts per window and kind; rows later than the watermark are dropped by a stream. With ``slide``, windows overlap."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(window.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def session_counts(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per session of a key: sessions end after a gap without an event."""
    w = F.session_window(time, gap).alias("w")
    return events.withWatermark(time, late).groupBy(w, key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and return its result table, which lies in the shared folder.

    In complete mode the last result counts, in append mode all batches together; a batch that is run again replaces
    its own files.
    """
    spark = stream.sparkSession
    path, schema = scratch_path(spark, "stream-table"), stream.schema

    def write(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={no}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def distinct_counts(stream: DataFrame, key: str, kind: str, time: str, late: str = "1 hour") -> DataFrame:
    """``kind, n`` over a whole stream, each key once within the watermark; counted batch by batch inside the stream.

    A row without time takes part as one of the least time. One row per kind and batch leaves the stream.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, "stream-counts")
    at = F.coalesce(F.col(time), F.timestamp_seconds(F.lit(0)))
    once = stream.select(key, kind, at.alias(time)).withWatermark(time, late).dropDuplicatesWithinWatermark([key])

    def write(batch: DataFrame, no: int) -> None:
        batch.groupBy(kind).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={no}")

    once.writeStream.foreachBatch(write).option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    kind_type = stream.schema[kind].dataType.simpleString()
    return spark.read.schema(f"`{kind}` {kind_type}, n long").option("recursiveFileLookup", "true").parquet(path).groupBy(kind).agg(F.sum("n").alias("n"))


def deduplicated(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def upsert_stream(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str):
    """Upsert every micro-batch into the table at a path; a stored row of greater order stays, and replayed batches leave the same rows."""

    def write(batch: DataFrame, _: int) -> None:
        upsert_table(latest_by(batch, keys, F.col(order).isNotNull(), F.col(order)), path, keys, order=order)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
