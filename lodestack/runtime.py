"""Session-level helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides up to this many bytes (estimated from a checked row count) may be broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs on this machine alone (tests) is a temporary folder made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestack-ckpt-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs nothing upstream."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for a table written on the way."""
    return f"{shared_dir(spark).rstrip('/')}/lodestack-{label}-{uuid.uuid4().hex}"


def pick_rows(collection: DataFrame, wanted: DataFrame, *cols: str, id_col: str = "id") -> DataFrame:
    """The rows of a collection whose id is wanted, each id once; the wanted ids are few and written, such as those of hits.

    The ids are sent to the collection's rows if they are within ``BROADCAST_BYTES``, so that nothing but the wanted
    rows is shuffled; beyond that both sides are shuffled by id.
    """
    ids = cut_lineage(wanted.select(F.col(id_col)).where(F.col(id_col).isNotNull()).distinct())
    size = ids.agg(F.count("*").alias("n"), F.max(F.length(F.col(id_col).cast("string"))).alias("most")).first()
    small = size.n * (32 + (size.most or 0)) <= BROADCAST_BYTES
    return collection.select(id_col, *cols).join(F.broadcast(ids) if small else ids, id_col, "left_semi").dropDuplicates([id_col])


def row_key(*cols: str, sep: str = ":"):
    """Column that joins the given columns by ``sep``; a null part counts as the empty text."""
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return F.concat(*parts)
