"""Upserts on Parquet tables: rows in buckets by key; only touched buckets are written, and a manifest names the live files.

A table is a folder of Parquet folders, one per bucket and commit, and ``_manifest-N.json`` files, of which the one of
the highest number counts. A commit writes its buckets beside the others and then its manifest by one rename, so a
crash at any time leaves the earlier state whole.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.runtime import cut_lineage

BUCKETS = 32
#: Commits whose files are kept for readers that are under way.
KEPT_COMMITS = 2


def latest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in the given order. Aggregated before the shuffle, so a hot key is one row per task."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], replace_by: list[str] | None = None, replaced: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal key.

    Columns that ``new`` lacks keep their old values. With ``replace_by``, all old rows of a key found in ``new`` (or
    in ``replaced``, which may hold keys without any new row) go, so that nothing stale is left. With ``order``, of two
    rows of a key the one of the greater value stays, whichever came first; a null is the least, and of equal values the new row stays.
    """
    if replace_by:
        gone = new.select(*replace_by) if replaced is None else replaced.select(*replace_by).unionByName(new.select(*replace_by))
        return old.join(gone.distinct(), replace_by, "left_anti").unionByName(new, allowMissingColumns=True).select(*old.columns)
    missing = [c for c in old.columns if c not in new.columns]
    given = new.join(old.select(*keys, *missing), keys, "left") if missing else new
    given = given.select(*old.columns)
    if order:
        both = old.withColumn("_new", F.lit(0)).unionByName(given.withColumn("_new", F.lit(1)))
        return latest_by(both, keys, F.col(order).isNotNull(), F.col(order), F.col("_new")).select(*old.columns)
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(given)


class _Files:
    """The few file operations of a table, on any file system Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(""))] if self.fs.exists(self.at("")) else []

    def last(self) -> int:
        return max((int(n[10:-5]) for n in self.names() if n.startswith("_manifest-") and n.endswith(".json")), default=0)

    def read(self, no: int) -> dict:
        stream = self.fs.open(self.at(f"_manifest-{no}.json"))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def commit(self, no: int, manifest: dict) -> None:
        draft = self.at(f".draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self.fs.rename(draft, self.at(f"_manifest-{no}.json")):
            raise RuntimeError(f"another writer has committed {no} at {self.path}")
        live = {d for k in range(max(1, no - KEPT_COMMITS + 1), no + 1) if k == no or self.fs.exists(self.at(f"_manifest-{k}.json")) for d in self.read(k)["dirs"].values()}
        for n in self.names():
            if (n.startswith("part-") and n not in live) or (n.startswith("_manifest-") and int(n[10:-5]) <= no - KEPT_COMMITS):
                self.fs.delete(self.at(n), True)


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _load(spark: SparkSession, files: _Files, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
    dirs = [d for b, d in manifest["dirs"].items() if buckets is None or int(b) in buckets]
    paths = [f"{files.path}/{d}" for d in dirs]
    return spark.read.schema(manifest["schema"]).parquet(*paths) if paths else spark.createDataFrame([], manifest["schema"])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table at a path as of its last commit."""
    files = _Files(spark, path)
    return _load(spark, files, files.read(files.last()))


def create_table(spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS) -> DataFrame:
    """The table at a path; an empty one of that schema is made where there is none; another schema is an error."""
    files = _Files(spark, path)
    want = spark.createDataFrame([], schema)
    if not files.last():
        files.fs.mkdirs(files.at(""))
        files.commit(1, {"schema": _schema(want), "buckets": buckets, "dirs": {}})
    got = read_table(spark, path)
    if [(f.name, f.dataType) for f in got.schema] != [(f.name, f.dataType) for f in want.schema]:
        raise ValueError(f"the table at {path} has another schema")
    return got


def upsert_table(new: DataFrame, path: str, keys: list[str], replace_by: list[str] | None = None, replaced: DataFrame | None = None, order: str | None = None, buckets: int = BUCKETS, bucket_by: list[str] | None = None) -> None:
    """Upsert into the table at a path, which is made where there is none; parameters as of ``upsert``.

    Rows lie in buckets by ``bucket_by`` (columns that a key determines), else by ``replace_by`` or the keys, always by the same columns. Only
    buckets that a new or replaced key falls into are read and written. Written again, the same rows leave the same table.
    """
    spark = new.sparkSession
    files = _Files(spark, path)
    if not files.last():
        create_table(spark, path, _schema(new), buckets)
    no = files.last()
    manifest = files.read(no)
    by = bucket_by or replace_by or keys
    if manifest.setdefault("by", by) != by:
        raise ValueError(f"the table at {path} is written by {manifest['by']}")
    bucket = F.pmod(F.xxhash64(*by), F.lit(manifest["buckets"])).cast("int")
    new = cut_lineage(new)
    touched = new.select(*by) if replaced is None else new.select(*by).unionByName(replaced.select(*by))
    hit = sorted(r[0] for r in touched.select(bucket.alias("b")).distinct().collect())  # at most the number of buckets
    if not hit:
        return
    old = _load(spark, files, manifest, hit)
    rows = upsert(old, new, keys, replace_by, replaced, order).withColumn("_bucket", bucket)
    commit = f"part-{no + 1}-{uuid.uuid4().hex[:8]}"
    rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{files.path}/{commit}")
    filled = {n.getPath().getName() for n in files.fs.listStatus(files.at(commit))}
    dirs = {b: d for b, d in manifest["dirs"].items() if int(b) not in hit}
    for b in hit:
        if f"_bucket={b}" in filled:  # a folder of its own, so that it can be dropped when its bucket is written again
            files.fs.rename(files.at(f"{commit}/_bucket={b}"), files.at(f"{commit}-{b}"))
            dirs[str(b)] = f"{commit}-{b}"
    files.fs.delete(files.at(commit), True)
    files.commit(no + 1, manifest | {"dirs": dirs})
