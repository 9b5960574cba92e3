"""Upserts as a stream into a table of hash buckets, of which a batch rewrites only those it touches (K1, K4).

path/data/version=N/bucket=B holds the rows of a bucket as batch N left them, and
path/manifest/version=N tells of every bucket in which version it stands. A version
counts once its manifest is whole (Spark's _SUCCESS file), so a batch that died half
way is not seen; a replayed one writes its own version anew. Readers of an older
manifest are not disturbed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BUCKETS = 64
MANIFEST = "bucket int, at long"


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions of a table, in order."""
    folder, files = _files(spark, f"{path}/manifest")
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    exists = lambda n: files.exists(_files(spark, f"{path}/manifest/{n}/_SUCCESS")[0])
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("version=") and exists(n))


def manifest(spark: SparkSession, path: str, below: int | None = None) -> dict[int, int]:
    """bucket -> version of the newest whole version (below a number): a row a bucket."""
    known = [v for v in versions(spark, path) if below is None or v < below]
    return {r["bucket"]: r["at"] for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest/version={known[-1]}").collect()} if known else {}


def buckets_of(spark: SparkSession, path: str, at: dict[int, int]) -> DataFrame | None:
    """The rows of some buckets, each in its version; None if there are none."""
    if not at:
        return None
    return spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/version={v}/bucket={b}" for b, v in sorted(at.items())]).drop("version")


def last_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the last row by order: an aggregate, so that a hot key combines in each task."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")).select(*keys, "__last.*")


def upsert_batch(batch: DataFrame, number: int, path: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> None:
    """Write version `number`: the touched buckets with the last row of every key, and the manifest.

    order tells which of two rows of a key is the later one, whenever they come; rows
    that it leaves equal go by batch, then by their other columns.
    """
    spark = batch.sparkSession
    rest = [c for c in batch.columns if c not in keys and c not in order]
    by = [*order, "__batch", *rest]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    rows = last_rows(batch.withColumn("__batch", F.lit(number).cast("long")).withColumn("bucket", bucket), keys, by)
    before = manifest(spark, path, number)
    touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most as many as buckets
    old = buckets_of(spark, path, {b: before[b] for b in touched if b in before})
    merged = rows if old is None else last_rows(old.select(*rows.columns).unionByName(rows), keys, by)
    if touched:
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={number}")
    at = before | dict.fromkeys(touched, number)
    spark.createDataFrame(list(at.items()), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={number}")


def upsert_stream(updates: DataFrame, path: str, keys: list[str], checkpoint: str, order: list[str] | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """K1, K4 as a stream: every batch is one version of the table."""
    write = lambda batch, number: upsert_batch(batch, number, path, keys, order or [], buckets)
    return updates.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest whole version of a table, or None."""
    rows = buckets_of(spark, path, manifest(spark, path))
    return None if rows is None else rows.drop("bucket", "__batch")
