"""Snapshots with a tree of digests: a comparison reads only what differs.

A snapshot is a table in buckets by the hash of its key, one folder each, and a tree:
a digest a bucket, and above them one for every FAN nodes up to a root. Two snapshots
are compared from the roots down; a subtree whose digests agree is not looked at, and
a bucket whose digests agree is not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from dealforge.operators.access import audit_log

BUCKETS = 256
FAN = 16


def digest_of(*columns: str) -> list[Column]:
    """Aggregates that do not depend on order: a count, and two sums of independent hashes of rows."""
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])
    second = F.xxhash64(row, F.hash(*columns))
    return [F.count("*").alias("n"), F.bit_xor(row).alias("a"), F.sum(F.pmod(second, F.lit(1 << 40))).alias("b")]


def digest_tree(rows: DataFrame, buckets: int = BUCKETS, fan: int = FAN) -> DataFrame:
    """level (0: buckets), node, n, a, b of a table with a column bucket."""
    columns = sorted(c for c in rows.columns if c != "bucket")
    levels = [rows.groupBy(F.col("bucket").alias("node")).agg(*digest_of(*columns)).withColumn("level", F.lit(0))]
    level, nodes = 0, buckets
    while nodes > 1:
        level, nodes = level + 1, -(-nodes // fan)
        below = levels[-1]
        above = below.groupBy(F.floor(F.col("node") / fan).cast("int").alias("node")).agg(F.sum("n").alias("n"), F.bit_xor(F.xxhash64("node", "n", "a", "b")).alias("a"), F.sum(F.pmod(F.xxhash64("b", "a", "node"), F.lit(1 << 40))).alias("b"))
        levels.append(above.withColumn("level", F.lit(level)))
    return reduce(DataFrame.unionByName, levels).select("level", "node", "n", "a", "b")


def write_snapshot(df: DataFrame, key: str, path: str, buckets: int = BUCKETS) -> None:
    """Write df as a snapshot: path/rows by bucket and path/tree."""
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
    df.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/rows")
    rows = df.sparkSession.read.schema(StructType([*df.schema.fields, StructField("bucket", IntegerType())])).parquet(f"{path}/rows")
    digest_tree(rows, buckets).coalesce(1).write.parquet(f"{path}/tree")  # a row a node


def changed_buckets(old: DataFrame, new: DataFrame, fan: int = FAN) -> list[int]:
    """The buckets whose digests differ, found from the roots down: at most as many as there are buckets."""
    both = old.select("level", "node", F.struct("n", "a", "b").alias("old")).join(new.select("level", "node", F.struct("n", "a", "b").alias("new")), ["level", "node"], "full_outer")
    differs = both.filter(~F.col("old").eqNullSafe(F.col("new"))).select("level", "node")
    open_ = None
    for level in range(differs.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0], -1, -1):
        here = differs.filter(F.col("level") == level)
        if open_ is not None:
            here = here.filter(F.floor(F.col("node") / fan).isin(open_))
        open_ = [r["node"] for r in here.collect()]
        if not open_:
            return []
    return sorted(open_)


def audit_snapshots(spark: SparkSession, before: str, after: str, key: str, entity: str) -> DataFrame:
    """audit_log of two snapshots; both must have been written with as many buckets."""
    buckets = changed_buckets(spark.read.parquet(f"{before}/tree"), spark.read.parquet(f"{after}/tree"))
    if not buckets:  # nothing differs: rows of one side only, to have their columns
        rows = spark.read.parquet(f"{after}/rows").drop("bucket").limit(0)
        return audit_log(rows, rows, key, entity)
    sides = [spark.read.parquet(f"{p}/rows").filter(F.col("bucket").isin(buckets)).drop("bucket") for p in (before, after)]
    return audit_log(*sides, key, entity)
