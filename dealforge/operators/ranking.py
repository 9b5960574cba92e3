"""Ranks inside groups of any size: no task has to hold a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealforge.session import fresh_dir


def placed(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """df with a column `name`: the row's place in its group, from 1, in the given order.

    Rows are dealt into ranges of (group, order), so that a large group spreads over
    several. Each range numbers its own rows of a group; the counts of the ranges
    before, one row a range and group, move them. The ranges are written as a table in
    the shared folder: a lost executor cannot deal them anew.
    """
    path = fresh_dir(df.sparkSession, "ranges")
    dealt = df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("__part", F.spark_partition_id())
    dealt.write.parquet(path)
    dealt = df.sparkSession.read.schema(dealt.schema).parquet(path)
    sizes = dealt.groupBy(*group, "__part").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*order))
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group]
    on = (F.col("__part") == F.col("__p")) & same[0]
    for s in same[1:]:
        on &= s
    return dealt.withColumn("__inside", inside).join(before, on).select(*df.columns, (F.col("__inside") + F.col("__before")).cast("int").alias(name))
