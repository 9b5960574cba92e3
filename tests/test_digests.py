"""Comparisons by digests read changed buckets only; ranks by ranges equal a window's."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dealforge.operators import access, digests, ranking


def test_only_changed_buckets_are_read(spark, tmp_path):
    before = spark.range(2000).select("id", F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") % 3 > 0, F.col("id") / 7).alias("x"))
    after = before.filter("id <> 5").withColumn("name", F.when(F.col("id") == 77, "other").otherwise(F.col("name"))).unionByName(before.filter("id = 9").withColumn("id", F.lit(9999).cast("long")))
    paths = [str(tmp_path / n) for n in ("a", "b", "c")]
    for df, path in zip((before, after, before.repartition(3)), paths):
        digests.write_snapshot(df, "id", path)
    out = digests.audit_snapshots(spark, paths[0], paths[1], "id", "thing")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, access.audit_log(before, after, "id", "thing").collect()))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [bucket") == plan.count("PartitionFilters") > 0  # both sides are pruned to the changed buckets
    trees = [spark.read.parquet(f"{p}/tree") for p in paths]
    assert len(digests.changed_buckets(trees[0], trees[1])) == 3
    assert digests.changed_buckets(trees[0], trees[2]) == []
    assert digests.audit_snapshots(spark, paths[0], paths[2], "id", "thing").count() == 0


def test_a_value_that_moves_to_another_row_is_seen(spark, tmp_path):
    rows = [(1, "a", None), (2, None, "a")]
    for name, r in (("a", rows), ("b", [(1, None, "a"), (2, "a", None)])):
        digests.write_snapshot(spark.createDataFrame(r, "id int, x string, y string"), "id", str(tmp_path / name), 1)
    assert digests.audit_snapshots(spark, str(tmp_path / "a"), str(tmp_path / "b"), "id", "t").count() == 2


def test_places_in_a_hot_group(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 11)).alias("g"), F.pmod(F.hash("id"), F.lit(40)).alias("v"))
    order = [F.desc("v"), F.asc("id")]
    window = F.row_number().over(Window.partitionBy("g").orderBy(*order)).alias("place")
    want = sorted(map(tuple, df.select("id", window).collect()))
    assert sorted(map(tuple, ranking.placed(df, ["g"], order, "place").select("id", "place").collect())) == want
    assert ranking.placed(df.limit(0), ["g"], order, "place").count() == 0
