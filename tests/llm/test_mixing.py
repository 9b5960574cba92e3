"""Mixing: targets against a plain computation, thresholds against sorted hashes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dealforge.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Repeated water filling: stop what is above its cap, share the rest anew."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in stopped]
        level = (total - sum(stopped.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return stopped | {s: level * w[s] for s in free}
        stopped |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 10, None: 5}, {"x": 7}, {"a": 0, "b": 10}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_takes_come_near_targets(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    mixed = mixing.mix_sources(docs)
    assert mixed.count() == 3000 and mixed.filter("taken > 3 * size or taken < 0").count() == 0
    by = mixed.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(r["taken"] - r["target"]) <= r["most"] for r in by)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixing.mix_sources(docs).collect()))


def test_thresholds_equal_sorted_prefix(spark):
    rows = [("s", 1 + i % 7, int(h)) for i, h in enumerate(range(0, 1 << 36, (1 << 36) // 500))]
    sized = spark.createDataFrame(rows, "source string, size long, hash long")
    for budget in (0.0, 3.0, 700.5, float(sum(r[1] for r in rows))):
        found = mixing.hash_thresholds(sized, spark.createDataFrame([("s", budget)], "source string, budget double")).collect()
        taken = sum(r[1] for r in rows if found and r[2] < found[0]["threshold"])
        nearest = min(abs(sum(r[1] for r in rows[:k]) - budget) for k in range(len(rows) + 1))
        assert abs(taken - budget) == nearest or (not found and budget >= sum(r[1] for r in rows))


def test_documents_follow_the_plan(spark):
    """Ids shared by two sources, repeated rows, blank texts, null ids: each row by its own source."""
    a = [(i, "w " * (5 + i % 9), "a") for i in range(200)] + [(None, "n " * (i % 11), "a") for i in range(60)]
    b = [(i, "v " * (1 + i % 4), "b") for i in range(200)] + [(1000 + i, " ", "b") for i in range(50)]
    docs = spark.createDataFrame(a + b + [(7, "twice here", "c")] * 2, SCHEMA).selectExpr("*", "1 as own", "'p' as p_source", "5 as rounds", "0 as copies")
    plan = mixing.mix_sources(docs)
    want = {r["target"]: r["words"] for r in plan.groupBy("target").agg(F.sum("taken").alias("words")).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = {r["source"]: r["words"] for r in mixed.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("words")).collect()}
    assert sorted(got.values()) == sorted(want.values())
    assert all(abs(words - target) <= 14 for target, words in want.items())
    assert mixed.filter("trim(text) = ''").count() == 0 and plan.filter("copies > 3 or (size = 0 and copies > 0)").count() == 0


def test_targets_of_many_sources(spark):
    sizes = {f"s{i:04d}": (i * i) % 997 for i in range(700)} | {None: 3}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(5)
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, None), (1, None, None), (None, "a b", None), (2, "", "x"), (3, "c", "x")], SCHEMA).selectExpr("*", "1 as size", "2 as hash", "3 as target")
    assert mixing.mix_sources(docs).count() == 5
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns
