"""Feeds as a stream: stops, retries, restarts; cursors as carried state."""

from __future__ import annotations

import json


from dealforge.session import setting
from dealforge.sources import feed
from dealforge.streaming import rotation


def fetch(name, page, size, attempt, options):
    if name == "odd" and page == 2 and attempt < 2:
        raise feed.FetchError(503)
    if name == "bad":
        raise feed.FetchError(None)
    if name == "none":
        return []
    short = {"odd": 3, "long": 9}[name]
    return [{"n": page * 10 + i} for i in range(size - (page == short))]  # pages after the short one would be full


def run(spark, folder, **more):
    feed.register(spark)
    options = {"fetch": "tests.test_feed:fetch", "feeds": json.dumps(["odd", "long", "none", "bad"]), "progress": f"{folder}/progress", "pageSize": 2, "pagesPerBatch": 2, "baseDelayMs": 1, "jitterMs": 0} | more
    stream = spark.readStream.format("provider_feed").options(**options).load()
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    rows = spark.read.schema(feed.SCHEMA).parquet(f"{folder}/out").collect()
    return sorted((r["feed"], r["page"], r["attempts"], r["error"] or r["record"]) for r in rows)


def expected(pages_of_long):
    rows = [("odd", p, 3 if p == 2 else 1, f'{{"n": {p * 10 + i}}}') for p in (1, 2, 3) for i in range(2 - (p == 3))]
    rows += [("long", p, 1, f'{{"n": {p * 10 + i}}}') for p in pages_of_long for i in range(2 - (p == 9))]
    return sorted([*rows, ("bad", 1, 3, "no answer")])


def test_feeds_stop_by_themselves(spark, tmp_path):
    assert run(spark, tmp_path) == expected(range(1, 10))
    assert run(spark, tmp_path) == expected(range(1, 10))  # a restart reads nothing again


def test_restart_goes_on_behind_the_last_page(spark, tmp_path):
    assert run(spark, tmp_path, maxPages=4) == expected(range(1, 5))
    assert run(spark, tmp_path, maxPages=50) == expected(range(1, 10))


def test_retries():
    waits = []

    def failing(times, status=503, after=0):
        def f(attempt):
            if attempt < times:
                raise feed.FetchError(status, after)
            return ["r"]

        return f

    assert feed.fetch_with_retries(failing(2), 3, 1000, 0, waits.append) == (["r"], 3, None)
    assert waits == [1.0, 2.0]
    assert feed.fetch_with_retries(failing(3), 3, 1, 0, waits.append) == ([], 3, "status 503")
    assert feed.fetch_with_retries(failing(1, 404), 3, 1, 0, waits.append) == ([], 1, "status 404")
    waits.clear()
    feed.fetch_with_retries(failing(1, 429, 5000), 3, 1000, 250, waits.append)
    assert 5.0 <= waits[0] <= 5.25


def test_progress(tmp_path):
    p = feed.Progress(str(tmp_path / "p"))
    assert p.latest() == {}
    p.note("a!/b c", 3, False)
    p.note("a!/b c", 5, True)
    p.note("x", 3, False)
    assert p.latest() == {"a!/b c": (5, True), "x": (3, False)}
    p.forget({"a!/b c": 5, "x": 3})
    assert p.latest() == {"a!/b c": (5, True), "x": (3, False)} and len(list(p.notes())) == 2


def test_cursors_are_kept_between_runs(spark, tmp_path):
    key = ["p", "net", "deal"]
    runs = [
        [(*key, "a", 0, 5, 2, False), (*key, "b", 0, 1, 1, True), (*key, "c", 0, 3, 3, False)],
        [(*key, "a", 1, 5, 2, False), (*key, "b", 1, 4, 1, False)],
        [(*key, "a", 1, 5, 2, False), (*key, "a", 2, 4, 3, False), (*key, "a", 3, 4, 3, True), (*key, "c", 3, 4, 2, False)],  # run 1 is told again, two runs at once
    ]
    schema = "policy string, provider string, kind string, store_key string, run int, size int, limit int, gated boolean"
    with setting(spark, "spark.sql.streaming.stateStore.providerClass", rotation.ROCKSDB):
        for rows in runs:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = rotation.rotated(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
            stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(rotation.CURSORS).parquet(str(tmp_path / "out")).collect()
    got = sorted((r["store_key"], r["run"], r["first"], r["cursor"]) for r in out)
    assert got == [("a", 0, 0, 2), ("a", 1, 2, 4), ("a", 2, 0, 3), ("a", 3, 3, 3), ("b", 0, 0, 0), ("b", 1, 0, 1), ("c", 0, 0, 0), ("c", 3, 0, 2)]


def long_feeds(name, page, size, attempt, options):
    last = {"a": 70, "b": 3}[name]  # behind a short page there are full ones again
    return [page * 10 + i for i in range(size - (page == last))]


def test_a_long_feed_is_read_ahead_in_few_batches(spark, tmp_path):
    options = {"pageSize": 2, "pagesPerBatch": 8, "pagesPerTask": 8, "readAhead": "true", "maxPages": 1 << 30, "baseDelayMs": 1}
    for _ in range(2):  # a restart reads nothing again
        rows = feed.read_to_end(spark, str(tmp_path), ["a", "b"], "tests.test_feed:long_feeds", **options).collect()
        got = sorted((r["feed"], r["page"], r["record"]) for r in rows)
        assert got == sorted((name, p, str(p * 10 + i)) for name, last in (("a", 70), ("b", 3)) for p in range(1, last + 1) for i in range(2 - (p == last)))
    assert len([f for f in (tmp_path / "checkpoint" / "commits").iterdir() if f.name.isdigit()]) <= 6  # 8, 8, 16, 32, 64 pages


def test_short_feeds_share_tasks(tmp_path):
    names = [f"f{i}" for i in range(1000)]
    reader = feed.FeedReader({"feeds": json.dumps(names), "progress": str(tmp_path / "p"), "pagesperbatch": "4", "pagespertask": "512"})
    tasks = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(tasks) == 8 and [r for t in tasks for r in t.runs] == [(n, 1, 5) for n in names]
    feed.Progress(str(tmp_path / "p")).note_runs([(n, 5, 2) for n in names])
    assert len(list((tmp_path / "p").iterdir())) == 1 and reader.latestOffset() == dict.fromkeys(names, 5) and not reader.unfinished()


def test_many_stores_share_a_state(spark, tmp_path):
    schema = "policy string, provider string, kind string, store_key string, run int, size int, limit int, gated boolean"
    with setting(spark, "spark.sql.streaming.stateStore.providerClass", rotation.ROCKSDB):
        for run in (0, 1):
            spark.createDataFrame([("p", "net", "deal", f"s{i}", run, 5, 2, i % 2 == 1) for i in range(3000)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = rotation.rotated(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
            query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
            query.awaitTermination()
            assert max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) <= rotation.BUCKETS < 3000
    got = sorted((r["store_key"], r["run"], r["first"], r["cursor"]) for r in spark.read.schema(rotation.CURSORS).parquet(str(tmp_path / "out")).collect())
    assert got == sorted((f"s{i}", run, *((0, 0) if i % 2 else (2 * run, 2 * run + 2))) for i in range(3000) for run in (0, 1))
