"""Provider feeds as a stream: page after page with retries, until a short page ends the feed.

A feed is a sequence: whether page n + 1 is asked for depends on page n. So a feed's
pages of a micro-batch are read in turn; feeds are read side by side, short ones
together in a task. The offset is the next page of every feed. What only a task can
know, that a feed has ended, it leaves as a note in a folder that driver and tasks
share, one file a task; the driver plans no further page of such a feed. A replayed
batch reads the same pages and leaves the same notes, and a restarted query goes on
where the last batch ended.

A long feed may be read ahead instead: a batch asks for as many pages as all batches
before, in runs that are read side by side. So a feed takes few batches, and no task
more than a run. What lies behind the first page that ended the feed is none of its rows.
"""

from __future__ import annotations

import functools
import hashlib
import importlib
import json
import random
import time
import uuid
from collections.abc import Callable, Iterator
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from dealforge.sources.provider import retry_wait

SCHEMA = "feed string, page int, place int, record string, attempts int, error string"


class FetchError(Exception):
    """What a fetch function raises: the status of an answer, or none if there was no answer."""

    def __init__(self, status: int | None = None, retry_after_ms: int = 0):
        super().__init__(f"status {status}" if status else "no answer")
        self.status, self.retry_after_ms = status, retry_after_ms


def fetch_with_retries(fetch: Callable, attempts: int, base_ms: int, jitter_ms: int, sleep: Callable = time.sleep) -> tuple[list, int, str | None]:
    """(records, attempts made, what went wrong): fetch(attempt) again after a wait, as often as S6 allows."""
    attempt = 0
    while True:
        try:
            return fetch(attempt), attempt + 1, None
        except FetchError as e:
            wait = retry_wait(attempt, attempts, e.status, e.status is None, e.retry_after_ms, base_ms)
            if wait is None:
                return [], attempt + 1, str(e)
            sleep((wait + random.randint(0, jitter_ms)) / 1000)
            attempt += 1


class Progress:
    """Notes in a shared folder, JSON lines: the page before which a run of a feed's pages was read, and the page that ended it."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(folder)
        self.select = fs.FileSelector(self.path, allow_not_found=True)

    def note_runs(self, runs: list[tuple[str, int, int | None]]) -> None:
        """runs: feed, before which page, the page that ended it or None. The same runs make the same file."""
        self.fs.create_dir(self.path, recursive=True)
        name = hashlib.sha256(json.dumps([r[:2] for r in runs]).encode()).hexdigest()
        hidden = f"{self.path}/.{name}-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(hidden) as out:
            out.write("".join(json.dumps(dict(zip(("feed", "until", "end"), r))) + "\n" for r in runs).encode())
        self.fs.move(hidden, f"{self.path}/{name}.json")

    def note(self, feed: str, until: int, ended: bool) -> None:
        self.note_runs([(feed, until, until - 1 if ended else None)])

    def notes(self) -> Iterator[tuple[list[dict], str]]:
        """(the runs, the path) of every file."""
        for info in self.fs.get_file_info(self.select):
            if info.base_name.endswith(".json"):
                with self.fs.open_input_stream(info.path) as text:
                    yield [json.loads(line) for line in text.read().splitlines()], info.path

    def latest(self) -> dict[str, tuple[int, bool]]:
        out: dict[str, tuple[int, bool]] = {}
        for runs, _ in self.notes():
            for run in runs:
                until, ended = out.get(run["feed"], (0, False))
                out[run["feed"]] = max(until, run["until"]), ended or run["end"] is not None
        return out

    def forget(self, before: dict[str, int]) -> None:
        """Drop notes that later ones have replaced; ends stay."""
        for runs, path in list(self.notes()):
            if all(run["end"] is None and run["until"] < before.get(run["feed"], 0) for run in runs):
                self.fs.delete_file(path)


class Pages(InputPartition):
    """Runs of pages: feed, first, before which page."""

    def __init__(self, runs: list[tuple[str, int, int]]):
        self.runs = runs


class FeedReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k: v for k, v in options.items() if k != "feeds"}  # what goes to every task
        number = lambda name, default: int(options.get(name, default))
        self.feeds = json.loads(options["feeds"])
        self.start, self.size, self.each = number("startpage", 1), number("pagesize", 100), number("pagesperbatch", 2)
        self.end = self.start + number("maxpages", 50)
        self.per_task, self.ahead = number("pagespertask", self.each), options.get("readahead", "false").lower() == "true"
        self.attempts, self.base_ms, self.jitter_ms = number("attempts", 3), number("basedelayms", 1000), number("jitterms", 250)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "feeds"}  # a task needs its own feeds only

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.feeds, self.start)

    def latestOffset(self) -> dict:
        seen = Progress(self.options["progress"]).latest()
        out = {}
        for feed in self.feeds:
            until, ended = seen.get(feed, (self.start, False))
            step = max(self.each, until - self.start) if self.ahead else self.each
            out[feed] = until if ended else min(until + step, self.end)
        return out

    def unfinished(self) -> list[str]:
        """Feeds that neither ended nor reached their last page."""
        seen = Progress(self.options["progress"]).latest()
        behind = lambda until, ended: not ended and until < self.end
        return [feed for feed in self.feeds if behind(*seen.get(feed, (self.start, False)))]

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        tasks: list[list[tuple[str, int, int]]] = []
        room = 0
        for feed, last in end.items():
            first = start.get(feed, self.start)
            for page in range(first, last, self.per_task if self.ahead else max(last - first, 1)):
                run = feed, page, min(page + self.per_task, last) if self.ahead else last
                if run[2] - run[1] > room:
                    tasks.append([])
                    room = self.per_task
                tasks[-1].append(run)
                room -= run[2] - run[1]
        return [Pages(runs) for runs in tasks]

    def commit(self, end: dict) -> None:
        Progress(self.options["progress"]).forget(end)

    def read(self, partition: Pages) -> Iterator[tuple]:
        module, _, name = self.options["fetch"].rpartition(":")
        fetch = getattr(importlib.import_module(module), name)
        notes = []
        for feed, first, last in partition.runs:
            end = None
            for page in range(first, last):
                records, attempts, error = fetch_with_retries(lambda attempt: fetch(feed, page, self.size, attempt, self.options), self.attempts, self.base_ms, self.jitter_ms)
                if error:
                    yield feed, page, None, None, attempts, error
                for place, record in enumerate(records):
                    yield feed, page, place, record if isinstance(record, str) else json.dumps(record), attempts, None
                if error or len(records) < self.size:
                    end = page
                    break
            notes.append((feed, last, end))
        Progress(self.options["progress"]).note_runs(notes)


class FeedSource(DataSource):
    """format("provider_feed"): options fetch="module:function", feeds (a JSON list), progress (a shared folder),
    startPage, pageSize, pagesPerBatch (of a feed), pagesPerTask (feeds share a task up to it), maxPages, attempts,
    baseDelayMs, jitterMs; readAhead="true" reads ahead, in runs of pagesPerTask, and leaves rows behind a feed's end
    to rows_until_end.

    fetch(feed, page, size, attempt, options) gives a page's records, or raises FetchError.
    A page that keeps failing gives one row with an error and ends its feed, no other.
    """

    @classmethod
    def name(cls) -> str:
        return "provider_feed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FeedReader:
        return FeedReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedSource)


def rows_until_end(rows: DataFrame, progress: str) -> DataFrame:
    """Rows of feeds that were read ahead, without those behind the page that ended their feed."""
    ends = rows.sparkSession.read.schema("feed string, until int, end int").json(progress).groupBy("feed").agg(F.min("end").alias("__end"))
    return rows.join(ends, "feed", "left").filter("__end is null or page <= __end").select(*rows.columns)


def read_to_end(spark: SparkSession, folder: str, feeds: list[str], fetch: str, **options) -> DataFrame:
    """The rows of feeds (SCHEMA), read side by side until each ends; folder: a shared one, in which a run that
    is started again goes on."""
    register(spark)
    stream = spark.readStream.format("provider_feed").options(fetch=fetch, feeds=json.dumps(feeds), progress=f"{folder}/progress", **options).load()
    reader = FeedReader({"feeds": json.dumps(feeds), "progress": f"{folder}/progress"} | {k.lower(): str(v) for k, v in options.items()})
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/records").start()
    try:
        run.processAllAvailable()
        while run.isActive and reader.unfinished():
            run.processAllAvailable()
        run.processAllAvailable()  # what was noted last is committed as well
    finally:
        run.stop()
    if reader.unfinished():
        raise RuntimeError(f"feeds that did not end: {reader.unfinished()[:10]}")
    rows = spark.read.schema(SCHEMA).parquet(f"{folder}/records")
    return rows_until_end(rows, f"{folder}/progress") if str(options.get("readAhead", "false")).lower() == "true" else rows


# How stored pages are dealt to files.
BUCKETS, BLOCK = 256, 64


def store_pages(records: DataFrame, failures: DataFrame, folder: str) -> None:
    """Writes what fetch_stored answers. records: feed, page, place, record; failures: feed, page, status, times (a page fails so often).

    Blocks of pages lie together, in small row groups of a bucket, so that a page is found without a look at the others.
    """
    rows = records.select("feed", "page", "place", "record").unionByName(failures.select("feed", "page", "status", "times"), allowMissingColumns=True)
    block = F.concat_ws("/", "feed", F.floor(F.col("page") / BLOCK).cast("string"))
    dealt = rows.withColumn("bucket", (F.crc32(block.cast("binary")) % BUCKETS).cast("int")).repartition("bucket").sortWithinPartitions("bucket", "feed", "page", "place")
    dealt.write.option("parquet.block.size", 1 << 20).partitionBy("bucket").parquet(folder)


@functools.lru_cache(maxsize=2)
def _stored_block(pages: str, feed: str, block: int) -> dict[int, list[tuple]]:
    """The rows of a block's pages: place, record, status, times."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(pages)
    folder = f"{path}/bucket={crc32(f'{feed}/{block}'.encode()) % BUCKETS}"
    if files.get_file_info(folder).type == fs.FileType.NotFound:
        return {}
    wanted = [("feed", "=", feed), ("page", ">=", block * BLOCK), ("page", "<", (block + 1) * BLOCK)]
    columns = ["page", "place", "record", "status", "times"]
    table = pq.read_table(folder, filesystem=files, columns=columns, filters=wanted, partitioning=None)
    out: dict[int, list[tuple]] = {}
    for page, *row in zip(*[table[c].to_pylist() for c in columns]):
        out.setdefault(page, []).append(tuple(row))
    return out


def fetch_stored(feed: str, page: int, size: int, attempt: int, options: dict[str, str]) -> list[str]:
    """A page out of a folder of store_pages (option pages), as a provider's stand-in."""
    rows = _stored_block(options["pages"], feed, page // BLOCK).get(page, [])
    for _, _, status, times in rows:
        if status is not None and attempt < times:
            raise FetchError(status)
    return [record for _, record in sorted((place, record) for place, record, _, _ in rows if place is not None)][:size]
