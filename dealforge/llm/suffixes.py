"""Operator 12: long repeats across documents by a logarithmic family of suffix arrays.

An array holds sampled suffixes, sorted: those that begin at anchors. A position is an
anchor if its next CORE bytes hash lowest among all that begin in some window of LENGTH
bytes. So every window of LENGTH bytes holds an anchor, and equal windows hold theirs at
equal places, wherever they stand; some 1 in 14 suffixes is kept. What belongs to a
suffix is its core (the CORE bytes from the anchor) and its context (all windows that
contain the core).

Documents come in batches, in order of their ids. A batch gets its arrays (sorted where
the texts lie, then by shards of the core's hash), and these are scanned in merged order
with those of the levels that stand: a suffix whose whole context is known from a smaller
id is covered; one that shares its core only is an edge. Then the batch becomes a level;
levels of equal size merge into one of twice the size, as in binary counting. A level
keeps one suffix a core and context.

Windows are looked at one by one only at edges: texts meet their marks in buckets of
documents, and the hashes of the windows whose lowest core is an edge are sorted, sharded
and scanned in the same manner, as arrays of one batch. A window that holds the core of a
covered suffix is known already, and never the first of its kind.

Arrays and marks travel as blocks of packed columns, so that a row costs little and rows
don't grow with the number of entries: an array is cut into shards where its order of
cores says so, marks are dealt to buckets only once many are together.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from contextlib import contextmanager
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealforge.llm.common import arrow_schema, delete, freed_shuffles, kept_table, read_table, scratch, set_inside, shared_dir, small_batches

LENGTH = 50
CORE = 24
BEFORE = LENGTH - CORE
#: Bytes of texts that are hashed together, and whose suffixes are sorted before they leave the task.
PIECE = 1 << 18
LOCAL = 1 << 23
#: Bytes of texts for a shard, batches of a whole table.
SHARD = 1 << 24
BATCHES = 4
#: Entries of a row of a level.
ROW_ENTRIES = 1 << 16
#: What an array keeps of a core's hash: two cores that agree in it only cost looks at windows.
SHORT = np.uint64(0xFFFFFFFFFFFF0000)
#: Marks that are dealt to buckets together, buckets a shard's worth of documents, and least number of such shards.
DEALT = 1 << 21
BUCKETS = 4
LEAST = 64
#: Bytes of rows that pass from or to Python together.
PASSED = 1 << 22
#: Contexts of a core in a task from which on the task itself calls them edges.
MANY = 64
#: A null id counts as larger than all others.
NO_ID = np.iinfo(np.int64).max

FIELDS = {"core": np.uint64, "ctx": np.uint64, "doc": np.uint32, "pos": np.uint32, "told": np.uint8, "ids": np.int64, "keys": np.int32}
MARKS = {"id": np.int64, "key": np.int32, "pos": np.uint32, "kind": np.uint8}
#: data holds packed FIELDS, or MARKS in rows of the level MARKED.
ROWS = "shard int, level int, data binary"
MARKED = -1
#: What is marked: a suffix whose windows are all known, one whose windows are looked at, a known window.
COVERED, EDGE, WINDOW = range(3)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


@cache
def byte_codes() -> np.ndarray:
    return mixed(mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of an odd base modulo 2 ** 64, and of its inverse."""
    base = 0xBF58476D1CE4E5B9
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        all_ = np.full(n, b, np.uint64)
        all_[0] = 1
        out.append(np.cumprod(all_, dtype=np.uint64))
    return out[0], out[1]


class Hashes:
    """Hashes of any span of some bytes, from hashes of its prefixes."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(max(2 * PIECE, 1 << len(data).bit_length()))  # one table for all usual sizes
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte_codes()[data] * up[: len(data)], out=self.sums[1:], dtype=np.uint64)

    def spans(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mixed((self.sums[last] - self.sums[first]) * self.down[first])

    def runs(self, length: int) -> np.ndarray:
        """Of all spans of a length."""
        n = max(len(self.sums) - length, 0)
        return mixed((self.sums[length : length + n] - self.sums[:n]) * self.down[:n])


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over all runs of a width."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = pick(out[: len(out) - step], out[step:])
        done += step
    return out


class Texts:
    """Texts side by side; a long one comes in pieces that overlap, each with its own part."""

    def __init__(self):
        self.parts, self.rows, self.size = [], [], 0

    def add(self, text: bytes, row: int, first: int, last: int) -> None:
        """The bytes of a row from first to last, with what stands around them."""
        low, high = max(first - 2 * LENGTH, 0), min(last + 2 * LENGTH, len(text))
        self.parts.append(text[low:high])
        # row, where the part begins here and ends, its own range here, its place in the text
        self.rows.append((row, self.size, self.size + high - low, self.size + first - low, self.size + last - low, low))
        self.size += high - low


def text_groups(texts: Iterable[bytes | None]):
    """The texts of at least LENGTH bytes in groups of about PIECE bytes."""
    group = Texts()
    for row, text in enumerate(texts):
        if text is None or len(text) < LENGTH:
            continue
        for first in range(0, len(text), PIECE):
            group.add(text, row, first, min(first + PIECE, len(text)))
            if group.size >= PIECE:
                yield group
                group = Texts()
    if group.size:
        yield group


def anchors(group: Texts) -> dict[str, np.ndarray]:
    """core, ctx, row, pos of the anchors of a group."""
    data = np.frombuffer(b"".join(group.parts), np.uint8)
    hashes = Hashes(data)
    cores = np.maximum(hashes.runs(CORE), np.uint64(1))
    least = sliding(cores, BEFORE + 1, np.minimum)
    rows = np.array(group.rows, np.int64)
    inside, own = np.zeros(len(data) + 1, np.int8), np.zeros(len(data) + 1, np.int8)
    long_enough = rows[rows[:, 2] - rows[:, 1] >= LENGTH]
    np.add.at(inside, long_enough[:, 1], 1)
    np.add.at(inside, long_enough[:, 2] - LENGTH + 1, -1)
    np.add.at(own, rows[:, 3], 1)
    np.add.at(own, rows[:, 4], -1)
    least[np.cumsum(inside[: len(least)], dtype=np.int8) == 0] = 0  # windows across texts
    padded = np.concatenate([np.zeros(BEFORE, np.uint64), least, np.zeros(BEFORE, np.uint64)])
    highest = sliding(padded, BEFORE + 1, np.maximum)
    at = np.flatnonzero((cores == highest[: len(cores)]) & (np.cumsum(own[: len(cores)], dtype=np.int8) > 0))
    part = np.searchsorted(rows[:, 1], at, side="right") - 1
    first, last = np.maximum(at - BEFORE, rows[part, 1]), np.minimum(at + LENGTH, rows[part, 2])
    shape = ((at - first) * 128 + (last - at)).astype(np.uint64)
    # times an odd number: sampling takes low hashes, shards are ranges
    return {"core": (cores[at] * np.uint64(0xD6E8FEB86659FD93)) & SHORT, "ctx": mixed(hashes.spans(first, last) + shape * np.uint64(0x94D049BB133111EB)), "row": rows[part, 0], "pos": (at - rows[part, 1] + rows[part, 5]).astype(np.uint32)}


def joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """All entries; the parts lose their columns one by one."""
    return {name: np.concatenate([p.pop(name) for p in parts]) for name in list(parts[0])}


def taken(e: dict[str, np.ndarray], where: np.ndarray) -> dict[str, np.ndarray]:
    return {name: values[where] for name, values in e.items()}


def narrowed(e: dict[str, np.ndarray], where: np.ndarray) -> dict[str, np.ndarray]:
    """taken, in place: column after column, so that two copies never stand side by side."""
    if not where.all():
        for name in e:
            e[name] = e[name][where]
    return e


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; the first one does."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def suffix_array(e: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Entries core, ctx, id, key, pos, told in order of core, context and id."""
    order = np.argsort(e["core"])
    core = e["core"][order]
    same = np.zeros(len(core) + 1, bool)
    same[1:-1] = core[1:] == core[:-1]
    tied = same[:-1] | same[1:]  # few: only their order is left to find
    at = order[tied]
    order[tied] = at[np.lexsort((e["id"][at], e["ctx"][at], e["core"][at]))]
    for name in e:  # one by one: the columns in the old order go at once
        e[name] = e[name][order]
    return narrowed(e, changes(e["core"], e["ctx"], e["id"], e["key"], e["pos"]))


def known(e: dict[str, np.ndarray]) -> np.ndarray:
    """Which entries of an array have their core and context at a smaller id, too."""
    starts = changes(e["core"], e["ctx"])
    return e["id"] > e["id"][np.flatnonzero(starts)[np.cumsum(starts) - 1]] if len(starts) else starts


def contested(e: dict[str, np.ndarray]) -> np.ndarray:
    """Which entries have their core in another context and at another id, too."""
    if not len(e["core"]):
        return np.zeros(0, bool)
    starts = np.flatnonzero(changes(e["core"]))
    contexts = np.add.reduceat(changes(e["core"], e["ctx"]).astype(np.int64), starts)
    several = np.minimum.reduceat(e["id"], starts) < np.maximum.reduceat(e["id"], starts)
    return np.repeat((contexts > 1) & several, np.diff(starts, append=len(e["core"])))


def frequent(e: dict[str, np.ndarray], many: int = MANY) -> tuple[np.ndarray, np.ndarray]:
    """Entries of cores with more than `many` contexts, at several ids; and a few of each core that still show it.

    A core that stands in very many documents so costs its shard a few rows a task.
    """
    frequent_, shown = np.zeros(len(e["core"]), bool), np.zeros(len(e["core"]), bool)
    if len(e["core"]):
        starts = np.flatnonzero(changes(e["core"]))
        contexts = np.add.reduceat(changes(e["core"], e["ctx"]).astype(np.int64), starts)
        ends = np.append(starts[1:], len(e["core"]))
        for a, b in zip(starts[contexts > many], ends[contexts > many]):
            ids = e["id"][a:b]
            if ids.min() < ids.max():
                frequent_[a:b] = True
                shown[[a, b - 1, a + ids.argmin(), a + ids.argmax()]] = True  # two contexts and two ids at least
    return frequent_, shown


@cache
def codecs():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(columns: dict[str, np.ndarray], kinds: dict) -> bytes:
    """Columns of these kinds: of each one all first bytes, then all second ones ..., compressed: high bytes are much alike."""
    out = [np.array([len(columns[name]) for name in kinds], np.uint32).tobytes()]
    for name, kind in kinds.items():
        values = np.ascontiguousarray(columns[name], kind)
        out.append(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).data if len(values) else b"")
    return codecs()[0].compress(b"".join(out))


def unpacked(data: bytes, kinds: dict) -> dict[str, np.ndarray]:
    data = np.frombuffer(codecs()[1].decompress(data), np.uint8)
    sizes, start, out = data[: 4 * len(kinds)].view(np.uint32).tolist(), 4 * len(kinds), {}
    for (name, kind), n in zip(kinds.items(), sizes):
        width = np.dtype(kind).itemsize
        out[name] = np.ascontiguousarray(data[start : start + n * width].reshape(width, n).T).view(kind).ravel()
        start += n * width
    return out


def row_of(e: dict[str, np.ndarray], shard: int, level: int) -> tuple[int, int, bytes]:
    """Entries as a row of ROWS: documents are numbered, their ids and keys stand once."""
    order = np.argsort(e["id"])
    new = changes(e["id"][order], e["key"][order])
    doc = np.empty(len(order), np.uint32)
    doc[order] = np.cumsum(new) - 1
    first = order[new]
    return shard, level, packed(e | {"doc": doc, "ids": e["id"][first], "keys": e["key"][first]}, FIELDS)


def entries_of(data: bytes) -> dict[str, np.ndarray]:
    f = unpacked(data, FIELDS)
    return {"core": f["core"], "ctx": f["ctx"], "id": f["ids"][f["doc"]], "key": f["keys"][f["doc"]], "pos": f["pos"], "told": f["told"]}


def marks_row(e: dict[str, np.ndarray], where: np.ndarray, kind: int, shards: int) -> list[tuple[int, int, bytes]]:
    """A row of ROWS that marks the places of some entries, to pass by any shard; none for none."""
    order = np.flatnonzero(where)
    if not len(order):
        return []
    order = order[np.argsort(e["id"][order])]
    e = {name: e[name][order] for name in ("id", "key", "pos")}
    shard = (int(e["id"][0]) + int(e["key"][0]) + int(e["pos"][0])) % shards
    return [(shard, MARKED, packed(e | {"kind": np.full(len(order), kind, np.uint8)}, MARKS))]


def batches_of(rows: list[tuple], schema) -> list:
    """Rows whose last column is binary as Arrow batches of some PASSED bytes."""
    import pyarrow as pa

    part = np.cumsum([len(row[-1]) for row in rows]) // PASSED
    starts = np.flatnonzero(changes(part)).tolist()
    columns = lambda some: [pa.array(column, field.type) for column, field in zip(zip(*some), schema)]
    return [pa.RecordBatch.from_arrays(columns(rows[a:b]), schema=schema) for a, b in zip(starts, [*starts[1:], len(rows)])]


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (null: NO_ID), key (tells rows of one id apart) and text (bytes, none for null) of docs, beside its own id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("id"), F.hash(text).alias("key"), text.cast("binary").alias("text"))


def task_rows(portions, shards: int, kind: int):
    """Lists of rows of ROWS: entries by shard, and marks of those that are known within the task (kind) or edges.

    portions: entries, with the bytes of text behind them.
    """
    waiting, size = [], 0

    def flush():
        e = joined(waiting)
        waiting.clear()
        e = suffix_array(e)
        old = known(e)
        rows = marks_row(e, old & (e["told"] == 0), kind, shards)
        e = narrowed(e, ~old)
        many, told = frequent(e)
        rows += marks_row(e, many & (e["told"] == 0), EDGE, shards)
        e["told"] |= many.astype(np.uint8)
        e = narrowed(e, ~many | told)
        # a shard is a range of cores
        shard = ((e["core"] >> np.uint64(33)) * np.uint64(shards)) >> np.uint64(31)
        starts = np.flatnonzero(changes(shard))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(shard)]):
            rows.append(row_of(taken(e, slice(a, b)), int(shard[a]), 0))
        return rows

    for portion, n in portions:
        waiting.append(portion)
        size += n
        if size >= LOCAL:
            yield flush()
            size = 0
    if waiting:
        yield flush()


def local_arrays(docs: DataFrame, shards: int) -> DataFrame:
    """Rows of ROWS: each task's anchors by shard, and marks of what the task tells by itself."""
    arrow = arrow_schema(ROWS)

    def run(batches):
        for rows in task_rows((x for batch in batches for x in anchor_entries(batch)), shards, COVERED):
            yield from batches_of(rows, arrow)

    return docs.mapInArrow(run, ROWS)


def of_documents(e: dict[str, np.ndarray], batch) -> dict[str, np.ndarray]:
    """Entries with the id and key of their row, and not told yet."""
    row = e.pop("row")
    return e | {"id": batch.column("id").to_numpy()[row], "key": batch.column("key").to_numpy()[row], "told": np.zeros(len(row), np.uint8)}


def anchor_entries(batch):
    for group in text_groups(text.as_py() for text in batch.column("text")):
        yield of_documents(anchors(group), batch), group.size


def gathered(table) -> tuple[dict[str, np.ndarray] | None, list[tuple]]:
    """A shard's entries in order, with the level they come from, and the rows of marks that pass by it."""
    held, marks = [], []
    for shard, level, data in zip(table.column("shard").to_pylist(), table.column("level").to_pylist(), table.column("data")):
        if level == MARKED:
            marks.append((shard, level, data.as_py()))
        else:
            e = entries_of(data.as_buffer())
            held.append(e | {"level": np.full(len(e["core"]), level, np.int8)})
    if not held:
        return None, marks
    e = joined(held)
    held.clear()
    return suffix_array(e), marks


@contextmanager
def passing_blocks(spark: SparkSession):
    """Tables that are written inside hold blocks: in small batches, and not compressed again, for which Parquet keeps buffers of a block's size."""
    with freed_shuffles(spark), small_batches(spark), set_inside(spark, "spark.sql.parquet.compression.codec", "uncompressed"):
        yield


class SuffixIndex:
    """A family of levels in the shared folder; level number n holds up to 2 ** n batches."""

    def __init__(self, spark: SparkSession, shards: int):
        self.spark, self.shards = spark, shards
        self.levels: dict[int, str] = {}

    def add(self, docs: DataFrame, keep: bool = True) -> DataFrame:
        """Marks of a batch of identified documents, packed: covered suffixes, and edges of new and old ones.

        Ids of a batch are not below those of earlier ones. Without keep the family
        stays as it is.
        """
        import pyarrow as pa

        merging = []
        while len(merging) in self.levels:
            merging.append(len(merging))
        number, arrow, shards = len(merging), arrow_schema(ROWS), self.shards
        rows = local_arrays(docs.select("id", "key", "text"), shards)
        for level, path in self.levels.items():
            table = self.spark.read.schema(ROWS).parquet(path).filter(F.col("level") != MARKED)
            rows = rows.unionByName(table.withColumn("level", F.lit(level + 1)))

        def scan(table: pa.Table) -> pa.Table:
            e, out = gathered(table)
            if e:
                shard = int(table.column("shard")[0].as_py())
                fresh = e["level"] == 0
                covered = known(e) & fresh
                out += marks_row(e, covered, COVERED, shards)
                e = narrowed(e, ~covered)
                edge = contested(e) & (e["told"] == 0)
                out += marks_row(e, edge, EDGE, shards)
                e["told"] |= edge.astype(np.uint8)
                if keep:
                    own = np.flatnonzero((e["level"] <= number) & changes(e["core"], e["ctx"]))  # levels that don't merge keep theirs
                    for a in range(0, len(own), ROW_ENTRIES):
                        out.append(row_of(taken(e, own[a : a + ROW_ENTRIES]), shard, number))
            del e
            return pa.Table.from_batches(batches_of(out, arrow), schema=arrow)

        path = f"{shared_dir(self.spark)}/suffixes-{uuid.uuid4().hex}"
        with passing_blocks(self.spark):
            rows.groupBy("shard").applyInArrow(scan, ROWS).write.option("parquet.page.row.count.limit", 1).parquet(path)
            marks = scratch(self.spark.read.schema(ROWS).parquet(path).filter(F.col("level") == MARKED).select("data"))
        if keep:
            self.drop(merging)
            self.levels[number] = path
        else:
            delete(self.spark, path)
        return marks

    def drop(self, levels: list[int]) -> None:
        """Delete the tables of levels."""
        for level in levels:
            delete(self.spark, self.levels.pop(level))


def bucket_of(id_: np.ndarray, key: np.ndarray, buckets: int) -> np.ndarray:
    return (id_ % buckets + key.astype(np.int64) % buckets) % buckets


def bucket_column(buckets: int) -> Column:
    """bucket_of columns id and key."""
    n = F.lit(buckets).cast("long")
    return F.pmod(F.pmod("id", n) + F.pmod("key", n), n).cast("int")


def by_bucket(marks: DataFrame, buckets: int) -> DataFrame:
    """bucket, data of packed marks: those of a bucket's documents."""
    schema = "bucket int, data binary"
    arrow = arrow_schema(schema)

    def dealt(held: list[dict[str, np.ndarray]]) -> list[tuple[int, bytes]]:
        e = joined(held)
        bucket = bucket_of(e["id"], e["key"], buckets)
        order = np.lexsort((e["id"], bucket))
        e, bucket = taken(e, order), bucket[order]
        starts = np.flatnonzero(changes(bucket))
        return [(int(bucket[a]), packed(taken(e, slice(a, b)), MARKS)) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)])]

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for data in batch.column("data"):
                held.append(unpacked(data.as_py(), MARKS))
                n += len(held[-1]["id"])
                if n >= DEALT:
                    yield from batches_of(dealt(held), arrow)
                    held, n = [], 0
        if held:
            yield from batches_of(dealt(held), arrow)

    return marks.select("data").mapInArrow(run, schema)


def merged_spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans as few, disjoint ones in order; those that touch are one."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order]) if len(order) else last
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > reach[:-1]
    starts = np.flatnonzero(new)
    return first[starts], reach[np.append(starts[1:], len(first)) - 1] if len(starts) else reach


def all_of(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers in spans, span after span."""
    n = last - first
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(first - (ends - n), n)


class Places:
    """Where the marks of a bucket are: of each document in order of their places."""

    def __init__(self, table):
        blocks = [unpacked(data, MARKS) for data in table.column("data").to_pylist()]
        e = joined(blocks) if blocks else {name: np.zeros(0, kind) for name, kind in MARKS.items()}
        order = np.lexsort((e["pos"], e["kind"], e["key"], e["id"]))
        e = taken(e, order[changes(*(e[name][order] for name in MARKS))])
        starts = np.flatnonzero(changes(e["id"], e["key"], e["kind"]))
        names = zip(*(e[name][starts].tolist() for name in ("id", "key", "kind")))
        self.places, self.none = dict(zip(names, np.split(e["pos"].astype(np.int64), starts[1:]))), np.zeros(0, np.int64)

    def of(self, batch, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and place of all marks of a kind in a batch of documents."""
        found = [self.places.get((*name, kind), self.none) for name in zip(batch.column("id").to_pylist(), batch.column("key").to_pylist())]
        return np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate([self.none, *found])


def bytes_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary Arrow array, text after text, and where each begins and the last one ends."""
    import pyarrow as pa

    texts = texts.cast(pa.binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def window_entries(batch, places: Places):
    """The windows of a batch whose lowest core is an edge, without those that hold the core of a covered suffix."""
    data, offsets = bytes_of(batch.column("text"))
    kinds = np.zeros(len(data), np.uint8)
    for kind in (COVERED, EDGE):
        row, pos = places.of(batch, kind)
        at = offsets[row] + pos  # the last kind: edges
        kinds[at] |= 1 << kind
    first, last = merged_spans(np.maximum(at - BEFORE, offsets[row]), np.minimum(at, offsets[row + 1] - LENGTH) + 1)
    cuts = -((first - last) // PIECE)  # of long spans
    first, end = all_of(np.zeros_like(cuts), cuts) * PIECE + np.repeat(first, cuts), np.repeat(last, cuts)
    last = np.minimum(first + PIECE, end)
    portion = np.cumsum(last - first + LENGTH) // PIECE
    bounds = np.flatnonzero(changes(portion)).tolist()
    for a, b in zip(bounds, [*bounds[1:], len(portion)]):
        low, high = first[a:b], last[a:b]
        taken_ = all_of(low, high + LENGTH - 1)
        hashes, marked = Hashes(data[taken_]), kinds[taken_]
        cores = np.maximum(hashes.runs(CORE), np.uint64(1))
        marked = marked[: len(cores)]
        at_edge = np.where(marked & (1 << EDGE), cores, np.iinfo(np.uint64).max)
        fit = sliding(at_edge, BEFORE + 1, np.minimum) == sliding(cores, BEFORE + 1, np.minimum)
        fit &= sliding(marked & (1 << COVERED), BEFORE + 1, np.maximum) == 0
        inside = np.cumsum(high - low + LENGTH - 1) - (high - low + LENGTH - 1)
        here = all_of(inside, inside + high - low)
        here, starts = here[fit[here]], all_of(low, high)[fit[here]]
        windows = hashes.runs(LENGTH)[here]
        rows = np.searchsorted(offsets, starts, side="right") - 1
        # an entry takes some 14 bytes of text in an array of suffixes
        yield of_documents({"core": windows & SHORT, "ctx": windows & ~SHORT, "row": rows, "pos": (starts - offsets[rows]).astype(np.uint32)}, batch), 14 * len(starts)


def known_windows(own: DataFrame, dealt: DataFrame, buckets: int, shards: int) -> DataFrame:
    """Packed marks where the windows start that are known from a smaller id, from identified documents and their marks by bucket.

    dealt may have a multiple of these buckets.
    """
    import pyarrow as pa

    arrow = arrow_schema(ROWS)

    def windows(docs: pa.Table, marks: pa.Table) -> pa.Table:
        places, out = Places(marks), []
        for rows in task_rows((x for batch in docs.to_batches() for x in window_entries(batch, places)), shards, WINDOW):
            out += rows
        return pa.Table.from_batches(batches_of(out, arrow), schema=arrow)

    def scan(table: pa.Table) -> pa.Table:
        e, out = gathered(table)
        if e:
            out += marks_row(e, known(e), WINDOW, shards)
        return pa.Table.from_batches(batches_of(out, arrow), schema=arrow)

    docs = own.select("id", "key", "text", bucket_column(buckets).alias("bucket"))
    dealt = dealt.withColumn("bucket", F.col("bucket") % buckets)
    rows = docs.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInArrow(windows, ROWS)
    return rows.groupBy("shard").applyInArrow(scan, ROWS).select("data")


def without_spans(own: DataFrame, dealt: DataFrame, buckets: int) -> DataFrame:
    """doc_id, n_bytes, spans, kept of identified documents, from all their marks by bucket."""
    import pyarrow as pa

    schema = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    arrow = arrow_schema(schema)

    def cut(batch, places: Places) -> pa.RecordBatch:
        data, offsets = bytes_of(batch.column("text"))
        row, pos = places.of(batch, COVERED)
        more_row, more = places.of(batch, WINDOW)
        low = np.concatenate([np.maximum(pos - BEFORE, 0), more])
        row, high = np.concatenate([row, more_row]), np.concatenate([pos, more]) + LENGTH
        high = np.minimum(offsets[row] + high, offsets[row + 1])
        first, last = merged_spans(offsets[row] + low + row, high + row)  # plus the row: else spans of two texts may touch
        row = np.searchsorted(offsets + np.arange(len(offsets)), first, side="right") - 1
        first, last = first - row, last - row
        steps = np.zeros(len(data) + 1, np.int8)
        np.add.at(steps, first, 1)
        np.add.at(steps, last, -1)
        gone = np.cumsum(steps[:-1], dtype=np.int8) > 0
        left = np.diff(offsets) - np.bincount(row, last - first, len(batch)).astype(np.int64)
        struct = arrow.field("spans").type.value_type
        spans = pa.StructArray.from_arrays([pa.array(first - offsets[row], pa.int64()), pa.array(last - offsets[row], pa.int64())], fields=list(struct))
        ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        spans = pa.ListArray.from_arrays(ends(np.bincount(row, minlength=len(batch))), spans, type=arrow.field("spans").type)
        kept = pa.Array.from_buffers(pa.binary(), len(batch), [None, ends(left).buffers()[1], pa.py_buffer(data[~gone].tobytes())])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), spans, kept.cast(arrow.field("kept").type)], schema=arrow)

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        places = Places(marks)
        return pa.Table.from_batches([cut(batch, places) for batch in docs.to_batches()], schema=arrow)

    docs = own.withColumn("bucket", bucket_column(buckets))
    return docs.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInArrow(run, schema)


def removed_by_marks(own: DataFrame, marks: DataFrame, shards: int) -> DataFrame:
    """doc_id, n_bytes, spans, kept of identified documents, from the marks of an index that has seen them."""
    large = max(shards, LEAST)
    small = large * BUCKETS
    with passing_blocks(own.sparkSession):
        dealt = scratch(by_bucket(marks, small))
        known_ = scratch(known_windows(own, dealt, large, shards))
        windows = scratch(by_bucket(known_, small))
    return without_spans(own, dealt.unionByName(windows), small)


def remove_repeats(docs: DataFrame, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans, kept: one row per row of docs.

    A byte goes if a window of 50 bytes that covers it also stands in a row of a smaller
    id; spans are the maximal runs of such bytes, kept is the rest. A null text counts
    as empty; a null id as larger than all others; rows of one id don't repeat one
    another, so repeated rows get equal results; texts under 50 bytes stay whole; a very
    long text counts whole, hashed in pieces; an empty table gives none; other columns
    are not read.
    """
    own = identified(docs, id_col, text_col)
    spark = docs.sparkSession
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, size // SHARD + 1)
    middle = own.filter(F.col("id") < int(NO_ID)).approxQuantile("id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    bounds = [None, *sorted({int(x) for x in middle}), None]

    def all_marks() -> DataFrame:
        index, marks = SuffixIndex(spark, shards), None
        for n, (low, high) in enumerate(zip(bounds[:-1], bounds[1:])):
            above = F.lit(True) if low is None else F.col("id") > low
            found = index.add(own.filter(above if high is None else above & (F.col("id") <= high)), keep=n + 2 < len(bounds))
            marks = found if marks is None else marks.unionByName(found)
        index.drop(list(index.levels))
        return marks

    return removed_by_marks(own, kept_table(all_marks, spark), shards)


def op12_suffix_array_dedup(spark, sf_dir):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
