"""Operator 6: near duplicates by bottom-k sketches of one hash function.

A document is the set of its word shingles, each hashed once to 64 bits; its sketch
is the k least values. Documents of equal sets are one node. Inverted lists of the
retained values give pairs that overlap; the sketch of a pair's union estimates its
similarity and filters; the full sets of the rest are compared. Connected nodes form
a class.

Lists stay short without a cap. If two sketches share `need` values, then the rarest
len - need + 1 values of the one and of the other have a value in common, so only
these are listed; `need` follows from the similarity asked for. What is then still a
long list belongs to a large group of near copies. Its nodes form a family, which is
compared exactly by blocks of full sets of like sizes; no pair of it leaves a task
but those of a forest that connects its classes.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealforge.llm.common import kept_table, read_table, scratch

WIDTH = 5
PERCENT = 80
#: Values that a sketch keeps, and the chance that a linked pair shares fewer of them than is asked for.
KEPT = 48
MISS = 1e-8
#: A value held more often than HOT is joined by broadcast, if there are at most HOT_ROWS (some 20 MB) of them.
HOT = 256
HOT_ROWS = 500_000
#: Members beyond which a list is long; members and shingles a block, columns a product.
LONG = 32
BLOCK = 1024
BLOCK_SHINGLES = 250_000
COLUMNS = 1024
CACHE_WORDS = 1_000_000
ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)


class WordHashes(dict):
    """64-bit hashes of words, remembered; the memory is emptied when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = WordHashes()


def shingle_set(text: str | None, width: int):
    """The sorted distinct 64-bit hashes of a text's shingles.

    A-Z are lower-cased and the six ASCII blanks divide words. Fewer words than a
    shingle are one shingle; no words give no shingle.
    """
    import numpy as np

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.int64)
    h = np.fromiter(map(_hashes.__getitem__, found), dtype=np.uint64, count=len(found))
    size = min(width, len(h))
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for j in range(size):
        out = (out ^ out >> np.uint64(29)) * np.uint64(ODD[j % 4]) + h[j : len(h) - size + 1 + j]
    out = (out ^ out >> np.uint64(32)) * np.uint64(ODD[1])
    out = (out ^ out >> np.uint64(29)) * np.uint64(ODD[2])
    return np.unique((out ^ out >> np.uint64(32)).view(np.int64))


def digest_of(shingles) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketch_rows(docs: DataFrame, width: int, kept: int) -> DataFrame:
    """doc_id, text_hash, n, node (digest of the set), sketch (its least values) of every row."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column("text").to_pylist()]
            least = [s[:kept] for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in least])]).astype(np.int32)
            values = np.concatenate(least) if least else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest_of(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                names=["doc_id", "text_hash", "n", "node", "sketch"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, n long, node binary, sketch array<long>")


def least_shared(percent: int, kept: int, miss: float = MISS) -> int:
    """How many of `kept` sketch values a linked pair shares at least, but for a chance of `miss`.

    Of the least `kept` values of a pair's union, each is common with the chance of
    its similarity. Below one value nothing could be listed: such a similarity needs
    longer sketches.
    """
    share, chance = percent / 100, 0.0
    for n in range(kept + 1):
        chance += math.comb(kept, n) * share**n * (1 - share) ** (kept - n)
        if chance > miss:
            if n < 1:
                raise ValueError(f"sketches of {kept} values are too short for {percent} %")
            return n
    return kept


def joined_by_value(rows: DataFrame, table: DataFrame, often: str) -> DataFrame:
    """rows with table's columns by rows.value = table.t_value; no task gets all rows of a frequent value.

    table is written, has one row a value and `often`, how many rows hold it. Values
    above HOT are few, as each has that many rows; their number is counted first.
    """
    same = F.col("value") == F.col("t_value")
    hot = table.filter(F.col(often) > HOT)
    if hot.count() > HOT_ROWS:  # beyond, adaptive execution splits them
        return rows.join(table, same).drop("t_value")
    hot = F.broadcast(hot)
    rest = rows.join(hot, same, "left_anti").join(table.filter(F.col(often) <= HOT), same)
    return rest.unionByName(rows.join(hot, same)).drop("t_value")


def inverted_lists(nodes: DataFrame, percent: int, kept: int, need: int) -> DataFrame:
    """value, node, n, members, first: the lists of every node's rarest values, and the least node of each.

    A node that is so small that all its partners have at most `kept` shingles shares
    `percent` of its set with them, any other one `need` sketch values. Values that no
    other node retains come first among the rarest, so they need no list: only their
    number counts.
    """
    each = nodes.select("node", "n", F.explode("sketch").alias("value"))
    often = scratch(each.groupBy(F.col("value").alias("t_value")).agg(F.count("*").alias("often")).filter("often > 1"))
    of_node = Window.partitionBy("node")
    own = F.ceil(F.col("n") * percent / 100).cast("int")
    least = F.when(100 * F.col("n") <= kept * percent, own).otherwise(F.least(own, F.lit(need)))
    listed = (
        joined_by_value(each, often, "often")
        .withColumn("rank", F.row_number().over(of_node.orderBy("often", "value")))
        .withColumn("shared", F.count("*").over(of_node))
        .filter(F.col("rank") <= F.col("shared") - least + 1)
        .select("value", "node", "n")
    )
    listed = scratch(listed)
    members = scratch(listed.groupBy(F.col("value").alias("t_value")).agg(F.count("*").alias("members"), F.min("node").alias("first")).filter("members > 1"))
    return scratch(joined_by_value(listed, members, "members"))


def near_in_size(a: str, b: str, percent: int):
    return (100 * F.least(F.col(a), F.col(b))) >= percent * F.greatest(F.col(a), F.col(b))


def pairs_of(lists: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs that share a (short) list and are near in size."""
    side = lambda p: lists.select(F.col("value").alias(f"{p}_value"), F.col("node").alias(p), F.col("n").alias(f"{p}_n"))
    return side("a").join(side("b"), (F.col("a_value") == F.col("b_value")) & (F.col("a") < F.col("b")) & near_in_size("a_n", "b_n", percent)).select("a", "b").distinct()


def full_sets(asked: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """node, shingles: the sets of nodes (node, doc), made anew from the documents' texts."""

    def sets(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            nodes, found = [], []
            for text, node in zip(batch.column("text").to_pylist(), batch.column("node").to_pylist()):
                s = shingle_set(text, width)
                if digest_of(s) == node:  # else another text of the same id
                    nodes.append(node)
                    found.append(s)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
            values = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["node", "shingles"])

    texts = docs.select("doc_id", "text").join(asked, F.col("doc_id").eqNullSafe(F.col("doc"))).select("text", "node")
    return scratch(texts.mapInArrow(sets, "node binary, shingles array<long>").dropDuplicates(["node"]))


def links_among(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int, kept: int, need: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough.

    Sketches that are whole sets decide at once. Other pairs that the estimate lets
    through are compared on their full sets.
    """
    side = lambda p: nodes.select(F.col("node").alias(p), F.col("n").alias(f"{p}_n"), F.col("doc").alias(f"{p}_doc"), F.col("sketch").alias(f"{p}_sketch"))
    union = F.slice(F.array_sort(F.array_union("a_sketch", "b_sketch")), 1, kept)
    shared = F.array_intersect("a_sketch", "b_sketch")
    common = F.size(F.array_intersect("union", "shared"))
    whole = (F.col("a_n") <= kept) & (F.col("b_n") <= kept)
    estimated = (
        pairs.join(side("a"), "a").join(side("b"), "b").withColumn("shared", shared).withColumn("union", union)
        .filter(F.when(whole, 100 * F.size("shared") >= percent * (F.col("a_n") + F.col("b_n") - F.size("shared"))).otherwise(common * kept >= need * F.size("union")))
        .select("a", "b", "a_doc", "b_doc", whole.alias("sure"))
    )
    estimated = scratch(estimated)
    open_ = estimated.filter("not sure")
    full = full_sets(open_.select(F.col("a").alias("node"), F.col("a_doc").alias("doc")).union(open_.select("b", "b_doc")).distinct(), docs, width)

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                n = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * n >= percent * (len(x) + len(y) - n))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    shingles = lambda p, name: full.select(F.col("node").alias(p), F.col("shingles").alias(name))
    compared = open_.select("a", "b").join(shingles("a", "x"), "a").join(shingles("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(compare, "a binary, b binary")
    return scratch(estimated.filter("sure").select("a", "b").unionByName(compared))


def families(lists: DataFrame) -> DataFrame:
    """node, label: the nodes that long lists connect, before any comparison."""
    return connect(lists.select(F.col("node").alias("a"), F.col("first").alias("b")), loops=True)


def common_shingles(rows: list, others: list):
    """The sizes of the intersections of each set of rows with each of others, by matrix products."""
    import numpy as np

    n = len(rows)
    sizes = [len(x) for x in [*rows, *others]]
    values, column = np.unique(np.concatenate([*rows, *others]), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    often = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(often) - 1
    row, column = row[often[column]], place[column[often[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, len(others)), dtype=np.float32)
    for at in range(0, int(often.sum()), COLUMNS):
        low, high = np.searchsorted(column, [at, at + COLUMNS])
        holds = np.zeros((len(sizes), COLUMNS), dtype=np.float32)
        holds[row[low:high], column[low:high] - at] = 1
        out += holds[:n] @ holds[n:].T
    return out


def forest(near):
    """(i, j) edges that connect what a matrix of rows by others connects; j counts after the rows."""
    import numpy as np

    n, m = near.shape
    label = np.arange(n + m)
    while True:
        high = n + m
        new = label.copy()
        new[:n] = np.minimum(new[:n], np.where(near, label[n:], high).min(axis=1, initial=high))
        new[n:] = np.minimum(new[n:], np.where(near.T, new[:n], high).min(axis=1, initial=high))
        if (new == label).all():
            return [(i, int(x)) for i, x in enumerate(label) if i != x]
        label = new


def links_in_families(lists: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: links that connect the near nodes of each family.

    A family is dealt in bands of like sizes, such that linked nodes stand in one
    band or in neighbours, and the bands in blocks of bounded size. Each pair of
    blocks is compared as two matrices, and only a forest of the links that it finds
    leaves the task.
    """
    family = scratch(families(lists)).withColumnRenamed("node", "f_node")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent) + 1e-9)).cast("int") if percent < 100 else F.col("n").cast("int") * 2
    members = nodes.select("node", "doc", "n").join(family, F.col("node") == F.col("f_node")).drop("f_node").withColumn("band", band)
    parts = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK)).cast("int")
    blocks = scratch(members.groupBy(F.col("label").alias("b_label"), F.col("band").alias("b_band")).agg(parts.alias("blocks")))
    near = lambda step: blocks.select(F.col("b_label").alias(f"l{step + 1}"), (F.col("b_band") - step).alias(f"s{step + 1}"), F.col("blocks").alias(f"blocks{step + 1}"))
    for step in (-1, 0, 1):
        members = members.join(near(step), (F.col("label") == F.col(f"l{step + 1}")) & (F.col("band") == F.col(f"s{step + 1}")), "left").drop(f"l{step + 1}", f"s{step + 1}")
    members = scratch(members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks1")).cast("int")))
    full = full_sets(members.select("node", "doc"), docs, width)
    numbers = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda low, i, high, j, first: F.struct(low.alias("low"), i.alias("i"), high.alias("high"), j.alias("j"), first.alias("first"))
    b, own = F.col("band"), F.col("own")
    pairs = F.concat(
        F.transform(numbers("blocks0"), lambda k: pair(b - 1, k, b, own, F.lit(False))),
        F.transform(numbers("blocks1"), lambda k: pair(b, F.least(own, k), b, F.greatest(own, k), own <= k)),
        F.transform(numbers("blocks2"), lambda k: pair(b, own, b + 1, k, F.lit(True))),
    )
    dealt = members.select("node", "label", F.explode(pairs).alias("p")).join(full, "node").select("label", "p.*", "node", "shingles")

    def compare(table):
        import numpy as np
        import pyarrow as pa

        first = np.array(table.column("first").to_pylist())
        sets = [x.values.to_numpy() for x in table.column("shingles")]
        node = table.column("node").to_pylist()
        one_block = table.column("i")[0] == table.column("j")[0] and table.column("low")[0] == table.column("high")[0]
        at = np.flatnonzero(first)
        to = at if one_block else np.flatnonzero(~first)
        if not len(at) or not len(to):
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        common = common_shingles([sets[i] for i in at], [sets[i] for i in to])
        sizes = np.array([len(x) for x in sets], dtype=np.float32)
        near = 100 * common >= percent * (sizes[at][:, None] + sizes[to][None, :] - common)
        place = np.concatenate([at, to])
        edges = [(node[place[i]], node[place[j]]) for i, j in forest(near)]
        edges = [e for e in edges if e[0] != e[1]]
        return pa.table({"a": pa.array([a for a, _ in edges], pa.binary()), "b": pa.array([b for _, b in edges], pa.binary())})

    return scratch(dealt.groupBy("label", "low", "i", "high", "j").applyInArrow(compare, "a binary, b binary"))


def connect(links: DataFrame, loops: bool = False) -> DataFrame:
    """node, label: the least node that each linked node can reach (with loops: least nodes too).

    Alternates large and small stars: every node hands its neighbours on to the
    least of them, until all edges end in a least node. No neighbourhood is gathered.
    """
    edges = scratch(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy(F.col("u").alias("m_u")).agg(F.min("v").alias("m"))
        least = least.select("m_u", F.least("m", "m_u").alias("m"))
        large = both.join(least, F.col("u") == F.col("m_u")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy(F.col("u").alias("m_u")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("m_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("m_u", "m")).filter("u != v").distinct()
        edges = scratch(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            out = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
            return out.union(links.filter("a = b").select("a", "b").distinct().join(edges, F.col("a") == F.col("u"), "left_anti")) if loops else out
        state = now


def classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, kept: int = KEPT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash: one row per row of docs.

    component_id is the least doc_id of the class, kept says whether the row has it.
    A null, empty or blank text has no shingles and is alone; rows of one id are
    kept alike; null ids count as larger than others, and a class of null ids alone
    has a null component_id and is kept; an empty table gives no rows; other columns
    than doc_id and text are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    sketched = scratch(sketch_rows(docs, width, kept))

    def components() -> DataFrame:
        need = least_shared(percent, kept)
        nodes = scratch(sketched.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
        lists = inverted_lists(nodes, percent, kept, need)
        long_ = lists.filter(F.col("members") > LONG)
        links = links_among(pairs_of(lists.filter(F.col("members") <= LONG), percent), nodes, docs, width, percent, kept, need)
        if not long_.isEmpty():
            links = links.union(links_in_families(long_, nodes, docs, width, percent))
        labels = connect(links)
        known = nodes.select("node", "doc").join(labels.withColumnRenamed("node", "l_node"), F.col("node") == F.col("l_node"), "left").withColumn("label", F.coalesce("label", "node"))
        least = known.groupBy(F.col("label").alias("c_label")).agg(F.min("doc").alias("component_id"))
        return known.join(least, F.col("label") == F.col("c_label")).select(F.col("node").alias("c_node"), "component_id")

    of_node = kept_table(components, spark)
    both = sketched.select("doc_id", "text_hash", "n", "node").join(of_node, F.col("node") == F.col("c_node"), "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return both.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose id is the least of its class, with the columns of docs.

    Rows are found again by id and text, so that null or repeated ids do no harm. Of
    several rows with one id and text one stays, whichever. Texts without words are
    alone and stay. Columns of docs may have any names.
    """
    stay = scratch(classes(docs, **options).filter("kept").groupBy(F.col("doc_id").alias("stay"), F.col("text_hash").alias("hash")).agg(F.count("*").alias("rows")))
    own = docs.select(F.struct(*docs.columns).alias("own"))
    same = F.col("own.doc_id").eqNullSafe(F.col("stay")) & (F.xxhash64("own.text") == F.col("hash"))
    kept = own.join(stay, same)
    once = kept.filter("rows = 1").select("own")
    many = kept.filter("rows > 1").groupBy("stay", "hash").agg(F.first("own").alias("own")).select("own")
    return once.unionByName(many).select("own.*")


def op6_minhash_near_dedup(spark, sf_dir):
    return classes(read_table(spark, sf_dir, "documents"), width=4).drop("text_hash")
