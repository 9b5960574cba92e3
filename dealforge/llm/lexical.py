"""Operator 13: ranked lexical search in a tiered index that lies beside its documents.

The index has one row a document: the terms that items ask for and their impacts, in
three tiers. A term's postings of highest impact are in the first tier, the next ones
in the second, all others in the third; for every term and tier the residual bound is
known, the highest impact that lies further down. Tiers are columns, so that a look at
the first reads nothing of the others.

A look at the tiers down to a level gives each item a sum a document, and so a floor
under its k-th score. No document outside those tiers can exceed the item's residual
bounds in sum. If these lie below the floor, the item is proven: what can still reach
the floor is among the documents seen, and only these are scored whole. An item that
lacks the proof falls to the next level; at the last one all postings are read.

Items come in blocks of bounded size, each against all documents. No posting is
shuffled: tasks keep their best k of an item.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealforge.llm.common import arrow_schema, ascii_words, binary_text, read_table, scratch

BEST = 20
#: Postings of a term that the tiers before the last hold at least, if there are as many.
TIERS = (1024, 32_768)
#: What a block of items may ask for in terms, and items: about 30 MB in a task.
BLOCK_TERMS = 65_536
BLOCK_ITEMS = 256
#: Impacts are counted in this many classes an octave.
OCTAVE = 8

IMPACT = "(1000000000L * tf) div (1000L * tf + 12L * (75L + ((25L * n_terms * {n}L) div {all}L)))"


def term_counts(text: bytes | None) -> Counter:
    counts: Counter = Counter()
    for part in ascii_words(text):
        counts.update(part)
    return counts


class Block:
    """Items of a block: their terms, numbered, and how often each item asks for a term."""

    def __init__(self, items: list[tuple[object, bytes]]):
        self.ids = [item_id for item_id, _ in items]
        asked = [term_counts(text) for _, text in items]
        self.number = {term: i for i, term in enumerate(sorted(set().union(*asked)))}
        self.asked: list[list[tuple[int, int]]] = [[] for _ in self.number]  # term -> (item, times)
        for item, counts in enumerate(asked):
            for term, times in counts.items():
                self.asked[self.number[term]].append((item, times))


def item_blocks(items: DataFrame, id_col: str, text_col: str):
    """The items in blocks: at most some BLOCK_ITEMS of them and BLOCK_TERMS words, by hash."""
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    own = scratch(items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).distinct().withColumn("words", words).filter("words > 0"))
    n, total = own.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    blocks = max(math.ceil(2 * n / BLOCK_ITEMS), math.ceil(2 * total / BLOCK_TERMS))  # half full on average
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1)))
    for block in range(blocks):
        rows = own.filter(place == block).select("item_id", binary_text()).collect()
        if rows:
            yield Block([tuple(r) for r in sorted(rows, key=lambda r: (r[0] is None, str(r[0]), bytes(r[1])))])


def list_array(flat: np.ndarray, owners: np.ndarray, rows: int):
    """An Arrow list a row from values sorted by row."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owners, np.arange(rows + 1)).astype(np.int32)), pa.array(flat))


def term_vectors(docs: DataFrame, block: Block, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_terms, terms, tfs of documents with a term: only terms that the block asks for are listed."""
    import pyarrow as pa

    number = docs.sparkSession.sparkContext.broadcast(block.number)  # at most some BLOCK_TERMS terms
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_terms long, terms array<int>, tfs array<long>"
    arrow = arrow_schema(schema)

    def count(batches):
        get = number.value.get
        for batch in batches:
            n, owners, terms, tfs = np.zeros(batch.num_rows, np.int64), [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                found: Counter = Counter()
                for part in ascii_words(text):
                    n[row] += len(part)
                    found.update(map(get, part))
                found.pop(None, None)
                owners += [row] * len(found)
                terms += found.keys()
                tfs += found.values()
            own = np.array(owners, np.int64)
            columns = [batch.column(0), pa.array(n), list_array(np.array(terms, np.int32), own, len(n)), list_array(np.array(tfs, np.int64), own, len(n))]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select(F.col(id_col).alias("doc_id"), binary_text(text_col)).mapInArrow(count, schema).filter("n_terms > 0")


class Index:
    """The tiered index of all documents for a block of items, and what bounds it."""

    def __init__(self, docs: DataFrame, block: Block, id_col: str, text_col: str, tiers: tuple[int, ...] = TIERS):
        vectors = scratch(term_vectors(docs, block, id_col, text_col))
        n_docs, n_all = vectors.agg(F.count("*"), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        self.impact = IMPACT.format(n=n_docs, all=max(n_all, 1))
        posted = vectors.select("n_terms", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("n_terms", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
        # classes upward in impact; several to an octave
        classes = posted.withColumn("impact", F.expr(self.impact)).withColumn("class", F.floor(F.log2(F.col("impact") + 1) * OCTAVE).cast("int"))
        sizes = classes.groupBy("term", "class").agg(F.count("*").alias("n"), F.max("impact").alias("most"), F.min("impact").alias("least"))
        down = Window.partitionBy("term").orderBy(F.desc("class"))
        above = F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        tier = sum(((F.col("above") >= size).cast("int") for size in tiers), F.lit(0))  # of a class: by what lies above it
        bounds = sizes.withColumn("above", above).withColumn("tier", tier).groupBy("term", "tier").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min("least").alias("least"))
        terms, levels = len(block.number), len(tiers) + 1
        self.weights, df = np.zeros(terms, np.int64), np.zeros(terms, np.int64)
        self.starts = np.full((levels, terms), np.iinfo(np.int64).max)  # least impact of a tier
        most = np.zeros((levels + 1, terms), np.int64)
        for term, level, n, top, low in bounds.collect():  # a row a term and tier: bounded by the block
            df[term] += n
            self.starts[level, term], most[level, term] = low, top
        self.residual = np.array([most[level + 1 :].max(axis=0) for level in range(levels)])
        self.starts = np.minimum.accumulate(self.starts, axis=0)
        self.weights[:] = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()]
        self.levels, self.block = levels, block
        self.rows = scratch(self.tiered(vectors))
        self.shared = docs.sparkSession.sparkContext.broadcast((block.asked, self.weights, self.residual, len(block.ids)))

    def tiered(self, vectors: DataFrame) -> DataFrame:
        """doc_id, and terms_i, impacts_i for every tier i."""
        import pyarrow as pa

        levels = self.levels
        posted = vectors.select("doc_id", "terms", F.expr(f"transform(tfs, tf -> {self.impact})").alias("impacts"))
        starts = vectors.sparkSession.sparkContext.broadcast(self.starts)
        schema = f"doc_id {vectors.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"terms_{i} array<int>, impacts_{i} array<long>" for i in range(levels))
        arrow = arrow_schema(schema)

        def deal(batches):
            for batch in batches:
                lists = batch.column(1)
                terms, impacts = lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy()
                owners = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
                tier = (impacts < starts.value[:, terms]).sum(axis=0)
                columns = [batch.column(0)]
                for i in range(levels):
                    own = tier == i
                    columns += [list_array(terms[own], owners[own], batch.num_rows), list_array(impacts[own], owners[own], batch.num_rows)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

        return posted.mapInArrow(deal, schema)

    def unseen(self, level: int) -> np.ndarray:
        """By item: the most that postings below a level can add up to."""
        out = np.zeros(len(self.block.ids), np.int64)
        for term, asked in enumerate(self.block.asked):
            for item, times in asked:
                out[item] += self.weights[term] * times * self.residual[level, term]
        return out


def tier_sums(batch, upto: int, shared, items: np.ndarray, bounds: bool, rows: np.ndarray | None = None) -> np.ndarray:
    """[row, item] sums of weight and impact in the tiers 0 ... upto of a batch; with bounds, less the residual bounds of what is seen."""
    asked, weights, residual, n_items = shared
    sums = np.zeros((batch.num_rows, n_items), np.int64)
    wanted = np.zeros(n_items, bool)
    wanted[items] = True
    for tier in range(upto + 1):
        lists = batch.column(f"terms_{tier}")
        terms, impacts = lists.flatten().to_numpy(), batch.column(f"impacts_{tier}").flatten().to_numpy()
        owners = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        if rows is not None:
            terms, impacts, owners = (a[rows[owners]] for a in (terms, impacts, owners))
        order = np.argsort(terms, kind="stable")
        terms, impacts, owners = terms[order], impacts[order], owners[order]
        edges = np.flatnonzero(np.diff(terms, prepend=-1, append=-1)) if len(terms) else []
        for a, b in zip(edges[:-1], edges[1:]):
            term = terms[a]
            own = [(item, times) for item, times in asked[term] if wanted[item]]
            if own:
                places, times = np.array(own, np.int64).T
                values = impacts[a:b] - residual[upto, term] if bounds else impacts[a:b]
                sums[np.ix_(owners[a:b], places)] += values[:, None] * (weights[term] * times)[None, :]
    return sums


class Best:
    """The best k rows of every item so far, by score, then by id, null last."""

    def __init__(self, k: int):
        self.k, self.rows = k, {}

    def add(self, item: int, scores: np.ndarray, ids: list) -> None:
        if len(scores) > self.k:
            least = np.partition(scores, -self.k)[-self.k]
            keep = np.flatnonzero(scores >= least)
            scores, ids = scores[keep], [ids[i] for i in keep]
        both = self.rows.get(item, []) + [(-s, i is None, i) for s, i in zip(scores.tolist(), ids)]
        self.rows[item] = sorted(both, key=lambda r: (r[0], r[1], 0 if r[1] else r[2]))[: self.k]

    def columns(self) -> dict[str, list]:
        flat = [(item, i, -s) for item, rows in self.rows.items() for s, _, i in rows]
        return {name: [r[place] for r in flat] for place, name in enumerate(("item", "doc_id", "score"))}


def best_of_tasks(index: Index, columns: list[str], score, k: int) -> DataFrame:
    """item, doc_id, score: the best k of each task; score(batch) yields (item, scores, ids)."""
    import pyarrow as pa

    schema = f"item int, doc_id {index.rows.schema['doc_id'].dataType.simpleString()}, score long"
    arrow = arrow_schema(schema)

    def run(batches):
        best = Best(k)
        for batch in batches:
            for found in score(batch):
                best.add(*found)
        yield pa.RecordBatch.from_pydict(best.columns(), schema=arrow)

    return index.rows.select(*columns).mapInArrow(run, schema)


def tier_columns(upto: int) -> list[str]:
    return ["doc_id", *[f"{name}_{i}" for i in range(upto + 1) for name in ("terms", "impacts")]]


def floors(index: Index, level: int, items: np.ndarray, k: int) -> np.ndarray:
    """By item: the k-th highest sum of a document in the tiers down to a level, 0 if there are fewer."""
    shared = index.shared

    def score(batch):
        sums = tier_sums(batch, level, shared.value, items, bounds=False)
        for item in items.tolist():
            own = sums[:, item]
            own = own[own > 0]
            yield item, own, [0] * len(own)

    best = best_of_tasks(index, tier_columns(level), score, k)
    last = best.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).filter(F.col("place") == k)
    out = np.zeros(len(index.block.ids), np.int64)
    for item, score_ in last.select("item", "score").collect():  # a row an item: bounded by the block
        out[item] = score_
    return out


def proven_levels(index: Index, k: int) -> tuple[np.ndarray, np.ndarray]:
    """By item: the level at which it is proven, and its floor there."""
    n = len(index.block.ids)
    levels, lowest = np.full(n, index.levels - 1), np.zeros(n, np.int64)
    open_ = np.arange(n)
    for level in range(index.levels - 1):
        if not len(open_):
            break
        found = floors(index, level, open_, k)
        proof = index.unseen(level)[open_] < found[open_]
        levels[open_[proof]], lowest[open_[proof]] = level, found[open_[proof]]
        open_ = open_[~proof]
    return levels, lowest


def search_block(index: Index, k: int) -> DataFrame:
    """item, doc_id, score: the best k of each task for every item of a block."""
    levels, lowest = proven_levels(index, k)
    unseen = {int(level): index.unseen(int(level)) for level in np.unique(levels)}
    shared, last = index.shared, index.levels - 1

    def score(batch):
        ids = batch.column("doc_id").to_pylist()
        can = np.zeros((batch.num_rows, len(levels)), bool)
        for level, rest in unseen.items():
            items = np.flatnonzero(levels == level)
            if level == last:
                can[:, items] = True
            else:
                can[:, items] = tier_sums(batch, level, shared.value, items, bounds=True)[:, items] + rest[items] >= lowest[items]
        rows = can.any(axis=1)
        sums = tier_sums(batch, last, shared.value, np.arange(len(levels)), bounds=False, rows=rows)
        sums[~can] = 0
        for item in range(len(levels)):
            own = np.flatnonzero(sums[:, item])
            yield item, sums[own, item], [ids[i] for i in own]

    return best_of_tasks(index, tier_columns(last), score, k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item with a score above 0.

    Equal scores go by id, null ids last; repeated rows of docs are ranked each, repeated
    rows of items once, texts of one item id each by itself; null and empty texts have no
    terms: such items have no rows and such documents are none; very long texts count
    whole; empty tables give none; other columns are not read.
    """
    out = None
    for block in item_blocks(items, item_id_col, item_text_col):
        index = Index(docs, block, id_col, text_col, tiers)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = search_block(index, k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = docs.sparkSession.createDataFrame(list(enumerate(block.ids)), f"number int, item_id {items.schema[item_id_col].dataType.simpleString()}")
        rows = scratch(best.join(F.broadcast(names), F.col("item") == F.col("number")).select("item_id", "rank", "doc_id", "score"))  # names: at most some BLOCK_ITEMS
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        types = items.schema[item_id_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"item_id {types[0]}, rank int, doc_id {types[1]}, score long")
    return out


def op13_ranked_search(spark, sf_dir):
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
docs AS (SELECT r, doc_id, len(ws)::BIGINT AS n, ws FROM words WHERE len(ws) > 0),
allof AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM docs),
items AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT i, item_id, t, count(*)::BIGINT AS q FROM (SELECT i, item_id, unnest(ws) AS t FROM items) GROUP BY ALL),
posts AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(ws) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
terms AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM posts, allof GROUP BY t, nn),
impacts AS (SELECT r, doc_id, t, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)) AS impact FROM posts, allof),
scores AS (
  SELECT i, item_id, r, doc_id, sum(q * w * impact)::BIGINT AS score FROM asked JOIN terms USING (t) JOIN impacts USING (t) GROUP BY i, item_id, r, doc_id HAVING sum(q * w * impact) > 0)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score FROM scores
QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) <= 20
"""
