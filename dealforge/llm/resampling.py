"""Operator 11: importance resampling towards a target distribution over hashed n-grams.

Two passes over the texts in Arrow batches. The first counts every run of one to
three words by its bucket (np.bincount, one vector of 10,000 counts a partition);
treeReduce adds the vectors up, so that neither a task nor the driver meets many of
them. The driver turns the vectors of corpus and target into one vector of gains. The
second pass gathers the gains of a document's buckets and sums them by document, with
bincount again. Gumbel noise from a hash of the id makes the highest scores a draw by
importance weight without replacement.

The checksum of a run of words follows from those of its words, as crc32 is linear:
runs are never built as strings.
"""

from __future__ import annotations

import math
import zlib
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealforge.llm.common import arrow_schema, ascii_words, binary_text, numbered_by, read_table, scratch

BUCKETS = 10_000
LONGEST_RUN = 3
SEED = 42
PERCENT = 5
LEAST_WORDS = 20
#: Words that are looked at together.
BLOCK_WORDS = 1 << 17
#: Words up to this many bytes are moved past in one step.
STEP_BYTES = 64
#: Levels of the tree that adds the vectors up.
DEPTH = 3


@cache
def shift_tables() -> np.ndarray:
    """[n, place, byte]: what a byte of a checksum becomes when n zero bytes follow."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> 1) ^ np.where(one & 1, np.uint32(0xEDB88320), np.uint32(0))
    out = np.empty((STEP_BYTES + 1, 4, 256), np.uint32)
    out[0] = [np.arange(256, dtype=np.uint32) << np.uint32(8 * place) for place in range(4)]
    for n in range(STEP_BYTES):
        out[n + 1] = one[out[n] & 255] ^ (out[n] >> np.uint32(8))
    return out


def moved(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """Checksums when zero bytes follow; tables: [..., place, byte]."""
    return tables[..., 0, :][crc & 255] ^ tables[..., 1, :][(crc >> 8) & 255] ^ tables[..., 2, :][(crc >> 16) & 255] ^ tables[..., 3, :][crc >> 24]


@cache
def doubled_tables(power: int) -> np.ndarray:
    """[place, byte] for 2 ** power zero bytes."""
    return shift_tables()[1] if not power else moved(doubled_tables(power - 1), doubled_tables(power - 1))


def joined_crc(first: np.ndarray, second: np.ndarray, second_bytes: np.ndarray) -> np.ndarray:
    """crc32 of joined texts, from the crc32 of both parts and the second's length."""
    tables, n = shift_tables(), np.minimum(second_bytes, STEP_BYTES)
    crc = tables[n, 0, first & 255] ^ tables[n, 1, (first >> 8) & 255] ^ tables[n, 2, (first >> 16) & 255] ^ tables[n, 3, first >> 24]
    for i in np.flatnonzero(second_bytes > STEP_BYTES):
        left, power = int(second_bytes[i]) - STEP_BYTES, 0
        while left >> power:
            if left >> power & 1:
                crc[i : i + 1] = moved(doubled_tables(power), crc[i : i + 1])
            power += 1
    return crc ^ second


def word_blocks(texts: list[bytes | None]):
    """Blocks of words as (text number, crc32, bytes, first): the words from `first` on are new.

    A block begins with the last words of the one before: runs across its edge are seen.
    """
    none = (np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.int64))
    kept, owners, words, waiting = none, [], [], 0

    def block():
        sizes = [len(part) for part in words]
        flat = [w for part in words for w in part]
        own = np.repeat(owners, sizes), np.fromiter(map(zlib.crc32, flat), np.uint32, len(flat)), np.fromiter(map(len, flat), np.int64, len(flat))
        return tuple(np.concatenate(pair) for pair in zip(kept, own))

    for number, text in enumerate(texts):
        for part in ascii_words(text):
            owners.append(number)
            words.append(part)
            waiting += len(part)
            if waiting >= BLOCK_WORDS:
                whole = block()
                yield (*whole, len(kept[0]))
                kept, owners, words, waiting = tuple(a[1 - LONGEST_RUN :] for a in whole), [], [], 0
    if words:
        yield (*block(), len(kept[0]))


def features(texts: list[bytes | None]):
    """Block by block: (text number of each word, text number of each run, bucket of each run)."""
    blank = np.uint32(zlib.crc32(b" "))
    for number, crc, size, first in word_blocks(texts):
        owners, values, run = [number[first:]], [crc[first:]], crc
        for k in range(1, LONGEST_RUN):  # run[i]: the k words that end at i; longer[i]: one more before them
            before = run[k - 1 : -1]
            spaced = joined_crc(before, np.full(len(before), blank), np.ones(len(before), np.int64))
            longer = crc.copy()
            longer[k:] = joined_crc(spaced, crc[k:], size[k:])
            ends = np.arange(max(first, k), len(crc))
            ends = ends[number[ends] == number[ends - k]]
            owners.append(number[ends])
            values.append(longer[ends])
            run = longer
        yield number[first:], np.concatenate(owners), (np.concatenate(values) % BUCKETS).astype(np.int64)


def bucket_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each bucket occurs in all texts of docs."""
    import pyarrow as pa

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, buckets in features(batch.column(0).to_pylist()):
                total += np.bincount(buckets, minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"counts": [total.tobytes()]})

    vectors = docs.select(binary_text(text_col)).mapInArrow(count, "counts binary").rdd.map(lambda row: np.frombuffer(row[0], np.int64))
    return vectors.treeReduce(np.add, DEPTH) if vectors.getNumPartitions() else np.zeros(BUCKETS, np.int64)


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of a bucket's smoothed share in the target by that in the corpus), in doubles."""
    all_corpus, all_target = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(t + 1) * all_corpus) / (float(s + 1) * all_target))) for s, t in zip(corpus.tolist(), target.tolist())], np.float64)


def noise(doc_id: Column) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of sha256(seed:doc_id); a null id counts as an empty one."""
    name = F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weighted(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight: the sum of the gains of a document's runs of words."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(gains)  # 10,000 numbers, whatever the corpus
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_features long, weight long"
    arrow = arrow_schema(schema)

    def weigh(batches):
        for batch in batches:
            n = batch.num_rows
            words, runs, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            for by_word, by_run, buckets in features(batch.column(1).to_pylist()):
                words += np.bincount(by_word, minlength=n)
                runs += np.bincount(by_run, minlength=n)
                weight += np.bincount(by_run, weights=shared.value[buckets], minlength=n)  # whole numbers: exact in doubles
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(runs), pa.array(weight.astype(np.int64))], schema=arrow)

    return docs.select(F.col(id_col).alias("doc_id"), binary_text(text_col)).mapInArrow(weigh, schema)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: one row per row of docs.

    rank numbers the drawn documents from 1, the highest score first: percent of those
    with at least least_words words. Equal scores go by id, null ids last; repeated
    rows get equal scores and ranks of their own; a null or empty text has no feature
    and weight 0; a null id draws the noise of an empty one; a very long text counts
    whole, in blocks of words; an empty table gives none, an empty target smoothed
    shares; other columns are not read.
    """
    gains = bucket_gains(bucket_counts(docs, text_col), bucket_counts(target, target_text_col))
    table = scratch(weighted(docs, gains, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("doc_id"))))
    fit = table.filter(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    ranked = numbered_by(fit, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features"), F.asc("n_words"))
    ranked = ranked.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place").cast("long"))).drop("place")
    return ranked.unionByName(table.filter(F.col("n_words") < least_words), allowMissingColumns=True)


def op11_importance_resampling(spark, sf_dir):
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("n_words")
