"""Operator 5: language identification by multinomial naive Bayes over hashed n-grams.

Letters are lower-cased, all else becomes a blank; n-grams of one to three code
points are hashed into buckets. Counts by language and bucket are summed in each
task and then over all; the matrix of log probabilities, languages by buckets, is
small whatever the corpus and goes to every executor, where the sparse counts of a
batch of documents are multiplied with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealforge.llm.common import held_out, map_columns, read_table, scratch

BUCKET_BITS = 14
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Languages of one matrix (16 MB); more are scored by several, one after the other.
BLOCK = 256
#: Numbers that a step of scoring gathers at once.
GATHERED = 8_000_000
#: Texts whose counts are made at once.
TEXTS = 256
UNKNOWN = "und"

_letters: list = []


def letter_table():
    """For each code point, whether it is a letter."""
    import numpy as np

    if not _letters:
        _letters.append(np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), dtype=np.bool_))
    return _letters[0]


def ngram_buckets(text: str, bits: int = BUCKET_BITS):
    """Buckets of the n-grams of a text, repeats included; none if it has no letter."""
    import numpy as np

    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = letter_table()[codes]
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    codes = np.where(letter, codes, 32).astype(np.uint64)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = letter[1:] | letter[:-1]  # one blank for several
    codes = np.concatenate([[np.uint64(32)], codes[keep], [np.uint64(32)]])
    out, h = [], np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = (h[: len(codes) - n + 1] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] * np.uint64(0xBF58476D1CE4E5B9)
        if n in ORDERS:
            mixed = (h ^ h >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
            out.append((mixed >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(out)


def ngram_counts(docs: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """lang, bucket, n over all rows of (text, lang) with a language."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        sums: dict = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                if lang not in sums:
                    sums[lang] = np.zeros(1 << bits, dtype=np.int64)
                sums[lang] += np.bincount(ngram_buckets(text, bits), minlength=1 << bits)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": at, "n": counts[at]}, schema=pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())]))

    known = docs.filter("text is not null and lang is not null").select("text", "lang")
    return known.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, bits: int = BUCKET_BITS, smoothing: float = SMOOTHING, block: int = BLOCK):
    """[(languages, log-probability matrix)] of labelled rows: blocks of at most `block` languages, in order.

    Counts cover all rows given; languages have equal priors. The counts of one
    block at a time come to the driver, at most block * 2^bits numbers.
    """
    import numpy as np

    counts = scratch(ngram_counts(docs, bits))
    languages = sorted(r["lang"] for r in counts.select("lang").union(docs.filter("text is not null").select("lang").filter("lang is not null")).distinct().collect())
    model = []
    for at in range(0, len(languages), block):
        part = languages[at : at + block]
        row = {lang: i for i, lang in enumerate(part)}
        matrix = np.full((len(part), 1 << bits), smoothing)
        mine = counts.filter(F.col("lang").between(part[0], part[-1])).toPandas()
        matrix[mine["lang"].map(row).to_numpy(dtype=np.int64), mine["bucket"].to_numpy(dtype=np.int64)] += mine["n"].to_numpy()
        model.append((part, np.log(matrix / matrix.sum(axis=1, keepdims=True)).astype(np.float32)))
    return model


def sparse_counts(texts, bits: int = BUCKET_BITS):
    """(document, bucket, count) arrays of the n-grams of texts, sorted by document and bucket."""
    import numpy as np

    found = [ngram_buckets(t, bits) if t else np.zeros(0, dtype=np.int64) for t in texts]
    parts = [np.unique(b, return_counts=True) for b in found]
    doc = np.repeat(np.arange(len(parts)), [len(b) for b, _ in parts])
    empty = [np.zeros(0, dtype=np.int64)]
    return doc, np.concatenate([b for b, _ in parts] or empty), np.concatenate([n for _, n in parts] or empty)


def log_likelihoods(n_docs: int, doc, bucket, count, matrix):
    """The sparse counts times the matrix: documents by languages, by steps of bounded size."""
    import numpy as np

    out = np.zeros((n_docs, len(matrix)))
    columns, step = np.ascontiguousarray(matrix.T), max(1, GATHERED // len(matrix))
    for at in range(0, len(doc), step):
        d = doc[at : at + step]
        first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        out[d[first]] += np.add.reduceat(columns[bucket[at : at + step]] * count[at : at + step, None], first, axis=0, dtype=np.float64)
    return out


def predict_language(docs: DataFrame, model) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of docs.

    The score is the posterior probability of the language. A null text or one
    without a letter is `und` with score 0, as is any text if nothing was learned;
    ties go to the first language in order. Repeated rows get equal results, an
    empty table none, null ids stay null; a very long text counts whole. Columns
    other than doc_id and text are not read.
    """
    shared = [docs.sparkSession.sparkContext.broadcast(block) for block in model]

    def work(cols):
        parts = [scored(cols["text"][at : at + TEXTS]) for at in range(0, len(cols["text"]), TEXTS)]
        return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "lang_pred": [x for names, _ in parts for x in names], "score": [x for _, scores in parts for x in scores]}

    def scored(texts):
        import numpy as np

        doc, bucket, count = sparse_counts(texts)
        best = np.full(len(texts), -np.inf)
        total = np.zeros(len(texts))  # sum of exp(log - best)
        name = np.full(len(texts), UNKNOWN, dtype=object)
        for block in shared:
            languages, matrix = block.value
            log = log_likelihoods(len(texts), doc, bucket, count, matrix)
            top = log.argmax(axis=1)
            high = log[np.arange(len(texts)), top]
            new = np.maximum(best, high)
            total = total * np.exp(np.maximum(best - new, -700)) + np.exp(np.maximum(log - new[:, None], -700)).sum(axis=1)
            name = np.where(high > best, np.array(languages, dtype=object)[top], name)
            best = new
        known = np.zeros(len(texts), dtype=bool)
        known[doc] = bool(shared)
        return [n if k else UNKNOWN for n, k in zip(name, known)], [float(1 / t) if k else 0.0 for t, k in zip(total, known)]

    return map_columns(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), work, "doc_id long, held_out boolean, lang_pred string, score double")


def op5_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return predict_language(docs, train(docs.filter(~held_out(F.col("doc_id")))))
