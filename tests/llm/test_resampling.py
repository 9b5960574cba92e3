"""Operator 11 against a plain version over every run of words."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from dealforge.llm import resampling
from dealforge.llm.common import read_table

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_buckets(text):
    words = plain_words(text)
    return Counter(zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1))


def plain(docs, target):
    """docs: (doc_id, text); target: texts."""
    own = [plain_buckets(t) for _, t in docs]
    s, t = sum(own, Counter()), sum(map(plain_buckets, target), Counter())
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000.0) / ((s[b] + 1) * (T + 10000.0))))
    rows = []
    for (doc_id, text), counts in zip(docs, own):
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(n * gain(b) for b, n in counts.items())
        rows.append([doc_id, sum(counts.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text))])
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(fit[: 5 * len(fit) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in rows]


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


def result(df):
    return in_order(df.select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_query_equals_plain_version(spark):
    docs = [tuple(r) for r in read_table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    target = [r[0] for r in read_table(spark, SMALL, "benchmark").select("text").collect()]
    out = result(resampling.op11_importance_resampling(spark, SMALL))
    assert out == in_order(plain(docs, target))
    assert sum(r[4] is not None for r in out) > 3


@pytest.mark.parametrize("words", [["a"], ["a", "b"], ["x" * 200, "y" * 64, "z" * 65, "ä" * 70, "1"] * 3])
def test_checksums_of_runs(words):
    found = [b for _, _, buckets in resampling.features([" ".join(words).encode()]) for b in buckets]
    assert Counter(map(int, found)) == plain_buckets(" ".join(words))


def test_blocks_see_runs_across_their_edges(monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK_WORDS", 3)
    monkeypatch.setattr(resampling, "ascii_words", lambda text: ([w] for w in (text or b"").split()))
    texts = ["a b c d e f g", "", "h i", "j", "k l m n"]
    found, words = [Counter() for _ in texts], np.zeros(len(texts), int)
    for by_word, by_run, buckets in resampling.features([t.encode() for t in texts]):
        words += np.bincount(by_word, minlength=len(texts))
        for n, b in zip(by_run, buckets):
            found[n][int(b)] += 1
    assert found == [plain_buckets(t) for t in texts]
    assert words.tolist() == [7, 0, 2, 1, 4]


def test_odd_rows(spark):
    many = " ".join(f"word{i % 9} Thing" for i in range(30))
    rows = [(1, None), (2, ""), (3, " .,! "), (None, many), (None, many), (4, many), (4, many), (5, "Ünïcode ЖЖ " * 40), (6, "x" * 3_000_000), (7, "long text " * 200_000)]
    rows += [(100 + i, f"{many} {i}") for i in range(60)]
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, weight int, place int")
    target = spark.createDataFrame([("word1 thing word2",), (None,)], "text string")
    assert result(resampling.resample(docs, target)) == in_order(plain(rows, ["word1 thing word2"]))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = docs.limit(0)
    assert resampling.resample(none, docs).count() == 0
    assert result(resampling.resample(docs, none)) == in_order(plain([(1, "a b")], []))
