"""Packing: ids against the tokenizer, places against each other, sequences against the bound."""

from __future__ import annotations

import bisect
import random
import zlib
from array import array

import pytest

from dealforge.llm import packing

pytest.importorskip("public_tokenizers")


def ids_of(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    return t.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


TEXTS = [None, "", "Hello, World.", "don't we're  é😀 x_1", "a\tb\x0bc\xa0d e", "<|startoftext|> <|endoftext|>x", "word " * 9000, "ünï Çode."] + [f"text {i} " * (i % 90) for i in range(300)]


def check(rows, texts, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i, text in enumerate(texts):
        ids, parts = ids_of(text), sorted(by[i], key=lambda r: r["piece"])
        want = [ids[k : k + capacity] for k in range(0, len(ids), capacity)]
        assert [(r["piece"], r["start"], r["length"]) for r in parts] == [(k, k * capacity, len(w)) for k, w in enumerate(want)]
        assert [r["ids_crc32"] for r in parts] == [zlib.crc32(array("I", w).tobytes()) for w in want]
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(spark, capacity):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "1 as length", "2 as rank")
    rows = packing.pack(docs, capacity).collect()
    used = check(rows, TEXTS, capacity)
    least = -(-sum(r["length"] for r in rows) // capacity)
    assert used <= 1.1 * least + 2


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    rows = packing.pack(docs).collect()
    assert len(rows) == 4 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 4
    assert packing.pack(docs.limit(0)).count() == 0


def best_fit_decreasing(counts, capacity):
    gaps, used = [], 0
    for x in sorted(counts, reverse=True):
        for _ in range(counts[x]):
            i = bisect.bisect_left(gaps, x)
            used += i == len(gaps)
            gap = capacity if i == len(gaps) else gaps.pop(i)
            bisect.insort(gaps, gap - x)
    return used


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    counts = {x: rng.randrange(1, 30) for x in rng.sample(range(1, 101), 60)}
    plan = packing.Plan(counts, 100)
    fill = {}
    for length, _, n, each, first, offset in plan.runs:
        for k in range(n):
            fill.setdefault(first + k // each, []).append((offset + k % each * length, length))
    assert sum(map(len, fill.values())) == sum(counts.values())
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    assert len(fill) <= 1.06 * best_fit_decreasing(counts, 100)
