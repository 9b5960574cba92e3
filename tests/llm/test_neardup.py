"""Near duplicates against a brute-force version."""

from __future__ import annotations

import os
import random
from itertools import combinations

import pytest

from dealforge.llm import neardup

SCHEMA = "doc_id long, text string"


def brute(rows, width, percent=80):
    """doc_id -> (size, least id reachable), by comparing all pairs."""

    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])

    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def copies(seed, n, words, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randrange(edits + 1)):
            text[rng.randrange(words)] = f"x{rng.randrange(10_000)}"
        yield " ".join(text)


@pytest.fixture(scope="module")
def rows():
    texts = [*copies(1, 60, 120, 8), *copies(2, 12, 300, 15), *copies(3, 9, 20, 2)]
    texts += ["", None, " \t\n", "one two", "One  TWO", "a b c d e f", "A B c d e f"]
    shared = " ".join(f"s{i}" for i in range(60))
    texts += [f"{shared} {' '.join(f'o{k}_{i}' for i in range(40))}" for k in range(50)]  # one passage in many
    return list(enumerate(texts))


@pytest.mark.parametrize("width", [4, 5])
def test_equals_brute_force(spark, monkeypatch, rows, width):
    monkeypatch.setattr(neardup, "LONG", 8)
    monkeypatch.setattr(neardup, "BLOCK", 16)  # families of several blocks
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.classes(spark.createDataFrame(rows, SCHEMA), width=width).collect()}
    assert got == brute(rows, width)


@pytest.mark.parametrize("percent", [50, 65, 90, 100])
def test_other_similarities(spark, monkeypatch, rows, percent):
    """What is asked of sketches follows from the similarity: no link is lost at others than 80 %."""
    monkeypatch.setattr(neardup, "HOT", 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.classes(spark.createDataFrame(rows, SCHEMA), width=4, percent=percent).collect()}
    assert got == brute(rows, 4, percent)


def test_sizes_around_the_sketch(spark):
    """Sets a little below and above what a sketch keeps, at the edge of the similarity."""
    rng = random.Random(9)
    texts = []
    for n in range(34, 62):
        base = [f"t{n}_{rng.randrange(10**6)}" for _ in range(int(n / 0.8))]
        texts += [" ".join(base), " ".join(base[: n + 1]), " ".join(base[-n:])]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.classes(spark.createDataFrame(rows, SCHEMA), width=1).collect()}
    assert got == brute(rows, 1)


def test_too_low_a_similarity():
    assert neardup.least_shared(80, 48) == 21 and neardup.least_shared(100, 48) == 48
    with pytest.raises(ValueError):
        neardup.least_shared(20, 48)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_real_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) < 60000")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.classes(docs, width=4).collect()}
    assert got == brute(rows, 4)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, "q r s t u v"), (3, None), (2, "")], SCHEMA).selectExpr("*", "1 as n", "'x' as node")
    got = sorted(neardup.classes(docs).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["kept"]))
    assert [(r["doc_id"], r["component_id"], r["kept"]) for r in got] == [(1, 1, True), (1, 1, True), (2, 2, True), (3, 3, True), (None, 1, False), (None, None, True)]
    assert neardup.classes(docs.limit(0)).count() == 0
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 4  # one of two equal rows


def test_shingles_use_ascii_blanks_and_case():
    a, b = (neardup.shingle_set(t, 2).tolist() for t in ("A\u00a0b C", "a B\u00a0c"))
    assert len(a) == 1 and a != b  # only A-Z fold, and a wide blank divides nothing
    assert len(neardup.shingle_set("x y x y x", 2)) == 2 and len(neardup.shingle_set("Ä b", 5)) == 1


def test_connects_stars_and_chains(spark, monkeypatch):
    """Hubs above HOT, as least and as greatest node, chains, and loops."""
    monkeypatch.setattr(neardup, "HOT", 4)
    rng = random.Random(5)
    edges = [(0, k) for k in range(1, 30)] + [(k, 99) for k in range(60, 90)] + [(k, k + 1) for k in range(100, 120)] + [(200, 200)]
    edges += [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(25)]
    links = spark.createDataFrame(edges, "a long, b long").selectExpr("to_binary(lpad(hex(a), 4, '0'), 'hex') as a", "to_binary(lpad(hex(b), 4, '0'), 'hex') as b")
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    loops = {a for a, b in edges if a == b}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    want = {x: y for x, y in label.items() if x != y}
    number = lambda b: int.from_bytes(b, "big")
    got = {number(r["node"]): number(r["label"]) for r in neardup.connect(links).collect()}
    assert got == want
    with_loops = {number(r["node"]): number(r["label"]) for r in neardup.connect(links, loops=True).collect()}
    assert with_loops == want | {x: label[x] for x in loops if x not in want} and loops - linked
