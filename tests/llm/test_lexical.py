"""Operator 13 against a plain version that scores every document, and its SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from dealforge.llm import lexical
from dealforge.llm.common import read_table

SMALL = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)))


def plain(docs, items, k=20):
    """docs, items: (id, text). (item_id, rank, doc_id, score), identical rows of items once."""
    own = [(i, plain_terms(t)) for i, t in docs if plain_terms(t)]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    rows = []
    for item_id, text in dict.fromkeys(items):
        scored = []
        for doc_id, counts in own:
            m = 75 + (25 * sum(counts.values()) * n) // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 12 * m)) for t, q in plain_terms(text).items() if counts[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        rows += [(item_id, place + 1, r[3], -r[0]) for place, r in enumerate(sorted(scored)[:k])]
    return sorted(rows, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def tables(spark):
    return [[tuple(r) for r in read_table(spark, SMALL, name).select(key, "text").collect()] for name, key in (("documents", "doc_id"), ("benchmark", "item_id"))]


def test_query_equals_plain_version_and_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from read_parquet('{SMALL}/{name}.parquet')")
    out = result(lexical.op13_ranked_search(spark, SMALL))
    assert out == plain(*tables(spark))
    assert out == sorted(con.sql(f"select item_id, rank, doc_id, score from ({lexical.OP13_SQL})").fetchall(), key=str)


def test_every_level_proves_items(spark):
    docs, items = read_table(spark, SMALL, "documents"), read_table(spark, SMALL, "benchmark")
    out = result(lexical.ranked_search(docs, items, tiers=(4, 100)))
    assert out == plain(*tables(spark))
    levels = set()
    for tiers in ((4, 100), (100, 300)):
        for block in lexical.item_blocks(items, "item_id", "text"):
            levels |= set(lexical.proven_levels(lexical.Index(docs, block, "doc_id", "text", tiers), 20)[0].tolist())
    assert levels == {0, 1, 2}


def test_first_tiers_hold_the_highest_impacts(spark):
    docs, items = read_table(spark, SMALL, "documents"), read_table(spark, SMALL, "benchmark")
    block = next(lexical.item_blocks(items, "item_id", "text"))
    index = lexical.Index(docs, block, "doc_id", "text", (50, 200))
    lists = [{}, {}, {}]
    for row in index.rows.collect():
        for level in range(3):
            for term, impact in zip(row[f"terms_{level}"], row[f"impacts_{level}"]):
                lists[level].setdefault(term, []).append(impact)
    for level in range(2):
        for term in range(len(block.number)):
            below = max((max(lists[k].get(term, [0])) for k in range(level + 1, 3)), default=0)
            assert index.residual[level, term] == below
            assert min(lists[level].get(term, [10**9])) > below
    assert sum(map(len, lists[1].values())) and sum(map(len, lists[2].values()))


def test_odd_rows_and_ties(spark, monkeypatch):
    chance = random.Random(5)
    words = [f"W{i}" for i in range(40)] + ["ünï", "Ж", "a1"]
    text = lambda n: " ".join(chance.choice(words) for _ in range(n))
    docs = [(i, text(chance.randint(1, 30))) for i in range(200)] + [(None, "w1 W2 w3"), (None, None), (901, None), (902, ""), (903, " .!"), (904, "w1, w2; w3."), (904, "w1, w2; w3."), (905, text(400_000))]
    docs += [(1000 + i, "w1 w2 w3") for i in range(30)]
    items = [(1, "w1 w1 w2"), (1, "w1 w1 w2"), (1, "w9"), (2, None), (3, ""), (4, "nowhere"), (None, "Ж ünï A1"), (5, text(60))] + [(10 + i, text(8)) for i in range(12)]
    table = spark.createDataFrame([(a, b, 7, "x") for a, b in docs], "doc_id long, text string, rank int, item_id string")
    asked = spark.createDataFrame([(a, b, 7) for a, b in items], "item_id long, text string, score int")
    want = plain(docs, items)
    assert result(lexical.ranked_search(table, asked, tiers=(3, 20))) == want
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 6)
    assert result(lexical.ranked_search(table, asked)) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked_search(docs, items.limit(0)).count() == 0
    assert lexical.ranked_search(docs.limit(0), items).count() == 0
