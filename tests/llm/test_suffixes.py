"""Operator 12 against a plain version over every window of 50 bytes."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealforge.llm import suffixes
from dealforge.llm.common import read_table

SMALL = "/root/testdata/sf0.01"


def plain(rows):
    """rows: (doc_id, text). (doc_id, n_bytes, n_removed, n_spans, sha256 of what is left)"""
    texts = [((float("inf") if i is None else i), i, (t or "").encode()) for i, t in rows]
    least: dict[bytes, float] = {}
    for i, _, t in texts:
        for a in range(len(t) - 49):
            w = t[a : a + 50]
            if least.get(w, i) >= i:
                least[w] = i
    out = []
    for i, doc_id, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for a in range(len(t) - 49):
            if least[t[a : a + 50]] < i:
                gone[a : a + 50] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = np.frombuffer(t, np.uint8)[~gone[:-1]].tobytes()
        out.append((doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digests(df):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256)).collect()), key=str)


def test_query_equals_plain_version(spark):
    rows = [tuple(r) for r in read_table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    out = suffixes.op12_suffix_array_dedup(spark, SMALL).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, out), key=str) == plain(rows)
    assert sum(r[3] > 0 for r in out) > 20


@pytest.mark.parametrize("batches", [1, 3, 8])
def test_repeats_of_all_kinds(spark, batches, monkeypatch):
    chance = random.Random(batches)
    text = lambda n: "".join(chance.choice("abcdefghij ") for _ in range(n))
    passages = [text(n) for n in (49, 50, 51, 75, 120, 400)]
    rows = []
    for i in range(120):
        parts = [text(chance.randint(0, 90))]
        for _ in range(chance.randint(0, 3)):
            p = chance.choice(passages)
            cut = chance.randint(0, len(p) - 1) if chance.random() < 0.4 else 0
            parts += [p[cut:], text(chance.randint(0, 60))]
        rows.append((i, "".join(parts)))
    whole = text(500)
    rows += [(200 + i, whole) for i in range(5)] + [(300 + i, whole[:i] + "#" + whole[i:]) for i in (0, 24, 25, 26, 49, 50, 51, 250)]
    rows += [(400, "z" * 300), (401, "z" * 60), (402, "z" * 49), (403, "ab" * 100), (404, "ba" * 100), (405, None), (406, ""), (None, whole), (None, whole), (None, passages[4]), (400, whole), (7, rows[7][1]), (7, rows[8][1])]
    rows += [(500, "é" * 100), (501, "xé" + "é" * 99), (502, text(30_000)), (503, "ü" + whole * 2)]
    docs = spark.createDataFrame([(a, b, 1, "e", b"") for a, b in rows], "doc_id long, text string, key int, edges string, core binary")
    assert digests(suffixes.remove_repeats(docs, batches)) == plain(rows)


def test_a_passage_in_very_many_documents(spark):
    """Its ends stand in more contexts than a task hands on; some documents hold parts of it and of one another."""
    chance = random.Random(9)
    text = lambda n: "".join(chance.choice("abcdefghij ") for _ in range(n))
    passage, rows = text(90), []
    for i in range(400):
        cut = chance.choice([0, 0, 5, 20, 45])
        rows.append((i, text(chance.randint(20, 60)) + passage[cut : 90 - chance.choice([0, 0, 7, 30])] + chance.choice(["one", "two", ""]) + text(chance.randint(0, 60))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    local = next(iter(suffixes.text_groups([t.encode() for _, t in rows])))
    e = suffixes.anchors(local)
    e = suffixes.suffix_array(e | {"id": e["row"], "key": e.pop("row"), "told": np.zeros(len(e["core"]), np.uint8)})
    assert suffixes.frequent(e)[0].sum() > 200
    assert digests(suffixes.remove_repeats(docs, 2)) == plain(rows)


def test_long_texts_in_pieces(monkeypatch):
    """What a text cut into pieces gives is what it gives in one."""
    chance = random.Random(3)
    data = "".join(chance.choice("ab cd") for _ in range(20_000)).encode()
    whole = [suffixes.anchors(g) for g in suffixes.text_groups([data, b"short", data[:70]])]
    monkeypatch.setattr(suffixes, "PIECE", 777)
    cut = suffixes.joined([suffixes.anchors(g) for g in suffixes.text_groups([data, b"short", data[:70]])])
    one = suffixes.joined(whole)
    key = lambda e: sorted(zip(*(e[n].tolist() for n in ("row", "pos", "core", "ctx"))))
    assert key(one) == key(cut)
    at = np.sort(one["pos"][one["row"] == 0].astype(int))
    assert at[0] <= 26 and len(data) - at[-1] <= 50 and np.diff(at).max() <= 27  # no window without an anchor


def test_levels_merge_geometrically(spark):
    chance = random.Random(1)
    shared = "".join(chance.choice("abcdefg ") for _ in range(200))
    docs = spark.createDataFrame([(i, "".join(chance.choice("abcdefg ") for _ in range(300)) + shared) for i in range(70)], "doc_id long, text string")
    own = suffixes.identified(docs, "doc_id", "text")
    index, seen = suffixes.SuffixIndex(spark, 3), []
    marks = None
    for n in range(7):
        found = index.add(own.filter(F.col("id").between(10 * n, 10 * n + 9)))
        marks = found if marks is None else marks.unionByName(found)
        seen.append(sorted(index.levels))
    assert seen == [[0], [1], [0, 1], [2], [0, 2], [1, 2], [0, 1, 2]]
    assert digests(suffixes.removed_by_marks(own, marks, 3)) == plain([tuple(r) for r in docs.collect()])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove_repeats(docs).count() == 0


def test_rows_do_not_grow_with_documents_and_shards(spark):
    """Marks leave a task or shard as one block each, and an array is cut into shards in its own order."""
    chance = random.Random(5)
    text = lambda n: "".join(chance.choice("abcdefgh ") for _ in range(n))
    shared = text(400)
    docs = spark.createDataFrame([(i, text(60) + shared + text(60)) for i in range(600)], "doc_id long, text string").repartition(2)
    own, shards = suffixes.identified(docs, "doc_id", "text"), 16
    marks = suffixes.SuffixIndex(spark, shards).add(own, keep=False)
    assert 0 < marks.count() <= 2 * shards + 4
    assert digests(suffixes.removed_by_marks(own, marks, shards)) == plain([tuple(r) for r in docs.collect()])
    core = np.random.default_rng(5).integers(0, 1 << 63, 10_000).astype(np.uint64) << np.uint64(1) & suffixes.SHORT
    e = {"core": core, "ctx": core + np.uint64(1), "id": np.arange(10_000), "key": np.arange(10_000, dtype=np.int32), "pos": np.arange(10_000, dtype=np.uint32), "told": np.zeros(10_000, np.uint8)}
    (rows,) = suffixes.task_rows([(e, 1)], shards, suffixes.COVERED)
    parts = [suffixes.entries_of(data) for _, _, data in rows]
    assert [shard for shard, _, _ in rows] == list(range(shards)) and np.array_equal(np.sort(core), np.concatenate([p["core"] for p in parts]))


def test_windows_are_looked_at_by_their_lowest_core(spark):
    """Of the windows around an edge those go on whose lowest core it is, unless a covered suffix tells of them."""
    import pyarrow as pa

    chance = random.Random(8)
    texts = ["".join(chance.choice("abcdefgh ") for _ in range(n)).encode() for n in (900, 40, 1200, 50)]
    found = suffixes.joined([suffixes.anchors(g) for g in suffixes.text_groups(texts)])
    at = [found["pos"][found["row"] == row].astype(np.int64) for row in range(4)]
    edges, covered = [a[::3] for a in at], [a[1::9] for a in at]
    marks = [(row, int(p), kind) for kind, places in ((suffixes.EDGE, edges), (suffixes.COVERED, covered)) for row in range(4) for p in places[row]]
    row, pos, kind = (np.array(x) for x in zip(*marks))
    block = suffixes.packed({"id": row, "key": row, "pos": pos, "kind": kind}, suffixes.MARKS)
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(4), pa.int64()), "key": pa.array(range(4), pa.int32()), "text": pa.array(texts, pa.binary())})
    out = suffixes.joined([e for e, _ in suffixes.window_entries(batch, suffixes.Places(pa.table({"data": [block]})))])
    want = []
    for i, text in enumerate(texts):
        cores = suffixes.Hashes(np.frombuffer(text, np.uint8)).runs(suffixes.CORE) if len(text) >= 50 else []
        for s in range(len(text) - 49):
            lowest = s + int(np.argmin(cores[s : s + 27]))
            if lowest in edges[i] and not ((covered[i] >= s) & (covered[i] <= s + 26)).any():
                want.append((i, s))
    assert sorted(zip(out["id"].tolist(), out["pos"].tolist())) == want and 0 < len(want) < 27 * sum(map(len, edges)) / 2
