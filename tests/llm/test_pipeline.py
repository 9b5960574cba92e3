"""The pipeline: each stage against a plain version of it, and odd tables through the whole."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_neardup import brute  # noqa: E402
from tests.llm.test_pii import base_spans  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, own string, spans int"


def table(rows):
    return [(i, t, lang, s, len(t or ""), f"o{i}", 7) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(12, 80))), "en", rng.choice(["a", "a", "b", None])) for i in range(80)]
    rows += [(100 + i, rows[i][1], "en", "b") for i in range(10)] + [(7, rows[7][1], "en", "a")]  # exact copies, one row twice
    rows += [(200 + i, rows[20 + i][1] + " tail", "en", "c") for i in range(5)]  # near copies
    rows += [(300, "write to joe.doe@mail.example or +1 (499) 555-6503 " + " ".join(words[:30]), None, "c"), (301, None, "en", "a"), (302, "", None, None), (None, " ".join(words[40:90]), "en", "b"), (303, "one two", "en", "a"), (304, "again and again " * 30, "en", "a")]
    rows += [(400, " ".join(rng.choices(words, k=9000)), "en", "long")]
    path = str(tmp_path_factory.mktemp("pipe"))
    spark.createDataFrame(table(rows), SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


def plain_keep(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)} if len(w) < 2000 else set()
    return len(w) >= 10 and 100 * len(twice) <= 20 * len(w)


def test_stages_against_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, d: spark.createDataFrame(stages[name](spark, d, folder).collect(), SCHEMA)
    good = step("quality rules", docs)
    assert {(r["doc_id"], r["text"]) for r in good.collect()} == {(r["doc_id"], r["text"]) for r in docs.collect() if plain_keep(r["text"])}
    kept = step("MinHash near-dedup", good)
    known = {r["doc_id"]: r["text"] for r in good.collect()}
    classes = brute([(10**9 if i is None else i, t) for i, t in known.items()], 5)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted((i == 10**9, 0 if i == 10**9 else i) for i, (_, least) in classes.items() if i == least)
    clean = step("PII", kept)
    before = {r["doc_id"]: r["text"] for r in kept.collect()}
    for r in clean.collect():
        assert r["own"] == f"o{r['doc_id']}" or r["doc_id"] is None
        assert not base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not base_spans(before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]
    mixed = step("mixing sources to target weights", clean)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert mixed.select(*docs.columns).exceptAll(clean.union(clean).union(clean).select(*docs.columns)).count() == 0
    packed = stages["best-fit packing"](spark, mixed, folder)
    sums = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert sums.agg(F.max("n")).first()[0] <= 4096 and packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()


def test_whole_run_and_empty_table(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
