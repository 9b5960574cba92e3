"""Quality rules against a plain version; the pipeline's stages one after the other."""

from __future__ import annotations

import os
import re

import pytest

from dealforge.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


TEXTS = [None, "", " \n\t", "a b c d e f g h i j", "one two three four five " * 3, "x y\nx y\n\nx y \nz", "#*$%&|<> " * 4 + "é😀 \xa0 ok", "w " * 3000, " ".join(f"w{i % 97}" for i in range(500)), " ".join(f"w{i}" for i in range(5000)), "a b c d e f a b c d e f a b c d e g h i j k l m n o p q r s t"]


def test_counts(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string").selectExpr("*", "1 as n_words", "2 as ref_lang")
    got = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain(text), i
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_null_languages_and_repeats(spark):
    docs = spark.createDataFrame([(None, TEXTS[3], None), (None, TEXTS[3], None), (1, None, "de")], "doc_id long, text string, lang string")
    rows = quality.quality_rules(docs).collect()
    assert len(rows) == 3 and len({tuple(r) for r in rows}) == 2
    assert quality.keep_good(docs).columns == docs.columns


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] > 0
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}


def test_keep_good_leaves_the_callers_columns(spark):
    text = " ".join(f"word{i} of a line" for i in range(40))
    docs = spark.createDataFrame([(1, text, "en", "mine", [7], 1.5), (2, "too short", "en", "mine", [7], 1.5)], "doc_id long, text string, lang string, __q_text string, __q_words array<int>, `__q_own.x` double")
    kept = quality.keep_good(docs)
    assert kept.schema == docs.schema
    assert [tuple(r) for r in kept.collect()] == [(1, text, "en", "mine", [7], 1.5)]
