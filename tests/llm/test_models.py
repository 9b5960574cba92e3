"""Language identification and toxicity: held-out accuracy and odd rows."""

from __future__ import annotations

import math
import os
import random
import zlib
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from dealforge.llm import language, toxicity

FOLDER = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


@needs_data
def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = language.op5_language_id(spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == out(r["doc_id"]) for r in got) and held
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


@pytest.mark.parametrize("block", [2, 256])
def test_scores_equal_plain_naive_bayes(spark, block):
    """Every prediction against counts and sums in plain Python, over one and over several blocks of languages."""
    rng = random.Random(1)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(40)] for lang, letters in {"a": "abcde", "b": "cdefg", "c": "fghij", "d": "aeiou", "e": "xyz ab"}.items()}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randrange(1, 30))), lang) for i, lang in enumerate(rng.choices(list(words), k=120))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = [r for r in rows if not out(r[0])]
    counts = {lang: Counter(b for _, text, x in learned if x == lang for b in language.ngram_buckets(text).tolist()) for lang in words}
    size = 1 << language.BUCKET_BITS
    got = {r["doc_id"]: r for r in language.predict_language(docs, language.train(docs.filter(~language.held_out(F.col("doc_id"))), block=block)).collect()}
    for i, text, _ in rows:
        log = {lang: sum(math.log((c[b] + 0.5) / (c.total() + 0.5 * size)) for b in language.ngram_buckets(text).tolist()) for lang, c in counts.items()}
        best = max(log, key=lambda lang: log[lang])
        assert got[i]["lang_pred"] == best
        assert got[i]["score"] == pytest.approx(1 / sum(math.exp(max(-700, x - log[best])) for x in log.values()), abs=1e-3)


def test_long_and_empty(spark):
    docs = spark.createDataFrame([(0, "aaa " * 50_000, "x"), (2, "ccc", "y")], "doc_id long, text string, lang string")
    model = language.train(docs)
    assert {r["lang_pred"] for r in language.predict_language(docs, model).collect()} == {"x", "y"}
    assert language.predict_language(docs.limit(0), model).count() == 0 and toxicity.score_toxicity(docs.limit(0), ({}, 1.0, -1.0)).count() == 0
    assert toxicity.score_toxicity(docs, ({"aaa": 4.0}, 1.0, -1.0)).count() == 2


def test_language_odd_rows(spark):
    docs = spark.createDataFrame([(0, "aaa bbb", "x"), (2, "ccc ddd", "y"), (3, None, "x"), (4, "12 3", "y"), (5, "aab", None), (None, "ccd", "y")], "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'q' as bucket")
    got = {r["doc_id"]: r for r in language.predict_language(docs, language.train(docs.filter("doc_id in (0, 2)"))).collect()}
    assert [got[i]["lang_pred"] for i in (0, 2, 3, 4, 5, None)] == ["x", "y", "und", "und", "x", "y"]
    assert got[None]["held_out"] is False
    assert [r["lang_pred"] for r in language.predict_language(docs, language.train(docs.limit(0))).collect()] == ["und"] * 6


@needs_data
def test_toxicity_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    got = toxicity.op7_toxicity(spark, FOLDER).join(labels, "doc_id").filter("held_out and toxic is not null").collect()
    toxic, clean = [r for r in got if r["toxic"] == 1], [r for r in got if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) >= 0.7 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.05 * len(clean)
    assert all((r["score"] >= 0.7) == bool(r["predicted"]) for r in got)


def test_grammar_factors():
    grammar = toxicity.Grammar({"fool": 4.0})
    plain, near, negated, told = (grammar.text(t) for t in ("some fool", "you fool", "never a fool", "they all said what a fool"))
    assert negated < plain < near and told < plain
    assert grammar.text("kill the process") == 0 < grammar.text("I will kill you, you fool")
    assert grammar.text("you. fool") == plain  # clauses stand alone


def step(machine, state, symbol):
    return machine.arcs[state][symbol]


def test_composition_equals_machines_in_turn():
    """Every clause of up to four symbols: the composed machine's marks and weights are those of its parts."""
    parts = (toxicity.INSULTS, toxicity.THREATENING, toxicity.NEGATING, toxicity.REPORTING, toxicity.TARGETING)
    kinds = (0, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.INSULT, toxicity.THREAT, toxicity.INSULT | toxicity.TARGET)
    for n in range(1, 5):
        for symbols in product(kinds, repeat=n):
            states, whole = [0] * len(parts), 0
            for symbol in symbols:
                marks, weight = 0, 1.0
                for i, machine in enumerate(parts):
                    states[i], m, w = step(machine, states[i], symbol)
                    marks, weight = marks | m, weight * w
                whole, m, w = step(toxicity.FORWARD, whole, symbol)
                assert (m, w) == (marks, pytest.approx(weight))


def plain_score(words, weights):
    """The clause's score by the rules, over all pairs of words."""
    total = 0.0
    for i, word in enumerate(words):
        learned = max(weights.get(form, 0.0) for form in toxicity.forms(word))
        if not learned and word not in toxicity.THREATS:
            continue
        reach = range(1, toxicity.REACH + 1)
        back = [words[i - k] for k in reach if i - k >= 0]
        ahead = [words[i + k] for k in reach if i + k < len(words)]
        weight = learned or toxicity.THREAT_WEIGHT
        weight *= toxicity.NEGATION_FACTOR if any(w in toxicity.NEGATIONS for w in back) else 1
        weight *= toxicity.REPORT_FACTOR if any(w in toxicity.REPORTS for w in words[:i]) else 1
        near = any(w in toxicity.TARGETS for w in back + ahead)
        total += weight * toxicity.TARGET_FACTOR if near else weight * (learned > 0)
    return total


def test_clauses_equal_the_rules():
    rng = random.Random(3)
    weights = {"fool": 4.0, "idiot*": 2.0}
    grammar = toxicity.Grammar(weights)
    for _ in range(3000):
        words = rng.choices(["you", "not", "said", "fool", "kill", "idiotic", "one", "two", "them"], k=rng.randrange(1, 12))
        assert grammar.clause(words) == pytest.approx(plain_score(words, weights))


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "fool")], "doc_id long, text string").selectExpr("*", "1 as toxic")
    got = toxicity.score_toxicity(docs, ({"fool": 4.0}, 1.0, -1.0)).collect()
    assert len(got) == 4 and len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    nothing = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(docs, nothing).count() == 4
