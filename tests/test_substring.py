"""Searches by the trigram index against plain filters; what is read; odd texts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from dealforge.functions.text import contains_any
from dealforge.operators import substring

WORDS = ["Steel", "STEEL", "plate", "50% off", "a_b", "x", "", "Straße", "İstanbul", "ΑΣ", "ΑΣΑ", "😀ab", "back\\slash", "  ", "ab", "tin\nfoil"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 4))), rng.choice([None, "CODE7", f"n{i:05d}"]), i, "batch") for i in range(3000)] + [(None, "no key, rare quince", None, 1, "x"), (5001, None, None, 1, "x"), (5002, "q" * 200_000 + " needle", None, 1, "x")]
    df = spark.createDataFrame(rows, "id int, title string, code string, bucket int, gram string").cache()
    path = str(tmp_path_factory.mktemp("grams"))
    substring.write_index(df.filter("id % 2 = 0 or id is null"), "id", ["title", "code"], path, 0, 16, 4)
    for _ in range(2):  # a batch that runs again counts once
        substring.write_index(df.filter("id % 2 = 1"), "id", ["title", "code"], path, 1, 16, 4)
    return df, substring.SubstringIndex(spark, path)


@pytest.mark.parametrize("term", ["steel", "PLATE x", "0% off", "n0012", "n_012", "00%7", "", "x", "ab", "\\%", "50\\%", "a\\_b", "%", "stra", "istanbul", "ας", "ΑΣ", "ΑΣΑ", "😀ab", "😀", "quince", "needle", "no such text", "tin\nfoil", "n01234"])
def test_terms_equal_filters(index, term):
    df, found = index
    key = lambda rows: sorted(map(str, rows.select("id", "title", "code", "bucket", "gram").collect()))
    pattern = f"%{term}%"
    want = df.filter(F.coalesce(F.col("title").ilike(pattern), F.lit(False)) | F.coalesce(F.col("code").ilike(pattern), F.lit(False)))
    assert key(found.ilike_any(pattern)) == key(want)
    assert key(found.contains_any(term, "title")) == key(df.filter(contains_any(term, F.col("title"))))


def test_rare_terms_read_few_buckets(index):
    df, found = index
    code = df.filter("code like 'n%'").agg(F.max("code")).first()[0]
    rows = found.ilike_any(f"%{code}%", "code")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PartitionFilters: [shelf" in plan and "PushedFilters: [In(gram" in plan
    assert rows.count() == 1


def test_an_empty_index(spark, tmp_path):
    df = spark.createDataFrame([], "id long, t string")
    substring.write_index(df, "id", ["t"], str(tmp_path / "e"))
    found = substring.SubstringIndex(spark, str(tmp_path / "e"))
    assert found.ilike_any("%abc%").collect() == found.ilike_any("%a%").collect() == []
