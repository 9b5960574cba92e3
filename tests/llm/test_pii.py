"""Personal data: base spans against regular expressions, added spans on a small corpus."""

from __future__ import annotations

import hashlib
import re

import pytest

from dealforge.llm import pii


def digits(m):
    return re.sub("[^0-9]", "", m)


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def counts(kind, m):
    n = len(digits(m))
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    return luhn(digits(m)) and 12 <= n <= 19 if kind == "card" else 9 <= n <= 15 if kind == "phone" else True


def base_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(pii.PATTERNS.items()):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "") if counts(kind, m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


TEXTS = [
    None, "", "nothing here", "a@b.co, c@d.e.f%x@y.z and x@y no", "é😀 joe.doe+1@mail-2.example.com.", "1.2.3.4.5.6.7.8 300.1.1.1 0255.1.1.001 1.2.3",
    "4111 1111-1111 1111 and 4111111111111112 0000000000000", "+1 (499) 555-6503 +12 3 ++49(0)30.1234567- +1 2", "a@b.c" * 3, "9" * 5000, "1 " * 4000, "a." * 3000 + "@x", "x@" + "a." * 3000 + "a",
]


def test_base_spans(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "'x' as row", "1 as value")
    got = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        want = base_spans(text)
        assert got[i]["spans"] == want and got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.PATTERNS] == [len(re.findall(rf"\b{k}:", want)) for k in pii.PATTERNS]
    assert pii.personal_data(docs.limit(0)).count() == 0


@pytest.fixture
def corpus(spark):
    told = [(i, f"Yesterday Zorbalin wrote from zorb@ex.org, as people often do ({i}).") for i in range(12)]
    plain = [(20 + i, "Yesterday people often wrote from here as they do.") for i in range(160)]
    other = [(200 + i, f"Yesterday wrote Qu{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}x from u{i}@ex.org, as people often do.") for i in range(30)]
    return spark.createDataFrame(told + plain + other, "doc_id long, text string").selectExpr("*", "cast(length(text) as bigint) as n_chars", "1 as row", "'a' as spans", "2 as own")


def test_disclosing_terms(corpus):
    rows = {r["doc_id"]: r["spans"] for r in pii.personal_data(corpus, remove=0.95).collect()}
    assert all(rows[i] == "removed:10:18,email:30:41" for i in range(12))
    assert all(rows[20 + i] == "" for i in range(160))
    assert all(len(rows[200 + i].split(",")) == 1 for i in range(30))  # one document tells too little


def test_masked_texts(corpus):
    masked = pii.mask_personal_data(corpus)
    rows = {r["doc_id"]: r for r in masked.collect()}
    assert masked.columns == corpus.columns and {r["own"] for r in rows.values()} == {2}
    assert "Zorbalin" not in rows[0]["text"] and "[EMAIL]" in rows[0]["text"] and rows[0]["n_chars"] == len(rows[0]["text"])
    assert rows[20]["text"] == "Yesterday people often wrote from here as they do."


def test_generalised_terms(spark):
    """A term gives way to the nearest broader term that tells nothing, else to the class of its form."""
    rows = [(i, "we saw Berlin and Germany with Zorbal and qumbal x@y.org") for i in range(4)] + [(10 + i, "we saw all of europe with them and more") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in pii.mask_personal_data(docs).collect()}
    assert texts[0] == "we saw europe and europe with [NAME] and [TERM] [EMAIL]" and texts[10] == rows[4][1]


def test_real_table_has_added_spans(spark):
    found = pii.op8_pii(spark, "/root/testdata/sf0.01")
    assert found.filter("spans like '%term:%'").count() > 0


def test_many_matches_in_one_text(spark):
    """Places behind thousands of matches, over several chunks."""
    text = " ".join(f"u{i}@ex{i % 7}.org é" for i in range(3000))
    got = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["spans"] == base_spans(text)


def test_repeated_and_null_rows(spark):
    docs = spark.createDataFrame([(None, "x@y.z"), (None, "x@y.z"), (1, None), (1, "x@y.z")], "doc_id long, text string")
    assert sorted(r["spans"] for r in pii.personal_data(docs).collect()) == ["", "email:0:5", "email:0:5", "email:0:5"]
    assert sorted(str(r["text"]) for r in pii.mask_personal_data(docs).collect()) == ["None", "[EMAIL]", "[EMAIL]", "[EMAIL]"]
