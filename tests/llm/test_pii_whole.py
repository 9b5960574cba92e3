"""Disclosing terms over whole documents, against a count in Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from dealforge.llm import pii

FAR = "and so on and on " * 12


def spans(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["spans"] for r in pii.personal_data(docs).collect()}


def want(texts):
    """Spans of e-mail addresses and of the terms that reveal one."""
    email = re.compile(pii.PATTERNS["email"])
    base = [[(m.start(), 0, "email", m.end()) for m in email.finditer(t or "")] for t in texts]
    values = [{m.group().lower() for m in email.finditer(t or "")} for t in texts]
    values = [v | {"email"} if v else v for v in values]
    outside = [email.sub(lambda m: " " * len(m.group()), t or "") for t in texts]
    found = [[(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{4,}", t)] for t in outside]
    terms = [{f[0] for f in fs} for fs in found]
    of_value, of_term = Counter(v for vs in values for v in vs), Counter(t for ts in terms for t in ts)
    both, n, told = Counter((v, t) for vs, ts in zip(values, terms) for v in vs for t in ts), len(texts), {}
    for (v, t), k in both.items():
        if of_value[v] < n:
            ratio = round(math.log(k * n / (of_value[v] * of_term[t])) / math.log(n / of_value[v]) * k / (k + 0.5), 6)
            if ratio >= pii.GENERALISE:
                told[t] = max(ratio, told.get(t, 0))
    added = [[(a, 5, "removed", b) if told[t] >= pii.REMOVE else (a, 4, "term", b) for t, a, b in fs if t in told] for fs in found]
    return {i: ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(x + y)) for i, (x, y) in enumerate(zip(base, added))}


def test_far_terms_and_texts_without_the_entity(spark):
    letters = [f"Zorbalin begins. {FAR} Write to zorb@ex.org ({i})." for i in range(6)]
    texts = letters + ["Zorbalin again; é😀 zorbalin."] + ["and so on Write begins"] * 90
    got = spans(spark, texts)
    assert got[0].startswith("term:0:8,email:") and got[6] == "term:0:8,term:19:27"
    assert got == want(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    masked = {r["doc_id"]: r["text"] for r in pii.mask_personal_data(docs).collect()}
    assert masked[6] == "[NAME] again; é😀 [TERM]." and not any("zorb" in t.lower() for t in masked.values())


def test_whole_documents_against_python(spark):
    rng = random.Random(5)
    common, rare = [f"common{c * 2}" for c in "abcdefgh"], [f"Rare{c * 3}" for c in "abcdefghijkl"]
    common, rare = [re.sub(r"\d", "", w) for w in common], [re.sub(r"\d", "", w) for w in rare]
    texts = [None, ""]
    for i in range(150):
        who = rng.randrange(12)
        parts = [*rng.choices(common, k=20), *([rare[who]] * rng.randrange(3)), *([f"user{who}@ex.org"] if rng.random() < 0.6 else []), *([f"new{i}@ex.org"] if rng.random() < 0.3 else [])]
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    expected = want(texts)
    assert any("term:" in x for x in expected.values()) or any("removed:" in x for x in expected.values())
    assert spans(spark, texts) == expected
