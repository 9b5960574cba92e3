"""Operator 7: toxicity by a weighted finite-state pattern grammar.

The grammar is five transducers, each a table of arcs (state, class of word) ->
(state, mark, weight): insults and threats mark the words that match, a target before
and a target behind complete them, negation and reported speech lower their weight.
compose() makes one machine of them, whose states are tuples of theirs and whose
weights are products; the target behind reads a clause from its end, as a machine
with two directions does. A clause's score is the sum over its marked words; words
by themselves, without a clause around them, score nothing. Insult terms and their
weights are learned from labelled rows: words, and beginnings of words, which stand
for all their forms. A logistic curve maps a document's sum to 0..1.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealforge.llm.common import held_out, map_columns, read_table, scratch

#: Labelled rows to learn from: all up to this many, else those of least hash.
SAMPLE = 20_000
#: A term needs this share of the toxic texts (and MIN_TEXTS), and this log ratio (few clean texts bound it lower).
MIN_SHARE = 0.01
MIN_TEXTS = 4
MIN_LOG_RATIO = 4.0
PREDICT = 0.7

# Words of the grammar's closed classes in English, German, French and Spanish.
THREATS = {"kill", "die", "hurt", "destroy", "murder", "attack", "beat", "töten", "sterben", "umbringen", "tuer", "mourir", "crever", "matar", "morir"}
TARGETS = {"you", "your", "yours", "yourself", "u", "ur", "they", "them", "he", "she", "du", "dich", "dir", "dein", "ihr", "euch", "tu", "toi", "te", "vous", "ton", "votre", "usted", "ustedes", "ti", "vosotros"}
NEGATIONS = {"not", "never", "no", "isn't", "aren't", "don't", "nicht", "nie", "kein", "keine", "pas", "jamais", "nunca", "jamás"}
REPORTS = {"said", "says", "wrote", "quoted", "called", "claimed", "reported", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió"}
#: Lengths of the beginnings of words that can be terms; such a term ends in a star.
STEMS = (5, 6, 7)
CACHE_WORDS = 500_000
#: How a match's weight changes near a target, under negation, and in reported speech; what a threat without a learned weight weighs.
TARGET_FACTOR, NEGATION_FACTOR, REPORT_FACTOR = 1.25, 0.7, 0.8
THREAT_WEIGHT = 0.5
#: Words over which a negation reaches, and a target on either side.
REACH = 3

CLAUSE = re.compile(r"[^.!?;:\n]+")
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


def clauses(text: str):
    """The clauses of a text, each as its lower-cased words."""
    for m in CLAUSE.finditer(text.lower()):
        found = TOKEN.findall(m.group())
        if found:
            yield found


#: Classes of words as bits of a symbol; a word may be of several.
TARGET, NEGATION, REPORT, INSULT, THREAT = 1, 2, 4, 8, 16
SYMBOLS = range(32)


@dataclass(frozen=True)
class Transducer:
    """arcs[state][symbol] = (next state, marks, weight); state 0 is the first.

    Marks are bits that the symbol gains for later machines; a weight other than 1
    is what the word's match is multiplied by.
    """

    name: str
    arcs: tuple[tuple[tuple[int, int, float], ...], ...]


#: Marks of the machines: the word matches as an insult or a threat; a target is near.
HIT, NEAR = 1, 2


def within(name: str, cause: int, mark: int, weight: float) -> Transducer:
    """Marks and weighs the words up to REACH after one of a class; state k > 0: k - 1 words since it."""

    def arc(state: int, symbol: int):
        following = 1 if symbol & cause else 0 if state == 0 or state > REACH - 1 else state + 1
        return (following, mark, weight) if state else (following, 0, 1.0)

    return Transducer(name, tuple(tuple(arc(state, symbol) for symbol in SYMBOLS) for state in range(REACH + 1)))


def marking(name: str, cause: int) -> Transducer:
    """Marks the words of a class."""
    return Transducer(name, (tuple((0, HIT if symbol & cause else 0, 1.0) for symbol in SYMBOLS),))


def since(name: str, cause: int, weight: float) -> Transducer:
    """Weighs all words after the first one of a class."""
    arc = lambda state, symbol: (1 if state or symbol & cause else 0, 0, weight if state else 1.0)
    return Transducer(name, tuple(tuple(arc(state, symbol) for symbol in SYMBOLS) for state in range(2)))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both machines on one reading: states are pairs, marks unite, weights multiply."""
    width = len(b.arcs)
    pair = lambda x, y: (x[0] * width + y[0], x[1] | y[1], x[2] * y[2])
    return Transducer(f"{a.name}+{b.name}", tuple(tuple(pair(p[s], q[s]) for s in SYMBOLS) for p in a.arcs for q in b.arcs))


INSULTS, THREATENING = marking("insult", INSULT), marking("threat", THREAT)
TARGETING = within("target", TARGET, NEAR, 1.0)  # read forwards and backwards
NEGATING = within("negation", NEGATION, 0, NEGATION_FACTOR)
REPORTING = since("report", REPORT, REPORT_FACTOR)
FORWARD = reduce(compose, (INSULTS, THREATENING, NEGATING, REPORTING, TARGETING))


def forms(word: str) -> list[str]:
    """The terms that a word can match: itself and its beginnings."""
    return [word, *[word[:k] + "*" for k in STEMS if len(word) > k]]


class Learned(dict):
    """The learned weight of each word seen, 0 for most; emptied when full."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        w = self[word] = max(self.weights.get(form, 0.0) for form in forms(word))
        return w


def symbol_of(word: str, learned: float) -> int:
    return TARGET * (word in TARGETS) | NEGATION * (word in NEGATIONS) | REPORT * (word in REPORTS) | INSULT * (learned > 0) | THREAT * (word in THREATS)


class Symbols(dict):
    """The (symbol, learned weight) of each word seen; emptied when full."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.learned = Learned(weights)

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) > CACHE_WORDS:
            self.clear()
        w = self.learned[word]
        out = self[word] = (symbol_of(word, w), w)
        return out


class Grammar:
    """The composed machine over clauses, with learned weights."""

    def __init__(self, weights: dict[str, float]):
        self.symbols = Symbols(weights)

    def clause(self, found: list[str]) -> float:
        """The sum of a clause's matches.

        An insult weighs what was learned, and more with a target on either side; a
        threat counts with a target only, and weighs what was learned or THREAT_WEIGHT.
        """
        read = [self.symbols[word] for word in found]
        if not any(s & (INSULT | THREAT) for s, _ in read):
            return 0.0
        state, hits = 0, []
        for i, (symbol, learned) in enumerate(read):
            state, marks, weight = FORWARD.arcs[state][symbol]
            if marks & HIT:
                hits.append((i, marks, weight * (learned or THREAT_WEIGHT), learned > 0))
        state, behind, total = 0, {}, 0.0
        for i in range(len(read) - 1, hits[0][0] - 1, -1):
            state, marks, _ = TARGETING.arcs[state][read[i][0]]
            behind[i] = marks
        for i, marks, weight, insult in hits:
            near = (marks | behind[i]) & NEAR
            total += weight * TARGET_FACTOR if near else weight * insult
        return total

    def text(self, text: str) -> float:
        return sum(map(self.clause, clauses(text)))


def learning_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic of labelled rows that are not held out, one row a text.

    The ids of the sample (bounded by the parameter) are joined with the documents.
    """
    usable = labels.filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("l_id"), "toxic")
    ids = usable.groupBy("l_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("l_id"), "l_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("l_id")).filter("text is not null")
    return rows.groupBy(F.sha2("text", 256).alias("key")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def learn_terms(rows: DataFrame) -> dict[str, float]:
    """Weights of the terms that mark toxic texts: log ratios of the shares of texts that hold them.

    All terms held by MIN_SHARE of the sample's toxic texts can be one: their number
    follows the length of the sample's texts, not the size of the corpus.
    """

    def work(cols):
        counts: tuple[Counter, Counter] = (Counter(), Counter())  # of clean and of toxic texts
        for text, toxic in zip(cols["text"], cols["toxic"]):
            counts[toxic > 0].update({form for word in set(TOKEN.findall(text.lower())) for form in forms(word)})
        terms = list(counts[0] | counts[1])
        return {"term": terms, "t": [counts[1][x] for x in terms], "c": [counts[0][x] for x in terms]}

    totals = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.count("*").alias("all")).first()
    toxic, clean = totals["toxic"], totals["all"] - totals["toxic"]
    if not toxic or not clean:
        return {}
    counts = map_columns(rows, work, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    ratio = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    terms = counts.withColumn("ratio", ratio).filter((F.col("t") >= max(MIN_TEXTS, MIN_SHARE * toxic)) & (F.col("ratio") >= min(MIN_LOG_RATIO, math.log(clean + 1))) & (F.col("t") > F.col("c")))
    return {r["term"]: r["ratio"] for r in terms.select("term", "ratio").collect()}


def signal(total: float) -> float:
    return math.log1p(total)


def fit_curve(signals: list[float], labels: list[int], decay: float = 1.0) -> tuple[float, float]:
    """(slope, offset) of a logistic curve, both classes of equal weight, with a small decay."""
    a, b = 1.0, -1.0
    n1 = sum(labels)
    n0 = len(labels) - n1
    if not n0 or not n1:
        return a, b
    for _ in range(50):
        ga = gb = haa = hab = hbb = 0.0
        for x, y in zip(signals, labels):
            w = 100.0 / n1 if y else 100.0 / n0
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b))))
            ga, gb, v = ga + w * (p - y) * x, gb + w * (p - y), w * max(p * (1 - p), 1e-6)
            haa, hab, hbb = haa + v * x * x, hab + v * x, hbb + v
        ga, haa, gb, hbb = ga + 0.01 * decay * a, haa + 0.01 * decay, gb + 0.01 * decay * b, hbb + 0.01 * decay
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        da, db = max(-2.0, min(2.0, da)), max(-2.0, min(2.0, db))
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-6:
            break
    return a, b


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], float, float]:
    """(weights, slope, offset). At most `sample` numbers and the sample's terms come to the driver."""
    rows = scratch(learning_rows(docs, labels, sample))
    weights = learn_terms(rows)

    def work(cols):
        grammar = Grammar(weights)
        return {"x": [signal(grammar.text(t)) for t in cols["text"]], "toxic": cols["toxic"]}

    scored = map_columns(rows, work, "x double, toxic int").toPandas()
    return weights, *fit_curve(scored["x"].tolist(), scored["toxic"].tolist())


def score_toxicity(docs: DataFrame, model) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs.

    Null and empty texts get the curve's value without a match. Repeated rows get
    equal scores, an empty table none, null ids stay null; a very long text is read
    whole, one clause at a time; columns other than doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(cols):
        weights, slope, offset = shared.value
        grammar = Grammar(weights)
        scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, slope * signal(grammar.text(t or "")) + offset)))) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "score": scores, "predicted": [int(s >= PREDICT) for s in scores]}

    return map_columns(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), work, "doc_id long, held_out boolean, score double, predicted int")


def op7_toxicity(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return score_toxicity(docs, train(docs, labels))
