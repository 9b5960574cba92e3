"""Operator 10: quality rules and distribution divergence.

Two sets of rules reject a document. The counting rules look for too few words and
for repeated five-word windows. The divergence rules compare two histograms of the
document, its character classes and its common words, with the reference of its
language by Jensen-Shannon distance; they speak only above a least length, as short
texts have ragged histograms. References are counted over the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from dealforge.llm.common import read_table, scratch, words

WINDOW = 5
MIN_WORDS = 10
#: A document fails if more than this percentage of its words repeat.
MAX_REPEAT_PERCENT = 20
#: Common words: the most frequent ones of at most SHORT characters in a language.
COMMON = 16
SHORT = 4
LETTERS = "abcdefghijklmnop"
#: Guards: fewer characters or words than these leave the divergence rules silent.
GUARD_CHARS = 120
GUARD_WORDS = 40
MAX_JS_CHARS = 0.25
MAX_JS_WORDS = 0.45
CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": r"\p{N}", "blank": r"\x20\x09-\x0D", "stop": ".,;:?'\"()-", "sign": r"!#*$%&|<>=+_@~^\\/{}\[\]"}


def only(text: Column, members: str) -> Column:
    """How many characters of text are among the members of a regex class."""
    return F.length(F.regexp_replace(text, f"[^{members}]+", "")).cast("long")


def with_class_counts(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with an array of the counts by character class; the last one is of all others.

    <out>_signs holds what only the last class is still to be removed from.

    The classes share no character. Each is removed from what the ones before it
    left, and what that shortens is its count: the first takes most of a text away,
    so that the others read little.
    """
    rest = [text]
    for i, members in enumerate(CLASSES.values()):
        rest.append(f"{out}_rest{i}")
        df = df.withColumn(rest[-1], F.regexp_replace(rest[-2], f"[{members}]+", ""))
    length = [F.length(c) for c in rest]
    counts = [(a - b).cast("long") for a, b in zip(length, length[1:])]
    return df.withColumn(out, F.array(*counts, length[-1].cast("long"))).withColumn(f"{out}_signs", F.col(rest[-2])).drop(*rest[1:])


def repeated_words(grams: str, ordered: str) -> Column:
    """Words inside windows that occur twice or more.

    ordered: (window hash, position), sorted; null where no window repeats. A window
    repeats if a neighbour in this order has its hash. Of the repeated positions,
    each adds WINDOW words, or fewer where the next one begins earlier.
    """
    item = lambda i: F.get(F.col(ordered), i)
    same = lambda i, j: F.coalesce(item(i)["g"] == item(j)["g"], F.lit(False))
    return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: same(i, i - 1) | same(i, i + 1)), lambda i: item(i)["i"]))


def shares(counts: Column, total: Column) -> Column:
    """A histogram of counts as shares of their sum, which the caller knows; all 0 if that is 0."""
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (root of the divergence in bits) of two histograms of shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    bits = lambda x, y: F.lit(0.5) * part(x, (x + y) / 2) + F.lit(0.5) * part(y, (x + y) / 2)
    return F.round(F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, bits), F.lit(0.0), lambda s, x: s + x))), 6)


def language_references(docs: DataFrame) -> DataFrame:
    """ref_lang, ref_chars, ref_words, ref_counts: one row per language of docs.

    docs: text, lang (null counts as a language of its own). Two sums over the whole
    corpus, pre-aggregated in each task: no text is shuffled.
    """
    d = docs.select(F.coalesce("lang", F.lit("")).alias("ref_lang"), F.coalesce("text", F.lit("")).alias("text"))
    chars = with_class_counts(d, "text", "c").withColumn("n", F.size(words(F.col("text"))).cast("long"))
    sums = chars.groupBy("ref_lang").agg(*[F.sum(F.col("c")[i]).cast("double").alias(f"c{i}") for i in range(len(CLASSES) + 1)], F.sum("n").alias("all"))
    refs = sums.select("ref_lang", F.array(*[F.col(f"c{i}") for i in range(len(CLASSES) + 1)]).alias("ref_chars"), "all")
    short = d.select("ref_lang", F.explode(F.filter(words(F.col("text")), lambda w: F.length(w) <= SHORT)).alias("w"))
    counts = short.groupBy("ref_lang", F.lower("w").alias("w")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("ref_lang").orderBy(F.desc("n"), "w"))
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= COMMON).groupBy(F.col("ref_lang").alias("t_lang")).agg(F.sort_array(F.collect_list(F.struct("rank", "w", "n"))).alias("top"))
    others = (F.col("all") - F.aggregate("top.n", F.lit(0).cast("long"), lambda s, x: s + x)).cast("double")
    joined = refs.join(top, F.col("ref_lang") == F.col("t_lang"), "left")
    return joined.select("ref_lang", "ref_chars", F.col("top.w").alias("ref_words"), F.concat(F.transform("top.n", lambda x: x.cast("double")), F.array(others)).alias("ref_counts"))


def judge(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """docs with the columns of the verdict, all under names that begin with __q_.

    docs must have text and lang. See quality_rules for the meaning.
    """
    size = F.size("__q_words")
    after = lambda i, k: F.get(F.col("__q_hashes"), i + k)
    gram = lambda x, i: F.xxhash64(x, *[after(i, k) for k in range(1, WINDOW)])
    d = docs.withColumn("__q_text", F.coalesce("text", F.lit(""))).withColumn("__q_words", words(F.col("__q_text")))
    lines = F.filter(F.split("__q_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = (
        with_class_counts(d, "__q_text", "__q_known")
        .withColumn("__q_lines", lines)
        .withColumn("__q_hashes", F.transform("__q_words", lambda w: F.xxhash64(w)))
        .withColumn("__q_grams", F.when(size >= WINDOW, F.slice(F.transform("__q_hashes", gram), F.lit(1), size - (WINDOW - 1))))
        .withColumn("__q_ordered", F.when(F.size(F.array_distinct("__q_grams")) < F.size("__q_grams"), F.sort_array(F.transform("__q_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
        .withColumn("__q_at", F.when(F.col("__q_ordered").isNotNull(), repeated_words("__q_grams", "__q_ordered")))
        .withColumn("__q_n_repeat_words", F.coalesce(F.aggregate(F.sequence(F.lit(0), F.size("__q_at") - 1), F.lit(0), lambda s, i: s + F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__q_at"), i + 1) - F.get(F.col("__q_at"), i), F.lit(WINDOW)))), F.lit(0)).cast("long"))
        .withColumn("__q_n_words", size.cast("long"))
        .withColumn("__q_word_chars", F.length("__q_text").cast("long") - F.col("__q_known")[list(CLASSES).index("blank")])
        .withColumn("__q_n_symbols", only(F.col("__q_known_signs"), "#*$%&|<>"))
        .withColumn("__q_n_dup_lines", (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"))
        .withColumn("__q_chars", shares(F.col("__q_known"), F.length("__q_text").cast("double")))
    )
    sum_of = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    refs = refs.withColumn("ref_chars", shares(F.col("ref_chars"), sum_of("ref_chars"))).withColumn("ref_counts", shares(F.col("ref_counts"), sum_of("ref_counts")))
    d = d.withColumn("__q_lang", F.coalesce("lang", F.lit(""))).join(refs.select([F.col(c).alias(f"__q_{c}") for c in refs.columns]), F.col("__q_lang") == F.col("__q_ref_lang"), "left")
    # The common words of the text in turn, one letter each: counting letters of a short text is cheap.
    short = F.filter("__q_words", lambda w: F.length(w) <= SHORT)
    places = F.filter(F.transform(short, lambda w: F.array_position(F.col("__q_ref_words"), F.lower(w)).cast("int")), lambda p: p > 0)
    d = d.withColumn("__q_letters", F.array_join(F.transform(places, lambda p: F.substring(F.lit(LETTERS), p, F.lit(1))), ""))
    found = F.transform("__q_ref_words", lambda w, i: (F.length("__q_letters") - F.length(F.replace(F.col("__q_letters"), F.substring(F.lit(LETTERS), i + 1, F.lit(1)), F.lit("")))).cast("double"))
    d = (
        d.withColumn("__q_found", found)
        .withColumn("__q_common", shares(F.concat("__q_found", F.array(F.col("__q_n_words") - sum_of("__q_found"))), F.col("__q_n_words").cast("double")))
        .withColumn("__q_js_chars", js_distance(F.col("__q_chars"), F.col("__q_ref_chars")))
        .withColumn("__q_js_words", F.coalesce(js_distance(F.col("__q_common"), F.col("__q_ref_counts")), F.lit(0.0)))
        .withColumn("__q_base_failed", (F.col("__q_n_words") < MIN_WORDS) | (100 * F.col("__q_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__q_n_words")))
    )
    strange = ((F.length("__q_text") >= GUARD_CHARS) & (F.col("__q_js_chars") > MAX_JS_CHARS)) | ((F.col("__q_n_words") >= GUARD_WORDS) & (F.col("__q_js_words") > MAX_JS_WORDS))
    return d.withColumn("__q_kept", ~F.col("__q_base_failed") & ~strange)


VERDICT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "js_chars", "js_words"]


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, js_chars, js_words: one row per row of docs.

    A null or empty text has no words: base_failed. A null lang is compared with the
    other texts of null lang. Repeated rows get equal verdicts, an empty table an
    empty result; columns of docs other than doc_id, text and lang are not read.
    """
    own = docs.select("doc_id", "text", "lang")
    return judge(own, scratch(language_references(own))).select("doc_id", *[F.col(f"__q_{c}").alias(c) for c in VERDICT])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs.

    The verdict is a chain of columns that use one another several times. A filter
    on it would be pushed below them all, each use expanded; the row number, which
    is not deterministic, keeps the filter above. The caller's row travels as one
    struct: its columns may have any names. Nulls, repeats, ties and empty tables as
    in quality_rules; very long texts are judged whole.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__q_own"), "text", "lang")
    judged = judge(own, scratch(language_references(docs.select("text", "lang")))).withColumn("__q_row", F.monotonically_increasing_id())
    return judged.filter(F.col("__q_kept") & (F.col("__q_row") >= 0)).select("__q_own.*")


def op10_quality_rules(spark, sf_dir):
    return quality_rules(read_table(spark, sf_dir, "documents"))


def _duck_only(members: str) -> str:
    return f"length(regexp_replace(t, '[^{members}]+', '', 'g'))"


_KNOWN = ", ".join(_duck_only(m.replace("'", "''")) for m in CLASSES.values())
_JS = "round(sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda x: CASE WHEN x[1] > 0 THEN 0.5 * x[1] * log2(x[1] / ((x[1] + x[2]) / 2)) ELSE 0 END + CASE WHEN x[2] > 0 THEN 0.5 * x[2] * log2(x[2] / ((x[1] + x[2]) / 2)) ELSE 0 END)))), 6)"
_SHARE = "list_transform({a}, lambda x: CASE WHEN list_sum({a}) > 0 THEN x / list_sum({a}) ELSE 0.0 END)"
OP10_SQL = rf"""
WITH d0 AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
d AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln,
  [{_KNOWN}] AS known FROM d0),
refc AS (SELECT lang, list(s ORDER BY i) AS ref_chars FROM (
  SELECT lang, i, sum(c)::DOUBLE AS s FROM (SELECT lang, unnest(list_append(known, length(t) - list_sum(known))) AS c, unnest(range(1, {len(CLASSES) + 2})) AS i FROM d) GROUP BY lang, i) GROUP BY lang),
cnt AS (SELECT lang, CASE WHEN length(x) <= {SHORT} THEN lower(x) END AS x, count(*) AS n FROM (SELECT lang, unnest(w) AS x FROM d) GROUP BY 1, 2),
rk AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS total, row_number() OVER (PARTITION BY lang ORDER BY x IS NULL, n DESC, x) AS r FROM cnt),
refw AS (SELECT lang, list(x ORDER BY r) AS ref_words, list_append(list(n::DOUBLE ORDER BY r), (any_value(total) - sum(n))::DOUBLE) AS ref_counts FROM rk WHERE r <= {COMMON} AND x IS NOT NULL GROUP BY lang),
g AS (SELECT rid, i, list_slice(w, i, i + {WINDOW - 1}) AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS j FROM rep) GROUP BY rid),
f AS (SELECT d.*, len(w) AS n_words, coalesce(cov.n, 0) AS n_repeat_words, ref_chars, ref_words, ref_counts,
  list_transform(list_append(known, length(t) - list_sum(known)), lambda x: x::DOUBLE) AS chars,
  list_transform(ref_words, lambda r: len(list_filter(w, lambda x: lower(x) = r))::DOUBLE) AS found
  FROM d LEFT JOIN cov USING (rid) LEFT JOIN refc USING (lang) LEFT JOIN refw USING (lang)),
s AS (SELECT *, list_append(found, n_words - list_sum(found)) AS common FROM f),
v AS (SELECT *, {_JS.format(p=_SHARE.format(a="chars"), q=_SHARE.format(a="ref_chars"))} AS js_chars, coalesce({_JS.format(p=_SHARE.format(a="common"), q=_SHARE.format(a="ref_counts"))}, 0) AS js_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, {_duck_only("#*$%&|<>")}::BIGINT AS n_symbols,
  (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (length(t) >= {GUARD_CHARS} AND js_chars > {MAX_JS_CHARS}) AND NOT (n_words >= {GUARD_WORDS} AND js_words > {MAX_JS_WORDS}) AS kept, js_chars, js_words
FROM v
"""
