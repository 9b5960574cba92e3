"""Operator 8: personal data, by patterns and by information-theoretic sanitisation.

Four patterns find the protected entities: e-mail addresses, IP addresses, card and
phone numbers. Corpus co-occurrence then tells how strongly the terms of a document
reveal an entity, be it one value or a kind of them. Over all documents, p(c) is the
share that holds entity c, p(t) the share that holds term t outside its entities, and
PMI(c; t) = log(p(c, t) / (p(c) p(t))) is compared with the information of c,
-log p(c): a ratio of 1 means that whoever reads t knows c. The ratio is smoothed by
b / (b + SMOOTHING), b the number of documents that hold both, so that a chance
meeting says little and no least number of documents is set. Terms above a first threshold are
generalised to the nearest broader term that does not disclose, those above a second
are removed, wherever they stand in a text.

All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealforge.llm.common import let, read_table, scratch

#: The base kinds in the order in which ties are listed, and their patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches, without backtracking or recursion: a start inside a run of the
#: first class fails as the run's start does, unless a match has just ended there.
FAST = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": PATTERNS["phone"],
}
PART = r"0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TERM = r"\p{L}{4,}"
#: Added kinds: terms that are generalised, terms that are removed.
GENERALISED, REMOVED = "term", "removed"
#: Thresholds of the smoothed ratio.
GENERALISE = 0.8
REMOVE = 0.95
#: Half a document, the weight that an even prior has in an estimate of a share.
SMOOTHING = 0.5
#: Terms and row numbers that may be broadcast (some 20 MB each), as counted first; beyond, rows are shuffled.
BROADCAST_TERMS = 500_000
BROADCAST_ROWS = 2_000_000
#: Matches that are placed in one go; see running().
CHUNK = 256

#: Terms and the broader terms that may stand for them.
HIERARCHY = {
    "london": "england", "manchester": "england", "england": "europe", "berlin": "germany", "munich": "germany", "germany": "europe", "paris": "france", "lyon": "france", "france": "europe",
    "madrid": "spain", "sevilla": "spain", "spain": "europe", "chicago": "america", "boston": "america", "mother": "relative", "father": "relative", "sister": "relative", "brother": "relative",
    "mutter": "verwandte", "vater": "verwandte", "madre": "pariente", "padre": "pariente", "monday": "weekday", "tuesday": "weekday", "wednesday": "weekday", "thursday": "weekday", "friday": "weekday",
    "saturday": "weekday", "sunday": "weekday", "january": "month", "february": "month", "march": "month", "april": "month", "june": "month", "july": "month", "august": "month", "september": "month",
    "october": "month", "november": "month", "december": "month", "doctor": "profession", "nurse": "profession", "lawyer": "profession", "teacher": "profession", "engineer": "profession",
    "mobile": "phone", "phone": "device", "telephone": "phone", "mailbox": "email", "email": "contact", "visa": "card", "mastercard": "card", "server": "computer", "computer": "device",
}


def before_each(values: Column, zero: Column, add) -> Column:
    """What add makes of zero and all items before each item of an array.

    Chunks are folded first and then each chunk from where the ones before it ended,
    so that no array is copied once per item.
    """
    fold = lambda items, first: F.aggregate(
        items, F.struct(first.alias("now"), F.filter(F.array(first), lambda _: F.lit(False)).alias("out")), lambda s, x: F.struct(add(s["now"], x).alias("now"), F.array_append(s["out"], s["now"]).alias("out"))
    )["out"]
    parts = lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int"))), lambda k: F.slice(v, k * CHUNK + 1, F.lit(CHUNK)))
    folded = lambda chunks: F.flatten(F.zip_with(chunks, fold(F.transform(chunks, lambda c: F.aggregate(c, zero, add)), zero), fold))
    return let(values, lambda v: let(parts(v), folded))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches in order: array of (m, start, end) in code points."""
    one = lambda x, at: F.struct(x["m"].alias("m"), (at + F.length(x["gap"])).alias("start"), (at + F.length(x["gap"]) + F.length(x["m"])).alias("end"))
    zipped = lambda found: F.arrays_zip(found.alias("m"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"))
    before = lambda pieces: before_each(F.transform(pieces, lambda x: F.length(x["gap"]) + F.length(x["m"])), F.lit(0), lambda s, x: s + x)
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(zipped(found), lambda pieces: F.zip_with(pieces, before(pieces), one)))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the Luhn sum of a text of digits is a multiple of ten."""
    n = F.length(number)
    value = lambda i: F.substring(number, i, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when((n - i) % 2 == 1, twice(value(i))).otherwise(value(i))) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """Whether a match of a kind counts."""
    if kind == "ip":
        return m.rlike(rf"^{PART}(\.{PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits(m)).between(12, 19), luhn(digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


def spans_of(text: Column, rank: int, kind: str) -> Column:
    """The valid matches of one kind: array of (start, rank, kind, end, value)."""
    can = F.contains(text, F.lit("@")) if kind == "email" else F.contains(text, F.lit("+")) if kind == "phone" else text.rlike("[0-9]")
    value = {"email": F.lower, "ip": lambda m: m}.get(kind, digits)
    one = lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"), F.concat(F.lit(f"{kind}:"), value(x["m"])).alias("value"))
    spans = F.transform(F.filter(matches(text, FAST[kind]), lambda x: valid(kind, x["m"])), one)
    return F.when(can, spans).otherwise(F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,value:string>>"))


def entities(text: Column) -> Column:
    """The base spans of a text, by start and kind."""
    return F.array_sort(F.concat(*[spans_of(text, rank, kind) for rank, kind in enumerate(FAST)]))


def replaced(text: Column, spans: Column, put) -> Column:
    """text with put(span, reach) for each of its spans, sorted by start; reach is where the spans before end.

    What lies under several spans goes once.
    """
    kept = lambda x, reach: F.concat(F.substring(text, reach + 1, F.greatest(F.lit(0), x["start"] - reach)), put(x, reach))
    ends = lambda v: F.transform(v, lambda x: x["end"])
    body = lambda v: F.concat(F.array_join(F.zip_with(v, before_each(ends(v), F.lit(0), lambda s, x: F.greatest(s, x)), kept), ""), F.substring(text, F.array_max(ends(v)) + 1, F.length(text)))
    return F.when(F.size(spans) > 0, let(spans, body)).otherwise(text)


def blanked(text: Column, spans: Column) -> Column:
    """text with blanks for the code points of its spans: what is left stands where it stood."""
    return replaced(text, spans, lambda x, reach: F.repeat(F.lit(" "), F.greatest(F.lit(0), x["end"] - F.greatest(reach, x["start"]))))


def terms_of(text: Column) -> Column:
    """The distinct lower-cased terms of a text."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))), F.lower))


def smoothed_ratio(both: Column, of_value: Column, of_term: Column, total: Column) -> Column:
    """PMI of an entity and a term over the entity's information, smoothed."""
    return F.round(F.log(both * total / (of_value * of_term)) / F.log(total / of_value) * (both / (both + SMOOTHING)), 6)


#: Stands for any entity; no value or kind is an empty text.
ANY = ""


def disclosing_terms(based: DataFrame, generalise: float = GENERALISE) -> DataFrame:
    """term, ratio: the terms that reveal some entity at least as strongly as `generalise`, by the largest ratio.

    based: row, base (spans), outside (the text without them). An entity is a value
    (email:a@b.c) or a kind of them (email). The smoothing bounds the ratio of
    whatever meets in b documents by b / (b + SMOOTHING), so that entities and pairs of
    fewer documents than the threshold asks for need no further counting. Documents
    with an entity that hold a term are a part of all that hold it: a pair whose ratio
    is too small with their number is so with any, and only the terms of other pairs
    are counted over the corpus. All counts are combined in each task before they are
    dealt out.
    """
    enough = lambda n: F.col(n) / (F.col(n) + SMOOTHING) >= generalise
    names = lambda s: F.array(s["kind"], s["value"])
    ratio = lambda of_term: smoothed_ratio(*map(F.col, ("both", "of_value", of_term, "total")))
    total = based.agg(F.count("*").alias("total"))
    with_ = based.filter(F.size("base") > 0).withColumn("held", F.array_distinct(F.flatten(F.transform("base", names))))
    of_value = scratch(with_.select(F.explode("held").alias("value")).groupBy("value").agg(F.count("*").alias("of_value")).filter(enough("of_value")))
    held = with_.select("row", F.explode("held").alias("value")).join(of_value.select("value"), "value", "left_semi")
    held = held.groupBy(F.col("row").alias("h_row")).agg(F.array_append(F.collect_list("value"), F.lit(ANY)).alias("values"))  # of one document
    pairs = with_.join(held.hint("merge"), F.col("row") == F.col("h_row")).select("values", F.explode(terms_of(F.col("outside"))).alias("term")).select("term", F.explode("values").alias("value"))
    met = scratch(pairs.groupBy("value", "term").agg(F.count("*").alias("both")).filter(enough("both")))
    least = met.filter(F.col("value") == ANY).select("term", F.col("both").alias("least"))
    both = met.filter(F.col("value") != ANY).join(of_value, "value").join(least, "term").crossJoin(F.broadcast(total)).filter("of_value < total")
    both = scratch(both.filter(ratio("least") >= generalise).drop("least"))
    each = based.select(F.explode(terms_of(F.col("outside"))).alias("t_term"))
    asked = scratch(both.select(F.col("term").alias("a_term")).distinct())
    if asked.count() <= BROADCAST_TERMS:  # beyond, all terms are counted and then joined
        each = each.join(F.broadcast(asked), F.col("t_term") == F.col("a_term"), "left_semi")
    of_term = each.groupBy("t_term").agg(F.count("*").alias("of_term"))
    told = both.join(of_term, F.col("term") == F.col("t_term")).withColumn("ratio", ratio("of_term"))
    return scratch(told.filter(F.col("ratio") >= generalise).groupBy("term").agg(F.max("ratio").alias("ratio")))


def broader_terms(told: DataFrame, hierarchy: dict[str, str]) -> DataFrame:
    """told with `broader`: the nearest broader term that is not told itself, or null."""
    chains = {}
    for term in hierarchy:
        chain = [term]
        while chain[-1] in hierarchy and hierarchy[chain[-1]] not in chain:
            chain.append(hierarchy[chain[-1]])
        chains[term] = chain[1:]
    if not chains:
        return told.withColumn("broader", F.lit(None).cast("string"))
    steps = told.sparkSession.createDataFrame([(t, i, b) for t, chain in chains.items() for i, b in enumerate(chain)], "b_term string, step int, broader string")
    free = steps.join(told.select(F.col("term").alias("x")), F.col("broader") == F.col("x"), "left_anti")
    nearest = free.groupBy("b_term").agg(F.min_by("broader", "step").alias("broader"))
    return told.join(nearest, F.col("term") == F.col("b_term"), "left").drop("b_term")


SPAN = "struct<start:int,rank:int,kind:string,end:int,broader:string>"


def base_and_added(docs: DataFrame, generalise: float, remove: float, hierarchy: dict[str, str] | None) -> tuple[DataFrame, DataFrame]:
    """Two tables: own, row, base of all rows; a_row, added of the rows with disclosing terms.

    The places of terms are found where the texts lie, so that spans are shuffled and texts are not.
    """
    own = docs.select(F.struct(*docs.columns).alias("own"), F.coalesce("text", F.lit("")).alias("text"))
    based = scratch(own.select("own", F.monotonically_increasing_id().alias("row"), entities(F.col("text")).alias("base")))
    open_ = based.select("row", "base", blanked(F.coalesce("own.text", F.lit("")), F.col("base")).alias("outside"))
    told = scratch(broader_terms(disclosing_terms(open_, generalise), HIERARCHY if hierarchy is None else hierarchy))
    few = told.count() <= BROADCAST_TERMS
    gone = F.col("ratio") >= remove
    span = F.struct(F.col("m.start").alias("start"), F.when(gone, 5).otherwise(4).alias("rank"), F.when(gone, F.lit(REMOVED)).otherwise(F.lit(GENERALISED)).alias("kind"), F.col("m.end").alias("end"), "broader")
    places = open_.select("row", F.explode(matches(F.col("outside"), TERM)).alias("m"))
    placed = places.join(F.broadcast(told) if few else told, F.lower("m.m") == F.col("term")).select(F.col("row").alias("a_row"), span.alias("span"))
    return based, placed.groupBy("a_row").agg(F.collect_list("span").alias("added"))  # of one document


def every_span() -> Column:
    """base and added of one row, sorted."""
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(None).cast("string").alias("broader")))
    return F.array_sort(F.concat(base, F.coalesce("added", F.array().cast(f"array<{SPAN}>")))).alias("spans")


def find_personal_data(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, hierarchy: dict[str, str] | None = None) -> DataFrame:
    """own (a struct of all columns of docs), text, spans: one row per row of docs.

    spans: array of (start, rank, kind, end, broader), base and added, sorted. docs
    must have text; null counts as empty. Every occurrence of a disclosing term is a
    span, also in rows without an entity. Repeated rows count as documents each and
    get equal spans. Columns of docs may have any names; an empty table gives no rows.
    """
    based, added = base_and_added(docs, generalise, remove, hierarchy)
    added = scratch(added)
    found = ["own", F.coalesce("own.text", F.lit("")).alias("text"), every_span()]
    if added.count() > BROADCAST_ROWS:
        return based.join(added, F.col("row") == F.col("a_row"), "left").select(*found)
    rows = F.broadcast(added.select(F.col("a_row").alias("h_row")))  # only texts with told terms are shuffled
    asked = based.join(rows, F.col("row") == F.col("h_row"), "left_semi").join(added.hint("merge"), F.col("row") == F.col("a_row"))
    rest = based.join(rows, F.col("row") == F.col("h_row"), "left_anti").withColumn("added", F.lit(None).cast(f"array<{SPAN}>"))
    return asked.select(*found).unionByName(rest.select(*found))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """text with every span replaced; of overlapping spans the first one's replacement stays.

    A base span gives way to the name of its kind in brackets, a generalised term to
    its broader term or, if none is known, to the class of its written form. Removed
    terms leave nothing.
    """
    named = F.lit(r"^\p{Lu}")
    form = lambda x: F.when(F.regexp_like(F.substring(text, x["start"] + 1, F.lit(1)), named), "[NAME]").otherwise("[TERM]")
    put = lambda x: F.when(x["kind"] == REMOVED, "").when(x["kind"] == GENERALISED, F.coalesce(x["broader"], form(x))).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
    return replaced(text, spans, lambda x, reach: F.when(x["start"] >= reach, put(x)).otherwise(""))


def personal_data(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, hierarchy: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row per row of docs.

    A null or empty text has no spans (the digest of the empty list); an empty table
    gives no rows; repeated rows get equal spans; a null id stays null; ties in start
    go by kind; other columns than doc_id and text are not read, whatever their names.
    A very long text is searched whole.
    """
    based, added = base_and_added(docs.select("doc_id", "text"), generalise, remove, hierarchy)
    found = based.select("own.doc_id", "row", "base").join(added.hint("merge"), F.col("row") == F.col("a_row"), "left").select("doc_id", every_span())
    base = F.filter("spans", lambda s: s["rank"] < len(PATTERNS))
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of_kind(kind).alias(f"n_{kind}") for kind in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def mask_personal_data(docs: DataFrame, **options) -> DataFrame:
    """docs with sanitised texts; n_chars, where there is one, follows. Other columns stay.

    Null texts stay null. See find_personal_data for repeats and empty tables.
    """
    found = find_personal_data(docs, **options)
    hit = F.size("spans") > 0
    new = {"text": F.when(hit, sanitised(F.col("text"), F.col("spans"))).otherwise(F.col("own.text"))}
    found = found.withColumn("new", new["text"])
    out = {"text": F.col("new"), "n_chars": F.when(hit, F.length("new").cast("long")).otherwise(F.col("own")["n_chars"]) if "n_chars" in docs.columns else None}
    return found.select(*[out[c].alias(c) if c in out else F.col("own")[c].alias(c) for c in docs.columns])


def op8_pii(spark, sf_dir):
    return personal_data(read_table(spark, sf_dir, "documents"))


_POSITIONS = "len(array_to_string(gs[1:i], '')) + len(array_to_string(ms[1:i - 1], ''))"
_DIGIT = "dg[i]::INT"
OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT * FROM (VALUES {", ".join(f"({rank}, '{kind}', '{pattern}')" for rank, (kind, pattern) in enumerate(PATTERNS.items()))}) v(rank, kind, pat)),
x AS (SELECT rid, t, rank, kind, regexp_extract_all(t, pat) AS ms, regexp_split_to_array(t, pat) AS gs FROM d, k WHERE regexp_matches(t, pat)),
y AS (SELECT rid, t, rank, kind, ms[i] AS m, {_POSITIONS} AS s FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM x)),
z AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS dg FROM y),
b AS (SELECT rid, t, rank, kind, s, s + len(m) AS e, kind || ':' || CASE kind WHEN 'email' THEN lower(m) WHEN 'ip' THEN m ELSE dg END AS value FROM z WHERE CASE kind WHEN 'email' THEN true
  WHEN 'ip' THEN regexp_matches(m, '^{PART}(\.{PART}){{3}}$') WHEN 'phone' THEN len(dg) BETWEEN 9 AND 15
  ELSE len(dg) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, len(dg) + 1), lambda i: CASE WHEN (len(dg) - i) % 2 = 0 THEN {_DIGIT} WHEN {_DIGIT} > 4 THEN 2 * {_DIGIT} - 9 ELSE 2 * {_DIGIT} END)) % 10 = 0 END),
cut AS (SELECT rid, list(s::VARCHAR || ':' || e::VARCHAR) AS places FROM b GROUP BY rid),
o AS (SELECT rid, CASE WHEN places IS NULL THEN t ELSE list_reduce(list_prepend(t, places), lambda acc, x: substr(acc, 1, split_part(x, ':', 1)::BIGINT) || repeat(' ', split_part(x, ':', 2)::BIGINT - split_part(x, ':', 1)::BIGINT) || substr(acc, split_part(x, ':', 2)::BIGINT + 1)) END AS txt
  FROM d LEFT JOIN cut USING (rid)),
g AS (SELECT rid, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT rid, regexp_extract_all(txt, '{TERM}') AS ms, regexp_split_to_array(txt, '{TERM}') AS gs FROM o)),
tw AS (SELECT DISTINCT rid, lower(ms[i]) AS term FROM g),
held AS (SELECT DISTINCT rid, value FROM b UNION SELECT DISTINCT rid, kind FROM b),
total AS (SELECT count(*) AS n FROM documents),
ov AS (SELECT value, count(*) AS n_value FROM held GROUP BY 1),
ot AS (SELECT term, count(*) AS n_term FROM tw GROUP BY 1),
pairs AS (SELECT value, term, count(*) AS n_both FROM held JOIN tw USING (rid) GROUP BY 1, 2 HAVING count(*) >= {SMOOTHING * GENERALISE / (1 - GENERALISE) - 0.5}),
told AS (SELECT term, max(ratio) AS ratio FROM (SELECT term, round(ln(n_both * n / (n_value * n_term)) / ln(n / n_value) * (n_both / (n_both + {SMOOTHING})), 6) AS ratio FROM pairs JOIN ov USING (value) JOIN ot USING (term), total WHERE n_value < n) WHERE ratio >= {GENERALISE} GROUP BY 1),
hit AS (SELECT rid, {_POSITIONS} AS s, {_POSITIONS} + len(ms[i]) AS e, ratio FROM g JOIN told ON lower(ms[i]) = term),
spans AS (SELECT rid, s, rank, kind, e FROM b UNION ALL SELECT rid, s, CASE WHEN ratio >= {REMOVE} THEN 5 ELSE 4 END, CASE WHEN ratio >= {REMOVE} THEN '{REMOVED}' ELSE '{GENERALISED}' END, e FROM hit),
l AS (SELECT rid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS every, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (rank < {len(PATTERNS)}) AS base,
  {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in PATTERNS)} FROM spans GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in PATTERNS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN l USING (rid)
"""
