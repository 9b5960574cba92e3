"""Text helpers as column expressions: cleaning, keys, slugs, search."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The words that stand for "no value", and for "no code".
NO_VALUE = "n/a|none|null|undefined"
NO_CODE = "n/a|none|no code|null"
# What a query reads like when it is a question.
ASKING = (
    r"(?i)\b(best|cheap|cheapest|recommend|suggest|compare|help|which|what|why|how|when|where|should|any|find me|show me|looking for|need)\b",
    r"(?i)\b(under|below|less than|between)\s*\$?\d",
    r"(?i)\b(this|next)\s+(week|month|weekend)\b",
    r"\?$",
)
MANY_WORDS = 4
# Fixed value: slugs that no sitemap lists.
PRIVATE_SLUG = r"(?i)((^|[-_/])(test|draft|temp|tmp|deleted|demo|sample|preview|staging)([-_/]|$)|\d{10,})"
SLUG_LENGTH = 80


def as_string(c: Column) -> Column:
    """Trimmed; blank is null."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def clean_string(c: Column) -> Column:
    """As X3, and words for "no value" are null."""
    return F.when(~F.lower(as_string(c)).rlike(f"^({NO_VALUE})$"), as_string(c))


def pick(record: Column, *keys: str) -> Column:
    """The first present, non-empty value of a map by case-insensitive keys."""
    lowered = F.map_from_entries(F.transform(F.map_entries(record), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    return F.coalesce(*[F.nullif(F.try_element_at(lowered, F.lit(k.lower())), F.lit("")) for k in keys])


def first(record: Column, *keys: str) -> Column:
    """The first present, non-empty value of a map by exact keys."""
    return F.coalesce(*[F.nullif(F.try_element_at(record, F.lit(k)), F.lit("")) for k in keys])


def string_list(c: Column, separators: str = ",|") -> Column:
    """The trimmed, non-blank parts of a separated text."""
    return F.filter(F.transform(F.split(c, f"[{separators}]"), lambda x: F.trim(x)), lambda x: x != "")


def other_keys(record: Column, *used: str) -> Column:
    """The entries of a map whose keys were not used, in either case."""
    return F.map_filter(record, lambda k, _: ~F.lower(k).isin([u.lower() for u in used]))


def norm_key(c: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def norm_query(c: Column) -> Column:
    """lower(btrim(query))."""
    return F.lower(F.trim(c))


def pretty_scope(c: Column) -> Column:
    """Underscores and hyphens to spaces, in sentence case."""
    words = F.lower(F.trim(F.regexp_replace(c, "[_-]+", " ")))
    return F.nullif(F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1_000_000)), F.lit(""))


def slugify_ascii(c: Column) -> Column:
    """X22 for texts that need no Unicode decomposition."""
    dashed = F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", "-")
    cut = F.rtrim(F.substring(F.btrim(dashed, F.lit("-")), 1, SLUG_LENGTH), F.lit("-"))
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("item"))


@F.pandas_udf(StringType())
def strip_marks(texts: pd.Series) -> pd.Series:
    """NFKD without combining marks: Spark has no built-in for it."""
    return texts.str.normalize("NFKD").str.replace("[̀-ͯ]", "", regex=True)


def slugify(c: Column) -> Column:
    """The import slug of any text. Texts outside ASCII need Python; the others reach it as null."""
    return slugify_ascii(F.when(F.coalesce(c, F.lit("")).rlike(r"[^\x00-\x7F]"), strip_marks(F.when(c.rlike(r"[^\x00-\x7F]"), c))).otherwise(F.coalesce(c, F.lit(""))))


def seo_slug(c: Column) -> Column:
    """Keeps word characters only, joins them with hyphens."""
    kept = F.trim(F.regexp_replace(F.lower(c), r"[^\w\s-]", ""))
    dashed = F.regexp_replace(F.regexp_replace(kept, r"[\s_]+", "-"), "-+", "-")
    return F.regexp_replace(F.substring(dashed, 1, SLUG_LENGTH), "^-|-$", "")


def is_clean_slug(c: Column) -> Column:
    """false for slugs of tests, drafts and long numbers; false for no slug."""
    return F.coalesce((c != "") & ~c.rlike(PRIVATE_SLUG), F.lit(False))


def store_slug(c: Column) -> Column:
    """X45."""
    return F.when(c.endswith("-coupons"), c).otherwise(F.concat(c, F.lit("-coupons")))


def category_slug(c: Column) -> Column:
    """X45."""
    return F.when(c.endswith("-offers"), c).otherwise(F.concat(c, F.lit("-offers")))


def page_of_slug(c: Column) -> Column:
    """Struct of kind (store, category, or null for none) and the slug without its suffix."""
    made = lambda kind, suffix: F.struct(F.lit(kind).alias("kind"), F.substring(c, F.lit(1), F.length(c) - len(suffix)).alias("slug"))
    return F.when(c.endswith("-coupons"), made("store", "-coupons")).when(c.endswith("-offers"), made("category", "-offers"))


def xml_text(c: Column) -> Column:
    """A text inside an XML element."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def is_conversational(c: Column) -> Column:
    """whether a query asks, rather than names a shop or an offer."""
    t = F.trim(c)
    asks = reduce(lambda a, b: a | b, [t.rlike(p) for p in ASKING])
    return (t != "") & (asks | (F.size(F.split(t, r"\s+")) > MANY_WORDS))


def contains_any(term: str, *columns: Column) -> Column:
    """whether any column, as lower-cased text, contains the term."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c.cast("string")), F.lit(term.lower())), F.lit(False)) for c in columns])


def search_term(term: str, strip_wildcards: bool = False) -> str:
    """the pattern of an ilike search; tools strip % and _, pages do not."""
    return f"%{term.replace('%', '').replace('_', '') if strip_wildcards else term}%"


def clip(c: Column, length: int) -> Column:
    """White space collapsed, cut to a length."""
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, length)


def mask_code(c: Column) -> Column:
    """The first three characters and dots."""
    return F.concat(F.substring(c, 1, 3), F.lit("•••"))


def mask_secret(c: Column) -> Column:
    """All but the last four characters hidden."""
    return F.when(F.length(c) <= 4, F.repeat(F.lit("•"), F.length(c))).otherwise(F.concat(F.repeat(F.lit("•"), F.length(c) - 4), F.substring(c, -4, 4)))


def csv_field(c: Column) -> Column:
    """K8: quoted only where a quote, a comma or a line end asks for it."""
    return F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
