"""Offer rules as column expressions: numbers, status, discounts, terms, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dealforge.functions.text import NO_CODE, as_string, clean_string

# Which words of a provider's status mean what, in order.
STATUS_WORDS = (
    ("active", "(^|_)(active|approved|joined|live|running)"),
    ("expired", "expire"),
    ("pending", "pending|review|applied"),
    ("inactive", "inactive|paused|ended|closed|rejected|declined|not"),
)
STATUSES = ("active", "inactive", "expired", "pending", "unknown")
# Currencies by symbol, in order.
CURRENCIES = (("$", "USD"), ("£", "GBP"), ("€", "EUR"), ("₹", "INR"))
# Phrases of a scope, in order.
SCOPES = (
    ("new customers only", r"(?i)new\s+customers?\s+only"),
    ("sitewide", r"(?i)(sitewide|site-wide|entire\s+(?:site|order))"),
    ("select items", r"(?i)select(?:ed)?\s+(?:items|products|styles)"),
    ("first order", r"(?i)first\s+order"),
)
# Where a text states its limits.
MINIMUM = r"(?i)(?:min(?:imum)?(?:\s+(?:purchase|order|spend))?|orders?\s+over|spend)\D{0,12}([\d.,]+)"
MAXIMUM = r"(?i)(?:max(?:imum)?\s+(?:savings?|discount)|up\s+to)\D{0,12}([\d.,]+)"
LIMIT = r"(?i)(?:limit(?:ed)?(?:\s+to)?|max(?:imum)?)\s+(\d+)\s+(?:use|order|redemption|purchase)"
FREE_SHIPPING, BOGO, PERCENT = r"free\s*ship", "bogo|buy one|buy 1", r"(\d+(?:\.\d+)?)\s*%"
DAY = 86_400.0
# Fixed value: what the address of a logo of our own contains.
HOSTED_LOGO = "/storage/v1/object/public/"


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without a match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def as_number(c: Column) -> Column:
    """All but digits, dots and minus signs stripped; nothing left is 0, nonsense null."""
    stripped = F.regexp_replace(F.trim(c.cast("string")), "[^0-9.-]", "")
    return F.when(as_string(c).isNotNull(), F.when(stripped == "", F.lit(0.0)).otherwise(stripped.try_cast("double")))


def first_number(c: Column) -> Column:
    """The first signed decimal of a text without its commas; null if there is none."""
    return found(F.replace(c.cast("string"), F.lit(","), F.lit("")), r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def as_timestamp(c: Column) -> Column:
    """ISO and a few common formats; anything else null."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy")])


def iso_date(c: Column) -> Column:
    """The UTC day of a time, as yyyy-MM-dd; null for what is no time."""
    return F.date_format(as_timestamp(c), "yyyy-MM-dd")


def date_range(c: Column) -> Column:
    """A "start/end" text as a struct of two timestamps."""
    return F.struct(as_timestamp(F.trim(F.split_part(c, F.lit("/"), F.lit(1)))).alias("start"), as_timestamp(F.nullif(F.trim(F.split_part(c, F.lit("/"), F.lit(2))), F.lit(""))).alias("end"))


def map_status(c: Column) -> Column:
    """The canonical status of a provider's text. `not_joined` is active, as its tail says so."""
    s = F.lower(F.coalesce(as_string(c), F.lit("")))
    out = F.when(s == "", "unknown")
    for status, words in STATUS_WORDS:
        out = out.when(s.rlike(words), status)
    return out.otherwise("unknown")


def discount_of(percent: Column, amount: Column, text: Column, symbols: str = "$£€", other: str | None = "other") -> Column:
    """Struct of type and value: percent field, amount field, then the text's words."""
    t = F.lower(F.coalesce(text, F.lit("")))
    money = rf"[{symbols}]\s*(\d+(?:\.\d+)?)"
    made = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.cast("double").alias("value"))
    none = F.lit(None)
    rest = F.struct(F.when(t == "", "unknown").otherwise(other).alias("type"), none.cast("double").alias("value")) if other else made(None, none)
    return (
        F.when(percent.isNotNull(), made("percentage", percent))
        .when(amount.isNotNull(), made("fixed", amount))
        .when(t.rlike(FREE_SHIPPING), made("free_shipping", none))
        .when(t.rlike(BOGO), made("bogo", none))
        .when(t.rlike(PERCENT), made("percentage", F.regexp_extract(t, PERCENT, 1).try_cast("double")))
        .when(t.rlike(money), made("fixed", F.regexp_extract(t, money, 1).try_cast("double")))
        .otherwise(rest)
    )


def is_url(c: Column) -> Column:
    """An absolute http(s) URL with a host."""
    return F.coalesce(F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))).isin("http", "https") & F.try_parse_url(c, F.lit("HOST")).isNotNull(), F.lit(False))


def logo_url(c: Column) -> Column:
    """Protocol-relative addresses get https; what is no URL is null."""
    whole = F.when(F.trim(c).startswith("//"), F.concat(F.lit("https:"), F.trim(c))).otherwise(F.trim(c))
    return F.when(is_url(whole), whole)


def domain_of(c: Column) -> Column:
    """The host without www."""
    whole = F.when(c.startswith("//"), F.concat(F.lit("https:"), c)).otherwise(c)
    return F.regexp_replace(F.lower(F.try_parse_url(whole, F.lit("HOST"))), r"^www\.", "")


def usable_code(c: Column) -> Column:
    """A code, unless it says that there is none."""
    s = as_string(c)
    return F.when(~F.lower(s).rlike(f"^({NO_CODE})$"), s)


def offer_code(direct: Column, enriched: Column) -> Column:
    """The usable code of an offer, else that of its advertisement, else what stands there."""
    return F.coalesce(usable_code(direct), usable_code(enriched), as_string(direct))


def tracking(ad: Column, direct: Column, store: Column, uri: Column, campaign: Column) -> Column:
    """Struct of url and warning: advertisement, promotion, store, promotion's uri, campaign."""
    made = lambda url, warning: F.struct(url.alias("url"), F.lit(warning).cast("string").alias("warning"))
    return (
        F.when(ad.isNotNull(), made(ad, None))
        .when(as_string(direct).isNotNull(), made(as_string(direct), None))
        .when(store.isNotNull(), made(store, "tracking url fell back to the campaign tracking link"))
        .when(uri.rlike("(?i)^https?://"), made(uri, "tracking url fell back to the promotion uri"))
        .when(campaign.isNotNull(), made(campaign, "tracking url fell back to the enriched campaign tracking link"))
        .otherwise(made(F.lit(None).cast("string"), "no tracking url available for this promotion"))
    )


def tracking_source(url: Column, warning: Column, ad: Column) -> Column:
    """Where an offer's tracking address came from."""
    return F.when(as_string(url).isNull(), "none").when(F.lower(as_string(warning)).contains("campaign"), "campaign").when(as_string(ad).isNotNull(), "ad").otherwise("promotion")


def logo_status(logo: Column) -> Column:
    """Hosted by us, the provider's, or missing."""
    return F.when(as_string(logo).isNull(), "missing").when(as_string(logo).contains(HOSTED_LOGO), "hosted").otherwise("provider")


def currency_of(explicit: Column, text: Column) -> Column:
    """The first three letters of a field, else by the symbol in the text."""
    out = F.when(clean_string(explicit).isNotNull(), F.substring(F.upper(clean_string(explicit)), 1, 3))
    for symbol, code in CURRENCIES:
        out = out.when(F.contains(text, F.lit(symbol)), code)
    return out


def scope_of(field: Column, text: Column) -> Column:
    out = F.when(field.isNotNull(), field)
    for scope, pattern in SCOPES:
        out = out.when(text.rlike(pattern), scope)
    return out


def terms_of(text: Column, minimum: Column, maximum: Column, limit: Column, scope: Column, currency: Column) -> Column:
    """Structured terms: fields first, else what the text says. A limit of 0 is none."""
    return F.struct(
        F.coalesce(minimum, first_number(found(text, MINIMUM))).alias("minimum_purchase"),
        F.coalesce(maximum, first_number(found(text, MAXIMUM))).alias("maximum_savings"),
        F.coalesce(F.when(limit > 0, limit), found(text, LIMIT).try_cast("double")).alias("purchase_limit"),
        scope_of(scope, text).alias("scope"),
        currency_of(currency, text).alias("currency"),
    )


def money(amount: Column, currency: Column) -> Column:
    """US format, two decimals; other currencies by code."""
    code = F.upper(F.coalesce(currency, F.lit("USD")))
    symbol = F.when(code == "USD", "$").when(code == "GBP", "£").when(code == "EUR", "€").when(code == "INR", "₹").otherwise(F.concat(code, F.lit(" ")))
    return F.concat(symbol, F.format_number(amount, 2))


def discount_text(kind: Column, value: Column, currency: Column) -> Column:
    """X30: "20% off", "$15.00 off", "Free shipping", "BOGO"."""
    plain = F.regexp_replace(F.format_string("%.2f", F.round(value, 2)), r"\.?0+$", "")
    return (
        F.when(kind == "free_shipping", "Free shipping").when(kind == "bogo", "BOGO")
        .when((kind == "percentage") & value.isNotNull(), F.concat(F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(plain), F.lit("% off")))
        .when((kind == "fixed") & value.isNotNull(), F.concat(money(value, currency), F.lit(" off")))
    )


def terms_text(terms: Column, text: Column, expiry: Column) -> Column:
    """The provider's own text, else sentences from the terms and the expiry date."""
    t = lambda f: terms[f]
    parts = [
        F.concat(F.lit("Minimum purchase of "), money(t("minimum_purchase"), t("currency")), F.lit(" required.")),
        F.concat(F.lit("Maximum savings of "), money(t("maximum_savings"), t("currency")), F.lit(".")),
        F.concat(F.lit("Limited to "), t("purchase_limit").cast("long").cast("string"), F.lit(" per customer.")),
        F.concat(F.lit("Applies to: "), t("scope"), F.lit(".")),
        F.concat(F.lit("Offer valid until "), F.date_format(expiry, "MMMM d, yyyy"), F.lit(".")),
    ]
    made = F.concat_ws(" ", *parts)
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.when(made != "", F.concat(made, F.lit(" Terms are set by the merchant and may change without notice."))))


def parse_discount(title: Column) -> Column:
    """0 to 0.95 from a title; "12.5%" reads 5 %."""
    t = F.lower(title)
    return (
        F.when(t.rlike(r"\d{1,3}\s*%"), F.least(F.regexp_extract(t, r"(\d{1,3})\s*%", 1).try_cast("int"), F.lit(95)) / 100.0)
        .when(t.rlike(r"\$\s?\d{1,4}"), F.least(F.regexp_extract(t, r"\$\s?(\d{1,4})", 1).try_cast("int") / 200.0, F.lit(0.9)))
        .when(t.rlike(r"\bfree shipping\b"), 0.2).when(t.rlike(r"\bbogo\b|buy one get one"), 0.5).when(t.rlike(r"\bclearance\b|\bsale\b"), 0.1)
        .otherwise(0.0)
    )


def days_between(later: Column, earlier: Column) -> Column:
    return (later.cast("timestamp").cast("double") - earlier.cast("timestamp").cast("double")) / DAY


def freshness(created: Column, now: Column) -> Column:
    """Decays by age, 0.1 at least."""
    return F.greatest(F.lit(0.1), F.exp(-days_between(now, created) / 30.0))


def expiry_penalty(expiry: Column, now: Column) -> Column:
    """X26."""
    left = days_between(expiry, now)
    return F.when(expiry.isNull(), 0.0).when(left < 0, 0.8).when(left < 1, 0.15).otherwise(0.0)


def rank_score(title: Column, clicks: Column, saves: Column, created: Column, expiry: Column, has_code: Column, popularity: Column, now: Column) -> Column:
    """The weighted sum that orders recommendations."""
    return (
        0.4 * parse_discount(title) + 0.2 * F.log10(1.0 + clicks) / 2.5 + 0.2 * F.log10(1.0 + saves) / 2.0
        + 0.15 * freshness(created, now) + 0.1 * popularity + F.when(has_code, 0.05).otherwise(0.0) - expiry_penalty(expiry, now)
    )


def policy_discount(kind: Column, discount_type: Column, value: Column) -> Column:
    """Deals 0; a percentage as it is, other amounts by a hundred."""
    return F.when((kind != "coupon") | value.isNull(), 0.0).when(discount_type == "percentage", value).otherwise(value / 100.0)


def offer_status(provider_status: Column, start: Column, end: Column, today: Column, valid: Column | None = None) -> Column:
    """Draft if not valid; by the window; then by the provider. A stale `expired` is active."""
    return (
        F.when(~valid if valid is not None else F.lit(False), "draft")
        .when(end < today, "expired").when(start > today, "draft").when(provider_status.isin("inactive", "pending"), "draft").otherwise("active")
    )


def stored_status(payload_status: Column, start: Column, end: Column, today: Column) -> Column:
    """The window first, then the payload's status; a stale `expired` is active."""
    return F.when(end < today, "expired").when(start > today, "draft").when(F.coalesce(payload_status, F.lit("active")) == "draft", "draft").otherwise("active")


def nice_ceil(n: Column) -> Column:
    """The next of 1, 2, 5 or 10 times a power of ten."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(n)))
    unit = n / power
    return F.when(n <= 1, 1.0).otherwise(F.when(unit <= 1, 1.0).when(unit <= 2, 2.0).when(unit <= 5, 5.0).otherwise(10.0) * power)


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Rounds halves towards +infinity, as the reports do."""
    scale = 10.0**digits
    return F.floor(c * scale + 0.5) / scale


def status_class(code: Column) -> Column:
    """The class of an HTTP status."""
    return (
        F.when(code == 401, "authentication_error").when(code == 403, "authorization_error").when(code == 408, "timeout").when(code == 429, "rate_limited")
        .when(code >= 500, "server_error").when(code >= 400, "validation_error").otherwise("unknown_error")
    )


def retry_after_ms(header: Column, now_ms: Column) -> Column:
    """A Retry-After header as milliseconds from now: seconds, or an HTTP date; null if neither."""
    seconds = F.trim(header).try_cast("double")
    date = F.try_to_timestamp(F.regexp_extract(header, r"(\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.when(seconds.isNotNull(), F.greatest(seconds, F.lit(0.0)) * 1000).when(date.isNotNull(), F.greatest(date.cast("double") * 1000 - now_ms, F.lit(0.0)))


def reset_time(reset: Column, now_ms: Column) -> Column:
    """A rate limit's reset as epoch milliseconds: epoch ms, epoch seconds, or seconds from now."""
    n = reset.try_cast("double")
    return F.when(n > 1e10, n).when(n > 1e6, n * 1000).otherwise(now_ms + n * 1000)


def effective_status(enabled: Column, stored: Column, last_test: Column) -> Column:
    """disabled, else the stored status, else that of the last test."""
    return F.when(~enabled, "disabled").otherwise(F.coalesce(stored, last_test, F.lit("never_tested")))


def store_seo_title(store: Column, year: int, brand: str) -> Column:
    """X32."""
    return F.concat(store, F.lit(f" Coupons, Promo Codes & Deals {year} | {brand}"))


def coupon_seo_title(title: Column, store: Column, year: int, brand: str) -> Column:
    """X32."""
    return F.concat(title, F.lit(" | "), store, F.lit(f" Coupons {year} | {brand}"))


def canonical_url(site: str, store: Column, fragment: Column | None = None) -> Column:
    """A store's page; an offer is a fragment of it."""
    page = F.concat(F.lit(f"{site}/"), store, F.lit("-coupons"))
    return page if fragment is None else F.concat(page, F.lit("#"), fragment)
