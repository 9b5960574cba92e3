"""What operators see before an import is applied (X40), and what logs may show of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealforge.functions import offers as of
from dealforge.functions.text import clean_string
from dealforge.operators import enrich
from dealforge.operators.normalize import OFFER_DESCRIPTION, STORE_DESCRIPTION, sentence

# Headers, parameters and body keys whose values no log shows, and what stands for them.
SECRET_HEADERS = ("authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "x-auth-token", "api-key", "apikey")
SECRET_PARAMETERS = ("apikey", "api_key", "token", "access_token", "auth", "signature")
SECRET_BODY_KEYS = "password|api_?key|token|secret|authorization"
REDACTED, TRUNCATED = "[REDACTED]", "…[truncated]"
NO_STORE = "this store"


def redact_headers(headers: Column) -> Column:
    """A map of headers without secrets; names match in any case. Null is an empty map."""
    safe = F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(*SECRET_HEADERS), REDACTED).otherwise(v))
    return F.coalesce(safe, F.create_map().cast("map<string,string>"))


def redact_url(url: Column) -> Column:
    """An address whose secret parameters have no value; every one of a name that comes twice. What has no scheme stays."""
    hidden = F.regexp_replace(url, rf"([?&](?:{'|'.join(SECRET_PARAMETERS)})=)[^&#]*", "$1%5BREDACTED%5D")
    fragment = F.regexp_extract(url, "#.*$", 0)  # not a parameter, whatever it looks like
    whole = F.concat(F.regexp_replace(hidden, "#.*$", ""), fragment)
    return F.when(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), whole).otherwise(url)


def redact_body(body: Column, length: int = 500) -> Column:
    """A JSON text without the values of secret keys, cut to a length. Null is "null"."""
    hidden = F.regexp_replace(F.coalesce(body, F.lit("null")), rf'(?i)("(?:{SECRET_BODY_KEYS})"\s*:\s*)"[^"]*"', f'$1"{REDACTED}"')
    return F.when(F.length(hidden) > length, F.concat(F.substring(hidden, 1, length), F.lit(TRUNCATED))).otherwise(hidden)


def presentation_rows(stores: DataFrame, offers: DataFrame, year: int, brand: str, seq: str = "seq") -> DataFrame:
    """How canonical stores and offers will look: titles, descriptions and what is there of logo, text, links.

    stores: seq, provider_entity_id, advertiser_id, campaign_id, name, logo, description, metadata; offers: seq, entity, provider_entity_id, advertiser_id,
    store_id, campaign_id, title, description, tracking_url, metadata. An offer's store is
    found by advertiser, store or campaign; of stores that share an id the last one counts.
    A store without a name gives its offers none.
    """
    c, text = F.col, lambda k: F.coalesce(F.col(k), F.lit(""))
    meta = lambda k: clean_string(F.try_element_at("metadata", F.lit(k)))
    there = lambda v: F.when(v.isNotNull(), "present").otherwise("missing")
    columns = ["entity", "provider_entity_id", "name", "seo_title", "seo_description", "logo_status", "description_status", "tracking_source", "landing_page_status", seq]
    shown = stores.select(
        F.lit("store").alias("entity"), "provider_entity_id", text("name").alias("name"), of.store_seo_title(text("name"), year, brand).alias("seo_title"),
        sentence(STORE_DESCRIPTION, store=text("name"), brand=F.lit(brand)).alias("seo_description"), of.logo_status(clean_string(c("logo"))).alias("logo_status"),
        there(clean_string(c("description"))).alias("description_status"), F.when(meta("trackingLink").isNotNull(), "campaign").otherwise("none").alias("tracking_source"),
        there(meta("landingPageUrl")).alias("landing_page_status"), seq,
    )
    table = enrich.last_by_keys(stores, ["provider_entity_id", "advertiser_id", "campaign_id"], seq, F.nullif(text("name"), F.lit("")))
    found = enrich.look_up_first(offers, ["advertiser_id", "store_id", "campaign_id"], table, "__store")
    store = F.coalesce("__store", meta("advertiserName"), F.lit(NO_STORE))
    rows = found.select(
        "entity", "provider_entity_id", text("title").alias("name"), of.coupon_seo_title(text("title"), store, year, brand).alias("seo_title"),
        sentence(OFFER_DESCRIPTION, store=store, title=text("title"), brand=F.lit(brand)).alias("seo_description"), F.lit("missing").alias("logo_status"),
        there(clean_string(c("description"))).alias("description_status"), of.tracking_source(clean_string(c("tracking_url")), meta("trackingUrlWarning"), meta("enrichmentAdId")).alias("tracking_source"),
        there(meta("landingPageUrl")).alias("landing_page_status"), seq,
    )
    return shown.select(*columns).unionByName(rows.select(*columns))


def preview(rows: DataFrame, limit: int = 50, seq: str = "seq") -> DataFrame:
    """The first rows: stores, then coupons, then deals, each as they came."""
    return rows.orderBy(F.array_position(F.array(*map(F.lit, ("store", "coupon", "deal"))), F.col("entity")), seq).limit(limit)
