"""What offers are enriched from, loaded page by page and joined (S10 with J7, J8, J11).

Advertisements and campaigns are two feeds; each is read to its end once, side by side,
and becomes rows. Promotions take the advertisement that the cascade finds and the
campaign of their advertiser, else of their campaign. A record that is no object is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealforge.functions.offers import domain_of
from dealforge.functions.text import clean_string, string_list
from dealforge.operators import enrich
from dealforge.operators.normalize import entries, kind_of, last_of_each, settled
from dealforge.session import stored

# The names under which a record may hold a field, in order of preference; names match exactly.
AD = {
    "promotion_id": ("PromotionIds", "PromotionId", "Promotion"), "campaign_id": ("CampaignId", "ProgramId"), "advertiser_id": ("AdvertiserId",),
    "title": ("Name", "DealName", "AdName", "Title", "Description"), "code": ("Code", "DealDefaultPromoCode", "CouponCode", "PromoCode"),
    "description": ("Description", "DealDescription", "ShortDescription", "AdDescription"), "tracking": ("TrackingLink", "TrackingUrl", "ClickUrl"),
    "landing": ("LandingPageUrl", "DestinationUrl", "TargetUrl", "Url"), "offer_code": ("CouponCode", "PromoCode", "GenericRedemptionCode", "Code", "DealDefaultPromoCode"),
}
CAMPAIGN = {
    "campaign_id": ("CampaignId", "ProgramId", "Id"), "advertiser_id": ("AdvertiserId",), "name": ("AdvertiserName", "CampaignName", "Name"), "country": ("Country", "CountryCode", "AdvertiserCountry"),
    "tracking": ("TrackingLink", "TrackingUrl"), "landing": ("CampaignUrl", "AdvertiserUrl", "LandingPageUrl", "Url"), "currency": ("Currency", "CurrencyCode", "PayoutCurrency"),
}
CAMPAIGN_LISTS = {"domains": ("DeeplinkDomains", "AllowedDeeplinkDomains"), "regions": ("ShippingRegions", "ShipsTo", "ShippingCountries", "AllowedCountries", "Geos")}
PROMOTION = {
    "promotion_id": ("PromotionIds", "PromotionId", "Id"), "campaign_id": ("CampaignId", "ProgramId"), "advertiser_id": ("AdvertiserId",),
    "title": ("PromotionTitle", "Name", "Title"), "code": ("GenericRedemptionCode", "PromoCode", "CouponCode", "Code"),
}


def _text(value: Column, kind: Column) -> Column:
    """A text without words for "no value", or a number; null for other values."""
    return F.when(~kind.rlike("^(ARRAY|OBJECT|BOOLEAN$)"), clean_string(F.try_variant_get(value, "$", "string")))


def rows_of(records: DataFrame, fields: dict, lists: dict | None = None, *carried: str) -> DataFrame:
    """carried columns, fields and lists of the records (column record) that are objects.

    Every entry is judged once: null and '' are no values, and of a field's names the
    first that has a value tells it.
    """
    parsed = settled(records, *carried, pairs=entries(F.col("record"))).filter("pairs is not null")
    keys = F.transform("pairs", lambda e: e["key"])
    kinds = F.transform(F.when(F.size(F.array_distinct(keys)) < F.size(keys), last_of_each(F.col("pairs"), "key")).otherwise(F.col("pairs")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), kind_of(e["value"]).alias("kind")))
    valued = F.filter(kinds, lambda e: (e["kind"] != "VOID") & (F.coalesce(F.try_variant_get(e["value"], "$", "string"), F.lit("-")) != ""))
    of_array = lambda e: F.when(e["kind"].startswith("ARRAY"), F.transform(F.try_variant_get(e["value"], "$", "array<variant>"), lambda v: _text(v, kind_of(v))))
    told = F.transform(valued, lambda e: F.struct(e["key"], F.struct(_text(e["value"], e["kind"]).alias("text"), *([of_array(e).alias("texts")] if lists else []))))
    wide = settled(parsed, *carried, told=F.map_from_entries(told))
    present = lambda names: F.coalesce(*[F.try_element_at("told", F.lit(n)) for n in names])
    wide = settled(wide, *carried, **{k: present(names) for k, names in (fields | (lists or {})).items()})
    texts = lambda k: F.filter(F.coalesce(F.col(k)["texts"], string_list(F.col(k)["text"])), lambda s: s.isNotNull())
    return wide.select(*carried, *[F.col(k)["text"].alias(k) for k in fields], *[F.coalesce(texts(k), F.array().cast("array<string>")).alias(k) for k in lists or {}])


def arrival(records: DataFrame) -> DataFrame:
    """Records of a feed (page, place, record) with seq, their order; errors are left out."""
    return records.filter("record is not null").withColumn("seq", F.col("page").cast("long") * (1 << 32) + F.col("place"))


def enrich_offers(promotions: DataFrame, ads: DataFrame, campaigns: DataFrame, index: str = "index") -> DataFrame:
    """The promotions (index, record) that are objects, with what advertisement and campaign add.

    ads and campaigns: records of the two feeds. Of campaigns that share an id the last
    one stands. Columns: index, matched_by, description, code, tracking_url, tracking_source,
    landing_page, advertiser_name, country, currency, regions, domains.
    """
    found = stored(enrich.with_keys(rows_of(arrival(ads), AD, None, "seq"), "title", "code"), "ads")  # six indexes read it
    payload = ["description", "offer_code", "tracking", "landing"]
    known = stored(rows_of(arrival(campaigns), CAMPAIGN, CAMPAIGN_LISTS, "seq"), "campaigns")
    table = enrich.last_by_keys(known, ["campaign_id", "advertiser_id"], "seq", F.struct("name", "country", "tracking", "landing", "currency", "domains", "regions"))
    offers = enrich.with_keys(rows_of(promotions.repartition(index), PROMOTION, None, index), "title", "code")
    joined = enrich.look_up_first(enrich.cascade(offers, found, "seq", payload), ["advertiser_id", "campaign_id"], table, "campaign")
    c = F.col
    url, landing = F.coalesce("ad.tracking", "campaign.tracking"), F.coalesce("ad.landing", "campaign.landing")
    none = F.array().cast("array<string>")
    domains = F.array_distinct(F.concat(F.coalesce("campaign.domains", none), F.array_compact(F.array(domain_of(c("campaign.landing")), domain_of(landing)))))
    return joined.select(
        index, "matched_by", c("ad.description").alias("description"), c("ad.offer_code").alias("code"), url.alias("tracking_url"),
        F.when(c("ad.tracking").isNotNull(), "ad").when(url.isNotNull(), "campaign").alias("tracking_source"), landing.alias("landing_page"), c("campaign.name").alias("advertiser_name"),
        c("campaign.country").alias("country"), c("campaign.currency").alias("currency"), F.coalesce("campaign.regions", none).alias("regions"), domains.alias("domains"),
    )


def enrichment_stats(enriched: DataFrame, ads: DataFrame, campaigns: DataFrame) -> DataFrame:
    """One row: ad_records, campaign_records, offers, with_ad, with_campaign_url."""
    objects = lambda df, name: arrival(df).agg(F.count_if(entries(F.col("record")).isNotNull()).alias(name))
    counts = enriched.agg(F.count("*").alias("offers"), F.count("matched_by").alias("with_ad"), F.count_if(F.col("tracking_source") == "campaign").alias("with_campaign_url"))
    return counts.crossJoin(objects(ads, "ad_records")).crossJoin(objects(campaigns, "campaign_records"))  # one row each
