"""Queries from raw JSON records to canonical rows and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealforge.operators import normalize
from dealforge.plans.registry import query
from dealforge.sources.catalogue import TODAY, oracle, view

SITE, BRAND, YEAR = "https://example.com", "Shop", 2024

_STORES = """, st as (select seq, case seq % 7 when 1 then concat('s-', seq) else cast(seq as varchar) end as provider_entity_id,
 case seq % 7 when 1 then concat('s-', seq) else cast(seq as varchar) end as campaign_id, case seq % 7 when 0 then concat('A', seq % 3) when 2 then cast(seq as varchar) end as advertiser_id, s_name as name,
 case when seq % 7 = 0 then concat('https://shop.example/', seq) end as website, case when seq % 7 = 0 then 'https://cdn.example.com/l.png' end as logo,
 case seq % 7 when 0 then 'a|b|7' when 1 then 'a|b|c' else '' end as categories, case when seq % 7 = 2 then 'US' end as country, case seq % 7 when 0 then 'active' when 1 then 'expired' else 'unknown' end as status,
 case when seq % 7 = 2 then '2.5' end as commission,
 case seq % 7 when 0 then concat('Extra={"q":[1]};originalLogo=//cdn.example.com/l.png;trackingLink=https://t.example/', seq) when 1 then 'note=true' else 'logoWarning=logo could not be resolved to an absolute http(s) url;originalLogo=junk;shippingRegions=["US"," ","CA"]' end as metadata
 from raw_stores join supplier on s_suppkey = seq where seq % 7 < 3)"""
_LINK = "(select concat('https://t.example/', max(seq)) from raw_stores where seq % 21 = 0)"
_OFFERS = f""", o as (select seq, seq % 6 as k, cast(seq as varchar) as provider_entity_id, case when seq % 6 = 0 then 'coupon' else 'deal' end as kind,
 case seq % 6 when 0 then concat('A', seq % 3) when 1 then 'none such' else 'A0' end as store_provider_id, case seq % 6 when 0 then p_name when 1 then concat('Take $5 off ', p_name) else concat('BOGO on ', p_name) end as title,
 case when seq % 6 = 2 then concat('BOGO on ', p_name) end as description, case when seq % 6 = 0 then concat('C', seq) end as code, case when seq % 6 = 0 then 'percentage' end as discount_type, case when seq % 6 = 0 then p_size::double end as discount_value,
 case seq % 6 when 0 then date '2024-01-05' when 1 then date '2024-01-01' end as start_date, case seq % 6 when 0 then make_date(2024, (1 + seq % 4)::int, 20) when 1 then date '2024-01-15' end as end_date,
 case seq % 6 when 0 then 'https://t.example/p' when 2 then {_LINK} end as tracking_url, case when seq % 6 = 0 then 'some terms' end as terms, case when seq % 6 = 2 then 'unknown' else 'active' end as status,
 case seq % 6 when 0 then 'x={{"y":null}}' when 1 then 'Code=None;Uri=/relative;Value=;trackingUrlWarning=no tracking url available for this promotion'
  else concat('CouponCode=X1;GenericRedemptionCode=N/A;trackingUrlWarning=', case when {_LINK} is null then 'no tracking url available for this promotion' else 'tracking url fell back to the campaign tracking link' end) end as metadata
 from raw_offers join part on p_partkey = seq where seq % 6 < 3)"""


def told(metadata):
    """A map as one text, in order of its keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def _stores(spark, d):
    return normalize.normalize_stores(view(spark, d, "raw_stores"), normalize.alias_table(spark), "seq")


def _offers(spark, d):
    links = normalize.store_links(_stores(spark, d)[0].withColumnRenamed("seq", "index"))
    return normalize.normalize_offers(view(spark, d, "raw_offers"), normalize.alias_table(spark), links, index="seq")


def _sluggish(stores):
    return stores.withColumn("slug", F.lower(F.replace("name", F.lit("#"), F.lit("-")))).withColumnRenamed("seq", "index")


@query(oracle(f"{_STORES} select * from st", "raw_stores"))
def normalize_stores(spark, d):
    """X1 to X14 composed: campaigns as stores."""
    rows = _stores(spark, d)[0].drop("description")
    return rows.withColumn("categories", F.array_join("categories", "|")).withColumn("metadata", told("metadata"))


@query(oracle(f"{_OFFERS} select * exclude (k) from o", "raw_stores", "raw_offers"))
def normalize_offers(spark, d):
    """U3, X11 to X16 composed: promotions as coupons and deals, with the stores' tracking links."""
    rows = _offers(spark, d)[0].drop("advertiser_id", "campaign_id")
    return rows.withColumn("start_date", F.to_date("start_date")).withColumn("end_date", F.to_date("end_date")).withColumn("metadata", told("metadata"))


@query(
    oracle(
        "select seq, case seq % 4 when 3 then concat('c', seq) else cast(seq as varchar) end as provider_entity_id, n_name as name, case when seq % 4 = 2 then cast(n_regionkey as varchar) end as parent_id, case when seq % 4 = 2 then 'a=[1]' else '' end as metadata from raw_categories join nation on n_nationkey = seq where seq % 4 > 1",
        "raw_categories",
    )
)
def normalize_categories(spark, d):
    rows, _ = normalize.normalize_categories(view(spark, d, "raw_categories"), normalize.alias_table(spark), "seq")
    return rows.withColumn("metadata", told("metadata"))


@query(
    oracle(
        """select 'store' as entity, seq as index, case seq % 7 when 3 then 'Store record is missing CampaignId/Id' when 4 then concat('Store ', seq, ' is missing a name') else 'Store record is not an object' end as reason from raw_stores where seq % 7 > 2
 union all select 'deal', seq, case seq % 6 when 3 then concat('Deal ', seq, ' is missing a title') when 4 then 'Deal record is missing PromotionIds' else 'Deal record is not an object' end from raw_offers where seq % 6 > 2
 union all select 'category', seq, case seq % 4 when 0 then 'Category record is not an object' else 'Category record is missing Id' end from raw_categories where seq % 4 < 2""",
        "raw_stores", "raw_offers", "raw_categories",
    )
)
def normalize_issues(spark, d):
    """What is wrong with which record."""
    categories = normalize.normalize_categories(view(spark, d, "raw_categories"), normalize.alias_table(spark), "seq")[1]
    return _stores(spark, d)[1].unionByName(_offers(spark, d)[1]).unionByName(categories)


@query(
    oracle(
        f"""{_STORES} select provider_entity_id, name, lower(replace(name, '#', '-')) as slug, logo as logo_url, case seq % 7 when 0 then '//cdn.example.com/l.png' when 2 then 'junk' end as logo_source_url, website as affiliate_url, country,
 case when seq % 7 = 2 then 'US,CA' else '' end as shipping_regions, concat(name, ' Coupons, Promo Codes & Deals 2024 | Shop') as seo_title,
 concat('Save more with verified ', name, ' coupons, promo codes and exclusive deals updated regularly on Shop.') as seo_description, concat('https://example.com/', lower(replace(name, '#', '-')), '-coupons') as seo_canonical_url from st""",
        "raw_stores",
    )
)
def payload_stores(spark, d):
    """K2: what is written of a store."""
    rows = normalize.store_payload(_sluggish(_stores(spark, d)[0]), SITE, BRAND, YEAR)
    return rows.drop("description", "category_provider_id", "metadata").withColumn("shipping_regions", F.array_join("shipping_regions", ","))


_FOUND = """, keyed as (select unnest([provider_entity_id, advertiser_id, campaign_id]) as key, seq, name from st), ix as (select key, arg_max(name, seq) as store from keyed where key is not null group by 1),
 p as (select o.*, coalesce(a.store, c.store) as store from o left join ix a on a.key = store_provider_id left join ix c on c.key = '7' and k = 0)"""


@query(
    oracle(
        f"""{_STORES} {_OFFERS} {_FOUND} select provider_entity_id, store_provider_id, title, description, code as coupon_code, case when k = 0 then 'code' else 'deal' end as coupon_type, tracking_url as affiliate_url, end_date as expiry_date, start_date,
 case when end_date < date '2024-01-31' then 'expired' when start_date > date '2024-01-31' then 'draft' else 'active' end as status, terms, discount_type, discount_value,
 concat(title, ' | ', coalesce(store, 'this store'), ' Coupons 2024 | Shop') as seo_title, concat('Save with ', coalesce(store, 'this store'), ' using this verified offer: ', title, '. Updated regularly on Shop.') as seo_description,
 'https://example.com/' || lower(replace(store, '#', '-')) || '-coupons#' || regexp_replace(regexp_replace(lower(title), '[^a-z0-9_\\s-]', '', 'g'), '[\\s_-]+', '-', 'g') as seo_canonical_url from p""",
        "raw_stores", "raw_offers",
    )
)
def payload_offers(spark, d):
    """K2: what is written of a coupon or deal."""
    rows = normalize.offer_payload(_offers(spark, d)[0].withColumnRenamed("seq", "index"), _sluggish(_stores(spark, d)[0]), TODAY, SITE, BRAND, YEAR)
    return rows.drop("landing_page_url", "metadata")
