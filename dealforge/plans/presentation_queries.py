"""Queries of the preview of an import, of what logs show, and of who gets a newsletter."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealforge.operators import presentation, reports
from dealforge.plans.registry import query
from dealforge.sources.catalogue import base_table, oracle, view

# Stores share advertisers, and some have no name; of offers some name a store by advertiser, some by its id, some by campaign, some by none.
_SHOPS = """select id as seq, concat('s', cast(id as string)) as provider_entity_id, concat('a', cast(id % 9 as string)) as advertiser_id, concat('c', cast(id % 50 as string)) as campaign_id, case when id % 10 = 4 then '' else name end as name,
 case id % 3 when 0 then 'n/a' when 1 then 'https://x.example/storage/v1/object/public/l.png' else '//p.example/l.png' end as logo, case when id % 4 = 0 then ' ' else slug end as description, case when id % 2 = 0 then 'https://t.example' end as link from stores"""
_OFFERED = """select id as seq, coupon_type as entity, concat('o', cast(id as string)) as provider_entity_id, case when id % 5 = 0 then concat('a', cast(id % 12 as string)) end as advertiser_id, case when id % 5 = 1 then concat('s', cast(store_id as string)) end as store_id,
 case when id % 5 = 2 then concat('c', cast(id % 60 as string)) end as campaign_id, title, case when id % 3 = 0 then null else title end as description, case when id % 4 > 0 then 'https://go.example' end as url, case when id % 6 = 1 then 'Fell back to the CAMPAIGN link' end as warning,
 case when id % 7 = 2 then '9' end as ad, case when id % 5 = 3 then 'Told' end as told, case when id % 8 = 0 then 'https://l.example' end as landing from coupons"""
_NAMED = """, named as (select key, arg_max(coalesce(name, ''), seq * 3 + nth) as name from (select seq, name, unnest([provider_entity_id, advertiser_id, campaign_id]) as key, unnest([0, 1, 2]) as nth from shops) group by 1)"""
_FROM = " from (select * replace (coalesce(nullif(a.name, ''), nullif(b.name, ''), nullif(c.name, ''), told, 'this store') as told) from offered left join named a on a.key = advertiser_id left join named b on b.key = offered.store_id left join named c on c.key = campaign_id)"


@query(
    oracle(
        f""", shops as ({_SHOPS}), offered as ({_OFFERED}) {_NAMED} select 'store' as entity, provider_entity_id, name, name || ' Coupons, Promo Codes & Deals 2024 | Shop' as seo_title,
 'Save more with verified ' || name || ' coupons, promo codes and exclusive deals updated regularly on Shop.' as seo_description, case seq % 3 when 0 then 'missing' when 1 then 'hosted' else 'provider' end as logo_status,
 case when seq % 4 = 0 then 'missing' else 'present' end as description_status, case when seq % 2 = 0 then 'campaign' else 'none' end as tracking_source, 'missing' as landing_page_status from shops
 union all select entity, provider_entity_id, title, title || ' | ' || told || ' Coupons 2024 | Shop', 'Save with ' || told || ' using this verified offer: ' || title || '. Updated regularly on Shop.', 'missing', case when seq % 3 = 0 then 'missing' else 'present' end,
 case when seq % 4 = 0 then 'none' when seq % 6 = 1 then 'campaign' when seq % 7 = 2 then 'ad' else 'promotion' end, case when seq % 8 = 0 then 'present' else 'missing' end {_FROM}""",
        "stores", "coupons",
    )
)
def presentation_rows(spark, d):
    """Every row of the preview, before it is cut."""
    pairs = lambda **more: F.map_filter(F.create_map(*[x for k, v in more.items() for x in (F.lit(k), F.col(v))]), lambda _, v: v.isNotNull())
    shops = spark.sql(_SHOPS.replace("from stores", "from {t}"), t=view(spark, d, "stores")).withColumn("metadata", pairs(trackingLink="link"))
    offered = spark.sql(_OFFERED.replace("from coupons", "from {t}"), t=view(spark, d, "coupons")).withColumnRenamed("url", "tracking_url")
    offered = offered.withColumn("metadata", pairs(trackingUrlWarning="warning", enrichmentAdId="ad", advertiserName="told", landingPageUrl="landing"))
    return presentation.presentation_rows(shops, offered, 2024, "Shop").drop("seq")


_REQUESTS = [
    "event_id",
    "map('Authorization', props, 'X-Api-Key', 'k', 'accept', event_type) as headers",
    "concat('https://api.example/v1?user=', cast(user_id as string), '&token=', event_type, '&auth=', cast(event_id as string), '#token=', event_type) as url",
    """concat('{"type": "', event_type, '", "Password" : "p', cast(event_id as string), '", "api_key":"', event_type, '", "fill": "', repeat('x', cast(event_id % 7 as int) * 100), '"}') as body""",
]


@query("""with t as (select event_id, event_type, user_id, '{"type": "' || event_type || '", "Password" : "[REDACTED]", "api_key":"[REDACTED]", "fill": "' || repeat('x', (event_id % 7 * 100)::int) || '"}' as body from events)
 select event_id, '[REDACTED]/[REDACTED]/' || event_type as headers, 'https://api.example/v1?user=' || user_id || '&token=%5BREDACTED%5D&auth=%5BREDACTED%5D#token=' || event_type as url, case when length(body) > 500 then substr(body, 1, 500) || '…[truncated]' else body end as body from t""")
def redacted_requests(spark, d):
    """Headers, addresses and bodies as logs show them."""
    rows = base_table(spark, d, "events").selectExpr(*_REQUESTS)
    return rows.select("event_id", F.array_join(F.map_values(presentation.redact_headers(F.col("headers"))), "/").alias("headers"), presentation.redact_url(F.col("url")).alias("url"), presentation.redact_body(F.col("body")).alias("body"))


@query("select 'c' || c_custkey || '@mail.example' as email, 'u' || c_custkey as unsubscribe_token from customer where c_acctbal > 0 and c_custkey % 3 <> 1 and c_nationkey % 4 <> 2")
def newsletter_recipients(spark, d):
    """A14, second half: who gets the newsletter; a state that is not known is no consent."""
    people = base_table(spark, d, "customer").selectExpr("concat('c', cast(c_custkey as string), '@mail.example') as email", "concat('u', cast(c_custkey as string)) as unsubscribe_token", "c_acctbal > 0 as active", "case when c_nationkey % 4 <> 2 then c_custkey % 3 <> 1 end as verified")
    return reports.newsletter_recipients(people)
