"""The offer catalogue as views over the base tables.

Each view is one SQL text in the common subset of Spark SQL and DuckDB, so that the
engine and its oracle start from the same rows. A view may read other views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The fixed clock of all reports.
NOW = "2024-01-31 00:00:00"
TODAY = "2024-01-31"

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "labels")

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "categories": (("nation",), "select n_nationkey as id, n_name as name, lower(replace(n_name,'_','-')) as slug, n_regionkey as parent_id from nation"),
    "stores": (
        ("supplier",),
        "select s_suppkey as id, s_name as name, lower(replace(s_name,'#','-')) as slug, s_nationkey as category_id, s_acctbal > 5000 as featured, s_acctbal as balance from supplier",
    ),
    "coupons": (
        ("part", "supplier"),
        """select p_partkey as id, p_partkey % (select count(*) from supplier) as store_id,
 concat(cast(p_size as string), '% off ', p_name) as title,
 case when p_type in ('PROMO','ECONOMY','SMALL') then upper(replace(concat(p_name, cast(p_size as string)),' ','')) end as coupon_code,
 case when p_type in ('PROMO','ECONOMY','SMALL') then 'code' else 'deal' end as coupon_type,
 case when p_size <= 30 then 'percentage' else 'fixed' end as discount_type, cast(p_size as double) as discount_value,
 date '2024-01-31' - cast(p_partkey % 60 as int) as created_at,
 case when p_partkey % 7 = 0 then null else date '2024-01-21' + cast(p_partkey % 45 as int) end as expiry_date,
 case when p_partkey % 7 <> 0 and p_partkey % 45 < 10 then 'expired' when p_partkey % 11 = 0 then 'draft' else 'active' end as status,
 p_partkey % 13 = 0 as featured_in_banner from part""",
    ),
    "coupon_clicks": (
        ("events",),
        """select event_id as id, cast(regexp_extract(props, '"k": ([0-9]+)', 1) as bigint) as coupon_id, ts as clicked_at,
 case when value < 50 then '/home' else '/store' end as source_page, user_id from events where event_type = 'click'""",
    ),
    "saved_coupons": (
        ("events",),
        """select user_id, cast(regexp_extract(props, '"k": ([0-9]+)', 1) as bigint) as coupon_id, min(ts) as created_at
 from events where event_type = 'purchase' group by 1, 2""",
    ),
    "search_queries": (
        ("events", "part"),
        """select e.event_id as id, e.user_id, case when e.event_id % 3 = 0 then concat('  ', upper(p.p_name), ' ') else p.p_name end as query,
 case when e.event_type = 'view' then 'search' else 'ai' end as source, e.ts as created_at
 from events e join part p on p.p_partkey = cast(regexp_extract(e.props, '"k": ([0-9]+)', 1) as bigint) where e.event_type in ('view','signup')""",
    ),
    # Arrival order is the order of all columns of a line: seq numbers it in the oracle, `arrival` holds it here.
    "promotions": (
        ("lineitem", "part"),
        """select concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)) as provider_entity_id, 'net' as provider,
 l_orderkey, l_linenumber, l_partkey, l_suppkey as advertiser_id, l_quantity, l_extendedprice, l_discount, l_tax, p.p_name as title,
 case when l_linestatus = 'O' then concat('C', cast(l_partkey as string)) else 'N/A' end as code, round(l_discount * 100, 6) as discount_percent,
 case l_returnflag when 'N' then 'ACTIVE' when 'R' then 'EXPIRED' else 'PENDING' end as state, cast(l_shipdate as date) as start_date,
 l_returnflag, l_linestatus from lineitem join part p on p.p_partkey = l_partkey""",
    ),
    # Raw records of a provider as JSON: by their number some are whole, some lack what they need, some are no objects.
    "raw_stores": (
        ("supplier",),
        """select s_suppkey as seq, case s_suppkey % 7
 when 0 then concat('{"CampaignId":', cast(s_suppkey as string), ',"CampaignName":" ', s_name, ' ","AdvertiserId":"A', cast(s_suppkey % 3 as string), '","CampaignUrl":"https://shop.example/', cast(s_suppkey as string), '","Categories":["a"," b ","",7],"CampaignLogoUri":"//cdn.example.com/l.png","ContractStatus":"Active","Extra":{"q":[1]},"TrackingLink":"https://t.example/', cast(s_suppkey as string), '"}')
 when 1 then concat('{"id":"s-', cast(s_suppkey as string), '","Name":"","ADVERTISERNAME":"', s_name, '","Categories":"a, b|c","Status":"Expired","note":true}')
 when 2 then concat('{"AdvertiserId":', cast(s_suppkey as string), ',"advertiserId":', cast(s_suppkey as string), ',"AdvertiserName":"', s_name, '","country":"US","Logo":"junk","Commission":2.5,"shippingRegions":["US"," ","CA"]}')
 when 3 then '{"Name":"only a name"}' when 4 then concat('{"Id":', cast(s_suppkey as string), ',"Name":null}') when 5 then '[1,2]' else '{"Id":' end as record from supplier""",
    ),
    "raw_offers": (
        ("part",),
        """select p_partkey as seq, case p_partkey % 6
 when 0 then concat('{"PromotionIds":', cast(p_partkey as string), ',"PromotionTitle":"', p_name, '","CampaignId":7,"AdvertiserId":"A', cast(p_partkey % 3 as string), '","PromoCode":"C', cast(p_partkey as string), '","DiscountPercent":"', cast(p_size as string), '%","StartDate":"2024-01-05","EndDate":"2024-0', cast(1 + p_partkey % 4 as string), '-20","TrackingLink":"https://t.example/p","Terms":" some terms ","State":"ACTIVE","x":{"y":null}}')
 when 1 then concat('{"Id":', cast(p_partkey as string), ',"Name":"Take $5 off ', p_name, '","CampaignId":"none such","PromotionEffectiveDates":"2024-01-01/2024-01-15","Status":"live","Uri":"/relative","Code":"None","Value":""}')
 when 2 then concat('{"PromotionId":', cast(p_partkey as string), ',"Description":"BOGO on ', p_name, '","AdvertiserId":"A0","GenericRedemptionCode":"N/A","CouponCode":"X1"}')
 when 3 then concat('{"Id":', cast(p_partkey as string), '}') when 4 then '{"Title":"no id"}' else 'null' end as record from part""",
    ),
    "raw_categories": (
        ("nation",),
        """select n_nationkey as seq, case n_nationkey % 4 when 0 then '7' when 1 then concat('{"CatalogName":"', n_name, '"}')
 when 2 then concat('{"CategoryId":', cast(n_nationkey as string), ',"Name":"', n_name, '","ParentId":', cast(n_regionkey as string), ',"a":[1]}')
 else concat('{"Id":"c', cast(n_nationkey as string), '","NAME":" ', n_name, '","CampaignId":""}') end as record from nation""",
    ),
    # Records of the two feeds that enrichment loads, and promotions.
    "raw_ads": (
        ("part",),
        """select p_partkey as n, case p_partkey % 5
 when 0 then concat('{"PromotionIds":"P', cast(p_partkey as string), '","CampaignId":', cast(p_partkey % 50 as string), ',"AdvertiserId":"A', cast(p_partkey % 20 as string), '","Name":"', p_name, '","Code":"C', cast(p_partkey as string), '","TrackingLink":"https://t.example/', cast(p_partkey as string), '","Description":"about ', p_name, '"}')
 when 1 then concat('{"CampaignId":', cast(p_partkey % 50 as string), ',"Title":"', p_name, '","Name":null,"LandingPageUrl":"https://www.shop', cast(p_partkey % 7 as string), '.example/x"}')
 when 2 then concat('{"AdvertiserId":"A', cast(p_partkey % 20 as string), '","Name":"","DealName":"N/A","CouponCode":"K ', cast(p_partkey % 30 as string), '","TrackingUrl":" "}')
 when 3 then concat('{"AdvertiserId":', cast(100000 + p_partkey as string), ',"Description":"only ', cast(p_partkey as string), '"}') else '[1]' end as record from part""",
    ),
    "raw_campaigns": (
        ("supplier",),
        """select s_suppkey as n, concat('{"Id":', cast(s_suppkey % 60 as string), ',"AdvertiserId":"A', cast(s_suppkey % 25 as string), '","CampaignName":"', s_name, '","TrackingLink":"https://c.example/', cast(s_suppkey as string), '","CampaignUrl":"https://www.c', cast(s_suppkey as string), '.example/","DeeplinkDomains":["a.example",null," b.example "],"Geos":"US|CA","Country":"', case when s_suppkey % 3 = 0 then 'none' else 'US' end, '"}') as record from supplier""",
    ),
    "raw_promotions": (
        ("part",),
        """select p_partkey as n, case p_partkey % 6
 when 0 then concat('{"Id":"P', cast(p_partkey as string), '","CampaignId":7}') when 1 then concat('{"Id":1,"ProgramId":"', cast(p_partkey % 55 as string), '","PromotionTitle":"', upper(p_name), '!"}')
 when 2 then concat('{"AdvertiserId":"A', cast(p_partkey % 30 as string), '","Title":"', p_name, '"}') when 3 then concat('{"AdvertiserId":"A', cast(p_partkey % 20 as string), '","Code":"k-', cast(p_partkey % 30 as string), '"}')
 when 4 then concat('{"AdvertiserId":', cast(100000 + p_partkey - 1 as string), '}') else 'true' end as record from part""",
    ),
}

#: The columns whose order is the promotions' order of arrival.
ARRIVAL = ("l_orderkey", "l_linenumber", "l_partkey", "advertiser_id", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "start_date")


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of the catalogue, or a base table."""
    if name not in VIEWS:
        return base_table(spark, sf_dir, name)
    needs, text = VIEWS[name]
    return spark.sql(_bound(text, needs), **{need: view(spark, sf_dir, need) for need in needs})


def _bound(text: str, needs: tuple[str, ...]) -> str:
    """The text with the tables after FROM and JOIN as parameters."""
    plain = text.replace("{", "{{").replace("}", "}}")
    return re.sub(rf"\b(from|join) ({'|'.join(needs)})\b", r"\1 {\2}", plain)


def oracle(text: str, *names: str) -> str:
    """SQL over views: the text with the views it names as common table expressions.

    A text that goes on with expressions of its own begins with a comma.
    """
    text = text.replace("count_if(", "count(*) filter (")  # a BIGINT, as in Spark
    return "with " + ", ".join(f"{n} as ({VIEWS[n][1]})" for n in names) + " " + text.strip()
