"""Queries of the import side: functions, planning, policy, enrichment, merging."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from dealforge.functions import offers as of
from dealforge.functions import text as tx
from dealforge.operators import access, digests, enrich, imports, merge, policy, reports
from dealforge.plans.registry import query
from dealforge.session import fresh_dir
from dealforge.sources.catalogue import ARRIVAL, NOW, TODAY, base_table, oracle, view

_ORDER = ", ".join(ARRIVAL)
_SEQ = f"seq as (select *, row_number() over (order by {_ORDER}) as seq from promotions)"
_LAST = f"{_SEQ}, last_ as (select *, count(*) over (partition by provider, provider_entity_id) as occurrences from seq qualify row_number() over (partition by provider, provider_entity_id order by seq desc) = 1)"
IDENTITY = ["provider", "provider_entity_id"]


@query(oracle(f", {_LAST} select provider, provider_entity_id, title, code, discount_percent, state, start_date, occurrences from last_", "promotions"))
def dedupe_keep_last(spark, d):
    return imports.keep_last(view(spark, d, "promotions"), IDENTITY, list(ARRIVAL)).select(*IDENTITY, "title", "code", "discount_percent", "state", "start_date", "occurrences")


@query(
    oracle(
        "select 'promotion' as entity, provider || '::' || provider_entity_id as identity, count(*) as occurrences, 'duplicate identity, kept the last of ' || count(*) as reason from promotions group by provider, provider_entity_id having count(*) > 1",
        "promotions",
    )
)
def dedupe_conflicts(spark, d):
    return imports.collisions(view(spark, d, "promotions"), IDENTITY, "promotion")


_STATUS = """case when lower(trim(state)) = '' then 'unknown' when regexp_matches(lower(state), '(^|_)(active|approved|joined|live|running)') then 'active' when regexp_matches(lower(state), 'expire') then 'expired'
 when regexp_matches(lower(state), 'pending|review|applied') then 'pending' when regexp_matches(lower(state), 'inactive|paused|ended|closed|rejected|declined|not') then 'inactive' else 'unknown' end"""


@query(oracle(f"select state, {_STATUS} as status, count(*) as n from promotions group by 1, 2", "promotions"))
def fn_status_map(spark, d):
    return view(spark, d, "promotions").groupBy("state", of.map_status(F.col("state")).alias("status")).agg(F.count("*").alias("n"))


@query(oracle("select id, title, case when regexp_matches(lower(title), '\\d{1,3}\\s*%') then least(regexp_extract(lower(title), '(\\d{1,3})\\s*%', 1)::int, 95) / 100.0 else 0 end::double as discount from coupons", "coupons"))
def fn_discount_parse(spark, d):
    return view(spark, d, "coupons").select("id", "title", of.parse_discount(F.col("title")).alias("discount"))


@query("select s_suppkey as id, s_name, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') as slug, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) as norm_key from supplier")
def fn_slugify(spark, d):
    return view(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_name", tx.slugify(F.col("s_name")).alias("slug"), tx.norm_key(F.col("s_name")).alias("norm_key"))


@query(
    oracle(
        """select distinct code, case when regexp_replace(code, '[^0-9.-]', '', 'g') = '' then 0 else try_cast(regexp_replace(code, '[^0-9.-]', '', 'g') as double) end as as_number,
 try_cast(nullif(regexp_extract(replace(code, ',', ''), '-?\\d+(\\.\\d+)?'), '') as double) as first_number, case when lower(code) not in ('n/a', 'none', 'no code', 'null') then code end as usable from promotions""",
        "promotions",
    )
)
def fn_number_parse(spark, d):
    code = F.col("code")
    return view(spark, d, "promotions").select("code", of.as_number(code).alias("as_number"), of.first_number(code).alias("first_number"), of.usable_code(code).alias("usable")).distinct()


@query(
    oracle(
        """, t as (select id, 'Min purchase $' || discount_value::int || ', up to ' || id || ' off. Limited to 2 orders. Sitewide' as text from coupons)
 select id, regexp_extract(text, '(?i)(?:min(?:imum)?(?:\\s+(?:purchase|order|spend))?|orders?\\s+over|spend)\\D{0,12}([\\d.]+)', 1)::double as minimum_purchase,
 regexp_extract(text, '(?i)up\\s+to\\D{0,12}(\\d+)', 1)::double as maximum_savings, 2.0::double as purchase_limit, 'sitewide' as scope, 'USD' as currency from t""",
        "coupons",
    )
)
def fn_terms_parse(spark, d):
    text = F.concat(F.lit("Min purchase $"), F.col("discount_value").cast("int").cast("string"), F.lit(", up to "), F.col("id").cast("string"), F.lit(" off. Limited to 2 orders. Sitewide"))
    none = F.lit(None).cast("double")
    terms = of.terms_of(text, none, none, none, F.lit(None).cast("string"), F.lit(None).cast("string"))
    return view(spark, d, "coupons").select("id", terms.alias("t")).select("id", "t.*")


@query("select page_id, regexp_matches(url, '^(?i)https?://[^/]+') as is_url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '') as domain from pages")
def fn_url_checks(spark, d):
    url = F.col("url")
    return view(spark, d, "pages").select("page_id", of.is_url(url).alias("is_url"), of.domain_of(url).alias("domain"))


@query(
    oracle(
        "select id, case when expiry_date < date '2024-01-31' then 'expired' when created_at > date '2024-01-31' then 'draft' when status in ('inactive','pending') then 'draft' else 'active' end as offer_status, case when expiry_date < date '2024-01-31' then 'expired' when created_at > date '2024-01-31' then 'draft' when status = 'draft' then 'draft' else 'active' end as stored_status from coupons",
        "coupons",
    )
)
def fn_offer_status(spark, d):
    today = F.lit(TODAY).cast("date")
    args = (F.col("status"), F.col("created_at"), F.col("expiry_date"), today)
    return view(spark, d, "coupons").select("id", of.offer_status(*args).alias("offer_status"), of.stored_status(*args).alias("stored_status"))


@query(
    oracle(
        """select id, case when discount_type = 'percentage' then discount_value::int || '% off' else '$' || discount_value::int || '.00 off' end as discount,
 'Minimum purchase of $' || discount_value::int || '.00 required. Applies to: sitewide.' || case when expiry_date is null then '' else ' Offer valid until ' || strftime(expiry_date, '%B %-d, %Y') || '.' end || ' Terms are set by the merchant and may change without notice.' as terms from coupons""",
        "coupons",
    )
)
def fn_terms_text(spark, d):
    none = F.lit(None).cast("double")
    terms = F.struct(F.col("discount_value").alias("minimum_purchase"), none.alias("maximum_savings"), none.alias("purchase_limit"), F.lit("sitewide").alias("scope"), F.lit(None).cast("string").alias("currency"))
    shown = of.discount_text(F.col("discount_type"), F.col("discount_value"), F.lit(None).cast("string"))
    return view(spark, d, "coupons").select("id", shown.alias("discount"), of.terms_text(terms, F.lit(None).cast("string"), F.col("expiry_date")).alias("terms"))


@query(
    oracle(
        "select c.id, c.title || ' | ' || s.name || ' Coupons 2024 | Shop' as seo_title, 'https://example.com/' || s.slug || '-coupons#' || regexp_replace(regexp_replace(lower(c.title), '[^a-z0-9_\\s-]', '', 'g'), '[\\s_-]+', '-', 'g') as canonical from coupons c join stores s on s.id = c.store_id",
        "coupons", "stores",
    )
)
def fn_seo(spark, d):
    s = view(spark, d, "stores").select(F.col("id").alias("store_id"), F.col("name").alias("store"), F.col("slug").alias("store_slug"))
    rows = view(spark, d, "coupons").join(s, "store_id")
    title = of.coupon_seo_title(F.col("title"), F.col("store"), 2024, "Shop")
    return rows.select("id", title.alias("seo_title"), of.canonical_url("https://example.com", F.col("store_slug"), tx.seo_slug(F.col("title"))).alias("canonical"))


@query("select event_id, try_cast(props->>'k' as bigint) as k, '' as others from events")
def fn_metadata_diff(spark, d):
    record = F.from_json("props", "map<string,string>")
    return view(spark, d, "events").select("event_id", tx.pick(record, "Key", "K").cast("long").alias("k"), F.array_join(F.map_keys(tx.other_keys(record, "K")), ",").alias("others"))


_RAW = """raw as (select id, case when id % 9 = 0 then '' else title end as title, case when id % 8 = 0 then 'odd' else 'active' end as status, case when id % 10 = 0 then null else store_id end as store,
 case when id % 6 = 0 then null when id % 5 = 0 then 'ftp://x' else 'https://shop.example/' || id end as url, case when id % 12 = 0 then 'soon' else '2024-01-01' end as start_date from coupons)"""


def _raw(spark, d):
    c, when = F.col, F.when
    return view(spark, d, "coupons").select(
        "id",
        when(c("id") % 9 == 0, "").otherwise(c("title")).alias("title"),
        when(c("id") % 8 == 0, "odd").otherwise("active").alias("status"),
        when(c("id") % 10 != 0, c("store_id")).alias("store"),
        when(c("id") % 6 == 0, None).when(c("id") % 5 == 0, "ftp://x").otherwise(F.concat(F.lit("https://shop.example/"), c("id").cast("string"))).alias("url"),
        when(c("id") % 12 == 0, "soon").otherwise("2024-01-01").alias("start_date"),
    )


@query(
    oracle(
        f""", {_RAW} select field, reason, severity, count(*) as n from (
 select 'status' as field, 'invalid status "odd"' as reason, 'error' as severity from raw where status = 'odd' union all select 'title', 'empty title', 'error' from raw where title = ''
 union all select 'providerStoreId', 'missing store reference', 'error' from raw where store is null union all select 'trackingUrl', 'missing tracking url', 'warning' from raw where url is null
 union all select 'trackingUrl', 'invalid tracking url (ignored)', 'warning' from raw where url like 'ftp%' union all select 'startDate', 'invalid startDate', 'error' from raw where start_date = 'soon') group by 1, 2, 3""",
        "coupons",
    )
)
def validate_issues(spark, d):
    c = F.col
    issues = imports.offer_issues(c("id"), c("title"), c("status"), c("store"), c("url"), c("start_date"), F.lit(None).cast("string"))
    return imports.validate(_raw(spark, d), "coupon", "id", issues)[1].groupBy("field", "reason", "severity").agg(F.count("*").alias("n"))


@query(
    oracle(
        f""", {_RAW}, bad as (select id, 'error' as type from raw where status = 'odd' or title = '' or store is null or start_date = 'soon')
 select type, count(*) as n from (select 'valid' as type from raw where id not in (select id from bad) union all select 'conflict' from (select provider_entity_id from promotions group by 1 having count(*) > 1)) group by 1""",
        "coupons", "promotions",
    )
)
def issues_union(spark, d):
    c = F.col
    issues = imports.offer_issues(c("id"), c("title"), c("status"), c("store"), c("url"), c("start_date"), F.lit(None).cast("string"))
    valid, _ = imports.validate(_raw(spark, d), "coupon", "id", issues)
    return imports.tagged_union(valid=valid, conflict=dedupe_conflicts(spark, d)).groupBy("type").agg(F.count("*").alias("n"))


_EXISTING = "existing as (select id, case when id % 3 = 0 then 'net' else 'other' end as provider, 'P' || id as provider_entity_id, slug from stores where id % 2 = 0 or id % 3 = 0)"
_INCOMING = "incoming as (select 'net' as provider, 'P' || id as provider_entity_id, case when id % 5 = 0 then slug || '-new' else slug end as slug, name from stores)"


def _existing(spark, d):
    rows = view(spark, d, "stores").filter("id % 2 = 0 or id % 3 = 0")
    return rows.select("id", F.when(F.col("id") % 3 == 0, "net").otherwise("other").alias("provider"), F.concat(F.lit("P"), F.col("id").cast("string")).alias("provider_entity_id"), "slug", F.lit("").alias("description"), F.col("name"))


def _incoming(spark, d):
    slug = F.when(F.col("id") % 5 == 0, F.concat("slug", F.lit("-new"))).otherwise(F.col("slug"))
    return view(spark, d, "stores").select(F.lit("net").alias("provider"), F.concat(F.lit("P"), F.col("id").cast("string")).alias("provider_entity_id"), slug.alias("slug"), F.upper("name").alias("name"), F.lit("new").alias("description"))


@query(
    oracle(
        f""", {_EXISTING}, {_INCOMING} select i.provider_entity_id, coalesce(a.id, b.id) as existing_id, case when a.id is not null then 'provider' when b.id is not null then 'slug' end as matched_by,
 case when coalesce(a.id, b.id) is null then 'create' else 'update' end as action from incoming i left join existing a on a.provider = 'net' and a.provider_entity_id = i.provider_entity_id left join existing b on b.slug = i.slug""",
        "stores",
    )
)
def entity_match(spark, d):
    return imports.match_existing(_incoming(spark, d), _existing(spark, d), "net").select("provider_entity_id", "existing_id", "matched_by", "action")


@query(
    oracle(
        """, s0 as (select 'P' || id as provider_entity_id, case when id % 2 = 0 then 'A' || (id - id % 4) end as advertiser_id, (id * 7) % 101 as arrival from stores),
 s as (select 'P' || id as provider_entity_id, null as advertiser_id from stores union all select arg_max(provider_entity_id, (arrival, provider_entity_id)), advertiser_id from s0 where advertiser_id is not null group by 2),
 o as (select id, case when id % 3 = 0 then 'A' || store_id end as advertiser_id, case when id % 5 = 0 then 'P' || store_id end as campaign_id, case when id % 7 = 0 then 'A' || store_id when id % 4 = 0 then 'P' || store_id end as store_ref_id from coupons)
 select o.id, coalesce(a.provider_entity_id, b.provider_entity_id, c.provider_entity_id, e.provider_entity_id) as store_ref from o left join s a on a.advertiser_id = o.advertiser_id left join s b on b.provider_entity_id = o.campaign_id and b.advertiser_id is null
 left join s c on c.provider_entity_id = o.store_ref_id and c.advertiser_id is null left join s e on e.advertiser_id = o.store_ref_id""",
        "coupons", "stores",
    )
)
def store_resolution(spark, d):
    c, named = F.col, lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    stores = view(spark, d, "stores").select(named("P", "id").alias("provider_entity_id"), F.when(c("id") % 2 == 0, F.concat(F.lit("A"), (c("id") - c("id") % 4).cast("string"))).alias("advertiser_id"), (c("id") * 7 % 101).alias("arrival"))
    refs = F.when(c("id") % 7 == 0, named("A", "store_id")).when(c("id") % 4 == 0, named("P", "store_id"))
    offers = view(spark, d, "coupons").select("id", F.when(c("id") % 3 == 0, named("A", "store_id")).alias("advertiser_id"), F.when(c("id") % 5 == 0, named("P", "store_id")).alias("campaign_id"), refs.alias("store_ref_id"))
    return imports.resolve_stores(offers, stores).select("id", "store_ref")


@query(
    oracle(
        """, b as (select id, 'deal-' || case when store_id % 3 = 0 then 'a' when store_id % 3 = 1 then 'b' else 'c' end as base from coupons),
 r as (select *, row_number() over (partition by base order by id) as n from b) select id, base, case when base = 'deal-a' then base || '-' || (n + 1) when n = 1 then base else base || '-' || n end as slug from r""",
        "coupons",
    )
)
def slug_reserve(spark, d):
    kind = F.when(F.col("store_id") % 3 == 0, "a").when(F.col("store_id") % 3 == 1, "b").otherwise("c")
    rows = view(spark, d, "coupons").select("id", F.concat(F.lit("deal-"), kind).alias("base"))
    return imports.reserve_slugs(rows, spark.createDataFrame([("deal-a",)], "slug string"), ["id"])


@query(
    oracle(
        f""", {_EXISTING}, {_INCOMING}, per as (select provider_entity_id, count(*) as n from (select * from incoming union all select * from incoming where provider_entity_id like '%1') group by 1)
 select 'store' as kind, (select sum(n) from per)::bigint as fetched, (select count(*) from per) as unique_ids, (select count_if(n > 1) from per) as duplicated, (select sum(n - 1) from per)::bigint as dropped,
 count_if(m is null) as to_create, count_if(m is not null) as to_update from (select coalesce(a.id, b.id) as m from incoming i left join existing a on a.provider = 'net' and a.provider_entity_id = i.provider_entity_id left join existing b on b.slug = i.slug)""",
        "stores",
    )
)
def identity_summary(spark, d):
    incoming = _incoming(spark, d)
    arrived = incoming.union(incoming.filter("provider_entity_id like '%1'"))
    return reports.identity_summary(arrived, imports.match_existing(incoming, _existing(spark, d), "net"), "store")


POLICY = policy.Policy(min_coupons=5, max_coupons=8, min_deals=0, max_deals=0, fair_distribution=True, rotation=True, publish_only_active=True)


def _offers(spark, d):
    c = F.col
    return view(spark, d, "coupons").select(
        F.when(c("coupon_type") == "code", "coupon").otherwise("deal").alias("kind"),
        policy.store_key(F.lit(None).cast("string"), c("store_id"), F.lit(None).cast("string")).alias("store_key"),
        F.lpad(c("id").cast("string"), 9, "0").alias("provider_entity_id"), "status", c("created_at").alias("start_date"), c("expiry_date").alias("end_date"), "discount_type", "discount_value",
        F.when(c("featured_in_banner"), 1).otherwise(0).alias("priority"), (c("id") % 17 == 0).alias("manually_disabled"), c("id").alias("seq"),
    )


def _cursors(spark, d):
    keys = _offers(spark, d).select("kind", "store_key").distinct()
    return keys.withColumn("cursor", F.pmod(F.ascii("store_key"), F.lit(5)).cast("int"))


def _decided(spark, d):
    return policy.apply_policy(_offers(spark, d), POLICY, TODAY, _cursors(spark, d))


_OFFERS = """o as (select case when coupon_type = 'code' then 'coupon' else 'deal' end as kind, store_id::varchar as store_key, lpad(id::varchar, 9, '0') as provider_entity_id, id as seq,
 case when expiry_date < date '2024-01-31' then 'expired' when created_at > date '2024-01-31' then 'draft' when status in ('inactive', 'pending') then 'draft' else 'active' end as st,
 case when coupon_type <> 'code' then 0 when discount_type = 'percentage' then discount_value else discount_value / 100 end as discount, created_at as s, coalesce(expiry_date, date '9999-12-31') as e,
 case when featured_in_banner then 1 else 0 end as priority, id % 17 = 0 as off from coupons),
 c as (select *, case when st = 'expired' then 'expired offer' when st <> 'active' then 'offer is not active (' || st || ')' when off then 'manually disabled by an administrator' end as content from o),
 fit as (select *, row_number() over (partition by kind, store_key order by priority desc, discount desc, s desc, e, provider_entity_id) - 1 as rank, count(*) over (partition by kind, store_key) as n from c where content is null),
 lim as (select kind, case when kind = 'coupon' then 5 else 0 end as low, case when kind = 'coupon' then 8 else ceil(count(*) / count(distinct store_key)) end::int as high from fit group by kind),
 p as (select fit.*, low, high, least(high, n) as lim, case when n > least(high, n) then (ascii(store_key) % 5) % n else 0 end as off_ from fit join lim using (kind)),
 q as (select *, ((rank - off_) % n + n) % n as position from p),
 decided as (select kind, store_key, provider_entity_id, seq, rank, position, n, lim, low, off_, case when low > 0 and n < low then 'store has fewer than the minimum of ' || low || ' ' || kind || 's' when position >= lim then 'over the maximum of ' || high || ' ' || kind || 's per store' end as hold_reason from q
 union all select kind, store_key, provider_entity_id, seq, null, null, null, null, null, null, content from c where content is not null),
 dist as (select store_key, count_if(kind = 'coupon' and hold_reason is null) as coupons_published, count_if(kind = 'coupon' and hold_reason is not null) as coupons_held, count_if(kind = 'deal' and hold_reason is null) as deals_published, count_if(kind = 'deal' and hold_reason is not null) as deals_held from decided group by 1)"""


@query(oracle(f", {_OFFERS} select kind, store_key, provider_entity_id, rank::int as rank, position::int as position, hold_reason is null as published, hold_reason from decided", "coupons"))
def policy_decisions(spark, d):
    return _decided(spark, d).offers.select("kind", "store_key", "provider_entity_id", "rank", "position", "published", "hold_reason")


@query(oracle(f", {_OFFERS} select kind, store_key, provider_entity_id, rank::int as rank from fit where rank < 3", "coupons"))
def policy_topk(spark, d):
    plain = policy.Policy(max_coupons=3, max_deals=3)
    rows = policy.apply_policy(_offers(spark, d), plain, TODAY).offers
    return rows.filter("published").select("kind", "store_key", "provider_entity_id", "rank")


@query(oracle(f", {_OFFERS} select kind, store_key, count(*) as held from decided where hold_reason like 'store has fewer%' group by 1, 2", "coupons"))
def policy_min_gate(spark, d):
    rows = _decided(spark, d).offers.filter(F.col("hold_reason").startswith("store has fewer"))
    return rows.groupBy("kind", "store_key").agg(F.count("*").alias("held"))


@query(oracle(f", {_OFFERS} select store_key, count(*) as published from decided where kind = 'deal' and hold_reason is null group by 1", "coupons"))
def policy_fair_cap(spark, d):
    return _decided(spark, d).offers.filter("kind = 'deal' and published").groupBy("store_key").agg(F.count("*").alias("published"))


@query(
    oracle(
        f", {_OFFERS}, moved as (select distinct kind, store_key, ((off_ + lim) % n)::int as cursor from decided where n is not null and not (low > 0 and n < low)) select distinct kind, store_key, coalesce(m.cursor, ascii(store_key) % 5)::int as cursor from o left join moved m using (kind, store_key)",
        "coupons",
    )
)
def policy_rotation(spark, d):
    return _decided(spark, d).cursors


@query(
    oracle(
        f", {_OFFERS}, f as (select kind, store_key, min(seq) as store_first from o group by 1, 2) select kind, provider_entity_id, row_number() over (partition by kind order by position, store_first, store_key)::int as place from decided join f using (kind, store_key) where hold_reason is null",
        "coupons",
    )
)
def policy_interleave(spark, d):
    return policy.interleaved(_decided(spark, d).offers, "seq").select("kind", "provider_entity_id", "place")


_HOT = "case when id % 2 = 0 then 'hot' else cast(id as string) end"


@query(
    oracle(
        f""", o as (select case when coupon_type = 'code' then 'coupon' else 'deal' end as kind, {_HOT} as store_key, cast(id as string) as provider_entity_id, id, discount_value from coupons),
 r as (select *, row_number() over (partition by kind, store_key order by case when kind = 'deal' then 0 else discount_value end desc, provider_entity_id) - 1 as rank, min(id) over (partition by kind, store_key) as first from o)
 select kind, provider_entity_id, rank::int as rank, row_number() over (partition by kind order by rank, first, store_key)::int as place from r""",
        "coupons",
    )
)
def policy_hot_store(spark, d):
    """One store holds half of all offers, and all others one each: both the ring and its first position are large."""
    kind = F.when(F.col("coupon_type") == "code", "coupon").otherwise("deal")
    key = F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string"))
    none = F.lit(None).cast("date")
    offers = view(spark, d, "coupons").select(
        "id", kind.alias("kind"), key.alias("store_key"), F.col("id").cast("string").alias("provider_entity_id"), F.lit("active").alias("status"), none.alias("start_date"), none.alias("end_date"),
        F.lit("percentage").alias("discount_type"), "discount_value", F.lit(0).alias("priority"), F.lit(False).alias("manually_disabled"),
    )
    decided = policy.apply_policy(offers, policy.Policy(ranking=("discount",)), TODAY).offers
    return policy.interleaved(decided, "id").select("kind", "provider_entity_id", "rank", "place")


@query(oracle(f", {_OFFERS} select hold_reason, count(*) as count from decided where hold_reason is not null group by 1", "coupons"))
def policy_hold_reasons(spark, d):
    return policy.hold_reasons(_decided(spark, d).offers)


@query(oracle(f", {_OFFERS} select * from dist order by coupons_published + deals_published desc, store_key limit 50", "coupons"))
def policy_distribution(spark, d):
    return policy.distribution(_decided(spark, d).offers)


@query(
    oracle(
        f""", {_OFFERS}, t as (select sum(coupons_published)::bigint as coupons_published, sum(coupons_held)::bigint as coupons_held, sum(deals_published)::bigint as deals_published, sum(deals_held)::bigint as deals_held,
 count_if(coupons_published + deals_published > 0) as stores_covered from dist) select *, floor(coupons_published / stores_covered * 10 + 0.5) / 10 as average_coupons, floor(deals_published / stores_covered * 10 + 0.5) / 10 as average_deals,
 floor(1000.0 * (coupons_published + deals_published) / (coupons_published + coupons_held + deals_published + deals_held) + 0.5) / 10 as coverage_percent from t""",
        "coupons",
    )
)
def policy_summary(spark, d):
    return policy.summary(_decided(spark, d).offers)


_ADS = """ads as (select p_partkey as seq, p_partkey as ad_id, case when p_partkey % 4 = 0 then 'C' || p_partkey end as promotion_id, p_partkey % 50 as campaign_id, p_partkey % 20 as advertiser_id,
 nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), '') as norm_title, 'c' || (p_partkey % 30) as norm_code from part where p_partkey % 3 <> 0)"""
_PROMOS = """promos as (select p_partkey as id, 'C' || p_partkey as promotion_id, p_partkey % 60 as campaign_id, p_partkey % 25 as advertiser_id, nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), '') as norm_title, 'c' || (p_size % 40) as norm_code from part)"""


def _ads(spark, d):
    k = F.col("p_partkey")
    rows = view(spark, d, "part").filter(k % 3 != 0).select(k.alias("seq"), k.alias("ad_id"), F.when(k % 4 == 0, F.concat(F.lit("C"), k.cast("string"))).alias("promotion_id"), (k % 50).alias("campaign_id"), (k % 20).alias("advertiser_id"), "p_name", F.concat(F.lit("c"), (k % 30).cast("string")).alias("code"))
    return enrich.with_keys(rows, "p_name", "code")


def _promos(spark, d):
    k = F.col("p_partkey")
    rows = view(spark, d, "part").select(k.alias("id"), F.concat(F.lit("C"), k.cast("string")).alias("promotion_id"), (k % 60).alias("campaign_id"), (k % 25).alias("advertiser_id"), "p_name", F.concat(F.lit("c"), (F.col("p_size") % 40).cast("string")).alias("code"))
    return enrich.with_keys(rows, "p_name", "code")


@query(
    f"""with {_ADS}, {_PROMOS}, i1 as (select promotion_id, max_by(ad_id, seq) as a from ads where promotion_id is not null group by 1), i2 as (select campaign_id, norm_title, max_by(ad_id, seq) as a from ads group by 1, 2),
 i3 as (select campaign_id, max(ad_id) as a from ads group by 1 having count(*) = 1), i4 as (select advertiser_id, norm_title, min_by(ad_id, seq) as a from ads group by 1, 2), i5 as (select advertiser_id, norm_code, min_by(ad_id, seq) as a from ads group by 1, 2),
 i6 as (select advertiser_id, max(ad_id) as a from ads group by 1 having count(*) = 1)
 select p.id, coalesce(i1.a, i2.a, i3.a, i4.a, i5.a, i6.a) as ad_id, case when i1.a is not null then 'promotion_id' when i2.a is not null then 'campaign_title' when i3.a is not null then 'campaign_single' when i4.a is not null then 'advertiser_title'
 when i5.a is not null then 'advertiser_code' when i6.a is not null then 'advertiser_single' end as matched_by from promos p left join i1 using (promotion_id) left join i2 on i2.campaign_id = p.campaign_id and i2.norm_title = p.norm_title left join i3 on i3.campaign_id = p.campaign_id
 left join i4 on i4.advertiser_id = p.advertiser_id and i4.norm_title = p.norm_title left join i5 on i5.advertiser_id = p.advertiser_id and i5.norm_code = p.norm_code left join i6 on i6.advertiser_id = p.advertiser_id"""
)
def enrich_cascade(spark, d):
    return enrich.cascade(_promos(spark, d), _ads(spark, d), "seq", ["ad_id"]).select("id", F.col("ad.ad_id").alias("ad_id"), "matched_by")


@query(
    """with k as (select * from (select s_suppkey as seq, unnest([s_suppkey::varchar, (s_suppkey % 7)::varchar]) as key, unnest([0, 1]) as nth, s_name from supplier)),
 t as (select key, arg_max(s_name, seq * 10 + nth) as value from k group by 1) select p_partkey as id, coalesce(a.value, b.value) as store from part left join t a on a.key = (p_partkey % 500)::varchar left join t b on b.key = (p_size)::varchar"""
)
def campaign_lookup(spark, d):
    rows = view(spark, d, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_suppkey").alias("campaign"), (F.col("s_suppkey") % 7).alias("advertiser"), "s_name")
    table = enrich.last_by_keys(rows, ["campaign", "advertiser"], "seq", F.col("s_name"))
    parts = view(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 500).alias("a"), F.col("p_size").alias("b"))
    return enrich.look_up_first(parts, ["a", "b"], table, "store").select("id", "store")


@query(
    oracle(
        """, urls as (select id, case when id % 2 = 0 then 'https://s.example/' || slug end as u from stores), t as (select c.id, case when c.id % 5 = 0 then 'https://d.example/' || c.id end as direct, urls.u, case when c.id % 3 = 0 then 'HTTP://uri' else 'x' end as uri from coupons c left join urls on urls.id = c.store_id)
 select id, coalesce(direct, u, case when uri <> 'x' then uri end) as url, case when direct is not null then null when u is not null then 'tracking url fell back to the campaign tracking link' when uri <> 'x' then 'tracking url fell back to the promotion uri' else 'no tracking url available for this promotion' end as warning from t""",
        "coupons", "stores",
    )
)
def tracking_fallback(spark, d):
    c = F.col
    stores = view(spark, d, "stores").select(c("id").alias("seq"), c("id").alias("key"), F.when(c("id") % 2 == 0, F.concat(F.lit("https://s.example/"), "slug")).alias("u"))
    rows = view(spark, d, "coupons").select("id", "store_id", F.when(c("id") % 5 == 0, F.concat(F.lit("https://d.example/"), c("id").cast("string"))).alias("direct"), F.when(c("id") % 3 == 0, "HTTP://uri").otherwise("x").alias("uri"))
    rows = enrich.look_up_first(rows, ["store_id"], enrich.last_by_keys(stores, ["key"], "seq", c("u")), "store_url")
    none = F.lit(None).cast("string")
    return rows.select("id", of.tracking(none, c("direct"), c("store_url"), c("uri"), none).alias("t")).select("id", "t.url", "t.warning")


@query(
    oracle(
        f""", {_EXISTING}, {_INCOMING}, m as (select coalesce(a.id, b.id) as mid, i.* from incoming i left join existing a on a.provider = 'net' and a.provider_entity_id = i.provider_entity_id left join existing b on b.slug = i.slug)
 select coalesce(m.provider, e.provider) as provider, coalesce(m.provider_entity_id, e.provider_entity_id) as provider_entity_id, e.slug, coalesce(upper(m.name), s.name) as name, case when m.mid is null then '' else 'new' end as description from existing e join stores s using (id) left join m on m.mid = e.id
 union all select provider, provider_entity_id, slug, upper(name), 'new' from m where mid is null""",
        "stores",
    )
)
def merge_apply(spark, d):
    rules = {"name": merge.PROVIDER_WINS, "description": merge.ADMIN_WINS}
    current = _existing(spark, d).withColumn("id", F.col("id").cast("string"))
    return merge.apply_rows(current, _incoming(spark, d), rules, "net")[0].select("provider", "provider_entity_id", "slug", "name", "description")


@query(
    oracle(
        f", {_EXISTING}, {_INCOMING} select count_if(m is null) as created, count_if(m is not null) as updated from (select coalesce(a.id, b.id) as m from incoming i left join existing a on a.provider = 'net' and a.provider_entity_id = i.provider_entity_id left join existing b on b.slug = i.slug)",
        "stores",
    )
)
def merge_counts(spark, d):
    return merge.apply_rows(_existing(spark, d).withColumn("id", F.col("id").cast("string")), _incoming(spark, d), {"name": merge.PROVIDER_WINS}, "net")[1]


@query("select distinct lower(replace(c_name, '#', '.') || '@example.com') as email from customer where c_custkey % 4 <> 0")
def subscribe_ignore(spark, d):
    email = F.concat(F.replace(F.col("c_name"), F.lit("#"), F.lit(".")), F.lit("@example.com"))
    people = view(spark, d, "customer").select("c_custkey", email.alias("email"))
    there = people.filter("c_custkey % 4 = 0").select(F.lower("email").alias("email"))
    asked = people.select(F.concat(F.lit("  "), F.upper("email")).alias("email")).union(people.select("email")).union(spark.createDataFrame([("x@y",), ("no address",)], "email string"))
    return merge.subscribe(there, asked)


_AUDIT = """, c as (select c_custkey as id, c_name as name, c_acctbal as balance from customer), n as (select max(id) + 1 as id from c)
 select action, 'customer' as entity, id as entity_id, name, action || case when action like '%e' then 'd' else 'ed' end || ' customer ' || name as description from (
  select case when id % 700 = 3 then 'delete' else 'update' end as action, id, case when id % 700 = 3 then name else lower(name) end as name from c where id % 700 = 3 or id % 500 = 7
  union all select 'insert', id, 'someone new' from n)"""


@query("with x as (select 1)" + _AUDIT.replace("action || case", "upper(action[1]) || action[2:] || case"))
def audit_digests(spark, d):
    """K11 by digests: two snapshots, of which only buckets that differ are read."""
    before = view(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    kept = before.filter("id % 700 <> 3").withColumn("name", F.when(F.col("id") % 500 == 7, F.lower("name")).otherwise(F.col("name")))
    after = kept.unionByName(before.agg((F.max("id") + 1).alias("id")).select("id", F.lit("someone new").alias("name"), F.lit(0.0).alias("balance")))
    folder = fresh_dir(spark, "audit")
    for df, name in ((before, "before"), (after, "after")):
        digests.write_snapshot(df, "id", f"{folder}/{name}", 64)
    return digests.audit_snapshots(spark, f"{folder}/before", f"{folder}/after", "id", "customer")


@query("select case when n_nationkey < 5 then 'delete' when n_nationkey % 6 = 0 then 'update' end as action, 'nation' as entity, n_nationkey as entity_id from nation where n_nationkey < 5 or n_nationkey % 6 = 0")
def audit_diff(spark, d):
    before = view(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    after = before.filter("n_nationkey >= 5").withColumn("name", F.when(F.col("n_nationkey") % 6 == 0, F.lower("name")).otherwise(F.col("name")))
    return access.audit_log(before, after, "n_nationkey", "nation").select("action", "entity", "entity_id")


@query("select substr(trim(p_name), 1, 200) as query, count(*) as n from part where trim(p_name) <> '' group by 1")
def append_searches(spark, d):
    rows = merge.searches_to_append(view(spark, d, "part").select(F.concat(F.lit(" "), "p_name").alias("query")))
    return rows.groupBy("query").agg(F.count("*").alias("n"))


@query(
    "select event_type as entity, count(*) as received, count(*) filter (value >= 50) as normalized from events group by 1 union all select 'total', count(*), count(*) filter (value >= 50) from events"
)
def sync_statistics(spark, d):
    rows = view(spark, d, "events").select(F.col("event_type").alias("entity"), F.lit(1).alias("received"), (F.col("value") >= 50).cast("int").alias("normalized"))
    return reports.sync_statistics(rows)


@query("select 'positive quantity' as rule, count(*) filter (not l_quantity > 0) as violations from lineitem union all select 'discount below 5 %', count(*) filter (not l_discount < 0.05) from lineitem union all select 'line is unique', (select count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1))")
def constraint_checks(spark, d):
    rules = {"positive quantity": F.col("l_quantity") > 0, "discount below 5 %": F.col("l_discount") < 0.05}
    return access.check_constraints(view(spark, d, "lineitem"), rules, {"line is unique": ["l_orderkey", "l_linenumber"]})


#: The tables and the payload of a whole import, from the base tables: some rows match by identity, some by slug, some are new, some coupons have no store.
_IMPORT = """cur_cat as (select cast(n_nationkey as string) as id, n_name as name, lower(n_name) as slug, case when n_nationkey % 3 = 0 then 'net' end as provider, case when n_nationkey % 3 = 0 then concat('c', cast(n_nationkey as string)) end as provider_entity_id from nation),
 in_cat as (select concat('c', cast(n_nationkey as string)) as provider_entity_id, upper(n_name) as name, lower(n_name) as slug from nation where n_nationkey % 2 = 0 union all select concat('new', cast(n_nationkey as string)), n_name, concat('new-', lower(n_name)) from nation where n_nationkey < 5),
 cur_sto as (select concat('s', cast(s_suppkey as string)) as id, s_name as name, lower(s_name) as slug, case when s_suppkey % 4 = 0 then ' ' else 'old' end as description, cast(s_nationkey as string) as category_id, case when s_suppkey % 2 = 0 then 'net' end as provider, case when s_suppkey % 2 = 0 then concat('p', cast(s_suppkey as string)) end as provider_entity_id from supplier),
 in_sto as (select concat('p', cast(s_suppkey as string)) as provider_entity_id, upper(s_name) as name, lower(s_name) as slug, 'fresh' as description, concat('c', cast(s_suppkey % 40 as string)) as category_provider_id from supplier where s_suppkey % 3 = 0 union all select concat('q', cast(s_suppkey as string)), s_name, concat('q-', lower(s_name)), null, 'new1' from supplier where s_suppkey % 10 = 1),
 cur_cou as (select concat('k', cast(p_partkey as string)) as id, p_name as title, case when p_partkey % 5 = 0 then '' else 'kept terms' end as terms, 'OLD' as coupon_code, 'draft' as status, date '2024-02-01' as expiry_date, concat('s', cast(p_partkey % (select count(*) from supplier) as string)) as store_id, 'net' as provider, concat('o', cast(p_partkey as string)) as provider_entity_id from part where p_partkey % 2 = 0),
 in_cou as (select concat('o', cast(p_partkey as string)) as provider_entity_id, case when p_partkey % 11 = 0 then null else upper(p_name) end as title, 'new terms' as terms, case when p_partkey % 4 = 0 then 'CODE' end as coupon_code, case p_partkey % 5 when 0 then 'expired' when 1 then '' when 2 then 'draft' when 3 then 'active' end as status,
 case when p_partkey % 6 <> 0 then date '2024-01-21' + cast(p_partkey % 45 as int) end as expiry_date, case when p_partkey % 8 = 0 then date '2024-01-21' + cast(p_partkey % 20 as int) end as start_date, case when p_partkey % 7 = 0 then 'nobody' else concat('p', cast(p_partkey % (select count(*) from supplier) as string)) end as store_provider_id from part where p_partkey % 3 = 0)"""

_IMPORTED = f"""with {_IMPORT},
 mc as (select i.*, coalesce(a.id, b.id) as mid from in_cat i left join cur_cat a on a.provider_entity_id = i.provider_entity_id left join cur_cat b on b.slug = i.slug),
 cats as (select coalesce(m.provider_entity_id, c.provider_entity_id) as pid, c.id from cur_cat c left join mc m on m.mid = c.id where m.mid is not null or c.provider = 'net' union all select provider_entity_id, sha256('net::' || provider_entity_id) from mc where mid is null),
 ms as (select i.*, coalesce(a.id, b.id) as mid, cats.id as cid from in_sto i left join cur_sto a on a.provider_entity_id = i.provider_entity_id left join cur_sto b on b.slug = i.slug left join cats on cats.pid = i.category_provider_id),
 stores2 as (select c.id, coalesce(m.name, c.name) as name, case when m.mid is null then c.description else coalesce(nullif(trim(c.description), ''), m.description) end as description, coalesce(m.cid, c.category_id) as category_id, coalesce(m.provider_entity_id, c.provider_entity_id) as pid, m.mid is not null or c.provider is not null as net from cur_sto c left join ms m on m.mid = c.id
  union all select sha256('net::' || provider_entity_id), name, description, cid, provider_entity_id, true from ms where mid is null),
 off as (select i.*, s.id as sid, case when i.expiry_date < date '2024-01-31' then 'expired' when i.start_date > date '2024-01-31' then 'draft' when i.status = 'expired' then 'active' else coalesce(nullif(i.status, ''), 'active') end as st from in_cou i left join stores2 s on s.net and s.pid = i.store_provider_id),
 mo as (select o.*, c.id as mid from off o left join cur_cou c on c.provider_entity_id = o.provider_entity_id where sid is not null),
 coupons2 as (select c.provider_entity_id, case when m.mid is null then c.title else coalesce(m.title, c.title) end as title, case when m.mid is null then c.terms else coalesce(nullif(trim(c.terms), ''), m.terms) end as terms, case when m.mid is null then c.coupon_code else m.coupon_code end as coupon_code,
  case when m.mid is null then c.status else m.st end as status, case when m.mid is null then c.expiry_date else m.expiry_date end as expiry_date, case when m.mid is null then c.store_id else m.sid end as store_id from cur_cou c left join mo m on m.mid = c.id
  union all select provider_entity_id, title, terms, coupon_code, st, expiry_date, sid from mo where mid is null)"""


def _import(spark, d):
    tables = {n: base_table(spark, d, n) for n in ("nation", "supplier", "part")}
    text = re.sub(r"\bfrom (nation|supplier|part)\b", r"from {\1}", _IMPORT)
    part = lambda name: spark.sql(f"with {text} select * from {name}", **tables)
    current = {"categories": part("cur_cat"), "stores": part("cur_sto"), "coupons": part("cur_cou")}
    return merge.import_apply(current, {"categories": part("in_cat"), "stores": part("in_sto"), "coupons": part("in_cou")}, "net", TODAY)


@query(f"{_IMPORTED} select * from coupons2")
def import_apply(spark, d):
    return _import(spark, d)[0]["coupons"].select("provider_entity_id", "title", "terms", "coupon_code", "status", "expiry_date", "store_id")


@query(f"{_IMPORTED} select id, name, description, category_id, pid as provider_entity_id from stores2")
def import_apply_stores(spark, d):
    return _import(spark, d)[0]["stores"].select("id", "name", "description", "category_id", "provider_entity_id")


@query(f"{_IMPORTED} select (select count(*) from mc where mid is null) + (select count(*) from ms where mid is null) + (select count(*) from mo where mid is null) as created, (select count(*) from mc where mid is not null) + (select count(*) from ms where mid is not null) + (select count(*) from mo where mid is not null) as updated, (select count(*) from off where sid is null) as skipped")
def import_apply_counts(spark, d):
    return _import(spark, d)[1]


@query(f"{_IMPORTED} select 'net' as provider, 'partial' as status, count(*) as skipped from off where sid is null")
def run_history(spark, d):
    none = spark.createDataFrame([], "run_id string, provider string, finished_at timestamp_ntz, status string, created long, updated long, skipped long, errors long")
    return merge.append_run(none, _import(spark, d)[1], "net", NOW).select("provider", "status", "skipped")
