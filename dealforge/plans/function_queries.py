"""Queries of the small functions and rules, over inputs that vary row by row.

Each input is one SELECT in the common subset of Spark SQL and DuckDB, so that the
query and its SQL read the same rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from dealforge.functions import offers as of
from dealforge.functions import text as tx
from dealforge.operators import imports, merge, reports
from dealforge.plans.registry import query
from dealforge.sources import provider
from dealforge.sources.catalogue import NOW, TODAY, oracle, view


def _over(name: str, columns: str):
    """(the query's input, its SQL as `t`) of one SELECT over a view."""
    return (lambda spark, d: view(spark, d, name).selectExpr(*_parts(columns))), lambda rest: oracle(f", t as (select {columns} from {name}) {rest}", name)


def _parts(columns: str) -> list[str]:
    """The select list, split at its line ends."""
    return [c.rstrip(",") for c in columns.splitlines()]


_texts, _sql = _over("stores", "id,\ncase id % 6 when 0 then concat('  ', name, ' ') when 1 then 'N/A' when 2 then ' null' when 3 then '   ' when 4 then 'Undefined' else name end as v")


@query(_sql("select id, nullif(trim(v), '') as as_string, case when lower(trim(v)) not in ('', 'n/a', 'none', 'null', 'undefined') then trim(v) end as cleaned from t"))
def fn_clean_string(spark, d):
    return _texts(spark, d).select("id", tx.as_string(F.col("v")).alias("as_string"), tx.clean_string(F.col("v")).alias("cleaned"))


_fields, _sql = _over("stores", "id,\ncase when id % 3 = 0 then '' else concat('n', cast(id as string)) end as a,\ncase when id % 2 = 0 then '' when id % 5 = 0 then null else concat('i', cast(id as string)) end as b")


@query(_sql("select id, coalesce(nullif(b, ''), nullif(a, '')) as picked, nullif(b, '') as first_exact, case when a = '' then 0 else 1 end as others from t"))
def fn_pick_first(spark, d):
    record = F.create_map(F.lit("Name"), F.col("a"), F.lit("ID"), F.col("b"))
    others = F.size(F.map_filter(tx.other_keys(record, "id"), lambda _, v: v != ""))
    return _fields(spark, d).select("id", tx.pick(record, "id", "name").alias("picked"), tx.first(record, "name", "ID").alias("first_exact"), others.alias("others"))


_lists, _sql = _over("coupons", "id,\nreplace(title, ' ', case id % 4 when 0 then ', ' when 1 then ' | ' when 2 then ';' else ',,' end) as v")
_LIST = "[trim(x) for x in string_split_regex(v, '[{}]') if trim(x) <> '']"


@query(_sql(f"select id, len({_LIST.format(',|')})::int as n, array_to_string({_LIST.format(',|')}, '/') as listed, array_to_string({_LIST.format(',;|')}, '/') as enriched from t"))
def fn_string_list(spark, d):
    plain = tx.string_list(F.col("v"))
    return _lists(spark, d).select("id", F.size(plain).alias("n"), F.array_join(plain, "/").alias("listed"), F.array_join(tx.string_list(F.col("v"), ",;|"), "/").alias("enriched"))


_dates, _sql = _over(
    "coupons",
    "id,\ncreated_at,\nexpiry_date,\ncase id % 5 when 0 then concat(cast(created_at as string), 'T23:30:00-02:00') when 1 then cast(created_at as string) when 2 then concat(cast(created_at as string), ' 10:00:00') when 3 then 'soon' end as v,\nconcat(cast(created_at as string), coalesce(concat(' / ', cast(expiry_date as string)), '')) as r",
)


@query(_sql("select id, case id % 5 when 0 then cast(created_at + 1 as string) when 1 then cast(created_at as string) when 2 then cast(created_at as string) end as day, created_at as range_start, expiry_date as range_end from t"))
def fn_dates(spark, d):
    span = of.date_range(F.col("r"))
    return _dates(spark, d).select("id", of.iso_date(F.col("v")).alias("day"), span["start"].cast("date").alias("range_start"), span["end"].cast("date").alias("range_end"))


_discounts, _sql = _over(
    "coupons",
    "id,\ncase when id % 8 = 0 then discount_value end as percent,\ncase when id % 8 = 1 then discount_value end as amount,\ncase id % 8 when 2 then 'Free Shipping today' when 3 then 'BOGO socks' when 4 then concat(cast(id % 90 as string), ' % off') when 5 then concat('Save $', cast(id as string)) when 6 then concat('Save ₹', cast(id as string)) when 7 then case when id % 16 = 7 then 'Great deal' else '' end end as v",
)
_KINDS = "case id % 8 when 0 then 'percentage' when 1 then 'fixed' when 2 then 'free_shipping' when 3 then 'bogo' when 4 then 'percentage' when 5 then 'fixed' "
_VALUES = "case id % 8 when 0 then percent when 1 then amount when 4 then (id % 90)::double when 5 then id::double "


@query(_sql(f"select id, {_KINDS} when 6 then 'other' else case when v = '' then 'unknown' else 'other' end end as kind, {_VALUES} end as value, {_KINDS} when 6 then 'fixed' end as enriched_kind, {_VALUES} when 6 then id::double end as enriched_value from t"))
def fn_discount_types(spark, d):
    args = (F.col("percent"), F.col("amount"), F.col("v"))
    plain, enriched = of.discount_of(*args), of.discount_of(*args, symbols="$£€₹", other=None)
    return _discounts(spark, d).select("id", plain["type"].alias("kind"), plain["value"].alias("value"), enriched["type"].alias("enriched_kind"), enriched["value"].alias("enriched_value"))


_scopes, _sql = _over("categories", "id,\nconcat(upper(slug), case id % 3 when 0 then '_new-customers' when 1 then '__' else '' end) as v")


@query(_sql("select id, upper(p[1]) || p[2:] as scope from (select id, lower(trim(regexp_replace(v, '[_-]+', ' ', 'g'))) as p from t)"))
def fn_pretty_scope(spark, d):
    return _scopes(spark, d).select("id", tx.pretty_scope(F.col("v")).alias("scope"))


_clips, _sql = _over("coupons", "id,\nconcat(' ', replace(title, ' ', '  '), ' ') as v,\ncoupon_code as code,\nsubstring(coupon_code, 1, cast(id % 7 as int)) as secret")


@query(_sql("select id, substring(trim(regexp_replace(v, '\\s+', ' ', 'g')), 1, 20) as clipped, substring(code, 1, 3) || '•••' as masked_code, case when length(secret) <= 4 then repeat('•', length(secret)) else repeat('•', length(secret) - 4) || right(secret, 4) end as masked_secret from t"))
def fn_clip_mask(spark, d):
    return _clips(spark, d).select("id", tx.clip(F.col("v"), 20).alias("clipped"), tx.mask_code(F.col("code")).alias("masked_code"), tx.mask_secret(F.col("secret")).alias("masked_secret"))


_slugs, _sql = _over("stores", "id,\ncase id % 4 when 0 then concat(slug, '-coupons') when 1 then concat(slug, '-offers') else slug end as v")


@query(
    _sql(
        """select id, case when suffix(v, '-coupons') then v else v || '-coupons' end as store_slug, case when suffix(v, '-offers') then v else v || '-offers' end as category_slug,
 case id % 4 when 0 then 'store' when 1 then 'category' end as kind, case when id % 4 < 2 then regexp_replace(v, '-(coupons|offers)$', '') end as slug from t"""
    )
)
def fn_slug_pages(spark, d):
    v, page = F.col("v"), tx.page_of_slug(F.col("v"))
    return _slugs(spark, d).select("id", tx.store_slug(v).alias("store_slug"), tx.category_slug(v).alias("category_slug"), page["kind"].alias("kind"), page["slug"].alias("slug"))


_states, _sql = _over("stores", "id,\nid % 4 <> 0 as enabled,\ncase when id % 3 = 0 then 'connected' end as stored,\ncase when id % 5 < 3 then 'failed' end as tested")


@query(_sql("select id, case when not enabled then 'disabled' else coalesce(stored, tested, 'never_tested') end as status from t"))
def fn_effective_status(spark, d):
    return _states(spark, d).select("id", of.effective_status(F.col("enabled"), F.col("stored"), F.col("tested")).alias("status"))


_responses, _sql = _over("stores", "id,\ncast(case id % 8 when 0 then 401 when 1 then 403 when 2 then 408 when 3 then 429 when 4 then 503 when 5 then 404 when 6 then 500 else 302 end as int) as code,\ncase id % 4 when 0 then cast(id as string) when 1 then 'Wed, 31 Jan 2024 00:00:05 GMT' when 2 then 'Mon, 01 Jan 2024 00:00:00 GMT' else 'later' end as header,\ncase id % 3 when 0 then '1706659200000' when 1 then '1706659200' else '60' end as reset")


@query(
    _sql(
        """select id, case code when 401 then 'authentication_error' when 403 then 'authorization_error' when 408 then 'timeout' when 429 then 'rate_limited' when 503 then 'server_error' when 500 then 'server_error' when 404 then 'validation_error' else 'unknown_error' end as class,
 case id % 4 when 0 then id * 1000.0::double when 1 then 5000.0::double when 2 then 0.0::double end as retry_after_ms, case id % 3 when 2 then 1706659260000.0::double else 1706659200000.0::double end as reset_ms from t"""
    )
)
def fn_http_response(spark, d):
    now = F.lit(1_706_659_200_000.0)
    return _responses(spark, d).select("id", of.status_class(F.col("code")).alias("class"), of.retry_after_ms(F.col("header"), now).alias("retry_after_ms"), of.reset_time(F.col("reset"), now).alias("reset_ms"))


_names, _sql = _over("stores", "id,\ncase id % 6 when 0 then ' Impact.com' when 1 then 'Commission Junction' when 2 then 'share-a-sale ' when 3 then 'AWIN' else 'nobody' end as a,\ncase id % 5 when 0 then 'rakuten linkshare' end as b")


@query(_sql("select id, coalesce(case id % 6 when 0 then 'impact' when 1 then 'cj' when 2 then 'shareasale' when 3 then 'awin' end, case when id % 5 = 0 then 'rakuten' end, 'custom_rest') as provider from t"))
def fn_provider_key(spark, d):
    return _names(spark, d).select("id", provider.provider_key(F.col("a"), F.col("b")).alias("provider"))


_bodies, _sql = _over(
    "stores",
    """id,
concat(case id % 4 when 0 then '' when 1 then '{"meta":1,"Campaigns":' when 2 then '{"page":{"n":2},"items":' else '{"none":' end, case when id % 4 = 3 then '1' else concat('[{"k":', cast(id as string), '},7,{"k":', cast(id + 1 as string), '}]') end, case when id % 4 = 0 then '' else '}' end) as body""",
)


@query(_sql("select id, k from (select id, unnest([id, id + 1])::bigint as k from t where id % 4 <> 3)"))
def envelope_records(spark, d):
    return provider.unwrap(_bodies(spark, d), "body", "Campaigns").select("id", F.get_json_object("record", "$.k").cast("long").alias("k"))


_configs, _sql = _over(
    "stores",
    "id,\nid % 9 <> 0 as enabled,\ncase id % 4 when 0 then '' when 1 then 'ftp://x.example' else 'https://api.example.com/v1' end as base_url,\ncast(case when id % 5 = 0 then 10 else 30000 end as int) as timeout_ms,\ncast(id % 25 as int) as retries,\ncase id % 6 when 0 then 'api_key' when 1 then 'bearer' when 2 then 'basic' when 3 then 'oauth2' when 4 then 'custom_headers' else 'magic' end as auth,\nid % 7 < 3 as has_key",
)


@query(
    _sql(
        """select id, concat_ws('; ', case when not enabled then 'Integration is disabled' end, case id % 4 when 0 then 'Base URL is required' when 1 then 'Base URL is invalid' end, case when timeout_ms = 10 then 'Timeout must be between 1000 and 600000 ms' end,
 case when retries > 20 then 'Retry attempts must be between 0 and 20' end, case when auth = 'magic' then 'Unknown authentication type' when has_key then null when auth = 'api_key' then 'API key credential is missing' when auth = 'bearer' then 'Bearer access token is missing'
 when auth = 'basic' then 'Basic auth username/password is missing' when auth = 'oauth2' then 'OAuth2 requires either an access token or client credentials' end) as errors from t"""
    )
)
def config_preflight(spark, d):
    errors = provider.config_errors(*[F.col(c) for c in ("enabled", "base_url", "timeout_ms", "retries", "auth")], lambda _: F.col("has_key"))
    return _configs(spark, d).select("id", F.array_join(errors, "; ").alias("errors"))


_records, _sql = _over(
    "stores",
    "id,\ncase when id % 11 = 0 then ' ' else cast(id as string) end as provider_entity_id,\ncase when id % 7 = 0 then '' else name end as name,\ncase id % 5 when 0 then 'weird' when 1 then null else 'active' end as status,\ncase id % 3 when 0 then 'nowhere' else 'https://shop.example/x' end as website,\ncase id % 4 when 0 then 'logo.png' when 1 then '' else 'https://cdn.example/l.png' end as logo",
)
_STORE_RULES = (
    ("provider_entity_id = ' '", "providerId", "'missing provider entity id'", "error"), ("status = 'weird'", "status", "'invalid status \"weird\"'", "error"), ("name = ''", "name", "'empty name'", "error"),
    ("website = 'nowhere'", "website", "'invalid website url'", "error"), ("logo = 'logo.png'", "logo", "'invalid logo url (ignored)'", "warning"),
)


def _issues(entity: str, rules) -> str:
    return " union all ".join(f"select '{entity}' as entity, provider_entity_id, '{field}' as field, {reason} as reason, '{severity}' as severity from t where {when}" for when, field, reason, severity in rules)


@query(_sql(f", i as ({_issues('store', _STORE_RULES)}) select * from i union all select entity, provider_entity_id, field, 'validation: ' || reason, 'warning' from i where severity = 'error'"))
def validate_stores(spark, d):
    rules = imports.store_issues(*[F.col(c) for c in ("provider_entity_id", "name", "status", "website", "logo")])
    told = imports.validate(_records(spark, d), "store", "provider_entity_id", rules)[1]
    return told.unionByName(imports.echoed(told))


@query(_sql("select id from t where provider_entity_id <> ' ' and name <> '' and coalesce(status, '') <> 'weird' and website <> 'nowhere'"))
def valid_stores(spark, d):
    rules = imports.store_issues(*[F.col(c) for c in ("provider_entity_id", "name", "status", "website", "logo")])
    return imports.validate(_records(spark, d), "store", "provider_entity_id", rules)[0].select("id")


@query(_sql(_issues("category", (_STORE_RULES[0], _STORE_RULES[2]))))
def validate_categories(spark, d):
    return imports.validate(_records(spark, d), "category", "provider_entity_id", imports.category_issues(F.col("provider_entity_id"), F.col("name")))[1]


_offers, _sql = _over(
    "coupons",
    "id,\ncoupon_code,\ntitle,\ncase when id % 9 = 0 then '' else cast(id as string) end as provider_entity_id,\ncase when id % 13 = 0 then '' else cast(store_id as string) end as store,\ncase id % 5 when 0 then '' when 1 then 'xx' else 'https://go.example/1' end as url,\ncase when id % 6 = 0 then 'soon' else cast(created_at as string) end as start_date,\ncast(expiry_date as string) as end_date",
)


@query(
    _sql(
        ", t_ as (select * from t where coupon_code is null) "
        + _issues("deal", (("provider_entity_id = ''", "providerId", "'missing provider entity id'", "error"), ("store = ''", "providerStoreId", "'missing store reference'", "error"), ("url = ''", "trackingUrl", "'missing tracking url'", "warning"), ("url = 'xx'", "trackingUrl", "'invalid tracking url (ignored)'", "warning"), ("start_date = 'soon'", "startDate", "'invalid startDate'", "error"))).replace("from t ", "from t_ ")
    )
)
def validate_deals(spark, d):
    deals = imports.split_offers(_offers(spark, d), "coupon_code")[1]
    none = F.lit(None).cast("string")
    return imports.validate(deals, "deal", "provider_entity_id", imports.offer_issues(F.col("provider_entity_id"), F.col("title"), none, F.col("store"), F.col("url"), F.col("start_date"), F.col("end_date")))[1]


@query(_sql("select id, case when coupon_code is null then 'deal' else 'coupon' end as type from t"))
def split_by_code(spark, d):
    coupons, deals = imports.split_offers(_offers(spark, d), "coupon_code")
    return imports.tagged_union(coupon=coupons.select("id"), deal=deals.select("id"))


_versions, _sql = _over("coupons", "id,\ncase when id % 3 = 0 then null when id % 3 = 1 then ' ' else title end as old,\ncase when id % 4 = 0 then null else coupon_code end as new,\nid % 5 as a,\nid % 2 as b")


@query(
    _sql(
        """select id, new as overwritten, coalesce(nullif(trim(old), ''), new) as admin, coalesce(new, old) as provider, coalesce(old, new) as kept,
 case when b = 0 then 'x=1,y=' || a else 'x=2,y=' || a || ',z=3' end as metadata, case when b = 0 then 'old' else 'r' || a end as regions from t"""
    )
)
def merge_rules(spark, d):
    old, new = F.col("old"), F.col("new")
    before = F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), F.col("a").cast("string"))
    after = F.when(F.col("b") == 1, F.create_map(F.lit("x"), F.lit("2"), F.lit("z"), F.lit("3")))
    entries = F.array_sort(F.transform(F.map_entries(merge.merged(merge.MERGE_MAP, before, after)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    regions = merge.merged(merge.REPLACE_FILLED, F.array(F.lit("old")), F.when(F.col("b") == 1, F.array(F.concat(F.lit("r"), F.col("a").cast("string")))).otherwise(F.array().cast("array<string>")))
    return _versions(spark, d).select(
        "id", merge.merged(merge.OVERWRITE, old, new).alias("overwritten"), merge.merged(merge.ADMIN_WINS, old, new).alias("admin"), merge.merged(merge.PROVIDER_WINS, old, new).alias("provider"),
        merge.merged(merge.KEEP_OLD, old, new).alias("kept"), F.array_join(entries, ",").alias("metadata"), F.array_join(regions, ",").alias("regions"),
    )


_subscribers, _sql = _over("stores", "id,\nconcat('token-', cast(id as string)) as token,\nid % 3 <> 0 as active")


@query(_sql("select id, token, active and token <> 'token-4' as active, (select count(*) > 0 from t where token = 'token-4' and active) as done from t"))
def unsubscribe_token(spark, d):
    after, done = merge.unsubscribe(_subscribers(spark, d), "token-4")
    return after.crossJoin(F.broadcast(done))


_stamped, _sql = _over("stores", "id,\nname,\nbalance,\ntimestamp '2023-05-01 00:00:00' as updated_at")


@query(_sql(f"select id, case when id % 5 = 0 then upper(name) else name end as name, balance, case when id % 5 = 0 then timestamp '{NOW}' else updated_at end as updated_at from t"))
def touch_updated(spark, d):
    before = _stamped(spark, d).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))
    return merge.touched(before, before.withColumn("name", F.when(F.col("id") % 5 == 0, F.upper("name")).otherwise(F.col("name"))), "id", NOW)


_titles, _sql = _over("coupons", "id,\ncase id % 4 when 0 then concat(title, ', more') when 1 then concat('\"', title, '\"') else title end as v")


@query(_sql("""select id, case when id % 4 < 2 then '"' || replace(v, '"', '""') || '"' else v end as field from t"""))
def csv_fields(spark, d):
    return _titles(spark, d).select("id", tx.csv_field(F.col("v")).alias("field"))


_paths, _sql = _over("stores", "concat('/', slug, case when id % 3 = 0 then '?a=1&b=<2>' else '' end) as path,\ncast(date '2024-01-01' + cast(id % 20 as int) as date) as lastmod")


@query(_sql("select path, '<url><loc>https://deals.example' || replace(replace(replace(path, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</loc><lastmod>' || cast(lastmod as string) || '</lastmod></url>' as xml from t"))
def sitemap_elements(spark, d):
    return reports.sitemap_xml(_paths(spark, d), "https://deals.example")


_tracked, _sql = _over("coupons", "id,\ncase when id % 4 = 0 then ' ' else 'https://go.example' end as url,\ncase when id % 3 = 0 then 'Fell back to the CAMPAIGN link' end as warning,\ncase when id % 5 < 2 then cast(id as string) end as ad,\ncase id % 3 when 0 then null when 1 then 'https://x.example/storage/v1/object/public/l.png' else 'https://p.example/l.png' end as logo")


@query(_sql("select id, case when id % 4 = 0 then 'none' when id % 3 = 0 then 'campaign' when id % 5 < 2 then 'ad' else 'promotion' end as tracking, case id % 3 when 0 then 'missing' when 1 then 'hosted' else 'provider' end as logo_status from t"))
def presentation_sources(spark, d):
    return _tracked(spark, d).select("id", of.tracking_source(F.col("url"), F.col("warning"), F.col("ad")).alias("tracking"), of.logo_status(F.col("logo")).alias("logo_status"))


@query(oracle("select id, name from stores where name like 'Supplier#%1'", "stores"))
def like_filter(spark, d):
    return view(spark, d, "stores").filter(F.col("name").like("Supplier#%1")).select("id", "name")


_taken, _sql = _over("coupons", "id,\ncase when id % 2 = 0 then upper(title) else title end as v")


@query(_sql("select lower(v) as name, count(*) as holders, min(id) as first_id from t group by 1 having count(*) > 1"))
def unique_names(spark, d):
    """names that are taken more than once, whatever their case; equality, so that % and _ are plain."""
    return _taken(spark, d).groupBy(F.lower("v").alias("name")).agg(F.count("*").alias("holders"), F.min("id").alias("first_id")).filter("holders > 1")


_people, _sql = _over("stores", "id,\nconcat(slug, '@shop.example') as email,\nlower(replace(name, '#', ' ')) as label")


@query(_sql("select id, split_part(email, '@', 1) as local_part, array_to_string([upper(x[1]) || x[2:] for x in string_split(label, ' ')], ' ') as titled from t"))
def fn_split_initcap(spark, d):
    return _people(spark, d).select("id", F.split_part("email", F.lit("@"), F.lit(1)).alias("local_part"), F.initcap("label").alias("titled"))


@query(oracle(f"select store_id, id, row_number() over (partition by store_id order by featured_in_banner desc, created_at, id) as place from coupons where created_at <= date '{TODAY}'", "coupons"))
def multi_column_order(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("store_id").orderBy(F.desc("featured_in_banner"), "created_at", "id")
    return view(spark, d, "coupons").filter(F.col("created_at") <= F.lit(TODAY).cast("date")).select("store_id", "id", F.row_number().over(order).cast("long").alias("place"))
