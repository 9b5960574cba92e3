"""Queries over clicks, searches and offers: reports and catalogue pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealforge.functions.callable import register_functions
from dealforge.functions.offers import nice_ceil
from dealforge.functions.text import is_conversational
from dealforge.operators import access, catalog, reports, substring
from dealforge.plans.registry import query
from dealforge.session import fresh_dir
from dealforge.sources.catalogue import NOW, TODAY, oracle, view

MONTH_AGO = "2024-01-01 00:00:00"
USER = 7


@query(oracle("select lower(trim(query)) as query, count(*) as count from search_queries where source = 'search' and trim(query) <> '' group by 1 order by 2 desc, 1 limit 10", "search_queries"))
def top_searches(spark, d):
    return reports.top_searches(view(spark, d, "search_queries"))


@query(oracle("select lower(trim(query)) as query, count(*) as count from search_queries where source = 'ai' and trim(query) <> '' group by 1 order by 2 desc, 1 limit 8", "search_queries"))
def top_ai_searches(spark, d):
    return reports.top_searches(view(spark, d, "search_queries"), "ai", 8)


@query(
    oracle(
        "select d.day::date as day, count(c.id) as clicks from (select unnest(generate_series(date '2024-01-01', date '2024-01-31', interval 1 day))::date as day) d left join coupon_clicks c on c.clicked_at::date = d.day group by 1",
        "coupon_clicks",
    )
)
def clicks_per_day(spark, d):
    return reports.clicks_per_day(view(spark, d, "coupon_clicks"), "2024-01-01", TODAY)


@query(oracle("select coupon_id, count(*) as clicks from coupon_clicks where coupon_id is not null group by 1 order by 2 desc, 1 limit 10", "coupon_clicks"))
def clicks_by_coupon(spark, d):
    return reports.top_counts(view(spark, d, "coupon_clicks"), "coupon_id", "coupon_id")


def _joined(spark, d):
    return reports.clicks_of_offers(*[view(spark, d, n) for n in ("coupon_clicks", "coupons", "stores", "categories")])


_JOINED = "from coupon_clicks k left join coupons c on c.id = k.coupon_id left join stores s on s.id = c.store_id left join categories g on g.id = s.category_id"
_ALL = ("coupons", "stores", "categories", "coupon_clicks")


@query(oracle(f"select s.name as store_name, count(*) as clicks {_JOINED} where s.name is not null group by 1 order by 2 desc, 1 limit 10", *_ALL))
def clicks_by_store(spark, d):
    return reports.top_counts(_joined(spark, d), "store_name", "store_name")


@query(oracle(f"select g.name as category_name, count(*) as clicks {_JOINED} where g.name is not null group by 1 order by 2 desc, 1 limit 10", *_ALL))
def clicks_by_category(spark, d):
    return reports.top_counts(_joined(spark, d), "category_name", "category_name")


@query(oracle("select count(*) as total, count(distinct coupon_id) as coupons, 30 as days from coupon_clicks where clicked_at >= timestamp '2024-01-01 00:00:00'", "coupon_clicks"))
def click_totals(spark, d):
    return reports.click_totals(reports.recent(view(spark, d, "coupon_clicks"), MONTH_AGO), 30)


_LAST = "last_clicks as (select * from coupon_clicks order by clicked_at desc, id desc limit 1000)"


@query(oracle(f", {_LAST} select coalesce(c.title, 'Unknown coupon') as label, count(*) as clicks from last_clicks k left join coupons c on c.id = k.coupon_id group by 1 order by 2 desc, 1 limit 10", "coupons", "stores", "coupon_clicks"))
def public_top_coupons(spark, d):
    return reports.public_tops(*[view(spark, d, n) for n in ("coupon_clicks", "coupons", "stores")])[0]


@query(
    oracle(
        f", {_LAST} select s.slug as slug, count(*) as clicks from last_clicks k join coupons c on c.id = k.coupon_id join stores s on s.id = c.store_id group by 1 order by 2 desc, 1 limit 8",
        "coupons", "stores", "coupon_clicks",
    )
)
def public_top_brands(spark, d):
    return reports.public_tops(*[view(spark, d, n) for n in ("coupon_clicks", "coupons", "stores")])[1]


@query(oracle(", t as (select coupon_id, count(*) as clicks from coupon_clicks group by 1 order by 2 desc, 1 limit 10) select *, greatest(6, floor(100.0 * clicks / max(clicks) over () + 0.5)::int)::int as percent from t", "coupon_clicks"))
def bar_percent(spark, d):
    return reports.bar_percents(clicks_by_coupon(spark, d), "clicks")


@query(oracle("select store_id, count(*) as offers from coupons where status = 'active' and store_id is not null group by 1", "coupons"))
def offers_per_store(spark, d):
    return reports.offers_per_store(view(spark, d, "coupons"))


@query(oracle("select s.category_id, count(*) as offers from coupons c join stores s on s.id = c.store_id where c.status = 'active' group by 1", "coupons", "stores"))
def offers_per_category(spark, d):
    return reports.offers_per_category(offers_per_store(spark, d), view(spark, d, "stores"))


@query(oracle("select id, name, coalesce(n, 0) as offers from stores left join (select store_id, count(*) as n from coupons where status = 'active' group by 1) on store_id = id", "coupons", "stores"))
def rank_stores(spark, d):
    return catalog.rank_by_offers(view(spark, d, "stores"), offers_per_store(spark, d), "store_id").select("id", "name", "offers")


@query(
    oracle(
        "select id, name, coalesce(n, 0) as offers from categories left join (select s.category_id, count(*) as n from coupons c join stores s on s.id = c.store_id where c.status = 'active' group by 1) on category_id = id",
        "categories", "coupons", "stores",
    )
)
def rank_categories(spark, d):
    return catalog.rank_by_offers(view(spark, d, "categories"), offers_per_category(spark, d), "category_id").select("id", "name", "offers")


@query(oracle("select c.id, c.title, c.coupon_code, c.created_at, s.name as store_name from (select * from coupons where status = 'active' and (title ilike '%2%' or coupon_code ilike '%2%') order by created_at desc, id limit 12) c left join stores s on s.id = c.store_id", "coupons", "stores"))
def search_offers(spark, d):
    return catalog.search_offers(view(spark, d, "coupons"), view(spark, d, "stores"), "2")


@query(oracle("select id, name, slug from stores where name ilike '%00%' order by name, id limit 10", "stores"))
def search_stores(spark, d):
    return catalog.search_stores(view(spark, d, "stores"), "%00_")


@query(oracle("select c.id, c.title, s.name as store_name, s.category_id from coupons c join stores s on s.id = c.store_id where c.status = 'active' and s.category_id = 3", "coupons", "stores"))
def category_page(spark, d):
    rows = catalog.category_offers(view(spark, d, "coupons"), view(spark, d, "stores"), 3)
    return rows.select("id", "title", F.col("store.name").alias("store_name"), F.col("store.category_id").alias("category_id"))


@query(oracle("select id, title, created_at, count(*) over () as total from coupons where status = 'active' order by created_at desc, id limit 24 offset 24", "coupons"))
def offer_page(spark, d):
    active = view(spark, d, "coupons").filter("status = 'active'").select("id", "title", "created_at")
    return catalog.page_with_total(active, [F.desc("created_at"), F.asc("id")], 2, 24)


@query(oracle("select id, title, coupon_type, created_at from coupons where status = 'active' and coupon_type = 'code' order by created_at desc, id limit 8", "coupons"))
def newest_by_type(spark, d):
    return catalog.newest(view(spark, d, "coupons"), "code", 8).select("id", "title", "coupon_type", "created_at")


@query("select c_custkey, c_custkey in (select o_custkey from orders where o_orderstatus = 'P') as is_admin from customer")
def admin_flag(spark, d):
    admins = view(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_custkey")
    return catalog.flag_members(view(spark, d, "customer"), "c_custkey", admins, "is_admin").select("c_custkey", "is_admin")


@query("select event_id, user_id, c_name as actor from events left join customer on c_custkey = user_id where event_type = 'error'")
def actor_lookup(spark, d):
    rows = view(spark, d, "events").filter("event_type = 'error'").select("event_id", "user_id")
    return catalog.look_up(rows, "user_id", view(spark, d, "customer"), "c_custkey", "c_name", "actor").select("event_id", "user_id", "actor")


@query(oracle("select * from coupons where contains(lower(title), 'plate') and (contains(lower(coupon_code), '1') or contains(lower(status), '1') or contains(lower(title), '1')) and coupon_type = 'code'", "coupons"))
def any_column_search(spark, d):
    rows = catalog.facets(view(spark, d, "coupons"), "1", ["title", "coupon_code", "status"], coupon_type="code", status="all")
    return catalog.facets(rows, "PLATE", ["title"])


@query(oracle("select id, expiry_date from coupons order by expiry_date desc nulls last, id", "coupons"))
def null_last_sort(spark, d):
    return catalog.sort_nulls_last(view(spark, d, "coupons").select("id", "expiry_date"), "expiry_date", True, "id")


@query(oracle("select status, count(*) as n from coupons where status = 'active' group by 1", "coupons"))
def rls_visible_offers(spark, d):
    return access.visible(view(spark, d, "coupons"), "coupons").groupBy("status").agg(F.count("*").alias("n"))


@query(oracle("select k.id, k.coupon_id from coupon_clicks k where (k.user_id is null or k.user_id = 7) and exists (select 1 from coupons c where c.id = k.coupon_id and c.status = 'active')", "coupons", "coupon_clicks"))
def rls_click_insert(spark, d):
    return access.admissible_clicks(view(spark, d, "coupon_clicks"), view(spark, d, "coupons"), USER).select("id", "coupon_id")


_CALLERS = "(select 'anon' as role, null as caller union all select 'user', 7 union all select 'admin', 7)"
_PRIVATE = ("profiles", "user_roles", "subscribers", "newsletter_logs", "search_queries", "categories", "unknown_table")


@query(
    oracle(
        f""", t as (select 'profiles' as tbl union all select 'user_roles' union all select 'subscribers' union all select 'newsletter_logs' union all select 'search_queries' union all select 'categories' union all select 'unknown_table')
 select tbl, role, (select count(*) from search_queries q where tbl = 'categories' or (role = 'admin' and tbl in ('subscribers', 'newsletter_logs')) or (tbl in ('profiles', 'user_roles', 'search_queries') and q.user_id = caller)) as n from t, {_CALLERS} callers""",
        "search_queries",
    )
)
def rls_private_tables(spark, d):
    rows = view(spark, d, "search_queries").withColumn("name", F.lit("x"))
    seen = lambda table: rows.select(F.col("user_id").alias("id"), "name") if table == "profiles" else rows
    counts = [
        access.visible(seen(table), table, role, caller).agg(F.count("*").alias("n")).select(F.lit(table).alias("tbl"), F.lit(role).alias("role"), "n")
        for table in _PRIVATE
        for role, caller in (("anon", None), ("user", USER), ("admin", USER))
    ]
    return reduce(DataFrame.unionByName, counts)


@query(oracle("select coupon_id, created_at from saved_coupons where user_id = 7", "saved_coupons"))
def rls_own_saves(spark, d):
    return access.visible(view(spark, d, "saved_coupons"), "saved_coupons", user_id=USER).select("coupon_id", "created_at")


@query(
    oracle(
        "select source, count_if(status = 'active') as active, count_if(status = 'draft') as draft, count_if(status = 'expired') as expired from coupons join (select id, coupon_type as source from coupons) using (id) group by 1",
        "coupons",
    )
)
def status_histogram(spark, d):
    return reports.status_histogram(view(spark, d, "coupons").withColumnRenamed("coupon_type", "source"), "status", ["active", "draft", "expired"], "source")


@query("select user_id, max(case when event_type <> 'error' then ts end) as last_success, max(case when event_type = 'error' then ts end) as last_failure from events group by 1")
def last_success_failure(spark, d):
    return reports.last_outcomes(view(spark, d, "events"), "user_id", "ts", F.col("event_type") != "error")


_LOGS = "logs as (select ts as sent_at, case when value >= 20 then 'success' else 'failed' end as status, floor(value)::bigint as successful from events where event_type = 'signup')"


def _logs(spark, d):
    status = F.when(F.col("value") >= 20, "success").otherwise("failed")
    return view(spark, d, "events").filter("event_type = 'signup'").select(F.col("ts").alias("sent_at"), status.alias("status"), F.floor("value").alias("successful"))


@query(f"with {_LOGS} select (select count(*) from customer) as total, (select count(*) from customer where c_acctbal > 0) as active, max(sent_at) as last_sent, sum(successful)::bigint as delivered from logs")
def newsletter_stats(spark, d):
    subscribers = view(spark, d, "customer").select((F.col("c_acctbal") > 0).alias("active"))
    return reports.newsletter_stats(subscribers, _logs(spark, d))


@query(
    oracle(
        f", {_LOGS}, since as (select coalesce(max(sent_at)::date, date '1970-01-01') as since from logs where status = 'success' and sent_at < timestamp '2024-01-11') select id, title, created_at from coupons, since where status = 'active' and (expiry_date is null or expiry_date >= date '2024-01-31') and created_at > since order by created_at desc, id limit 15",
        "coupons",
    )
)
def newsletter_selection(spark, d):
    early = _logs(spark, d).filter("sent_at < timestamp_ntz'2024-01-11 00:00:00'")
    return reports.newsletter_offers(view(spark, d, "coupons"), early, TODAY).select("id", "title", "created_at")


@query(
    oracle(
        "select coupon_type, count(*) as offers, count_if(coupon_code is not null) as with_code, count_if(expiry_date is not null) as with_expiry, count_if(status = 'active') as active, count_if(discount_value > 25) as large from coupons group by 1",
        "coupons",
    )
)
def coverage_counts(spark, d):
    c = F.col
    return reports.conditional_counts(
        view(spark, d, "coupons"), "coupon_type", offers=F.lit(True), with_code=c("coupon_code").isNotNull(), with_expiry=c("expiry_date").isNotNull(), active=c("status") == "active", large=c("discount_value") > 25
    )


@query(
    oracle(
        """, parts as (select slug, '/' || slug || '-coupons' as path, date '2024-01-15' as lastmod from stores
 union all select slug, '/' || slug || '-offers', null from categories
 union all select lower(replace(title, ' ', '-')), '/' || slug || '-coupons', created_at from (select c.title, c.created_at, s.slug from coupons c join stores s on s.id = c.store_id))
 select path, max(case when year(lastmod) > 1970 then lastmod else date '2024-01-31' end) as lastmod from parts
 where slug <> '' and not regexp_matches(slug, '(?i)((^|[-_/])(test|draft|temp|tmp|deleted|demo|sample|preview|staging)([-_/]|$)|\\d{10,})') group by 1""",
        "stores", "categories", "coupons",
    )
)
def sitemap_dedupe(spark, d):
    stores, categories = view(spark, d, "stores"), view(spark, d, "categories")
    path = F.concat(F.lit("/"), "slug", F.lit("-coupons"))
    s = stores.select("slug", path.alias("path"), F.lit("2024-01-15").alias("lastmod"))
    c = categories.select("slug", F.concat(F.lit("/"), "slug", F.lit("-offers")).alias("path"), F.lit(None).cast("string").alias("lastmod"))
    o = view(spark, d, "coupons").join(stores.select(F.col("id").alias("store_id"), F.col("slug").alias("s_slug")), "store_id")
    o = o.select(F.lower(F.replace(F.col("title"), F.lit(" "), F.lit("-"))).alias("slug"), F.concat(F.lit("/"), "s_slug", F.lit("-coupons")).alias("path"), F.col("created_at").cast("string").alias("lastmod"))
    return reports.sitemap([s, c, o], TODAY)


_COUNTED = """, scored as (select c.*, coalesce(k.n, 0) as clicks, coalesce(v.n, 0) as saves from coupons c
 left join (select coupon_id, count(*) as n from coupon_clicks group by 1) k on k.coupon_id = c.id
 left join (select coupon_id, count(*) as n from saved_coupons group by 1) v on v.coupon_id = c.id)"""
_SCORE = """round(0.4 * case when regexp_matches(lower(title), '\\d{1,3}\\s*%') then least(regexp_extract(lower(title), '(\\d{1,3})\\s*%', 1)::int, 95) / 100.0 else 0 end::double
 + 0.2::double * log10(1.0 + clicks) / 2.5::double + 0.2::double * log10(1.0 + saves) / 2.0::double + 0.15::double * greatest(0.1::double, exp(-date_diff('day', created_at, date '2024-01-31') / 30.0::double))
 + case when coupon_type = 'code' and coupon_code <> '' then 0.05 else 0.0 end::double
 - case when expiry_date is null then 0 when expiry_date < date '2024-01-31' then 0.8 when expiry_date < date '2024-02-01' then 0.15 else 0 end::double, 6)"""


@query(oracle(f"{_COUNTED} select id, clicks, saves, {_SCORE} as score from scored where status = 'active'", "coupons", "coupon_clicks", "saved_coupons"))
def rank_score(spark, d):
    active = view(spark, d, "coupons").filter("status = 'active'")
    counted = catalog.click_counts(view(spark, d, "saved_coupons"), catalog.click_counts(view(spark, d, "coupon_clicks"), active), "saves")
    return catalog.score_offers(counted, NOW).select("id", "clicks", "saves", "score")


@query(
    oracle(
        """, s as (select *, case when discount_type = 'percentage' then 2 * discount_value when discount_type = 'fixed' then discount_value else 1 end as score from coupons where status = 'active' and discount_value > 0)
 select store_id, id, title, score from s qualify row_number() over (partition by store_id order by score desc, created_at desc, id) = 1""",
        "coupons",
    )
)
def best_offer(spark, d):
    return catalog.best_offers(view(spark, d, "coupons"))


@query(oracle("select id, title, created_at from coupons where status = 'active' and featured_in_banner order by created_at desc, id limit 8", "coupons"))
def banner_featured(spark, d):
    return catalog.banner(view(spark, d, "coupons"), view(spark, d, "coupon_clicks"), MONTH_AGO).select("id", "title", "created_at")


@query(
    oracle(
        """, young as (select * from coupons where status = 'active' order by created_at desc, id limit 24)
 select y.id, y.title, count(k.id) as clicks from young y left join coupon_clicks k on k.coupon_id = y.id and k.clicked_at >= timestamp '2024-01-01' group by y.id, y.title, y.created_at order by 3 desc, y.created_at desc, y.id limit 8""",
        "coupons", "coupon_clicks",
    )
)
def banner_fallback(spark, d):
    plain = view(spark, d, "coupons").withColumn("featured_in_banner", F.lit(False))
    return catalog.banner(plain, view(spark, d, "coupon_clicks"), MONTH_AGO).select("id", "title", "clicks")


@query(
    oracle(
        _COUNTED
        + f""", signals as (select coupon_id from saved_coupons where user_id = 7 union all (select coupon_id from coupon_clicks where user_id = 7 order by clicked_at desc, id desc limit 50)),
 mine as (select distinct c.store_id from signals g join coupons c on c.id = g.coupon_id),
 young as (select * from scored where status = 'active' and (store_id in (select store_id from mine) or (select count(*) from mine) = 0) order by created_at desc, id limit 40)
 select id, title, {_SCORE} as score from young order by score desc, id limit 6""",
        "coupons", "coupon_clicks", "saved_coupons",
    )
)
def recommendations(spark, d):
    return catalog.recommendations(*[view(spark, d, n) for n in ("coupons", "coupon_clicks", "saved_coupons")], USER, NOW).select("id", "title", "score")


@query(
    oracle(
        "select c.id, c.title, k.clicks, case when k.clicks <= 1 then 1 else (case when k.clicks / pow(10, floor(log10(k.clicks))) <= 1 then 1 when k.clicks / pow(10, floor(log10(k.clicks))) <= 2 then 2 when k.clicks / pow(10, floor(log10(k.clicks))) <= 5 then 5 else 10 end) * pow(10, floor(log10(k.clicks))) end::double as axis from (select coupon_id, count(*) as clicks from coupon_clicks group by 1) k join coupons c on c.id = k.coupon_id",
        "coupons", "coupon_clicks",
    )
)
def fn_axis(spark, d):
    counts = view(spark, d, "coupon_clicks").groupBy(F.col("coupon_id").alias("id")).agg(F.count("*").alias("clicks"))
    return view(spark, d, "coupons").join(counts, "id").select("id", "title", "clicks", nice_ceil(F.col("clicks")).alias("axis"))


@query(
    r"""select conv_id, turn, trim(text) <> '' and (regexp_matches(trim(text), '(?i)\b(best|cheap|cheapest|recommend|suggest|compare|help|which|what|why|how|when|where|should|any|find me|show me|looking for|need)\b')
 or regexp_matches(trim(text), '(?i)\b(under|below|less than|between)\s*\$?\d') or regexp_matches(trim(text), '(?i)\b(this|next)\s+(week|month|weekend)\b') or regexp_matches(trim(text), '\?$')
 or len(regexp_split_to_array(trim(text), '\s+')) > 4) as conversational from conversations"""
)
def fn_conversational(spark, d):
    return view(spark, d, "conversations").select("conv_id", "turn", is_conversational(F.col("text")).alias("conversational"))


@query(
    oracle(
        "select span, count(*) as clicks, count(distinct user_id) as users from coupon_clicks join (select unnest([7, 30, 90]) as span) s on cast(clicked_at as date) > date '2024-01-31' - span and cast(clicked_at as date) <= date '2024-01-31' group by 1",
        "coupon_clicks",
    )
)
def distinct_visitors(spark, d):
    """A7 over spans of days, from a table of daily bitmaps."""
    folder = fresh_dir(spark, "daily")
    reports.daily_bitmaps(view(spark, d, "coupon_clicks")).write.partitionBy("day").parquet(folder)
    return reports.span_totals(spark.read.schema("part long, users binary, clicks long, day date").parquet(folder), TODAY)


_SUBSCRIBERS = "id, 'u' || id || '@x.example' as email, 'token-' || id as token, id % 3 <> 0 as active"


@query(
    oracle(
        f""", sub as (select {_SUBSCRIBERS} from stores), q as (select source, lower(trim(query)) as name, count(*) as n, row_number() over (partition by source order by count(*) desc, lower(trim(query))) as place from search_queries where trim(query) <> '' group by 1, 2)
 select 'search' as what, name, n from q where source = 'search' and place <= 25 union all select 'ai', name, n from q where source = 'ai' and place <= 8
 union all select 'subscribe', 'new@x.example', 1 union all select 'unsubscribe', token, id from sub where token = 'token-4' and active""",
        "stores", "search_queries",
    )
)
def call_functions(spark, d):
    """2.12: functions with parameters, called from SQL; of three addresses one is known and one is none."""
    register_functions(spark, search_queries=view(spark, d, "search_queries"), subscribers=view(spark, d, "stores").selectExpr(*_SUBSCRIBERS.split(", ")))
    return spark.sql("""
        select 'search' as what, query as name, count as n from get_top_searches(25) union all select 'ai', query, count from get_top_searches(n => 8, kind => 'ai')
        union all select 'subscribe', t.email, 1 from values (' New@X.example '), (' U1@x.example'), ('no address') as a(address), lateral subscribe_email(a.address) t
        union all select 'unsubscribe', 'token-' || id, id from unsubscribe_by_token('token-4')""")


# Plain terms, one with a live wildcard, one too short for the index, one in very many titles, one that nothing holds.
_TERMS = ("D WIDGET", "4% off c", "rod1", "9% O", "7", "off", "no such offer")


def _offer_index(spark, d) -> substring.SubstringIndex:
    """An index of titles and codes in two batches."""
    offers, folder = view(spark, d, "coupons"), fresh_dir(spark, "substrings")
    for batch in (0, 1):
        substring.write_index(offers.filter(F.col("id") % 2 == batch), "id", ["title", "coupon_code"], folder, batch, 32, 4)
    return substring.SubstringIndex(spark, folder)


@query(oracle(" union all ".join(f"select '{t}' as term, id, title, coupon_code from coupons where title ilike '%{t}%' or coupon_code ilike '%{t}%'" for t in _TERMS), "coupons"))
def substring_search(spark, d):
    """F4, F6 by the index of trigrams."""
    index = _offer_index(spark, d)
    each = [index.ilike_any(f"%{t}%").select(F.lit(t).alias("term"), "id", "title", "coupon_code") for t in _TERMS]
    return reduce(DataFrame.unionByName, each)


@query(oracle("select c.id, c.title, c.coupon_code, c.created_at, s.name as store_name from coupons c left join stores s on s.id = c.store_id where c.status = 'active' and (c.title ilike '%widget2%' or c.coupon_code ilike '%widget2%') order by c.created_at desc, c.id limit 12", "coupons", "stores"))
def substring_newest(spark, d):
    """the search page over the rows that the index names."""
    return catalog.search_offers(_offer_index(spark, d).holding(["widget2"]), view(spark, d, "stores"), "widget2")


@query(oracle("select id, status from coupons where (lower(title) like '%bolt%' or lower(coupon_code) like '%bolt%') and status = 'active'", "coupons"))
def substring_facets(spark, d):
    """F10, F11 by the index."""
    return catalog.facets(_offer_index(spark, d).contains_any("BOLT"), status="active").select("id", "status")
