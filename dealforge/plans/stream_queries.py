"""Queries over streams that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealforge.plans.registry import query
from dealforge.session import fresh_dir, setting
from dealforge.operators import sideloads
from dealforge.sources import feed
from dealforge.sources.catalogue import oracle, view
from dealforge.streaming import rotation, upserts

# A feed has 1000 events, a page 100. Every fifth feed from the third has a short page in
# its middle, from the fourth a page that fails twice, from the fifth one that is not there.
_FEED = """
with e as (select event_id, event_type, event_id // 1000 as f, (event_id % 1000) // 100 + 1 as page, event_id % 100 as place from events)
select 'feed ' || f as feed, page::int as page, place::int as place, event_id, event_type, case when f % 5 = 3 and page = 3 then 3 else 1 end as attempts, null::varchar as error
from e where not (f % 5 = 2 and (page > 4 or page = 4 and place >= 50)) and not (f % 5 = 4 and page > 1)
union all select distinct 'feed ' || f, 2, null::int, null::bigint, null::varchar, 1, 'status 404' from e where f % 5 = 4
"""


@query(_FEED)
def provider_feed(spark, d):
    """Pages cut from events, read as a stream of feeds until each ends."""
    folder = fresh_dir(spark, "feed")
    number, place = F.col("event_id") - F.col("event_id") % 1000, F.col("event_id") % 100
    events = view(spark, d, "events").withColumn("f", (number / 1000).cast("long")).withColumn("page", F.floor(F.col("event_id") % 1000 / 100).cast("int") + 1)
    cut = events.filter(~((F.col("f") % 5 == 2) & (F.col("page") == 4) & (place >= 50)))
    cut = cut.select(F.concat(F.lit("feed "), F.col("f").cast("string")).alias("feed"), "page", place.alias("place"), F.to_json(F.struct("event_id", "event_type")).alias("record"))
    numbers = events.select("f").distinct()
    odd = lambda rest, page, status, times: numbers.filter(F.col("f") % 5 == rest).select(F.concat(F.lit("feed "), F.col("f").cast("string")).alias("feed"), F.lit(page).alias("page"), F.lit(status).alias("status"), F.lit(times).alias("times"))
    feed.store_pages(cut, odd(3, 3, 503, 2).unionByName(odd(4, 2, 404, 9)), f"{folder}/pages")
    feeds = [r[0] for r in spark.read.parquet(f"{folder}/pages").select("feed").distinct().collect()]  # a feed is an integration's entity: the driver holds a name and a page number of each
    options = {"pages": f"{folder}/pages", "pageSize": 100, "pagesPerBatch": 4, "pagesPerTask": 512, "baseDelayMs": 1, "jitterMs": 1}
    rows = feed.read_to_end(spark, folder, sorted(feeds), "dealforge.sources.feed:fetch_stored", **options)
    rows = rows.withColumn("r", F.from_json("record", "event_id long, event_type string"))
    return rows.select("feed", "page", "place", "r.event_id", "r.event_type", "attempts", "error")


_RUNS = 3
_SIZES = """select 'default' as policy, 'net' as provider, kind, store_key, run, size, case when kind = 'deal' then least(size, 3) else size end as lim, size < 5 as gated
 from (select coupon_type as kind, cast(store_id as string) as store_key, run, count(*)::int as size from coupons join (select unnest([0, 1, 2]) as run) r on id % 4 <> run group by 1, 2, 3)"""


def _moved(run: int, before: str) -> str:
    """SQL of a run's rows; before: the cursors that stand (kind, store_key, cursor)."""
    first = "case when size > lim then coalesce(b.cursor, 0) % size else 0 end"
    return f"select s.policy, s.provider, s.kind, s.store_key, s.run, ({first})::int as first, (case when gated then coalesce(b.cursor, 0) else ({first} + lim) % size end)::int as cursor from sizes s left join {before} b using (kind, store_key) where s.run = {run}"


_ROTATION = f""", sizes as ({_SIZES}), none as (select '' as kind, '' as store_key, 0 as cursor), r0 as ({_moved(0, "none")}), r1 as ({_moved(1, "r0")}),
 l1 as (select kind, store_key, cursor from r1 union all select kind, store_key, cursor from r0 anti join r1 using (kind, store_key)), r2 as ({_moved(2, "l1")})
 select * from r0 union all select * from r1 union all select * from r2"""


def run_sizes(coupons: DataFrame, run: int) -> DataFrame:
    """What a run tells the rotation of every store: those coupons are fit whose id does not leave the run's number, modulo 4."""
    fit = coupons.filter(F.col("id") % 4 != run).groupBy(F.col("coupon_type").alias("kind"), F.col("store_id").cast("string").alias("store_key")).agg(F.count("*").cast("int").alias("size"))
    limit = F.when(F.col("kind") == "deal", F.least("size", F.lit(3))).otherwise(F.col("size"))
    return fit.select(F.lit("default").alias("policy"), F.lit("net").alias("provider"), "kind", "store_key", F.lit(run).alias("run"), "size", limit.alias("limit"), (F.col("size") < 5).alias("gated"))


@query(oracle(_ROTATION, "coupons").replace("as string", "as varchar"))
def policy_rotation_stream(spark, d):
    """Three runs in turn; each resumes the stream, whose state holds the cursors of the one before."""
    folder = fresh_dir(spark, "rotation")
    coupons = view(spark, d, "coupons")
    with setting(spark, "spark.sql.streaming.stateStore.providerClass", rotation.ROCKSDB):
        for run in range(_RUNS):
            sizes = run_sizes(coupons, run)
            sizes.write.mode("append").parquet(f"{folder}/sizes")
            stream = rotation.rotated(spark.readStream.schema(sizes.schema).parquet(f"{folder}/sizes"))
            stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/cursors").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rotation.CURSORS).parquet(f"{folder}/cursors")


@query(oracle("select coupon_id, max(id) as id, arg_max(user_id, id) as user_id, arg_max(source_page, id) as source_page from coupon_clicks where coupon_id is not null group by 1", "coupon_clicks"))
def last_click_stream(spark, d):
    """K1, K4: clicks come in batches that are not in order; the table keeps the last one of every coupon."""
    folder = fresh_dir(spark, "clicks")
    clicks = view(spark, d, "coupon_clicks").filter("coupon_id is not null").select("coupon_id", "id", "user_id", "source_page")
    clicks.repartition(6, F.col("id") % 6).write.parquet(f"{folder}/clicks")
    stream = spark.readStream.schema(clicks.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/clicks")
    upserts.upsert_stream(stream, f"{folder}/table", ["coupon_id"], f"{folder}/checkpoint", ["id"], 16).awaitTermination()
    return upserts.latest_version(spark, f"{folder}/table")


_SIDE_SQL = """, ads as (select n as seq, case when n % 5 = 0 then 'P' || n end as promotion_id, case when n % 5 < 2 then (n % 50)::varchar end as campaign_id, case n % 5 when 3 then (100000 + n)::varchar when 1 then null else 'A' || (n % 20) end as advertiser_id,
 case when n % 5 < 2 then p_name when n % 5 = 3 then 'only ' || n end as title, case n % 5 when 0 then 'c' || n when 2 then 'k ' || (n % 30) end as code, case n % 5 when 0 then 'about ' || p_name when 3 then 'only ' || n end as description,
 case n % 5 when 0 then 'C' || n when 2 then 'K ' || (n % 30) end as offer_code, case when n % 5 = 0 then 'https://t.example/' || n end as tracking, case when n % 5 = 1 then 'https://www.shop' || (n % 7) || '.example/x' end as landing from raw_ads join part on n = p_partkey where n % 5 < 4),
 k as (select unnest([(n % 60)::varchar, 'A' || (n % 25)]) as key, n from raw_campaigns), cm as (select key, max(n) as n from k group by 1),
 p as (select n, case n % 6 when 0 then 'P' || n when 1 then '1' end as promotion_id, case n % 6 when 0 then '7' when 1 then (n % 55)::varchar end as campaign_id, case n % 6 when 2 then 'A' || (n % 30) when 3 then 'A' || (n % 20) when 4 then (100000 + n - 1)::varchar end as advertiser_id,
 case when n % 6 in (1, 2) then p_name end as title, case when n % 6 = 3 then 'k ' || (n % 30) end as code from raw_promotions join part on n = p_partkey where n % 6 < 5),
 i1 as (select promotion_id, max(seq) as a from ads where promotion_id is not null group by 1), i2 as (select campaign_id, title, max(seq) as a from ads where campaign_id is not null and title is not null group by 1, 2), i3 as (select campaign_id, max(seq) as a from ads where campaign_id is not null group by 1 having count(*) = 1),
 i4 as (select advertiser_id, title, min(seq) as a from ads where advertiser_id is not null and title is not null group by 1, 2), i5 as (select advertiser_id, code, min(seq) as a from ads where advertiser_id is not null and code is not null group by 1, 2), i6 as (select advertiser_id, max(seq) as a from ads where advertiser_id is not null group by 1 having count(*) = 1),
 m as (select p.n, coalesce(i1.a, i2.a, i3.a, i4.a, i5.a, i6.a) as seq, case when i1.a is not null then 'promotion_id' when i2.a is not null then 'campaign_title' when i3.a is not null then 'campaign_single' when i4.a is not null then 'advertiser_title' when i5.a is not null then 'advertiser_code' when i6.a is not null then 'advertiser_single' end as matched_by,
 coalesce(x.n, y.n) as c from p left join i1 on i1.promotion_id = p.promotion_id left join i2 on i2.campaign_id = p.campaign_id and i2.title = p.title left join i3 on i3.campaign_id = p.campaign_id left join i4 on i4.advertiser_id = p.advertiser_id and i4.title = p.title
 left join i5 on i5.advertiser_id = p.advertiser_id and i5.code = p.code left join i6 on i6.advertiser_id = p.advertiser_id left join cm x on x.key = p.advertiser_id left join cm y on y.key = p.campaign_id),
 e as (select m.n as index, matched_by, description, offer_code as code, coalesce(tracking, 'https://c.example/' || c) as tracking_url, case when tracking is not null then 'ad' when c is not null then 'campaign' end as tracking_source,
 coalesce(landing, 'https://www.c' || c || '.example/') as landing_page, s_name as advertiser_name, case when c % 3 > 0 then 'US' end as country, case when c is not null then 'US,CA' else '' end as regions,
 concat_ws(',', case when c is not null then 'a.example,b.example,c' || c || '.example' end, regexp_extract(landing, 'shop[0-9].example', 0)) as domains from m left join ads using (seq) left join supplier on s_suppkey = c)
 """
_SIDE_VIEWS = ("raw_ads", "raw_campaigns", "raw_promotions")


def _side_feeds(spark, d):
    """(ads, campaigns, promotions): the first two as pages of 200 records, loaded as feeds until they end."""
    folder = fresh_dir(spark, "sideloads")
    pages = [view(spark, d, f"raw_{name}").select(F.lit(name).alias("feed"), (F.floor(F.col("n") / 200) + 1).cast("int").alias("page"), (F.col("n") % 200).cast("int").alias("place"), "record") for name in ("ads", "campaigns")]
    failing = spark.range(1).select(F.lit("ads").alias("feed"), F.lit(2).alias("page"), F.lit(503).alias("status"), F.lit(1).alias("times"))
    feed.store_pages(pages[0].unionByName(pages[1]), failing, f"{folder}/pages")
    options = {"pages": f"{folder}/pages", "pageSize": 200, "pagesPerBatch": 64, "pagesPerTask": 64, "readAhead": "true", "maxPages": 1 << 30, "baseDelayMs": 1, "jitterMs": 1}
    loaded = feed.read_to_end(spark, folder, ["ads", "campaigns"], "dealforge.sources.feed:fetch_stored", **options)
    return loaded.filter("feed = 'ads'"), loaded.filter("feed = 'campaigns'"), view(spark, d, "raw_promotions").withColumnRenamed("n", "index")


@query(oracle(_SIDE_SQL + "select * from e", *_SIDE_VIEWS))
def enrich_side_loads(spark, d):
    """Promotions with what two loaded feeds add."""
    ads, campaigns, promotions = _side_feeds(spark, d)
    rows = sideloads.enrich_offers(promotions, ads, campaigns).drop("currency")
    return rows.withColumns({k: F.array_join(k, ",") for k in ("regions", "domains")})


@query(oracle(_SIDE_SQL + "select count(*) as offers, count(matched_by) as with_ad, count(*) filter (tracking_source = 'campaign') as with_campaign_url, (select count(*) from raw_ads where n % 5 < 4) as ad_records, (select count(*) from raw_campaigns) as campaign_records from e", *_SIDE_VIEWS))
def enrichment_statistics(spark, d):
    """What was loaded and how much of it matched."""
    ads, campaigns, promotions = _side_feeds(spark, d)
    return sideloads.enrichment_stats(sideloads.enrich_offers(promotions, ads, campaigns), ads, campaigns)
