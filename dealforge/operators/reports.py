"""Click, search, import and newsletter reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealforge.functions.offers import round_half_up
from dealforge.functions.text import is_clean_slug, norm_query, xml_text


def top_searches(queries: DataFrame, source: str = "search", limit: int = 10) -> DataFrame:
    """A1, A2: the most frequent queries of a source, ties by query."""
    named = queries.filter((F.col("source") == source) & (F.trim("query") != "")).groupBy(norm_query(F.col("query")).alias("query"))
    return named.agg(F.count("*").alias("count")).orderBy(F.desc("count"), "query").limit(limit)


def with_offer(clicks: DataFrame, coupons: DataFrame, stores: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Clicks with their coupon's title, store and category, where there are any.

    The dimensions join by key; Spark broadcasts those that its size limit admits.
    """
    c = coupons.select(F.col("id").alias("coupon_id"), F.col("title").alias("coupon_title"), "store_id")
    s = stores.select(F.col("id").alias("store_id"), F.col("name").alias("store_name"), F.col("slug").alias("store_slug"), "category_id")
    out = clicks.join(c, "coupon_id", "left").join(s, "store_id", "left")
    if categories is not None:
        out = out.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name")), "category_id", "left")
    return out


def clicks_of_offers(clicks: DataFrame, coupons: DataFrame, stores: DataFrame, categories: DataFrame) -> DataFrame:
    """One row a clicked coupon, with its store, category and `clicks`: facts are counted before they are joined."""
    return with_offer(clicks.groupBy("coupon_id").agg(F.count("*").alias("clicks")), coupons, stores, categories)


def recent(clicks: DataFrame, since: str | None, row_cap: int | None = None) -> DataFrame:
    """Clicks from a time on; row_cap keeps the newest of them, as a page would."""
    out = clicks.filter(F.col("clicked_at") >= F.lit(since).cast("timestamp_ntz")) if since else clicks
    return out.orderBy(F.desc("clicked_at"), F.desc("id")).limit(row_cap) if row_cap else out


def clicks_per_day(clicks: DataFrame, first: str, last: str) -> DataFrame:
    """A3: day, clicks, for every day from first to last; days without a click have 0."""
    days = clicks.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    inside = (F.col("clicked_at") >= F.lit(first).cast("date")) & (F.col("clicked_at") < F.date_add(F.lit(last).cast("date"), 1))  # reaches the scan
    counts = clicks.filter(inside).groupBy(F.to_date("clicked_at").alias("day")).agg(F.count("*").alias("clicks"))
    return days.join(counts, "day", "left").select("day", F.coalesce("clicks", F.lit(0)).alias("clicks"))


def top_counts(rows: DataFrame, key: str | Column, name: str, limit: int | None = 10, keep_null: bool = False) -> DataFrame:
    """Clicks per key, most frequent first, ties by key; rows without a key do not count.

    A row is one click, or as many as its column `clicks` says.
    """
    n = F.sum("clicks") if "clicks" in rows.columns else F.count("*")
    keyed = rows.withColumn(name, F.col(key) if isinstance(key, str) else key)
    keyed = keyed if keep_null else keyed.filter(F.col(name).isNotNull())
    out = keyed.groupBy(name).agg(n.alias("clicks")).orderBy(F.desc("clicks"), name)
    return out.limit(limit) if limit else out


def click_totals(clicks: DataFrame, days: int) -> DataFrame:
    """A7."""
    return clicks.agg(F.count("*").alias("total"), F.countDistinct("coupon_id").alias("coupons"), F.lit(days).alias("days"))


def public_tops(clicks: DataFrame, coupons: DataFrame, stores: DataFrame, last: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Top ten coupons and top eight brands among the last clicks."""
    rows = with_offer(recent(clicks, None, last), coupons, stores)
    return top_counts(rows, F.coalesce("coupon_title", F.lit("Unknown coupon")), "label", 10), top_counts(rows, "store_slug", "slug", 8)


def bar_percents(counts: DataFrame, value: str) -> DataFrame:
    """Percent: the value as a share of the largest, 6 at least."""
    most = counts.agg(F.max(value).alias("__most"))
    share = round_half_up(100.0 * F.col(value) / F.col("__most")).cast("int")
    return counts.crossJoin(F.broadcast(most)).withColumn("percent", F.greatest(F.lit(6), share)).drop("__most")


def offers_per_store(coupons: DataFrame) -> DataFrame:
    """A10: active offers by store."""
    return coupons.filter("status = 'active' and store_id is not null").groupBy("store_id").agg(F.count("*").alias("offers"))


def offers_per_category(per_store: DataFrame, stores: DataFrame) -> DataFrame:
    """The sum of its stores' offers for every category."""
    s = stores.filter("category_id is not null").select(F.col("id").alias("store_id"), "category_id")
    return s.join(per_store, "store_id").groupBy("category_id").agg(F.sum("offers").alias("offers"))


def newsletter_stats(subscribers: DataFrame, logs: DataFrame) -> DataFrame:
    """Subscribers, active ones, the last sending and the sum of deliveries (0 without one)."""
    s = subscribers.agg(F.count("*").alias("total"), F.count_if("active").alias("active"))
    return s.crossJoin(F.broadcast(logs.agg(F.max("sent_at").alias("last_sent"), F.coalesce(F.sum("successful"), F.lit(0)).cast("long").alias("delivered"))))


def newsletter_offers(coupons: DataFrame, logs: DataFrame, today: str, limit: int = 15) -> DataFrame:
    """The newest active, unexpired offers since the last successful sending."""
    since = logs.filter("status = 'success'").agg(F.coalesce(F.max("sent_at").cast("date"), F.lit("1970-01-01").cast("date")).alias("since"))
    day = F.lit(today).cast("date")
    rows = coupons.filter((F.col("status") == "active") & (F.col("expiry_date").isNull() | (F.col("expiry_date") >= day)))
    return rows.crossJoin(F.broadcast(since)).filter("created_at > since").drop("since").orderBy(F.desc("created_at"), "id").limit(limit)


def newsletter_recipients(subscribers: DataFrame) -> DataFrame:
    """Email and unsubscribe_token of the subscribers who are active and verified; an unknown state is neither."""
    return subscribers.filter(F.col("active") & F.col("verified")).select("email", "unsubscribe_token")


def conditional_counts(df: DataFrame, by: str | None = None, **conditions: Column) -> DataFrame:
    """How many rows meet each condition, all together or by a column."""
    aggs = [F.count_if(c).alias(name) for name, c in conditions.items()]
    return df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)


def status_histogram(df: DataFrame, status: str, values: list[str], by: str) -> DataFrame:
    """Counts by status as columns, 0 where there is none."""
    return df.groupBy(by).pivot(status, values).agg(F.count(F.lit(1))).na.fill(0, values)


def last_outcomes(tests: DataFrame, by: str, at: str, success: Column) -> DataFrame:
    """The last success and the last failure."""
    return tests.groupBy(by).agg(F.max(F.when(success, F.col(at))).alias("last_success"), F.max(F.when(~success, F.col(at))).alias("last_failure"))


def sitemap(parts: list[DataFrame], build_date: str) -> DataFrame:
    """Path, lastmod: one row per path of a clean slug, with its latest valid date.

    parts: slug, path, lastmod. A missing date, or one of 1970 or before, is the build date.
    """
    rows = reduce(DataFrame.unionByName, [p.select("slug", "path", F.col("lastmod").cast("date").alias("lastmod")) for p in parts])
    valid = F.when(F.year("lastmod") > 1970, F.col("lastmod")).otherwise(F.lit(build_date).cast("date"))
    return rows.filter(is_clean_slug(F.col("slug"))).groupBy("path").agg(F.max(valid).alias("lastmod"))


# The envelope of a sitemap.
SITEMAP_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
SITEMAP_TAIL = "</urlset>"


def sitemap_xml(entries: DataFrame, site: str) -> DataFrame:
    """Path and one <url> element per entry, escaped. The envelope is SITEMAP_HEAD and SITEMAP_TAIL around each file's elements."""
    url = F.concat(F.lit("<url><loc>"), xml_text(F.concat(F.lit(site), "path")), F.lit("</loc><lastmod>"), F.date_format("lastmod", "yyyy-MM-dd"), F.lit("</lastmod></url>"))
    return entries.select("path", url.alias("xml"))


def identity_summary(arrived: DataFrame, planned: DataFrame, kind: str) -> DataFrame:
    """Fetched, unique, duplicated identities, dropped rows, creates and updates of a kind."""
    per = arrived.groupBy("provider_entity_id").agg(F.count("*").alias("n"))
    counts = per.agg(F.sum("n").alias("fetched"), F.count("*").alias("unique_ids"), F.count_if(F.col("n") > 1).alias("duplicated"), F.sum(F.col("n") - 1).alias("dropped"))
    actions = planned.agg(F.count_if(F.col("action") == "create").alias("to_create"), F.count_if(F.col("action") == "update").alias("to_update"))
    return counts.crossJoin(F.broadcast(actions)).select(F.lit(kind).alias("kind"), "*")


def sync_statistics(per_entity: DataFrame) -> DataFrame:
    """Per-entity counters and their total, in one pass over the data."""
    numbers = [c for c in per_entity.columns if c != "entity"]
    by = per_entity.rollup("entity").agg(*[F.sum(c).cast("long").alias(c) for c in numbers], F.grouping("entity").alias("__all"))
    return by.withColumn("entity", F.when(F.col("__all") == 1, "total").otherwise(F.col("entity"))).drop("__all")


def daily_bitmaps(clicks: DataFrame) -> DataFrame:
    """Day, part, users (a bitmap), clicks: what a day adds to any span, one row a day and 32,768 user ids.

    Written once a day, it stands for the facts: spans add up days and scan no clicks.
    Clicks without a user are counted in part -1.
    """
    user = F.col("user_id").cast("long")
    part = F.coalesce(F.bitmap_bucket_number(user), F.lit(-1).cast("long"))
    return clicks.groupBy(F.to_date("clicked_at").alias("day"), part.alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(user)).alias("users"), F.count("*").alias("clicks"))


def span_totals(daily: DataFrame, today: str, spans: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
    """Span (days up to today), clicks, users: distinct users exactly, by joining the days' bitmaps.

    Bitmaps combine in each task and meet by part, never all in one.
    """
    day = F.lit(today).cast("date")
    inside = daily.filter(F.col("day").between(F.date_sub(day, max(spans) - 1), day)).withColumn("span", F.explode(F.array(*map(F.lit, spans)))).filter(F.col("day") > F.date_sub(day, F.col("span")))
    parts = inside.groupBy("span", "part").agg(F.bitmap_or_agg("users").alias("users"), F.sum("clicks").alias("clicks"))
    return parts.groupBy("span").agg(F.sum("clicks").alias("clicks"), F.sum(F.when(F.col("part") >= 0, F.bitmap_count("users")).otherwise(0)).alias("users"))
