"""Catalogue queries: search, pages, ranking, recommendation (F, J, W)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealforge.functions.offers import rank_score
from dealforge.functions.text import contains_any, search_term


def with_store(coupons: DataFrame, stores: DataFrame, how: str = "left") -> DataFrame:
    """Coupons with a nested store (name, slug); inner drops coupons without one."""
    s = stores.select(F.col("id").alias("store_id"), F.struct(F.col("name").alias("name"), F.col("slug").alias("slug"), F.col("category_id").alias("category_id")).alias("store"))
    return coupons.join(s, "store_id", how)


def search_offers(coupons: DataFrame, stores: DataFrame, term: str, limit: int = 12, strip_wildcards: bool = False) -> DataFrame:
    """active offers whose title or code is like the term, newest first."""
    pattern = search_term(term, strip_wildcards)
    hits = coupons.filter((F.col("status") == "active") & (F.col("title").ilike(pattern) | F.col("coupon_code").ilike(pattern)))
    newest = hits.orderBy(F.desc("created_at"), "id").limit(limit)
    return with_store(newest, stores).select("id", "title", "coupon_code", "created_at", F.col("store.name").alias("store_name"))


def search_stores(stores: DataFrame, term: str, limit: int = 10) -> DataFrame:
    """stores whose name is like the term, in order of names. Chats ask for 5, tools for 10."""
    return stores.filter(F.col("name").ilike(search_term(term, True))).orderBy("name", "id").limit(limit).select("id", "name", "slug")


def category_offers(coupons: DataFrame, stores: DataFrame, category_id: int) -> DataFrame:
    """Active offers of the stores of a category."""
    return with_store(coupons.filter("status = 'active'"), stores.filter(F.col("category_id") == category_id), "inner")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of rows in a total order; numbers below 1 are 1."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_with_total(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page, each row with the count of all rows."""
    return page(df, order, number, size).crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))


def newest(coupons: DataFrame, kind: str | None, limit: int) -> DataFrame:
    """The newest active offers of a type."""
    rows = coupons.filter("status = 'active'")
    return (rows.filter(F.col("coupon_type") == kind) if kind else rows).orderBy(F.desc("created_at"), "id").limit(limit)


def flag_members(df: DataFrame, key: str, members: DataFrame, name: str) -> DataFrame:
    """Whether the key is among the members (existence join)."""
    m = members.select(F.col(members.columns[0]).alias("__member")).distinct()
    return df.join(m, F.col(key) == F.col("__member"), "left").withColumn(name, F.col("__member").isNotNull()).drop("__member")


def look_up(df: DataFrame, key: str, names: DataFrame, id_col: str, name_col: str, alias: str) -> DataFrame:
    """A name for each key, null if unknown."""
    return df.join(names.select(F.col(id_col).alias(key), F.col(name_col).alias(alias)), key, "left")


def facets(df: DataFrame, term: str = "", columns: list[str] | None = None, **equal: str) -> DataFrame:
    """any-column search and equality facets; "all" and "" filter nothing."""
    if term:
        df = df.filter(contains_any(term, *[F.col(c) for c in (columns or df.columns)]))
    for name, value in equal.items():
        df = df if value in ("all", "") else df.filter(F.col(name) == value)
    return df


def sort_nulls_last(df: DataFrame, key: str, descending: bool, *ties: str) -> DataFrame:
    """Nulls come last in both directions."""
    return df.orderBy(F.desc_nulls_last(key) if descending else F.asc_nulls_last(key), *ties)


def rank_by_offers(df: DataFrame, offers: DataFrame, key: str, name: str = "name") -> DataFrame:
    """Rows with their number of offers (0 if none), most first, then by name."""
    return df.join(offers.withColumnRenamed(key, "__key"), F.col("id") == F.col("__key"), "left").withColumn("offers", F.coalesce("offers", F.lit(0))).drop("__key").orderBy(F.desc("offers"), name)


def best_offers(coupons: DataFrame) -> DataFrame:
    """The best offer of every store: percentages count twice their value, fixed ones once, others 1.

    An offer without a value is none; ties go to the newest, then to the least id.
    """
    value = F.coalesce("discount_value", F.lit(0.0))
    score = F.when(value <= 0, 0.0).when(F.col("discount_type") == "percentage", 2 * value).when(F.col("discount_type") == "fixed", value).otherwise(1.0)
    scored = coupons.filter("status = 'active' and store_id is not null").withColumn("score", score).filter("score > 0")
    best = scored.groupBy("store_id").agg(F.max_by(F.struct("id", "title", "score"), F.struct("score", "created_at", -F.col("id"))).alias("best"))
    return best.select("store_id", "best.*")


def banner(coupons: DataFrame, clicks: DataFrame, since: str, show: int = 8, pool: int = 24) -> DataFrame:
    """The newest featured offers; if there are none, the most clicked of the newest."""
    active = coupons.filter("status = 'active'")
    featured = active.filter("featured_in_banner").orderBy(F.desc("created_at"), "id").limit(show)
    young = active.orderBy(F.desc("created_at"), "id").limit(pool)
    counts = click_counts(clicks.filter(F.col("clicked_at") >= F.lit(since).cast("timestamp_ntz")), young)
    fallback = counts.orderBy(F.desc("clicks"), F.desc("created_at"), "id").limit(show)
    none = featured.agg(F.count("*").alias("__featured"))
    return featured.withColumn("clicks", F.lit(None).cast("long")).unionByName(fallback.crossJoin(F.broadcast(none)).filter("__featured = 0").drop("__featured"))


def click_counts(clicks: DataFrame, among: DataFrame, name: str = "clicks") -> DataFrame:
    """Among (with id) and how many rows of clicks each has, 0 if none."""
    ids = among.select(F.col("id").alias("coupon_id"))
    counts = clicks.join(ids, "coupon_id", "left_semi").groupBy(F.col("coupon_id").alias("__id")).agg(F.count("*").alias(name))
    return among.join(counts, F.col("id") == F.col("__id"), "left").withColumn(name, F.coalesce(name, F.lit(0))).drop("__id")


def interest_stores(saved_stores: DataFrame | None, saved: DataFrame, clicks: DataFrame, coupons: DataFrame, user_id: int, last_clicks: int = 50) -> DataFrame:
    """The stores that a user saved, or whose offers they saved or lately clicked."""
    mine = F.col("user_id") == user_id
    of = coupons.select(F.col("id").alias("coupon_id"), "store_id")
    signals = saved.filter(mine).select("coupon_id").union(clicks.filter(mine).orderBy(F.desc("clicked_at"), F.desc("id")).limit(last_clicks).select("coupon_id"))
    out = signals.join(of, "coupon_id").select("store_id")
    if saved_stores is not None:
        out = out.union(saved_stores.filter(mine).select("store_id"))
    return out.distinct()


def score_offers(candidates: DataFrame, now: str, popularity: Column | None = None) -> DataFrame:
    """Candidates (with clicks and saves) and their score, rounded to 6 places."""
    at = F.lit(now).cast("timestamp")
    has_code = (F.col("coupon_type") == "code") & F.col("coupon_code").isNotNull() & (F.col("coupon_code") != "")
    score = rank_score(F.col("title"), F.col("clicks"), F.col("saves"), F.col("created_at"), F.col("expiry_date"), has_code, popularity if popularity is not None else F.lit(0.0), at)
    return candidates.withColumn("score", F.round(score, 6))


def recommendations(coupons: DataFrame, clicks: DataFrame, saved: DataFrame, user_id: int, now: str, pool: int = 40, show: int = 6) -> DataFrame:
    """The best scored of the newest offers of a user's stores; of all stores if there are none."""
    stores = interest_stores(None, saved, clicks, coupons, user_id)
    active = coupons.filter("status = 'active'")
    known = stores.agg(F.count("*").alias("__known"))
    flagged = active.join(stores.withColumn("__mine", F.lit(True)), "store_id", "left").crossJoin(F.broadcast(known))
    young = flagged.filter("__mine or __known = 0").drop("__mine", "__known").orderBy(F.desc("created_at"), "id").limit(pool)
    scored = score_offers(click_counts(saved, click_counts(clicks, young), "saves"), now)
    return scored.orderBy(F.desc("score"), "id").limit(show)


def latest_per(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of every group in a total order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("__rn") <= n).drop("__rn")
