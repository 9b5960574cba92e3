"""Catalogue merges as pure functions from tables to their next versions (K1, K5, K6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealforge.operators.imports import match_existing

# K1: how an incoming value meets the one that stands there.
PROVIDER_WINS, ADMIN_WINS, OVERWRITE, MERGE_MAP, KEEP_OLD, REPLACE_FILLED = "provider", "admin", "overwrite", "map", "keep", "filled"
STORE_RULES = {"name": PROVIDER_WINS, "logo_url": PROVIDER_WINS, "affiliate_url": PROVIDER_WINS, "country": PROVIDER_WINS, "description": ADMIN_WINS, "metadata": MERGE_MAP, "shipping_regions": REPLACE_FILLED}
COUPON_RULES = {
    "title": PROVIDER_WINS, "discount_type": PROVIDER_WINS, "discount_value": PROVIDER_WINS, "description": ADMIN_WINS, "terms": ADMIN_WINS,
    "coupon_code": OVERWRITE, "expiry_date": OVERWRITE, "status": OVERWRITE, "store_id": OVERWRITE, "metadata": MERGE_MAP, "structured_terms": KEEP_OLD,
}


def merged(rule: str, old: Column, new: Column) -> Column:
    """K1b to K1f: one column's next value."""
    if rule == OVERWRITE:
        return new
    if rule == ADMIN_WINS:
        return F.coalesce(F.nullif(F.trim(old), F.lit("")), new)
    if rule == KEEP_OLD:
        return F.coalesce(old, new)
    if rule == MERGE_MAP:
        kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))  # no key twice, whatever the session says of that
        return F.coalesce(F.map_concat(kept, new), old, new)
    if rule == REPLACE_FILLED:
        return F.when(F.size(new) > 0, new).otherwise(old)
    return F.coalesce(new, old)


def apply_rows(current: DataFrame, incoming: DataFrame, rules: dict[str, str], provider: str, match_slug: bool = True) -> tuple[DataFrame, DataFrame]:
    """K1: (next version, counts created / updated) of one table.

    Both have provider, provider_entity_id and the ruled columns; current has id, and
    slug where match_slug. A row that is matched by slug takes on the provider's
    identity. New ids are hashes of the identity, so reruns agree.
    """
    rows = incoming if "slug" in incoming.columns else incoming.withColumn("slug", F.lit(None).cast("string"))
    known = current if match_slug else current.withColumn("slug", F.lit(None).cast("string"))
    plan = match_existing(rows, known.select("id", "provider", "provider_entity_id", "slug"), provider)
    ruled = [c for c in rules if c in current.columns]
    new = plan.filter("action = 'update'").select(F.col("existing_id"), F.col("provider").alias("__provider"), F.col("provider_entity_id").alias("__entity"), *[F.col(c).alias(f"__{c}") for c in ruled])
    joined = current.join(new, F.col("id") == F.col("existing_id"), "left")
    hit = F.col("existing_id").isNotNull()
    values = {c: F.when(hit, merged(rules[c], F.col(c), F.col(f"__{c}"))).otherwise(F.col(c)) for c in ruled}
    values |= {"provider": F.when(hit, F.col("__provider")).otherwise(F.col("provider")), "provider_entity_id": F.when(hit, F.col("__entity")).otherwise(F.col("provider_entity_id"))}
    kept = joined.select(*[values.get(c, F.col(c)).alias(c) for c in current.columns])
    fresh = plan.filter("action = 'create'")
    made_id = F.sha2(F.concat_ws("::", "provider", "provider_entity_id"), 256)
    created = fresh.select(*[(made_id if c == "id" else F.col(c) if c in fresh.columns else F.lit(None)).cast(current.schema[c].dataType).alias(c) for c in current.columns])
    return kept.unionByName(created), plan.agg(F.count_if(F.col("action") == "create").alias("created"), F.count_if(F.col("action") == "update").alias("updated"))


def published_status(status: Column, start: Column, end: Column, today: str) -> Column:
    """K1: expired behind its end, draft before its start, else what the provider says (active by default); an expired offer that still runs is active."""
    day = F.lit(today).cast("date")
    said = F.coalesce(F.nullif(status, F.lit("")), F.lit("active"))
    return F.when(end < day, "expired").when(start > day, "draft").when(said == "expired", "active").otherwise(said)


def import_apply(current: dict[str, DataFrame], incoming: dict[str, DataFrame], provider: str, today: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """K1: (next versions of categories, stores and coupons, counts created / updated / skipped).

    Stores find their category, and coupons their store, by the provider's ids in the
    versions that the steps before made. A coupon without a store is skipped and
    counted (K1g). Each step is three joins by key; nothing is looped over.
    """
    owned = {name: df.withColumn("provider", F.lit(provider)) for name, df in incoming.items()}
    ids = lambda df, key, name: df.filter(F.col("provider") == provider).select(F.col("provider_entity_id").alias(key), F.col("id").alias(name))
    categories, n_categories = apply_rows(current["categories"], owned["categories"], {"name": PROVIDER_WINS}, provider)
    placed = owned["stores"].join(ids(categories, "category_provider_id", "category_id"), "category_provider_id", "left")
    stores, n_stores = apply_rows(current["stores"], placed, STORE_RULES | {"category_id": PROVIDER_WINS}, provider)
    offers = owned["coupons"].join(ids(stores, "store_provider_id", "store_id"), "store_provider_id", "left")
    offers = offers.withColumn("status", published_status(F.col("status"), F.col("start_date"), F.col("expiry_date"), today))
    coupons, n_coupons = apply_rows(current["coupons"], offers.filter("store_id is not null"), COUPON_RULES | {"start_date": PROVIDER_WINS}, provider, match_slug=False)
    skipped = offers.agg(F.count_if(F.col("store_id").isNull()).alias("skipped"))
    counts = n_categories.unionByName(n_stores).unionByName(n_coupons).agg(F.sum("created").alias("created"), F.sum("updated").alias("updated")).crossJoin(skipped)
    return {"categories": categories, "stores": stores, "coupons": coupons}, counts


def append_run(history: DataFrame, counts: DataFrame, provider: str, finished_at: str, errors: int = 0) -> DataFrame:
    """K7: history with one row more: run_id, provider, finished_at, status, created, updated, skipped, errors."""
    status = F.lit("failed" if errors else "success")
    run = counts.select(
        F.sha2(F.concat_ws("::", F.lit(provider), F.lit(finished_at)), 256).alias("run_id"), F.lit(provider).alias("provider"), F.lit(finished_at).cast("timestamp_ntz").alias("finished_at"),
        F.when((F.col("skipped") > 0) & (status == "success"), "partial").otherwise(status).alias("status"), "created", "updated", "skipped", F.lit(errors).cast("long").alias("errors"),
    )
    return history.unionByName(run)


def subscribe(subscribers: DataFrame, emails: DataFrame) -> DataFrame:
    """K5: new subscribers: normalised, valid addresses that are not there yet, once each."""
    email = F.lower(F.trim("email"))
    valid = emails.select(email.alias("email")).filter(F.length("email").between(6, 254) & F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"))
    return valid.dropDuplicates(["email"]).join(subscribers.select("email"), "email", "left_anti")


def unsubscribe(subscribers: DataFrame, token: str) -> tuple[DataFrame, DataFrame]:
    """K6: (next version, done): the active subscriber with the token becomes inactive."""
    hit = (F.col("token") == F.lit(token)) & F.col("active")
    return subscribers.withColumn("active", F.when(hit, F.lit(False)).otherwise(F.col("active"))), subscribers.agg((F.count_if(hit) > 0).alias("done"))


def touched(before: DataFrame, after: DataFrame, key: str, now: str) -> DataFrame:
    """After, whose updated_at is now in rows that differ from before's of the same key, and in new ones."""
    columns = [c for c in after.columns if c != "updated_at"]
    old = before.select(F.col(key).alias("__key"), F.struct(*columns).alias("__old"), F.col("updated_at").alias("__at"))
    same = F.struct(*columns).eqNullSafe(F.col("__old"))
    at = F.when(same, F.col("__at")).otherwise(F.lit(now).cast("timestamp_ntz"))
    return after.join(old, F.col(key) == F.col("__key"), "left").select(*columns, at.alias("updated_at"))


def searches_to_append(queries: DataFrame, length: int = 200) -> DataFrame:
    """K3: trimmed, cut, without blank ones."""
    return queries.withColumn("query", F.substring(F.trim("query"), 1, length)).filter("query != ''")
