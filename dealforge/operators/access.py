"""Row-level security as filters (F15) and audit trails."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADMIN = "admin"

# Who may read what. A table that is named nowhere is read by nobody.
PUBLIC = ("categories", "stores", "subcategories", "translations", "site_settings", "blog_categories")
#: Tables of which everybody reads the rows that meet a condition.
CONDITIONS = {
    "coupons": "status = 'active'", "posts": "status = 'published'", "post_comments": "status = 'approved'", "store_reviews": "status = 'approved'",
    "sliders": "active", "ads": "active", "menus": "active", "pages": "published", "head_entries": "enabled",
}
#: Tables of which a signed-in caller reads their own rows, by the column that names the caller.
OWNED = {"profiles": "id", "user_roles": "user_id", "saved_coupons": "user_id", "saved_stores": "user_id", "search_queries": "user_id", "post_comments": "user_id", "store_reviews": "user_id", "chat_messages": "user_id"}
#: Tables that administrators read whole; of the owned ones only those that are moderated.
MANAGED = (
    *PUBLIC, *CONDITIONS, "coupon_clicks", "subscribers", "newsletter_logs", "admin_activity_log", "email_templates", "affiliate_integrations",
    "affiliate_integration_tests", "affiliate_import_runs", "publishing_policies", "publishing_rotation_state",
)


def visible(df: DataFrame, table: str, role: str = "anon", user_id=None) -> DataFrame:
    """the rows of a table that a caller may read: those that some policy grants, by default none."""
    if table in PUBLIC or (role == ADMIN and table in MANAGED):
        return df
    grants = [F.expr(CONDITIONS[table])] if table in CONDITIONS else []
    if table in OWNED and user_id is not None:
        grants.append(F.col(OWNED[table]) == F.lit(user_id))
    return df.filter(reduce(lambda a, b: a | b, grants, F.lit(False)))


def admissible_clicks(clicks: DataFrame, coupons: DataFrame, user_id=None) -> DataFrame:
    """The clicks that a caller may insert: of nobody or themself, on active coupons."""
    active = coupons.filter("status = 'active'").select(F.col("id").alias("coupon_id"))
    return clicks.filter(F.col("user_id").isNull() | (F.col("user_id") == F.lit(user_id))).join(active, "coupon_id", "left_semi")


def audit_log(before: DataFrame, after: DataFrame, key: str, entity: str, name_columns=("name", "title", "display_name", "slug", "key")) -> DataFrame:
    """One row per inserted, updated or deleted row: action, entity, entity_id, name, description."""
    same = [c for c in after.columns if c != key]
    side = lambda df, p: df.select(F.col(key).alias(f"{p}_key"), F.struct(*same).alias(p))
    both = side(before, "old").join(side(after, "new"), F.col("old_key") == F.col("new_key"), "full_outer")
    action = F.when(F.col("old_key").isNull(), "insert").when(F.col("new_key").isNull(), "delete").when(~F.col("old").eqNullSafe(F.col("new")), "update")
    names = [c for c in name_columns if c in same]
    name = F.coalesce(*[F.col(f"{p}.{c}").cast("string") for c in names for p in ("new", "old")]) if names else F.lit(None).cast("string")
    rows = both.withColumn("action", action).filter("action is not null")
    done = F.initcap(F.concat("action", F.when(F.col("action").endswith("e"), "d").otherwise("ed")))
    return rows.select("action", F.lit(entity).alias("entity"), F.coalesce("new_key", "old_key").alias("entity_id"), name.alias("name"), F.concat_ws(" ", done, F.lit(entity), name).alias("description"))


def check_constraints(df: DataFrame, rules: dict[str, Column], unique: dict[str, list[str]] | None = None) -> DataFrame:
    """Rule, violations: how many rows break a CHECK, how many keys repeat. A null passes a CHECK."""
    broken = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()]) if rules else None
    out = [broken.select(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules]
    for name, keys in (unique or {}).items():
        present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        out.append(df.filter(present).groupBy(*keys).count().filter("count > 1").agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations"))
    return reduce(DataFrame.unionByName, out)
