"""Enrichment: the priority cascade from promotions to advertisements, and its lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealforge.functions.text import norm_key

#: The rules in order of priority: name, keys, and which advertisement a shared key stands for.
RULES = (
    ("promotion_id", ("promotion_id",), "last"),
    ("campaign_title", ("campaign_id", "norm_title"), "last"),
    ("campaign_single", ("campaign_id",), "single"),
    ("advertiser_title", ("advertiser_id", "norm_title"), "first"),
    ("advertiser_code", ("advertiser_id", "norm_code"), "first"),
    ("advertiser_single", ("advertiser_id",), "single"),
)


def with_keys(df: DataFrame, title: str, code: str) -> DataFrame:
    return df.withColumn("norm_title", F.nullif(norm_key(F.col(title)), F.lit(""))).withColumn("norm_code", F.nullif(norm_key(F.col(code)), F.lit("")))


def index_of(ads: DataFrame, keys: tuple[str, ...], which: str, seq: str, payload: Column) -> DataFrame:
    """One advertisement per key: the last, the first, or the only one."""
    present = ads
    for key in keys:
        present = present.filter(F.col(key).isNotNull())
    pick = F.min_by(payload, seq) if which == "first" else F.max_by(payload, seq)
    out = present.groupBy(*keys).agg(pick.alias("__hit"), F.count("*").alias("__n"))
    return out.filter("__n = 1") if which == "single" else out


def cascade(promotions: DataFrame, ads: DataFrame, seq: str, payload: list[str]) -> DataFrame:
    """Promotions with `ad` (a struct of payload) and `matched_by`, by the first rule that finds one.

    Every index has one row a key, so that no join multiplies rows. Promotions need
    promotion_id, campaign_id, advertiser_id, norm_title and norm_code, as do ads.
    """
    out, hits = promotions, []
    for i, (name, keys, which) in enumerate(RULES):
        index = index_of(ads, keys, which, seq, F.struct(*payload)).select(*[F.col(k).alias(f"__{i}_{k}") for k in keys], F.col("__hit").alias(f"__hit{i}"))
        on = [F.col(k) == F.col(f"__{i}_{k}") for k in keys]
        out = out.join(index, on, "left")
        hits.append((name, F.col(f"__hit{i}")))
    matched = F.when(F.lit(False), F.lit(""))
    for name, hit in hits:
        matched = matched.when(hit.isNotNull(), name)
    return out.select(*promotions.columns, F.coalesce(*[h for _, h in hits]).alias("ad"), matched.alias("matched_by"))


def last_by_keys(rows: DataFrame, keys: list[str], seq: str, payload: Column) -> DataFrame:
    """Key, value: several key columns share one map; later rows overwrite earlier ones."""
    each = rows.select(F.explode(F.array(*[F.struct(F.col(k).cast("string").alias("key"), F.lit(i).alias("nth")) for i, k in enumerate(keys)])).alias("e"), F.col(seq).alias("__seq"), payload.alias("__value"))
    return each.filter("e.key is not null").groupBy("e.key").agg(F.max_by("__value", F.struct("__seq", "e.nth")).alias("value"))


def look_up_first(df: DataFrame, keys: list[str], table: DataFrame, name: str) -> DataFrame:
    """df with the value of the first of several keys that the table (key, value) has."""
    out = df
    for i, key in enumerate(keys):
        out = out.join(table.select(F.col("key").alias(f"__k{i}"), F.col("value").alias(f"__v{i}")), F.col(key).cast("string") == F.col(f"__k{i}"), "left")
    return out.select(*df.columns, F.coalesce(*[F.col(f"__v{i}") for i in range(len(keys))]).alias(name))
