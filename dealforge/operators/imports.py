"""Import planning: validate, keep the last, match, resolve stores, reserve slugs (D, J9, J10, W6, W7)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealforge.functions.offers import STATUSES, is_url, usable_code
from dealforge.operators.ranking import placed


def keep_last(df: DataFrame, identity: list[str], arrival: list[str]) -> DataFrame:
    """The last row of every identity in order of arrival, with its number of occurrences.

    An aggregate over a struct: it combines in each task, so one identity may hold
    any share of the rows.
    """
    rest = [c for c in df.columns if c not in identity]
    last = df.groupBy(*identity).agg(F.max_by(F.struct(*rest), F.struct(*arrival)).alias("__last"), F.count("*").alias("occurrences"))
    return last.select(*identity, "__last.*", "occurrences")


def collisions(df: DataFrame, identity: list[str], entity: str) -> DataFrame:
    """One issue for every identity that arrives more than once."""
    many = df.groupBy(*identity).agg(F.count("*").alias("occurrences")).filter("occurrences > 1")
    return many.select(F.lit(entity).alias("entity"), F.concat_ws("::", *identity).alias("identity"), F.col("occurrences"), F.concat(F.lit("duplicate identity, kept the last of "), F.col("occurrences").cast("string")).alias("reason"))


def missing(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) == "", F.lit(True))


def issue(when: Column, field: str, reason: Column | str, severity: str = "error") -> Column:
    text = F.lit(reason) if isinstance(reason, str) else reason
    return F.when(when, F.struct(F.lit(field).alias("field"), text.alias("reason"), F.lit(severity).alias("severity")))


def _bad_status(status: Column) -> Column:
    return issue(status.isNotNull() & ~status.isin(*STATUSES), "status", F.concat(F.lit('invalid status "'), status, F.lit('"')))


def store_issues(provider_id: Column, name: Column, status: Column, website: Column, logo: Column) -> list[Column]:
    """A bad logo only warns."""
    bad = lambda url: (F.coalesce(url, F.lit("")) != "") & ~is_url(url)
    return [
        issue(missing(provider_id), "providerId", "missing provider entity id"),
        _bad_status(status),
        issue(missing(name), "name", "empty name"),
        issue(bad(website), "website", "invalid website url"),
        issue(bad(logo), "logo", "invalid logo url (ignored)", "warning"),
    ]


def category_issues(provider_id: Column, name: Column) -> list[Column]:
    """D2."""
    return [issue(missing(provider_id), "providerId", "missing provider entity id"), issue(missing(name), "name", "empty name")]


def offer_issues(provider_id: Column, title: Column, status: Column, store: Column, tracking_url: Column, start: Column, end: Column) -> list[Column]:
    """Coupons and deals; a missing or bad tracking address only warns. Dates are texts."""
    bad_date = lambda d: (F.coalesce(d, F.lit("")) != "") & d.try_cast("timestamp").isNull()
    no_url = F.coalesce(tracking_url, F.lit("")) == ""
    return [
        issue(missing(provider_id), "providerId", "missing provider entity id"),
        _bad_status(status),
        issue(missing(title), "title", "empty title"),
        issue(missing(store), "providerStoreId", "missing store reference"),
        issue(no_url, "trackingUrl", "missing tracking url", "warning"),
        issue(~no_url & ~is_url(tracking_url), "trackingUrl", "invalid tracking url (ignored)", "warning"),
        issue(bad_date(start), "startDate", "invalid startDate"),
        issue(bad_date(end), "endDate", "invalid endDate"),
    ]


def validate(df: DataFrame, entity: str, id_col: str, issues: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The rows without an error, and all issues (entity, provider_entity_id, field, reason, severity)."""
    marked = df.withColumn("__issues", F.array_compact(F.array(*issues)))
    told = marked.select(F.lit(entity).alias("entity"), F.col(id_col).cast("string").alias("provider_entity_id"), F.explode("__issues").alias("i")).select("entity", "provider_entity_id", "i.*")
    valid = marked.filter(~F.exists("__issues", lambda i: i["severity"] == "error")).drop("__issues")
    return valid, told


def echoed(issues: DataFrame) -> DataFrame:
    """Errors once more, as warnings."""
    return issues.filter("severity = 'error'").withColumn("reason", F.concat(F.lit("validation: "), "reason")).withColumn("severity", F.lit("warning"))


def tagged_union(**parts: DataFrame) -> DataFrame:
    """U4, K9: the rows of several DataFrames with a `type` that names theirs."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("type", F.lit(name)) for name, df in parts.items()])


def split_offers(offers: DataFrame, code: str) -> tuple[DataFrame, DataFrame]:
    """(coupons, deals): offers with a usable code, and the others."""
    has = usable_code(F.col(code)).isNotNull()
    return offers.filter(has), offers.filter(~has)


def match_existing(incoming: DataFrame, existing: DataFrame, provider: str) -> DataFrame:
    """existing_id, matched_by and action for every incoming row.

    By provider identity first, by slug second. Rows of other providers match by slug
    only. Each lookup side has one row a key: the least id.
    """
    own = F.when(F.col("provider") == provider, F.col("provider_entity_id"))
    by_id = existing.withColumn("k", own).filter("k is not null").groupBy(F.col("k").alias("__k_id")).agg(F.min("id").alias("__by_id"))
    by_slug = existing.filter("slug is not null").groupBy(F.col("slug").alias("__k_slug")).agg(F.min("id").alias("__by_slug"))
    out = incoming.join(by_id, F.col("provider_entity_id") == F.col("__k_id"), "left").join(by_slug, F.col("slug") == F.col("__k_slug"), "left")
    found = F.coalesce("__by_id", "__by_slug")
    how = F.when(F.col("__by_id").isNotNull(), "provider").when(F.col("__by_slug").isNotNull(), "slug")
    return out.select(*incoming.columns, found.alias("existing_id"), how.alias("matched_by"), F.when(found.isNull(), "create").otherwise("update").alias("action"))


def resolve_stores(offers: DataFrame, stores: DataFrame) -> DataFrame:
    """store_ref of every offer, null if it has none: such offers are skipped (K1g).

    The store of its advertiser; else its campaign, then its store id, if known; else
    its store id read as an advertiser. stores: provider_entity_id, advertiser_id, and
    arrival: of stores that share an advertiser the last one to arrive is meant.
    """
    known = stores.select(F.col("provider_entity_id").alias("__known")).filter("__known is not null").distinct()
    by_adv = stores.filter("advertiser_id is not null").groupBy(F.col("advertiser_id").alias("__adv")).agg(F.max_by("provider_entity_id", F.struct("arrival", "provider_entity_id")).alias("__store"))
    out = offers
    refs = []
    for i, (column, side) in enumerate((("advertiser_id", "adv"), ("campaign_id", "known"), ("store_ref_id", "known"), ("store_ref_id", "adv"))):
        lookup = by_adv.select(F.col("__adv").alias(f"__k{i}"), F.col("__store").alias(f"__v{i}")) if side == "adv" else known.select(F.col("__known").alias(f"__k{i}"), F.col("__known").alias(f"__v{i}"))
        out = out.join(lookup, F.col(column) == F.col(f"__k{i}"), "left")
        refs.append(F.col(f"__v{i}"))
    return out.select(*offers.columns, F.coalesce(*refs).alias("store_ref"))


def slug_stem(slug: Column) -> Column:
    """The slug without the numbers at its end: all slugs that can collide share it."""
    return F.regexp_replace(slug, r"(-\d+)+$", "")


def reserve_slugs(rows: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Rows (with base) and their slug: base, or base-2, base-3 ... as far as taken.

    Slugs of different stems cannot meet. Within a stem the first free number depends
    on earlier slugs only if some base is itself a numbered form of another (a, a-2):
    such stems are folded, each in its own group. In all others the n-th row that
    needs a number gets the n-th free one, which row numbers and counts of the taken
    numbers below give without a fold. existing: slug.
    """
    stems = rows.withColumn("__stem", slug_stem(F.col("base")))
    taken = existing.select(F.col("slug").alias("base")).distinct().withColumn("__stem", slug_stem(F.col("base")))
    mixed = stems.select("__stem", "base").distinct().groupBy("__stem").agg(F.count("*").alias("n")).filter("n > 1").select("__stem")
    plain = stems.join(mixed, "__stem", "left_anti")
    numbered = numbered_slugs(plain, taken, order).select(*rows.columns, "slug")
    keyed = stems.withColumn("__taken", F.lit(False)).unionByName(taken.withColumn("__taken", F.lit(True)), allowMissingColumns=True)
    folded = keyed.join(mixed, "__stem", "left_semi")
    schema = rows.withColumn("slug", F.lit("")).schema

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        following: dict[str, int] = {}
        slugs = []
        group = group.sort_values(["__taken", *order], ascending=[False, *[True] * len(order)], kind="stable")
        for slug, is_taken in zip(group["base"], group["__taken"]):
            if slug in taken and not is_taken:
                number = following.get(slug, 2)
                while f"{slug}-{number}" in taken:
                    number += 1
                following[slug] = number + 1
                slug = f"{slug}-{number}"
            taken.add(slug)
            slugs.append(slug)
        return group.assign(slug=slugs)[~group["__taken"]][schema.names]

    return numbered.unionByName(folded.groupBy("__stem").applyInPandas(fold, schema))


def numbered_slugs(rows: DataFrame, taken: DataFrame, order: list[str]) -> DataFrame:
    """rows with slug, where no base is a numbered form of another.

    A taken number t is passed by the n-th row to number if fewer than n free numbers
    lie below it: t - 2 less the taken ones below. In one order of rows and taken
    numbers by these, a row's place less its place among the rows tells how many it
    passes. All places are found by ranges (see ranking.placed): a base may hold any
    share of the rows.
    """
    bases = rows.select("base").distinct()
    in_use = bases.join(taken.select("base"), "base", "left_semi").withColumn("__used", F.lit(1))
    suffix = F.regexp_extract("slug", r"-([1-9]\d*)$", 1)
    numbers = taken.select(F.col("base").alias("slug")).withColumn("__number", suffix.try_cast("int")).filter("__number >= 2")
    numbers = numbers.withColumn("base", F.expr("left(slug, length(slug) - length(__number) - 1)")).join(bases, "base", "left_semi").select("base", "__number")
    passed = placed(numbers, ["base"], [F.asc("__number")], "__below").select("base", (F.col("__number") - 1 - F.col("__below")).alias("__at"))  # free numbers below
    ordered = placed(rows, ["base"], [F.col(c) for c in order], "__own").join(in_use, "base", "left")
    nth = F.col("__own") - 1 + F.coalesce("__used", F.lit(0))
    both = ordered.withColumn("__nth", nth).withColumn("__at", nth).withColumn("__row", F.lit(1)).unionByName(passed.withColumn("__row", F.lit(0)), allowMissingColumns=True)
    out = placed(both, ["base"], [F.asc("__at"), F.desc("__row")], "__place").filter("__row = 1").withColumn("__passed", F.col("__place") - F.col("__own"))
    slug = F.when(F.col("__nth") == 0, F.col("base")).otherwise(F.concat_ws("-", "base", (F.col("__nth") + 1 + F.col("__passed")).cast("string")))
    return out.withColumn("slug", slug)


def plan_offers(offers: DataFrame, existing: DataFrame, provider: str, arrival: list[str]) -> DataFrame:
    """The plan of a kind: last row of each identity, its slug candidate, match and action."""
    unique = keep_last(offers, ["provider", "provider_entity_id"], arrival)
    return match_existing(unique, existing, provider)
