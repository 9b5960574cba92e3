"""Publishing policy: content rules, rank, minimum, fair cap, rotation, interleaving."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealforge.functions.offers import offer_status, policy_discount, round_half_up
from dealforge.operators.ranking import placed

UNASSIGNED = "__unassigned__"
#: The order of ranking keys where a policy names none.
DEFAULT_PRIORITY = ("merchant_priority", "discount", "newest", "expiry")


@dataclass(frozen=True)
class Policy:
    enabled: bool = True
    min_coupons: int = 0
    max_coupons: int = 0
    min_deals: int = 0
    max_deals: int = 0
    ranking: tuple[str, ...] = DEFAULT_PRIORITY
    fair_distribution: bool = False
    rotation: bool = False
    publish_only_active: bool = True
    skip_expired: bool = True
    respect_manual_disable: bool = True

    def completed(self) -> tuple[str, ...]:
        """The configured keys, then the missing default ones."""
        return tuple(dict.fromkeys([*self.ranking, *DEFAULT_PRIORITY]))


@dataclass(frozen=True)
class Published:
    """offers: all offers with their decision; cursors: the rotation state to store."""

    offers: DataFrame
    cursors: DataFrame
    policy: Policy = field(default_factory=Policy)


def store_key(advertiser: Column, store: Column, campaign: Column) -> Column:
    some = lambda c: F.nullif(c.cast("string"), F.lit(""))
    return F.coalesce(some(advertiser), some(store), some(campaign), F.lit(UNASSIGNED))


def ranking_order(ranking: tuple[str, ...]) -> list[Column]:
    """Sort columns for a policy's keys; the identity breaks ties."""
    known = {"merchant_priority": F.desc("priority"), "discount": F.desc("discount"), "newest": F.desc("start_rank"), "expiry": F.asc("end_rank")}
    return [known[k] for k in ranking if k in known] + [F.asc("provider_entity_id")]


def by_kind(coupon: int, deal: int) -> Column:
    return F.when(F.col("kind") == "coupon", F.lit(coupon)).otherwise(F.lit(deal))


def prepared(offers: DataFrame, today: str) -> DataFrame:
    """The columns that decide: status, discount, start_rank and end_rank (missing: earliest, latest)."""
    day = F.lit(today).cast("date")
    return (
        offers.withColumn("publish_status", offer_status(F.col("status"), F.col("start_date"), F.col("end_date"), day))
        .withColumn("discount", policy_discount(F.col("kind"), F.col("discount_type"), F.col("discount_value")))
        .withColumn("start_rank", F.coalesce("start_date", F.lit("1970-01-01").cast("date")))
        .withColumn("end_rank", F.coalesce("end_date", F.lit("9999-12-31").cast("date")))
    )


def content_reason(policy: Policy) -> Column:
    """Why an offer is held before ranking: the first rule that it breaks."""
    out = F.when(F.lit(False), F.lit(""))
    if policy.skip_expired:
        out = out.when(F.col("publish_status") == "expired", "expired offer")
    if policy.publish_only_active:
        out = out.when(F.col("publish_status") != "active", F.concat(F.lit("offer is not active ("), F.col("publish_status"), F.lit(")")))
    if policy.respect_manual_disable:
        out = out.when(F.coalesce(F.col("manually_disabled"), F.lit(False)), "manually disabled by an administrator")
    return out


def apply_policy(offers: DataFrame, policy: Policy, today: str, cursors: DataFrame | None = None) -> Published:
    """The policy's decision for every offer.

    offers: kind (coupon, deal), store_key, provider_entity_id, status, start_date,
    end_date, discount_type, discount_value, priority, manually_disabled.
    cursors: kind, store_key, cursor. Adds published, hold_reason, rank (0 is best),
    position (place in the rotated ring).

    Ranking puts the offers of a store and kind in order, by ranges of them (see
    ranking.placed): a store may hold any share of the offers. The counts and the fair
    cap are aggregates. A disabled policy publishes all.
    """
    ready = prepared(offers, today)
    if not policy.enabled:
        out = ready.withColumn("hold_reason", F.lit(None).cast("string")).withColumn("published", F.lit(True)).withColumn("rank", F.lit(None).cast("int")).withColumn("position", F.lit(None).cast("int"))
        return Published(out, ready.sparkSession.createDataFrame([], "kind string, store_key string, cursor int"), policy)
    ready = ready.withColumn("content_reason", content_reason(policy))
    low, high = by_kind(policy.min_coupons, policy.min_deals), by_kind(policy.max_coupons, policy.max_deals)
    fit = ready.filter("content_reason is null")
    sizes = fit.groupBy("kind", "store_key").agg(F.count("*").cast("int").alias("size"))
    limits = sizes.groupBy("kind").agg(F.ceil(F.sum("size") / F.count("*")).cast("int").alias("share"))
    fair = F.when(F.lit(policy.fair_distribution) & (high <= 0), F.greatest("share", low)).otherwise(high)
    limits = limits.select("kind", low.alias("low"), fair.alias("high"))
    sizes = sizes.join(F.broadcast(limits), "kind")  # one row a kind
    if cursors is not None:
        sizes = sizes.join(cursors.select("kind", "store_key", F.col("cursor").alias("before")), ["kind", "store_key"], "left")
    else:
        sizes = sizes.withColumn("before", F.lit(None).cast("int"))
    limit = F.when(F.col("high") > 0, F.least("high", "size")).otherwise(F.col("size"))
    offset = F.when(F.lit(policy.rotation) & (F.col("size") > limit), F.pmod(F.coalesce("before", F.lit(0)), "size")).otherwise(0)
    sizes = sizes.withColumn("limit", limit).withColumn("offset", offset).withColumn("gated", (F.col("low") > 0) & (F.col("size") < F.col("low")))
    ranked = placed(fit, ["kind", "store_key"], ranking_order(policy.completed()), "rank").withColumn("rank", F.col("rank") - 1)
    ring = ranked.join(sizes, ["kind", "store_key"]).withColumn("position", F.pmod(F.col("rank") - F.col("offset"), F.col("size")))
    noun = F.concat(F.col("kind"), F.lit("s"))
    reason = F.when(F.col("gated"), F.concat(F.lit("store has fewer than the minimum of "), F.col("low").cast("string"), F.lit(" "), noun)).when(
        F.col("position") >= F.col("limit"), F.concat(F.lit("over the maximum of "), F.col("high").cast("string"), F.lit(" "), noun, F.lit(" per store"))
    )
    decided = ring.withColumn("hold_reason", reason).select(*ready.columns, "hold_reason", "rank", "position")
    held = ready.filter("content_reason is not null").withColumn("hold_reason", F.col("content_reason"))
    out = decided.unionByName(held, allowMissingColumns=True).withColumn("published", F.col("hold_reason").isNull()).drop("content_reason")
    return Published(out, next_cursors(sizes, cursors, policy), policy)


def next_cursors(sizes: DataFrame, cursors: DataFrame | None, policy: Policy) -> DataFrame:
    """Kind, store_key, cursor after this run; stores that did not rotate keep theirs."""
    moved = sizes.filter(~F.col("gated") & F.lit(policy.rotation)).select("kind", "store_key", F.pmod(F.col("offset") + F.col("limit"), "size").cast("int").alias("cursor"))
    return moved if cursors is None else upsert(cursors.select("kind", "store_key", "cursor"), moved, ["kind", "store_key"])


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """K4: incoming rows replace those of their keys."""
    return current.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def interleaved(offers: DataFrame, arrival: str) -> DataFrame:
    """Published offers and their place: one of every store in turn, stores in order of their first offer's arrival.

    The place is the number of offers at earlier positions, one sum a position, plus
    the rank inside the position. A position has one offer a store, the first one of
    every store, so it is ranked by ranges, too.
    """
    first = offers.groupBy("kind", "store_key").agg(F.min(arrival).alias("store_first"))
    rows = offers.filter("published").join(first, ["kind", "store_key"])
    earlier = Window.partitionBy("kind").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("kind", "position").agg(F.count("*").alias("n")).select("kind", "position", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = placed(rows, ["kind", "position"], [F.asc("store_first"), F.asc("store_key")], "inside").join(before, ["kind", "position"])
    return ranked.withColumn("place", (F.col("before") + F.col("inside")).cast("int")).drop("before", "inside")


def hold_reasons(offers: DataFrame) -> DataFrame:
    """A20."""
    return offers.filter("not published").groupBy("hold_reason").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "hold_reason")


def distribution(offers: DataFrame, limit: int | None = 50) -> DataFrame:
    """Published and held coupons and deals per store, most published first."""
    count = lambda kind, published: F.count_if((F.col("kind") == kind) & (F.col("published") == published))
    rows = offers.groupBy("store_key").agg(
        count("coupon", True).alias("coupons_published"), count("coupon", False).alias("coupons_held"), count("deal", True).alias("deals_published"), count("deal", False).alias("deals_held")
    )
    rows = rows.orderBy(F.desc(F.col("coupons_published") + F.col("deals_published")), "store_key")
    return rows.limit(limit) if limit else rows


def summary(offers: DataFrame) -> DataFrame:
    """Totals, covered stores, averages and coverage to one decimal (0 where nothing is covered)."""
    per = distribution(offers, None)
    total = per.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("coupons_published", "coupons_held", "deals_published", "deals_held")],
        F.count_if(F.col("coupons_published") + F.col("deals_published") > 0).alias("stores_covered"),
    )
    published = F.col("coupons_published") + F.col("deals_published")
    fetched = published + F.col("coupons_held") + F.col("deals_held")
    per_store = lambda c: F.when(F.col("stores_covered") > 0, round_half_up(F.col(c) / F.col("stores_covered"), 1)).otherwise(0.0)
    return total.withColumn("average_coupons", per_store("coupons_published")).withColumn("average_deals", per_store("deals_published")).withColumn(
        "coverage_percent", F.when(fetched > 0, round_half_up(100.0 * published / fetched, 1)).otherwise(0.0)
    )
