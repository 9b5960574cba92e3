"""Properties of planning, policy, merging, access and enrichment."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from dealforge.operators import access, enrich, imports, merge, policy

OFFER = "kind string, store_key string, provider_entity_id string, status string, start_date date, end_date date, discount_type string, discount_value double, priority int, manually_disabled boolean"


def offers(spark, n, store="s", kind="coupon"):
    return spark.createDataFrame([(kind, store, f"{i:03}", "active", None, None, "percentage", float(100 - i), 0, False) for i in range(n)], OFFER)


def published(result):
    return [r["provider_entity_id"] for r in result.offers.filter("published").orderBy("position").collect()]


def test_rotation_case(spark):
    cursors = spark.createDataFrame([("coupon", "s", 4)], "kind string, store_key string, cursor int")
    out = policy.apply_policy(offers(spark, 5), policy.Policy(max_coupons=2, rotation=True, ranking=("discount",)), "2024-01-31", cursors)
    assert published(out) == ["004", "000"]
    assert [r["cursor"] for r in out.cursors.collect()] == [1]


def test_rotation_visits_all(spark):
    n, limit, seen, cursors = 7, 3, set(), None
    for _ in range(math.ceil(n / limit)):
        out = policy.apply_policy(offers(spark, n), policy.Policy(max_coupons=limit, rotation=True), "2024-01-31", cursors)
        seen |= set(published(out))
        cursors = spark.createDataFrame(out.cursors.collect(), "kind string, store_key string, cursor int")
    assert len(seen) == n


def test_minimum_gate_keeps_cursor(spark):
    cursors = spark.createDataFrame([("coupon", "s", 3)], "kind string, store_key string, cursor int")
    out = policy.apply_policy(offers(spark, 2), policy.Policy(min_coupons=3, rotation=True), "2024-01-31", cursors)
    assert published(out) == [] and [r["cursor"] for r in out.cursors.collect()] == [3]
    assert out.offers.first()["hold_reason"] == "store has fewer than the minimum of 3 coupons"


def test_disabled_policy_publishes_all(spark):
    out = policy.apply_policy(offers(spark, 4).withColumn("status", F.lit("pending")), policy.Policy(enabled=False), "2024-01-31")
    assert out.offers.filter("published").count() == 4


def test_published_and_held_are_all(spark):
    rows = offers(spark, 9).union(offers(spark, 4, "t", "deal")).withColumn("manually_disabled", F.col("provider_entity_id") == "002")
    out = policy.apply_policy(rows, policy.Policy(max_coupons=3), "2024-01-31").offers
    assert out.count() == 13 and out.filter("published").count() + out.filter("hold_reason is not null").count() == 13
    assert policy.summary(out).first()["stores_covered"] == 2
    assert policy.summary(out.limit(0)).first()["coverage_percent"] == 0.0


def test_store_key(spark):
    key = policy.store_key(F.lit(""), F.lit(None).cast("string"), F.lit("c"))
    assert spark.range(1).select(key).first()[0] == "c"
    none = F.lit(None).cast("string")
    assert spark.range(1).select(policy.store_key(none, none, none)).first()[0] == policy.UNASSIGNED


def slugs(spark, bases, taken=()):
    rows = spark.createDataFrame(list(enumerate(bases)), "id int, base string")
    return [r["slug"] for r in imports.reserve_slugs(rows, spark.createDataFrame([(t,) for t in taken], "slug string"), ["id"]).orderBy("id").collect()]


def test_slug_fold(spark):
    assert slugs(spark, ["a", "a", "a-2"]) == ["a", "a-2", "a-2-2"]
    assert slugs(spark, ["a-2", "a", "a"]) == ["a-2", "a", "a-3"]
    assert slugs(spark, ["b", "c", "b"], ["b", "b-2"]) == ["b-3", "c", "b-4"]


def test_keep_last_keeps_one_per_identity(spark):
    rows = spark.createDataFrame([("p", "1", 1, "old"), ("p", "1", 2, "new"), ("p", "2", 3, None)], "provider string, provider_entity_id string, seq int, title string")
    got = imports.keep_last(rows, ["provider", "provider_entity_id"], ["seq"]).orderBy("provider_entity_id").collect()
    assert [(r["title"], r["occurrences"]) for r in got] == [("new", 2), (None, 1)]


def test_admin_wins(spark):
    value = lambda old, new: spark.range(1).select(merge.merged(merge.ADMIN_WINS, F.lit(old), F.lit(new))).first()[0]
    assert value("  ", "y") == "y" and value("x", "y") == "x"


def test_second_import_creates_nothing(spark):
    current = spark.createDataFrame([("1", None, None, "a", "A", "kept")], "id string, provider string, provider_entity_id string, slug string, name string, description string")
    incoming = spark.createDataFrame([("net", "P1", "a", "new A", "d"), ("net", "P2", "b", "B", "d")], "provider string, provider_entity_id string, slug string, name string, description string")
    after, counts = merge.apply_rows(current, incoming, merge.STORE_RULES, "net")
    assert tuple(counts.first()) == (1, 1)
    assert {(r["slug"], r["name"], r["description"], r["provider_entity_id"]) for r in after.collect()} == {("a", "new A", "kept", "P1"), ("b", "B", "d", "P2")}
    again, counts = merge.apply_rows(after, incoming, merge.STORE_RULES, "net")
    assert tuple(counts.first()) == (0, 2) and sorted(map(tuple, again.collect())) == sorted(map(tuple, after.collect()))


def test_map_merge_prefers_new(spark):
    m = merge.merged(merge.MERGE_MAP, F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")), F.create_map(F.lit("b"), F.lit("2")))
    assert spark.range(1).select(m).first()[0] == {"a": "1", "b": "2"}


def test_unsubscribe(spark):
    people = spark.createDataFrame([("a", "t1", True), ("b", "t2", True)], "email string, token string, active boolean")
    after, done = merge.unsubscribe(people, "t2")
    assert done.first()["done"] and [r["active"] for r in after.orderBy("email").collect()] == [True, False]
    assert not merge.unsubscribe(after, "t2")[1].first()["done"]


def test_cascade_priority(spark):
    ads = spark.createDataFrame([(1, 1, "p", 1, 1, "t", "c"), (2, 2, None, 1, 1, "t", "c"), (3, 3, None, 9, 2, "u", "d")], "seq int, ad_id int, promotion_id string, campaign_id int, advertiser_id int, norm_title string, norm_code string")
    rows = [(1, "p", 9, 2, "u", "d"), (2, "x", 1, 5, "t", None), (3, "x", 9, 5, None, None), (4, "x", 8, 1, "t", None), (5, "x", 8, 1, None, "c"), (6, "x", 8, 2, None, None), (7, None, None, None, None, None)]
    promos = spark.createDataFrame(rows, "id int, promotion_id string, campaign_id int, advertiser_id int, norm_title string, norm_code string")
    got = {r["id"]: (r["ad"] and r["ad"]["ad_id"], r["matched_by"]) for r in enrich.cascade(promos, ads, "seq", ["ad_id"]).collect()}
    assert got == {1: (1, "promotion_id"), 2: (2, "campaign_title"), 3: (3, "campaign_single"), 4: (1, "advertiser_title"), 5: (1, "advertiser_code"), 6: (3, "advertiser_single"), 7: (None, None)}


def test_visibility(spark):
    saves = spark.createDataFrame([(1, 5), (2, 6)], "user_id int, coupon_id int")
    assert access.visible(saves, "saved_coupons", "admin", 1).count() == 1
    assert access.visible(saves, "coupon_clicks").count() == 0
    assert access.visible(saves, "coupon_clicks", "admin").count() == 2
    posts = spark.createDataFrame([("draft",), ("published",)], "status string")
    assert access.visible(posts, "posts").count() == 1
