"""Normalisation of odd records, with enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealforge.operators import normalize as nz
from dealforge.sources import provider


def stores(spark, *records):
    rows = spark.createDataFrame(list(enumerate(records)), "index int, record string")
    good, issues = nz.normalize_stores(rows, nz.alias_table(spark))
    return {r["index"]: r for r in good.collect()}, {r["index"]: r["reason"] for r in issues.collect()}


def test_odd_store_records(spark):
    good, issues = stores(
        spark,
        '{"Id":"a","Name":"N","id":"b"}',  # keys that differ in case: the last counts
        '{"Id":"a","Name":"N","id":""}',  # ... even if it is empty
        '{"CampaignId":true,"Name":12.50,"Logo":"https://x.example/l.png","trackinglink":"T","originalLogo":"own"}',
        '{"CampaignId":["x"],"Id":"i","Name":"n","Vertical":{"k":1}}',  # an array is found, but no text
        "{}", "", None, "[]", '"text"', '{"Id":1,"Name":"   "}',
    )
    assert good[0]["provider_entity_id"] == "b" and good[0]["campaign_id"] == "b" and dict(good[0]["metadata"]) == {}
    assert good[2]["provider_entity_id"] == "true" and good[2]["name"] == "12.5" and good[2]["categories"] == []
    assert dict(good[2]["metadata"]) == {"trackingLink": "T", "originalLogo": "https://x.example/l.png"}
    assert good[3]["provider_entity_id"] == "i" and good[3]["categories"] == []
    assert issues == {1: "Store record is missing CampaignId/Id", 4: "Store record is missing CampaignId/Id", 9: "Store 1 is missing a name"} | {i: "Store record is not an object" for i in (5, 6, 7, 8)}


def test_an_alias_table_of_ones_own(spark):
    rows = spark.createDataFrame([(1, '{"ref":"r1","label":"L","Name":"kept"}')], "index int, record string")
    own = spark.createDataFrame([("store", "id", "ref", 0, True), ("store", "name", "label", 0, True)], nz.ALIASES)
    r = nz.normalize_stores(rows, own)[0].first()
    assert (r["provider_entity_id"], r["name"], dict(r["metadata"])) == ("r1", "L", {"Name": "kept"})


def test_enriched_offers(spark):
    rows = spark.createDataFrame([(0, '{"Id":1,"Name":"Sale","PromoCode":"none","Landing":"x"}'), (1, '{"Id":2,"Name":"Ship","PromoType":"Free Shipping","Code":"S"}')], "index int, record string")
    more = spark.createDataFrame([(0, "AD5", "fixed", 5.0, "D", None, None, "https://ad", None, "T")], f"index int, {nz.ENRICHMENT}")
    out = {r["index"]: r for r in nz.normalize_offers(rows, nz.alias_table(spark), enrichment=more)[0].collect()}
    assert [out[0][c] for c in ("kind", "code", "discount_type", "discount_value", "description", "tracking_url", "terms")] == ["coupon", "AD5", "fixed", 5.0, "D", "https://ad", "T"]
    assert dict(out[0]["metadata"]) == {"Landing": "x"}
    assert [out[1][c] for c in ("kind", "code", "discount_type", "discount_value", "tracking_url")] == ["coupon", "S", "free_shipping", None, None]
    assert dict(out[1]["metadata"]) == {"PromoType": "Free Shipping", "trackingUrlWarning": "no tracking url available for this promotion"}


def test_payload_of_an_offer_without_a_store(spark):
    offer = '{"Id":1,"Title":"T","CampaignId":5,"isPubliclyAvailable":false,"landingPageUrl":" u ","advertiserName":"Adv"}'
    rows = spark.createDataFrame([(0, offer)], "index int, record string")
    offers, _ = nz.normalize_offers(rows, nz.alias_table(spark))
    none = nz.normalize_stores(rows, nz.alias_table(spark))[0].limit(0).withColumn("slug", F.lit(""))
    r = nz.offer_payload(offers, none, "2024-01-31", "https://s", "B", 2024).first()
    assert (r["status"], r["landing_page_url"], r["seo_canonical_url"]) == ("draft", None, None)  # the page is the tracking address, so no metadata holds it
    assert r["seo_description"] == "Save with Adv using this verified offer: T. Updated regularly on B."


def test_envelopes_tell_arrays_from_texts(spark):
    bodies = spark.createDataFrame([('{"note":"[1]","Items":[{"b":1,"a":[{"q":2}],"B":3},[1],null]}',), ('{"n":1,"Items":[{"d":1,"d":2}]}',), ('{"X":[{"x":1}],"Campaigns":"[9]"}',), (" [ ]",)], "body string")
    assert sorted(r["record"] for r in provider.unwrap(bodies, "body", "Campaigns").collect()) == ['{"b":1,"a":[{"q":2}],"B":3}', '{"d":1,"d":2}', '{"x":1}']


def test_entries_stay_in_their_row(spark):
    rows = spark.createDataFrame([(0, '{"Id":1,"Name":"Sale","Landing":"x"}')], "index int, record string")
    plan = nz.normalize_offers(rows, nz.alias_table(spark))[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and plan.count("from_json(MapType(StringType,VariantType") == 1  # parsed once, nothing exploded


def test_fields_of_odd_side_records(spark):
    from dealforge.operators import sideloads

    record = '{"AdvertiserName":"N/A","Name":"n","Id":[1],"AdvertiserId":true,"Country":"","CountryCode":" x ","ShipsTo":["a",null,["b"]," ",2],"DeeplinkDomains":"p, q|none"}'
    df = spark.createDataFrame([(0, record), (1, "[1]"), (2, None)], "seq int, record string")
    (r,) = sideloads.rows_of(df, sideloads.CAMPAIGN, sideloads.CAMPAIGN_LISTS, "seq").collect()
    assert (r["name"], r["campaign_id"], r["advertiser_id"], r["country"], r["regions"], r["domains"]) == (None, None, None, "x", ["a", "2"], ["p", "q", "none"])
