"""Scalar rules, with the cases that are easily got wrong."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from dealforge.functions import offers as of
from dealforge.functions import text as tx


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x, kind="string"):
    return F.lit(x).cast(kind)


@pytest.mark.parametrize(("given", "want"), [("N/A", 0.0), ("1.2.3", None), ("$1,200", 1200.0), ("", None), (None, None)])
def test_as_number(spark, given, want):
    assert value(spark, of.as_number(lit(given))) == want


@pytest.mark.parametrize(("given", "want"), [("N/A", None), ("-3.5 off", -3.5), ("1,250.5", 1250.5), (None, None)])
def test_first_number(spark, given, want):
    assert value(spark, of.first_number(lit(given))) == want


@pytest.mark.parametrize(("given", "want"), [("inactive", "inactive"), ("not_joined", "active"), ("", "unknown"), (None, "unknown"), ("EXPIRED", "expired"), ("in review", "pending"), ("odd", "unknown")])
def test_map_status(spark, given, want):
    assert value(spark, of.map_status(lit(given))) == want


@pytest.mark.parametrize(("given", "want"), [("12.5% off", 0.05), ("99% off", 0.95), ("$300 off", 0.9), ("Free shipping", 0.2), ("BOGO now", 0.5), ("Clearance", 0.1), ("x", 0.0)])
def test_parse_discount(spark, given, want):
    assert value(spark, of.parse_discount(lit(given))) == pytest.approx(want)


@pytest.mark.parametrize(
    ("status", "start", "end", "want"),
    [("active", None, "2024-01-30", "expired"), ("active", "2024-02-01", None, "draft"), ("expired", "2024-01-01", "2024-02-01", "active"), ("pending", None, None, "draft"), (None, None, None, "active")],
)
def test_offer_status(spark, status, start, end, want):
    assert value(spark, of.offer_status(lit(status), lit(start, "date"), lit(end, "date"), lit("2024-01-31", "date"))) == want


@pytest.mark.parametrize(("given", "want"), [("Café & Co.", "cafe-and-co"), ("***", "item"), (None, "item"), ("A" * 90, "a" * 80)])
def test_slugify(spark, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(tx.slugify(F.col("t"))).first()[0] == want


def test_seo_slug_keeps_words_only(spark):
    assert value(spark, tx.seo_slug(lit("  20% off & more_things -- now "))) == "20-off-more-things-now"


@pytest.mark.parametrize(
    ("percent", "amount", "text", "want"),
    [(10.0, None, "", ("percentage", 10.0)), (None, 5.0, "", ("fixed", 5.0)), (None, None, "Free  ship", ("free_shipping", None)), (None, None, "buy one", ("bogo", None)), (None, None, "15.5 % off", ("percentage", 15.5)), (None, None, "$ 7 off", ("fixed", 7.0)), (None, None, "thing", ("other", None)), (None, None, "", ("unknown", None))],
)
def test_discount_of(spark, percent, amount, text, want):
    assert tuple(value(spark, of.discount_of(lit(percent, "double"), lit(amount, "double"), lit(text)))) == want


def test_terms_and_currency(spark):
    none = lit(None, "double")
    got = value(spark, of.terms_of(lit("Orders over £50. Max savings 1,000. Limit 3 uses. New customers only"), none, none, lit(0.0, "double"), lit(None), lit(None)))
    assert got.asDict() == {"minimum_purchase": 50.0, "maximum_savings": 1000.0, "purchase_limit": 3.0, "scope": "new customers only", "currency": "GBP"}


def test_urls(spark):
    assert value(spark, of.is_url(lit("https://a.example/x"))) and not value(spark, of.is_url(lit("ftp://a"))) and not value(spark, of.is_url(lit(None)))
    assert value(spark, of.logo_url(lit("//cdn.example/x.png"))) == "https://cdn.example/x.png"
    assert value(spark, of.domain_of(lit("https://www.Shop.example/a"))) == "shop.example"


def test_pick_is_case_insensitive_and_skips_empty(spark):
    record = F.create_map(F.lit("NAME"), F.lit(""), F.lit("Title"), F.lit("x"))
    assert value(spark, tx.pick(record, "name", "title")) == "x"
    assert value(spark, tx.first(record, "title", "Title")) == "x"
    assert value(spark, tx.first(record, "title")) is None
    assert value(spark, tx.other_keys(record, "name")) == {"Title": "x"}


def test_small_text_rules(spark):
    assert value(spark, tx.string_list(lit("a, b||c ,"))) == ["a", "b", "c"]
    assert value(spark, tx.clean_string(lit(" N/A "))) is None
    assert value(spark, tx.pretty_scope(lit("ENTIRE_STORE"))) == "Entire store"
    assert value(spark, tx.csv_field(lit('a "b", c'))) == '"a ""b"", c"'
    assert value(spark, tx.mask_secret(lit("abcdefgh"))) == "••••efgh"
    assert not value(spark, tx.is_clean_slug(lit("my-test-page"))) and value(spark, tx.is_clean_slug(lit("contest")))
    assert value(spark, tx.store_slug(lit("a-coupons"))) == "a-coupons" and value(spark, tx.category_slug(lit("a"))) == "a-offers"
    assert tx.search_term("50%_off", True) == "%50off%" and tx.search_term("50%") == "%50%%"


def test_rounding_and_axis(spark):
    assert value(spark, of.round_half_up(lit(-2.5, "double"))) == -2.0
    assert [value(spark, of.nice_ceil(lit(n, "double"))) for n in (0, 3, 12, 51)] == [1.0, 5.0, 20.0, 100.0]


def test_http_rules(spark):
    assert [value(spark, of.status_class(lit(s, "int"))) for s in (401, 429, 503, 404, 200)] == ["authentication_error", "rate_limited", "server_error", "validation_error", "unknown_error"]
    assert value(spark, of.reset_time(lit("60"), lit(1000.0, "double"))) == 61_000.0


def test_dates(spark):
    got = value(spark, of.date_range(lit("2026-07-28/2026-07-29")))
    assert got["start"] == datetime.datetime(2026, 7, 28) and got["end"] == datetime.datetime(2026, 7, 29)
    assert value(spark, of.as_timestamp(lit("nonsense"))) is None


def test_texts(spark):
    assert value(spark, of.discount_text(lit("percentage"), lit(12.5, "double"), lit(None))) == "12.5% off"
    assert value(spark, of.discount_text(lit("fixed"), lit(1500.0, "double"), lit("eur"))) == "€1,500.00 off"
    assert value(spark, of.offer_code(lit("n/a"), lit("SAVE"))) == "SAVE" and value(spark, of.offer_code(lit("none"), lit(None))) == "none"
