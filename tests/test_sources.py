"""Provider pages, envelopes, head entries and streams."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from dealforge.functions import head
from dealforge.sources import provider, sinks
from dealforge.streaming import clicks, upserts


def fetch(page, size, options):
    return [{"Id": page * 100 + i} for i in range(size if page < 3 else 1)]


def test_pages(spark):
    provider.register(spark)
    df = spark.read.format("provider_pages").option("fetch", "tests.test_sources:fetch").option("maxPages", 6).option("pageSize", 2).option("pagesPerPartition", 6).load()
    assert df.count() == 5  # two full pages and a short one, which ends the run


def test_envelopes(spark):
    bodies = spark.createDataFrame([('[{"a":1},2]',), ('{"x":1,"Ads":[{"b":1}],"Campaigns":[{"c":1}]}',), ('{"n":{"q":[1]},"Other":[{"d":1}]}',), ('{"n":1}',), ("broken",), (None,)], "body string")
    assert [r["record"] for r in provider.unwrap(bodies, "body", "Campaigns").orderBy("record").collect()] == ['{"a":1}', '{"c":1}', '{"d":1}']


def test_provider_keys(spark):
    key = provider.provider_key(F.lit(" Impact Radius "), F.lit(None).cast("string"))
    assert spark.range(1).select(key).first()[0] == "impact"
    assert spark.range(1).select(provider.provider_key(F.lit("who"), F.lit("CJ"))).first()[0] == "cj"
    assert spark.range(1).select(provider.provider_key(F.lit("who"))).first()[0] == "custom_rest"


def test_retry_and_placeholders():
    assert provider.retry_wait(0, 3, 503) == 1000 and provider.retry_wait(9, 20, network_error=True) == 30_000
    assert provider.retry_wait(2, 3, 503) is None and provider.retry_wait(0, 3, 404) is None
    assert provider.retry_wait(0, 3, 429, retry_after_ms=5000) == 5000
    assert provider.fill_placeholders("/{Account SID}/{api-key}/{who}", {"username": "a b", "apikey": "k"}) == ("/a%20b/k/{who}", ["who"])


def test_config_errors(spark):
    has = lambda name: F.lit(name == "username")
    errors = provider.config_errors(F.lit(False), F.lit("nope"), F.lit(10), F.lit(30), F.lit("oauth2"), has)
    assert len(spark.range(1).select(errors).first()[0]) == 5
    fine = provider.config_errors(F.lit(True), F.lit("https://x.example"), F.lit(5000), F.lit(3), F.lit("basic"), has)
    assert spark.range(1).select(fine).first()[0] == []


@pytest.mark.parametrize(
    ("html", "error"),
    [
        ("", "HTML content is empty."), ("x <meta name=a>", "Malformed HTML: stray text outside of tags."), ("<div>", "Tag <div> is not allowed in the head. Allowed: meta, link, script."),
        ('<link href="JavaScript:x">', 'Unsafe URL in "href".'), ("<script onload=x></script>", 'Inline event handler "onload" is not allowed.'), ("<script>a", "Malformed HTML: unclosed <script> tag."), ("plain", "Malformed HTML: stray content after the last tag."),
    ],
)
def test_refused_heads(spark, html, error):
    assert one(spark, html, head.sanitize_head)["error"] == error


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_scanned_head(spark):
    tags = one(spark, '<meta NAME="a" content=\'b\'><script async src=x></script>', head.sanitize_head)["tags"]
    assert [tuple(t) for t in tags] == [("meta", {"name": "a", "content": "b"}, None), ("script", {"async": "", "src": "x"}, None)]
    assert one(spark, '{"@type": "A<b"}', head.validate_json_ld)["json"] == '{"@type":"A\\u003cb"}'


def test_rendered_entries(spark):
    rows = [
        (1, "verification", "", "meta", "google", "v", None, True), (2, "verification", "", "meta", "Google", "w", None, True), (3, "analytics", "GA", "script", None, "https://ga.example/x.js", "go()", True),
        (4, "analytics", "ga", "script", None, "https://other", None, True), (5, "structured_data", "", "json-ld", None, None, '{"@type":"A"}', True), (6, "custom_html", "", "html", None, None, "<b>", True),
        (7, "custom_html", "", "html", None, None, "<meta name=q content='1&2'>", True), (8, "verification", "", "meta", "x", "y", None, False), (9, "else", "", "", "", "", "", True),
    ]
    entries = spark.createDataFrame(rows, "seq int, section string, provider string, type string, name string, value string, content string, enabled boolean")
    tags, skipped = head.render_entries(entries, "seq")
    assert [r["html"] for r in tags.orderBy("seq", "place").collect()] == [
        '<meta name="google" content="v">', '<script src="https://ga.example/x.js" async></script>', "<script>go()</script>",
        '<script type="application/ld+json">{"@type":"A"}</script>', '<meta name="q" content="1&amp;2">',
    ]
    assert {r["seq"]: r["reason"] for r in skipped.collect()} == {
        2: 'Duplicate verification tag "Google".', 4: 'Duplicate analytics provider "ga".', 6: "Tag <b> is not allowed in the head. Allowed: meta, link, script.", 8: "Disabled", 9: 'Unknown section "else".',
    }


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([('a "b"', 1)], "t string, n int")
    sinks.write_issues_csv(df, str(tmp_path / "i"))
    text = "".join(p.read_text() for p in (tmp_path / "i").glob("*.csv"))
    assert '"a ""b""","1"' in text


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_daily_clicks_stream(spark, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = clicks.daily_clicks(clicks.event_stream(spark, str(tmp_path / "in")))
    upserts.upsert_stream(stream, str(tmp_path / "out"), ["day", "coupon_id"], str(tmp_path / "ck")).awaitTermination()
    got = upserts.latest_version(spark, str(tmp_path / "out"))
    assert got.agg(F.sum("clicks")).first()[0] == events.filter("event_type = 'click'").count()
