"""What logs show of odd requests; the order of the preview."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealforge.operators import presentation


def test_redaction_of_odd_inputs(spark):
    rows = [(None, None, None), ({"COOKIE": "a", "x": "b"}, "not a url?token=a", '{"token": "a", "x": 1}'), ({}, "https://x/?a=1&token=&token=b&tokens=c", "x" * 501)]
    df = spark.createDataFrame(rows, "h map<string,string>, u string, b string")
    got = df.select(presentation.redact_headers(F.col("h")).alias("h"), presentation.redact_url(F.col("u")).alias("u"), presentation.redact_body(F.col("b")).alias("b")).collect()
    assert [r["h"] for r in got] == [{}, {"COOKIE": "[REDACTED]", "x": "b"}, {}]
    assert [r["u"] for r in got] == [None, "not a url?token=a", "https://x/?a=1&token=%5BREDACTED%5D&token=%5BREDACTED%5D&tokens=c"]
    assert [r["b"] for r in got] == ["null", '{"token": "[REDACTED]", "x": 1}', "x" * 500 + "…[truncated]"]


def test_preview_order(spark):
    df = spark.createDataFrame([("deal", 1), ("store", 3), ("coupon", 2), ("store", 1)], "entity string, seq int")
    assert [tuple(r) for r in presentation.preview(df, 3).collect()] == [("store", 1), ("store", 3), ("coupon", 2)]
