"""Bucketed versions: only touched buckets are written, half-written versions are not seen, late rows lose."""

from __future__ import annotations

import os

from dealforge.streaming import upserts

SCHEMA = "k int, seq int, v string"


def table(spark, path):
    return sorted(map(tuple, upserts.latest_version(spark, path).select("k", "seq", "v").collect()))


def batch(spark, path, number, *rows):
    upserts.upsert_batch(spark.createDataFrame(rows, SCHEMA), number, path, ["k"], ["seq"], 8)


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert upserts.latest_version(spark, path) is None
    batch(spark, path, 0, *[(k, 1, "a") for k in range(40)], (3, 0, "earlier"), (3, 1, "b"))
    assert table(spark, path) == sorted((k, 1, "b" if k == 3 else "a") for k in range(40))
    batch(spark, path, 1, (5, 2, "new"), (6, 0, "late"))
    assert dict((k, v) for k, _, v in table(spark, path))[5] == "new" and (6, 1, "a") in table(spark, path)
    written = [n for n in os.listdir(f"{path}/data/version=1") if n.startswith("bucket=")]
    assert len(written) <= 2 and len(upserts.manifest(spark, path)) == len({b for b in os.listdir(f"{path}/data/version=0") if b.startswith("bucket=")})
    want = table(spark, path)
    batch(spark, path, 1, (5, 2, "new"), (6, 0, "late"))  # told again
    assert table(spark, path) == want


def test_a_version_without_its_mark_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    batch(spark, path, 0, (1, 1, "a"))
    batch(spark, path, 1, (1, 2, "b"))
    os.remove(f"{path}/manifest/version=1/_SUCCESS")
    assert table(spark, path) == [(1, 1, "a")] and upserts.versions(spark, path) == [0]
    batch(spark, path, 1, (1, 2, "b"))
    assert table(spark, path) == [(1, 2, "b")]
    batch(spark, path, 2)  # an empty batch
    assert table(spark, path) == [(1, 2, "b")]
