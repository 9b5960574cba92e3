"""Every registered query of the catalogue against its SQL in DuckDB."""

from __future__ import annotations

import datetime
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from dealforge import plans  # noqa: E402
from dealforge.sources.catalogue import VIEWS  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "labels"):
        out.sql(f"create view {name} as select * from read_parquet('{FOLDER}/{name}.parquet')")
    return out


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


def rows(values):
    return sorted([tuple(map(plain, r)) for r in values], key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(spark, con, name):
    df = plans.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert rows(df.select(*columns).collect()) == rows(con.sql(f"select {quoted} from ({plans.ORACLE[name]})").fetchall())


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLE)
    assert len(plans.QUERIES) > 70


def test_views_name_what_they_read():
    for needs, text in VIEWS.values():
        assert all(need in text for need in needs)
