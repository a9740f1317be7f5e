import datetime
import decimal
import math
import os

import duckdb
import pytest

from tessera.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracles()))
def test_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, FOLDER)
    result = duck.execute(catalogue.oracles()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(repr(tuple(map(plain, row))) for row in result.fetchall())
    got = sorted(repr(tuple(map(plain, row))) for row in df.select(*columns).collect())
    assert got == want


def test_what_has_no_sql():
    """These are tested against plain Python in test_folds, test_speakers and test_nebula."""
    assert set(catalogue.queries()) - set(catalogue.oracles()) == {"agglomerative_clusters", "high_similarity_collapse", "mask_propagation", "online_clusters", "px_nebula", "small_cluster_merge"}
