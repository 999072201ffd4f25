"""Every query of the catalogue against its DuckDB SQL."""

import os

import duckdb
import pytest

from rastrel.plans import catalog

SF = os.environ.get("CATALOG_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(v):
    return round(float(v), 6) + 0.0 if not isinstance(v, (bool, str, type(None))) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck):
    got = catalog.QUERIES[name](spark, SF)
    found = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    expected = sorted(repr([plain(r[names.index(n)]) for n in order]) for r in found.fetchall())
    assert sorted(repr([plain(r[n]) for n in order]) for r in got.collect()) == expected
    assert expected


@pytest.mark.parametrize("name", ["dilated_mask", "covered_tiles", "confident_overlay"])
def test_frame_as_high_as_the_table(name, spark, tmp_path):
    con = duckdb.connect()
    con.execute("create view events as select i AS event_id, i * 7 % 31 / 2.0 AS value, CASE WHEN i % 3 = 0 AND i // 1000 % 2 = 0 THEN 'error' ELSE 'click' END AS event_type FROM range(15000) t(i)")
    con.execute(f"copy events to '{tmp_path}/events.parquet'")
    found = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    expected = sorted([plain(v) for v in r] for r in found.fetchall())
    assert sorted([plain(r[n]) for n in names] for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()) == expected
    assert max(r[0] for r in expected) >= 140
