"""Registered queries against their SQL on the driver's tables."""

import os

import pytest

from lodestone.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def _plain(rows):
    return sorted(tuple(None if v is None else round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, bool) else v for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    assert _plain(map(tuple, df.select(*cols).collect())) == _plain(want)
