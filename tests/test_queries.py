"""Every engine query against its DuckDB counterpart, and that it does observable work."""

import math

import duckdb
import pytest

from tonefold.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    assert rows or name == "ticker_lookup"
    if name in ORACLE:
        got = con.execute(ORACLE[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == cols
        assert rows == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in got.fetchall())
