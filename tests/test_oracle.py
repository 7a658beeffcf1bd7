"""Every query that has SQL gives the rows that DuckDB gives for it on the same tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from ledgerloom import queries as engine


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    yield con
    con.close()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if hasattr(x, "as_tuple"):
        return round(float(x), 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") and x.tzinfo else x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in found)


def test_every_query_with_sql_is_registered():
    assert set(engine.SQL) <= set(engine.QUERIES)


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, duck, name):
    df = engine.QUERIES[name](spark, sf_dir)
    want = duck.sql(engine.SQL[name])
    names, got = rows(df.columns, df.collect())
    assert (names, got) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert engine.QUERIES[name](spark, sf_dir).count() >= 0
