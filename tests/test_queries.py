"""Every query of the library against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from stratafold import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that the smallest tables give no row.
MAY_BE_EMPTY = {"frequency_filter"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL) and len(queries.QUERIES) > 120


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    found = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = sorted(str(tuple(plain(r[i]) for i in places)) for r in found.fetchall())
    assert sorted(str(tuple(plain(r[c]) for c in columns)) for r in got.collect()) == want
    assert want or name in MAY_BE_EMPTY
