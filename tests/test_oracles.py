"""Every query against DuckDB, over whole tables, comparing every value."""

import math

import duckdb
import pytest

from strata.samples import oracles, queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')"
        )
    yield connection
    connection.close()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else repr(value + 0.0)
        return repr(value)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def test_every_query_has_an_oracle():
    assert set(queries.queries()) == set(oracles.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_matches_oracle(spark, sf_dir, duck, name):
    result = queries.queries()[name](spark, sf_dir)
    oracle = duck.execute(oracles.oracle_sql()[name])
    columns = [c[0] for c in oracle.description]
    assert sorted(result.columns) == sorted(columns)
    expected = canonical(columns, oracle.fetchall())
    actual = canonical(result.columns, [tuple(r) for r in result.collect()])
    assert expected, "an oracle without rows checks nothing"
    assert actual == expected
