import math

import duckdb
import pytest

from vellum.plans import documents, service  # noqa: F401  they register their queries
from vellum.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6) if math.isfinite(value) else str(value)
    return str(value) if value is not None and not isinstance(value, (int, str, bool)) else value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_oracle(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    got = normal(frame.columns, frame.collect())
    found = duck.sql(ORACLES[name])
    assert got == normal(found.columns, found.fetchall())
    assert got[1]
