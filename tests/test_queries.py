"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

from notelake.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = sorted(tuple(map(str, r)) for r in got.select(columns).collect())
    if name in ORACLES:
        found = db.execute(ORACLES[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == columns
        assert rows == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in found.fetchall())
