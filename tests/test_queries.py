"""Every registered query of the base library gives the rows of its SQL."""

import duckdb
import pytest

from loomspan import long_queries, more_queries  # noqa: F401  they register their queries
from loomspan.queries import ORACLES, QUERIES
from verify import TABLES, plain

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    if name in ORACLES:
        got = db.execute(ORACLES[name])
        heads = [x[0] for x in got.description]
        assert sorted(heads) == columns
        theirs = sorted((tuple(plain(r[heads.index(c)]) for c in columns) for r in got.fetchall()), key=repr)
        assert ours == theirs


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
