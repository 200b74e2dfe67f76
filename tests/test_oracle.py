"""Every query with SQL gives the SQL's rows on the smallest tables; the others give rows."""

import math
from pathlib import Path

import duckdb
import pytest

from weakspot import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def norm(rows):
    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "None"
        return f"{x:.5g}" if isinstance(x, float) else str(x)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = [tuple(r) for r in found.select(*columns).collect()]
    if name not in SQL:
        assert rows
        return
    relation = db.sql(SQL[name])
    assert sorted(relation.columns) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    assert norm(rows) == norm(db.sql(f"SELECT {listed} FROM ({SQL[name]})").fetchall())
