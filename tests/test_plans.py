"""Every core query against its SQL on the smallest tables, where they are."""

from pathlib import Path

import duckdb
import pytest

from loomspark.plans import collect
from oracle import compare

FOLDER = Path("/root/testdata/sf0.001")
QUERIES, SQL = collect()


@pytest.fixture(scope="module")
def con():
    if not FOLDER.exists():
        pytest.skip("no tables")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    said = compare(spark, con, str(FOLDER), name, QUERIES[name], SQL.get(name))
    assert said.startswith(("ok", "rows only")), said


def test_names():
    assert set(SQL) <= set(QUERIES)
