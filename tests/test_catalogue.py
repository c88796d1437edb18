"""Every registered query of the reference's operators runs, and those with SQL equal DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from pulseloom.plans import catalogue

SF = "/root/testdata/sf0.001"
SLOW: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, (bool, int)) or v is None:
        return str(v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else f"{float(v):.5g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - SLOW))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = sorted([tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()])
    if name in catalogue.SQL:
        cursor = duck.execute(catalogue.SQL[name])
        names = [d[0] for d in cursor.description]
        want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())
        assert sorted(df.columns) == sorted(names) and got == want
