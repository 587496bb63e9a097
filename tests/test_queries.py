import glob
import os

import pytest

import __spark_entry__ as e
from lectern.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def cell(v):
    return None if v is None or v != v else int(v) if hasattr(v, "is_integer") and float(v).is_integer() else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_duckdb(spark, name):
    import duckdb

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    rows = QUERIES[name](spark, SF)
    got = sorted((tuple(cell(r[c]) for c in sorted(rows.columns)) for r in rows.collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    con = duckdb.connect()
    for t in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(t)[:-8]} AS SELECT * FROM '{t}'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(names) == sorted(rows.columns)
    assert got == sorted((tuple(cell(r[i]) for i in order) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
