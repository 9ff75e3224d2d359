import glob
import os

import duckdb
import pytest

from eventide.plans import catalog, continuous, service  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def value(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    return None if x is None or str(x) in ("nan", "NaT", "<NA>") else x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows_as_the_oracle(spark, oracle, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = oracle.execute(catalog.ORACLES[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    expected = sorted((tuple(value(r[names.index(c)]) for c in order) for r in rows.fetchall()), key=str)
    assert sorted((tuple(value(r[c]) for c in order) for r in got.collect()), key=str) == expected
