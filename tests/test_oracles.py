"""Registered queries against their SQL twins on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import workload

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for file in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def cell(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return ""
        return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(workload.ORACLES))
def test_query_equals_sql(spark, sql, name):
    df = workload.QUERIES[name](spark, str(SF))
    found = sql.execute(workload.ORACLES[name])
    names = [d[0] for d in found.description]
    assert canonical(df.columns, df.collect()) == canonical(names, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(workload.QUERIES) - set(workload.ORACLES)))
def test_query_without_twin_gives_rows(spark, name):
    assert workload.QUERIES[name](spark, str(SF)).count() > 0
