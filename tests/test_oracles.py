"""Every mesh query against its DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

from tetraflow.plans import frame_queries  # noqa: F401  (registers its queries)
from tetraflow.plans import lattice_queries as L

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows, order):
    fix = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(fix(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(L.oracle_sql()))
def test_query_equals_its_oracle(spark, duck, name):
    df = L.queries()[name](spark, SF)
    rel = duck.sql(f"SELECT * FROM ({L.oracle_sql()[name]}) LIMIT 100000000")  # no oracle may need a plan that a limit spoils
    assert sorted(df.columns) == sorted(rel.columns)
    columns = sorted(df.columns)
    assert plain(df.collect(), [df.columns.index(c) for c in columns]) == plain(rel.fetchall(), [rel.columns.index(c) for c in columns])


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
