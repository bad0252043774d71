"""Every query with an SQL twin returns the twin's rows on the small tables."""
import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, canon

SQL = entry.oracle_sql()
NO_TWIN = sorted(set(entry.queries()) - set(SQL))


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cur = con.execute(SQL[name])
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(cur.fetchall(), [d[0] for d in cur.description])


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["split"] for r in rows} == {"train", "val", "test"}
    assert all(r["n_crossing_clusters"] == 0 for r in rows)


@pytest.mark.parametrize("name", [n for n in NO_TWIN if n in
                                  ("features_all", "file_manifest", "near_dup_clusters_fast", "tree_importance")])
def test_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0
