"""Every registered query with SQL gives the SQL's rows (DuckDB on the same tables)."""

import duckdb
import pytest

import __spark_entry__
from plumbline.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries whose result on the smallest tables is empty.
MAY_BE_EMPTY = {"duplicates_within_source", "ratios_within_source", "balance_bands", "disjoint_labels", "n_profiles", "shares_within_source", "exact_across_sources", "missing_labels", "dominant_runs", "islands", "rising_starts", "shape_similarity", "similar_set_pairs", "value_sets", "reused_columns", "multiplicity_findings"}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(x):
    x = x.item() if hasattr(x, "item") else x
    return (None if x != x else round(x, 6) + 0.0) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted(str(tuple(map(plain, r))) for r in df.select(*names).collect())
    if name not in registry.SQL:
        assert got or name in MAY_BE_EMPTY
        return
    r = duck.execute(registry.SQL[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == names
    at = [cols.index(n) for n in names]
    assert got == sorted(str(tuple(plain(x[i]) for i in at)) for x in r.fetchall())
    assert got or name in MAY_BE_EMPTY


def test_entry(spark):
    assert "source" in __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
