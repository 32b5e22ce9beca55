"""Every registered query with SQL equals DuckDB's answer on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from plumbline.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if pd.isna(v) else round(v, 5) + 0.0
    return None if v is None or v is pd.NaT or v is pd.NA else v


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(repr(tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in map(plain, r))) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    found, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).columns


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize(("name", "of"), [("scale_ratio", "residuals"), ("scored", "residuals"), ("score_forests", "census")])
def test_runs_with_published_settings(spark, monkeypatch, name, of):
    from plumbline.config import DEFAULT
    from plumbline.plans import score_queries

    seen, f = [], {"scale_ratio": "scale_ratio", "scored": "score", "score_forests": "score_census"}[name]
    monkeypatch.setattr(getattr(score_queries, of), f, lambda *a, settings=DEFAULT, **b: seen.append([settings, *(x for x in a if isinstance(x, type(DEFAULT)))]))
    catalog.QUERIES[name](spark, SF)
    assert len(seen) == 1 and set(seen[0]) == {DEFAULT}
