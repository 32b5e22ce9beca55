"""A quarter of lines whose outcomes are all open has no rate: the census leaves it out, as its SQL does."""

from pathlib import Path

import duckdb
import pytest
from test_catalog import SF, rows

from plumbline.plans import catalog

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_census_equals_sql(spark, tmp_path):
    con = duckdb.connect()
    for t in ("supplier", "nation", "region"):
        con.execute(f"COPY (SELECT * FROM '{SF}/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
    first = "l_suppkey = 1 AND date_trunc('quarter', l_shipdate) = (SELECT min(date_trunc('quarter', l_shipdate)) FROM l WHERE l_suppkey = 1)"
    con.execute(f"CREATE VIEW l AS SELECT * FROM '{SF}/lineitem.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN {first} THEN 'N' ELSE l_returnflag END AS l_returnflag) FROM l) TO '{tmp_path}/lineitem.parquet'")
    for t in ("lineitem", "supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    assert con.execute(f"SELECT count(*) FROM lineitem l WHERE {first} AND l_returnflag <> 'N'").fetchone()[0] == 0
    found, want = catalog.QUERIES["score_census"](spark, str(tmp_path)).toPandas(), con.execute(catalog.ORACLE_SQL["score_census"]).df()
    assert rows(found) == rows(want)
