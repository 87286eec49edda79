"""Queries against their SQL on small tables: sources, answers, landmarks, outlines, cuts."""

import duckdb
import pytest

from gridloom.plans import catalogue

NAMES = ("case_maps", "refused_requests", "streamed_requests", "landmark_clearance", "disc_closing", "outline_areas", "door_cuts", "extension_documents")
#: The smallest tables have no map with labels and two rooms.
CASES = [*((name, "sf0.001") for name in NAMES), ("merge_documents", "sf0.01")]


@pytest.mark.parametrize(("name", "size"), CASES)
def test_as_sql(spark, name, size):
    got = catalogue.QUERIES[name](spark, f"/root/testdata/{size}")
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/{size}/{t}.parquet')")
    want = con.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = sorted(map(str, (tuple(r) for r in got.select(*names).collect())))
    assert rows and rows == sorted(map(str, want.fetchall()))
