"""Every registered query of the memory engine against its SQL, at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

from memengine.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    return round(float(v), 6) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    frame = registry.QUERIES[name](spark, DATA)
    cols = sorted(frame.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in frame.collect())
    if name in registry.ORACLE_SQL:
        want = db.sql(registry.ORACLE_SQL[name])
        assert sorted(want.columns) == cols
        rows = db.sql(f"SELECT {', '.join(cols)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
        assert got == sorted(repr(tuple(plain(v) for v in r)) for r in rows)
    else:
        assert got  # none is empty at any scale
