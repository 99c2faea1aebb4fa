import glob
import math
import os

import duckdb
import pytest

from ledgerlake.plans import catalog


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def flat(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else repr(x) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, sf_dir, tables, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = sorted(tuple(flat(r[c]) for c in sorted(df.columns)) for r in df.collect())
    found = tables.execute(catalog.SQL[name])
    columns = [d[0] for d in found.description]
    want = sorted(tuple(flat(dict(zip(columns, r))[c]) for c in sorted(columns)) for r in found.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_other_queries_run(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_amounts_of_odd_orders_equal_their_sql(spark, tmp_path):
    """A ratio of 2.565 (just below it as a double), orders of nothing, unknown and negative numbers, keys beyond 2^53."""
    con = duckdb.connect()
    con.execute("""CREATE TABLE orders AS SELECT * FROM (VALUES (16803::BIGINT, 101::BIGINT, 384750.0::DOUBLE), (2, 1, 0.0), (3, 7, 0.0), (4, NULL, 5.5), (5, 5, NULL), (NULL, 5, 5.5), (7, NULL, NULL), (8, -4, 3.3), (-9, -5, 1e6),
      (-100000, 7, -20.0), (11, 1, 0.05), (15, 1, 9.0e16), (16, 3, -0.0001), (200000000000000017, 1, 1.0), (18, 1, -384750.0), (20, NULL, 0.11), (21, NULL, 0.12), (22, -1, 0.12)) t(o_orderkey, o_custkey, o_totalprice)""")
    con.execute(f"COPY orders TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    got = [tuple(r) for r in catalog.QUERIES["report_amounts"](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, con.execute(catalog.SQL["report_amounts"]).fetchall()))
