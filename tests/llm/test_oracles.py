import os

import pytest

import __spark_entry__ as driver

SF = "/root/testdata/sf0.01"
TABLES = ("documents", "pages", "benchmark")


@pytest.mark.parametrize("name", ["op5_warc_salvage", "op6_minhash_join", "op7_fm_decontaminate", "op11_partenum_spelling", "op13_bwt_phrases"])
def test_queries_meet_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SF, t)}.parquet'")
    got = driver.queries()[name](spark, SF)
    want = con.execute(driver.oracle_sql()[name])
    assert sorted(got.columns) == sorted(c[0] for c in want.description)
    order = [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, got.select(order).collect()))) == sorted(map(repr, want.fetchall()))
