"""Keys that reach the numbers of other concepts, and results that must not hang on the order of rows."""

import datetime as dt
import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_oracle import difference  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from eventloom.operators import blocks, metrics  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    """The tables with part keys from 999,900 on: some are those of brands."""
    folder, con = tmp_path_factory.mktemp("shifted"), duckdb.connect()
    move = {"part": "* REPLACE (p_partkey + 999900 AS p_partkey, p_name || ' red' AS p_name)", "lineitem": "* REPLACE (l_partkey + 999900 AS l_partkey)"}
    for t in TABLES:
        con.execute(f"COPY (SELECT {move.get(t, '*')} FROM '{SF}/{t}.parquet') TO '{folder}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["audit_availability", "resolve_name", "brand_counts"])
def test_part_keys_among_those_of_brands(spark, shifted, name):
    folder, con = shifted
    got = entry.queries()[name](spark, folder).toPandas()
    assert len(got) and difference(got, con.execute(entry.oracle_sql()[name]).fetchdf()) is None


def test_halves_of_rows_with_one_number(spark):
    """Ten rows of one number, half of which fit: the lower scores, whatever the order of the rows."""
    rows = [(1, 1, 0, i / 10) for i in (9, 3, 7, 1, 5, 0, 8, 2, 6, 4)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "row_id LONG, seed LONG, y_true INT, p_raw DOUBLE").coalesce(1)
        fit = metrics.calibration_halves(df, "row_id").where("is_cal = 1")
        assert sorted(r.p_raw for r in fit.collect()) == [0.0, 0.1, 0.2, 0.3, 0.4]


def test_drug_rows_are_shuffled_once_and_shared_tables_stored(spark, vocabulary, tmp_path):
    """Rows meet their person's window before they are made distinct; what a query reads several times is a stored table."""
    drugs = spark.createDataFrame([(1, 7, dt.date(2020, 1, 3), 1)] * 2, "person_id LONG, concept_id LONG, event_date DATE, event_id LONG")
    day = dt.date(2020, 1, 1)
    cohort = spark.createDataFrame([(1, day, day, dt.date(2020, 1, 20), 1)], "person_id LONG, index_date DATE, acute_start DATE, acute_end DATE, is_inpatient INT")
    plan = blocks.drug_ingredients(drugs, cohort, vocabulary)._jdf.queryExecution().optimizedPlan().toString()
    assert not [s for s in plan.split("\n") if "Aggregate" in s and "event_date" in s]
    pairs = spark.createDataFrame([(1, 7, "one")], "person_id LONG, ingredient_id LONG, ingredient_name STRING")
    wide = blocks.ingredient_flags(pairs, cohort)
    assert [r.asDict() for r in wide.collect()] == [{"person_id": 1, "f_drug_one": 1}] and any("ingredient-pairs" in f for f in wide.inputFiles())
    visits = drugs.select("person_id", "event_id", F.lit(2).cast("long").alias("concept_id"), "event_date", F.lit(None).cast("date").alias("end_date"))
    members = spark.createDataFrame([("s", 7)], "set_id STRING, concept_id LONG")
    given = blocks.regimen_flag(drugs, cohort, visits, members, (2,), "f")
    assert [r.f for r in given.collect()] == [1] and {"given", "index-stays"} <= {f.split("/")[-2].rsplit("-", 1)[0] for f in given.inputFiles()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_drug_row_counts_for_its_own_brand(spark, shifted):
    """Rows of part keys from 1,000,000 on count too, once each and not for the brand whose number they share."""
    folder, con = shifted
    got = {r.brand: r.n for r in entry.queries()["brand_counts"](spark, folder).collect()}
    want = con.execute("SELECT CAST(substr(p_brand, 7) AS BIGINT), count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1")
    assert got == dict(want.fetchall())


def test_means_on_half_a_digit_are_rounded_as_in_the_sql(spark, tmp_path):
    """0.0040125 has its half below the double's true half: the SQL rounds it down."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT 6 AS l_linenumber, s AS l_suppkey, 0.0::DOUBLE AS l_discount, CASE WHEN i = 0 THEN s / 100.0::DOUBLE ELSE 0.0 END AS l_tax
        FROM range(300, 400) t(s), range(80) r(i)) TO '{tmp_path}/lineitem.parquet'""")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = {r.id: (r.p, r.p_bh) for r in entry.queries()["bh_adjust"](spark, str(tmp_path)).collect()}
    want = {r[1]: (r[2], r[4]) for r in con.execute(entry.oracle_sql()["bh_adjust"]).fetchall()}
    assert got == want
