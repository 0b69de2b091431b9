from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.operators import assemble as A


def test_blocks_keep_their_types_and_travel_as_one_row_each(spark):
    cohort = spark.createDataFrame([(i,) for i in range(1, 6)], "person_id BIGINT")
    flags = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (9, 1, 1)], "person_id BIGINT, f_a INT, f_b INT")
    numbers = spark.createDataFrame([(1, 2.5, None), (3, 0.0, 7)], "person_id BIGINT, f_x DOUBLE, n BIGINT")
    again = spark.createDataFrame([(1, 5.0, 1), (4, 6.5, 1)], "person_id BIGINT, f_x DOUBLE, yes INT")
    out = A.join_blocks(cohort, [flags, numbers, again], ["f_a", "f_b", "yes", "n"])
    assert [(f.name, f.dataType) for f in out.schema.fields[1:]] == [("f_a", T.IntegerType()), ("f_b", T.IntegerType()), ("f_x", T.DoubleType()), ("n", T.LongType()), ("yes", T.IntegerType())]
    assert sorted(map(tuple, out.collect())) == [(1, 1, 0, 2.5, 0, 1), (2, 0, 0, None, 0, 0), (3, 0, 0, 0.0, 7, 0), (4, 0, 0, 6.5, 0, 1), (5, 0, 0, None, 0, 0)]


def test_no_exchange_holds_persons_times_columns(spark):
    cohort = spark.range(200).select(F.col("id").alias("person_id"))
    blocks = [cohort.select("person_id", *[((F.col("person_id") + i) % 3 == 0).cast("int").alias(f"c{b}_{i}") for i in range(60)]) for b in range(3)]
    columns = [c for b in blocks for c in b.columns[1:]]
    out = A.join_blocks(cohort, blocks, columns)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "pivot" not in plan.lower()
    assert out.count() == 200 and out.agg(F.sum("c0_0")).first()[0] == 67
    assert A.join_blocks(cohort, []).columns == ["person_id"]
