import pytest
from pyspark.sql import functions as F

from alignspark.operators import dml
from alignspark.operators.dml import ORDER

SCHEMA = "emp_id int, name string, salary double"


@pytest.fixture
def emp(spark):
    return spark.createDataFrame([(1, "Alice", 90.0), (2, "Bob", 70.0), (3, "Carol", 85.0)], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upsert_last_wins_nulls_and_idempotence(spark, emp):
    src = spark.createDataFrame([(1, "x", 1.0, 0), (1, None, 2.0, 1), (9, "new", None, 2), (None, "n", 0.0, 3)], f"{SCHEMA}, {ORDER} long")
    once = dml.upsert(emp, src, ["EMP_ID"], [["emp_id"]])
    assert rows(once) == rows(spark.createDataFrame([(1, None, 2.0), (2, "Bob", 70.0), (3, "Carol", 85.0), (9, "new", None), (None, "n", 0.0)], SCHEMA))
    keyed = src.where("emp_id is not null")
    a = dml.upsert(emp, keyed, ["emp_id"])
    assert rows(dml.upsert(a, keyed, ["emp_id"])) == rows(a)


def test_upsert_bad_key_and_column(spark, emp):
    with pytest.raises(ValueError):
        dml.upsert(emp, emp, ["name"], [["emp_id"]])
    with pytest.raises(ValueError, match="ghost"):
        dml.insert(emp, emp.withColumn("ghost", F.lit(1)))


def test_empty_sides(spark, emp):
    none = emp.limit(0)
    assert rows(dml.upsert(emp, none, ["emp_id"])) == rows(emp)
    assert rows(dml.upsert(none, emp, ["emp_id"])) == rows(emp)
    assert rows(dml.update(emp, none, ["emp_id = ?"])) == rows(emp)
    assert dml.update_count(emp, none, ["emp_id = ?"]).first()[0] == 0


def test_update(spark, emp):
    one = spark.createDataFrame([(1, 99.0)], "emp_id int, salary double")
    assert dml.update(emp, one, ["emp_id = ?"]).where("emp_id = 1").first().salary == 99.0
    assert dml.update_count(emp, one, ["emp_id = ?"]).first()[0] == 1
    lit = spark.createDataFrame([("low",)], "name string")
    assert dml.update(emp, lit, ["salary < 80"]).where("name = 'low'").count() == 1
    two = spark.createDataFrame([(60.0, "a", 0), (80.0, "b", 1)], f"salary double, name string, {ORDER} long")
    with pytest.raises(ValueError):
        dml.update(emp, two, ["salary >= ?"])


def test_update_range_join_last_wins(spark):
    t = spark.createDataFrame([(1, 5, "-"), (2, 15, "-"), (3, 1, "-")], "id int, lo int, tag string")
    src = spark.createDataFrame([(0, "a", 0), (0, "b", 1)], f"id int, tag string, {ORDER} long")
    out = dml.update(t, src.where(f"{ORDER} = 1"), [("id", ">", "?")])
    assert {r.tag for r in out.collect()} == {"b"}


def test_tracking(spark, emp):
    one = spark.createDataFrame([(1, 99.0)], "emp_id int, salary double")
    kept, new = dml.update_track(emp, one, ["emp_id = ?"], at=F.lit(0))
    assert kept.first().salary == 90.0 and "track_inserted_at" in kept.columns
    assert new.where("emp_id = 1").first().salary == 99.0
    both = spark.createDataFrame([(1, "Bob"), (2, "Alice")], "emp_id int, name string")
    assert dml.snapshot(emp, both, ["emp_id", "name"]).count() == 2
    assert dml.snapshot(emp, both, ["emp_id", "name"], exact=True).count() == 0


def test_isolation(spark):
    src = spark.range(20).withColumnRenamed("id", ORDER).withColumn("v", F.when(F.col(ORDER) % 2 == 1, F.col(ORDER)))
    got = dml.isolate(src, F.col("v").isNotNull(), chunk=10, tolerance=3)
    s = {r._chunk: (r.total, r.success, r.failed, r.unprocessed) for r in got.summary.collect()}
    assert s == {0: (10, 2, 3, 5), 1: (10, 2, 3, 5)}


def test_dense_order(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 AS k")
    got = sorted((r.k, r[ORDER]) for r in dml.with_order(df, ["k"]).collect())
    assert [o for _, o in got] == list(range(1000))
