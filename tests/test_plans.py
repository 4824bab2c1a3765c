import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alignspark.operators import outliers, profile
from alignspark.plans import analyze, ddl, fingerprint, mapping
from alignspark.plans.model import ColumnSpec, ConstraintSpec, Family, IndexSpec, Policies, TableSpec, compatible, family_of, spec_of, sql_type


@pytest.fixture
def salaries(spark):
    return spark.createDataFrame([(50000.0,)] * 9 + [(999999.0,)], "salary double")


def test_types():
    assert compatible(Family.INTEGER, Family.FLOAT) and not compatible(Family.FLOAT, Family.INTEGER)
    assert sql_type(Family.STRING, "oracle", 10) == "VARCHAR2(10)"
    assert sql_type(Family.DATETIME, "postgresql", zone=True) == "TIMESTAMP WITH TIME ZONE"
    assert family_of(T.DecimalType(5, 2)) is Family.DECIMAL
    with pytest.raises(ValueError):
        sql_type(Family.DATE, "db2")
    p = Policies()
    p.outliers.max_share = 0.2
    with pytest.raises(ValueError):
        p.validate()


def test_outliers(spark, salaries):
    assert outliers.summarise(salaries, ["salary"]).outlier_rows == 1
    assert outliers.treat(salaries, ["salary"], "drop").count() == 9
    assert outliers.treat(salaries, ["salary"], "nullify").where("salary is null").count() == 1
    assert outliers.treat(salaries, ["salary"], "clip").agg(F.max("salary")).first()[0] < 999999
    assert outliers.bounds(salaries, ["salary"], "mad") == {}
    steps = spark.createDataFrame([(50000.0 + 1000 * i,) for i in range(9)] + [(999999.0,)], "salary double")
    assert outliers.summarise(steps, ["salary"], "mad").outlier_rows == 1
    wide = spark.createDataFrame([(50000.0 + 100 * i,) for i in range(20)] + [(9999999.0,)], "salary double")
    assert outliers.summarise(wide, ["salary"], "zscore").outlier_rows == 1
    assert outliers.within_cap(salaries, ["salary"])[0] is False
    assert outliers.summarise(salaries.limit(0), ["salary"]).outlier_rows == 0
    for bad in ({"method": "x"}, {"rule": "x"}, {"factor": -1}):
        with pytest.raises(ValueError):
            outliers.flag(salaries, ["salary"], **bad)


def test_mapping():
    assert mapping.similarity("a", "a") == 1.0 and mapping.similarity("Emp_ID", "emp_id") == 0.95
    found, extra, missing = mapping.match_columns(["EMP_ID", "ghost"], ["emp_id", "name"])
    assert [(m.source, m.target) for m in found] == [("EMP_ID", "emp_id")] and extra == ["ghost"] and missing == ["name"]
    assert "not in table: ghost" in mapping.report(found, extra, missing)
    assert mapping.normal_case("abc", "oracle") == "ABC" and mapping.normal_case('"abc"', "oracle") == "abc"


def test_analyze_and_ddl(spark):
    df = spark.createDataFrame([(1, "abcdef", 5), (None, "x", 6)], "id int, name string, extra int")
    spec = TableSpec("t", {"id": ColumnSpec("id", Family.INTEGER, False), "name": ColumnSpec("name", Family.STRING, max_length=3), "must": ColumnSpec("must", Family.DATE, False)}, [ConstraintSpec("PRIMARY_KEY", ["id"])])
    a = analyze.analyze(df, spec)
    found = {(i.code.value, i.severity.value) for i in a.issues}
    assert a.has_errors
    assert {("EXTRA_DF_COLUMN", "info"), ("COLUMN_NULLABILITY_VIOLATION", "error"), ("COLUMN_LENGTH_OVERFLOW", "warning"), ("MISSING_DB_COLUMN", "error"), ("CONSTRAINT_VIOLATION", "error")} <= found
    changes = analyze.plan_changes(df, a)
    assert [(c.kind, c.column, c.after) for c in changes] == [("ADD_COLUMN", "extra", "BIGINT"), ("WIDEN_COLUMN", "name", "7")]
    assert analyze.summarise_plan(changes)["risk"] == "low" and len(analyze.batches(changes)) == 1
    assert "ALTER TABLE t ALTER COLUMN name TYPE VARCHAR(7)" == ddl.change_sql(changes[1], spec, "postgresql")
    assert analyze.check_plan([analyze.Change("ALTER_TYPE", "t", "id", "a", "b", False)])


@pytest.mark.parametrize("dialect", ["oracle", "postgresql", "mssql", "mysql", "sqlite", "spark"])
def test_create_table(dialect):
    spec = TableSpec("emp", {"id": ColumnSpec("id", Family.INTEGER, False, identity=True), "Order": ColumnSpec("Order", Family.STRING, max_length=20)}, [ConstraintSpec("PRIMARY_KEY", ["id"]), ConstraintSpec("FOREIGN_KEY", ["Order"], references=("o", ["k"]))], [IndexSpec("ix", ["Order"], True)])
    out = ddl.create_table(spec, dialect)
    assert out[0].startswith("CREATE TABLE") and ("PRIMARY KEY" in out[0]) == (dialect != "spark")
    assert len(out) == (1 if dialect == "spark" else 2)


def test_partition_text():
    assert ddl.partition_sql("range", ["d"], "oracle", interval="NUMTOYMINTERVAL(1,'MONTH')").startswith("PARTITION BY RANGE (D) INTERVAL")
    with pytest.raises(ValueError):
        ddl.partition_sql("list", ["d"], "oracle", interval="x")
    with pytest.raises(ValueError):
        ddl.mssql_partition("p", "BIGINT", ["1"], ["a"])


def test_fingerprint(spark):
    a = spark.createDataFrame([], "id int, name string").schema
    b = spark.createDataFrame([], "name string, id int").schema
    c = spark.createDataFrame([], "id int, name string, age int").schema
    f = [fingerprint.fingerprint(spec_of(s, "t")) for s in (a, b, c)]
    assert f[0].digest == f[1].digest != f[2].digest and len(f[0].digest) == 16
    assert fingerprint.diff(f[0], f[2]).added == ["age"]
    assert not fingerprint.diff(f[0], f[1]).changed


def test_keys(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "a", 1)], "x int, y string, z int")
    k = profile.infer_key(df)
    assert k.unique and set(k.columns) == {"x", "y"} and k.name.endswith("_pk")
    assert profile.minimal_keys(df, ["x", "y", "z"]) == [["x", "y"]]
    with pytest.raises(ValueError):
        profile.infer_key(df.limit(0))
    same = spark.createDataFrame([(1,), (1,)], "x int")
    assert profile.infer_key(same).unique is False
