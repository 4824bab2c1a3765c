import json

import pytest
from pyspark.sql import functions as F

from alignspark import batch, cli
from alignspark.capture import capture, diagnose, retry, sniff
from alignspark.harness import CrudHarness, run_file
from alignspark.pipeline import AlignmentError, Pipeline, load
from alignspark.plans.model import ColumnSpec, ConstraintSpec, Family, TableSpec
from alignspark.sources import readers
from alignspark.sources.store import TableStore
from alignspark.streaming import watch


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, f"file://{tmp_path}/store")


@pytest.fixture
def emp(spark, store):
    spec = TableSpec("emp", {"emp_id": ColumnSpec("emp_id", Family.INTEGER, False), "name": ColumnSpec("name", Family.STRING, max_length=50), "salary": ColumnSpec("salary", Family.DECIMAL, precision=15, scale=2)}, [ConstraintSpec("PRIMARY_KEY", ["emp_id"])])
    store.create(spec)
    Pipeline(store).run(spark.createDataFrame([(1, "Alice", 90000.0), (2, "Bob", 70000.0), (3, "Carol", 85000.0)], "emp_id int, name string, salary double"), "emp")
    return store


def test_modes(spark, emp):
    p = Pipeline(emp)
    r = p.run(spark.createDataFrame([(1, "Al"), (4, "Dan")], "EMP_ID int, name string"), "emp", "upsert", ["emp_id"])
    assert r.counts["rows"] == 4 and r.version == 3
    got = {x.emp_id: (x.name, x.salary and int(x.salary)) for x in emp.read("emp").collect()}
    assert got == {1: ("Al", 90000), 2: ("Bob", 70000), 3: ("Carol", 85000), 4: ("Dan", None)}
    r = p.run(spark.createDataFrame([(1, 99999.0), (2, 5.0)], "emp_id int, salary double"), "emp", "update", where=["emp_id = ?"])
    assert r.counts["updated"] == 2
    r = p.run(spark.createDataFrame([(1, 1.0)], "emp_id int, salary double"), "emp", "update_track", where=["emp_id = ?"])
    assert r.counts["tracked"] == 1 and int(emp.read("emp_tracker").first().salary) == 99999
    p.run(spark.createDataFrame([(1, 2.0)], "emp_id int, salary double"), "emp", "update_track", where=["emp_id = ?"])
    assert emp.read("emp_tracker").count() == 2
    none = p.run(spark.createDataFrame([(77, 2.0)], "emp_id int, salary double"), "emp", "update_track", where=["emp_id = ?"])
    assert none.counts == {"tracked": 0, "updated": 0}
    assert p.run(emp.read("emp").limit(0), "emp").counts == {"rows": 0}
    assert emp.rollback("emp") == 5 and emp.vacuum("emp") > 0


def test_errors(spark, emp):
    p = Pipeline(emp)
    with pytest.raises(AlignmentError, match="Alignment errors"):
        p.run(spark.createDataFrame([(None, "x")], "emp_id int, name string"), "emp")
    with pytest.raises(ValueError):
        p.run(emp.read("emp"), "nowhere")
    with pytest.raises(ValueError):
        p.run(emp.read("emp"), "emp", "upsert", ["name"])
    with pytest.raises(ValueError):
        p.run(emp.read("emp"), "emp", "update")
    with pytest.raises(ValueError):
        p.run(emp.read("emp"), "emp", "merge")
    with pytest.raises(AlignmentError, match="no row"):
        p.run(spark.createDataFrame([(1, "dup")], "emp_id int, name string"), "emp")


def test_insert_isolates_rows(spark, emp):
    src = spark.createDataFrame([(1, "dup"), (10, "ok"), (10, "again")], "emp_id int, name string")
    r = Pipeline(emp).run(src, "emp")
    assert (r.counts["success"], r.counts["failed"]) == (1, 2) and r.quarantine.count() == 2
    assert emp.read("emp").count() == 4


def test_extra_columns_and_evolution(spark, emp):
    src = spark.createDataFrame([(20, "Eve", 7)], "emp_id int, name string, ghost int")
    _, found, report = Pipeline(emp).align(src, "emp")
    assert report.dropped == ["ghost"] and found.extra == ["ghost"]
    with capture() as log:
        load(spark, emp, src, "emp", "insert", clean=False, cast=False)
    assert emp.columns("emp")["ghost"] == "bigint" and len(log.by_op("insert")) == 1
    assert emp.read("emp").where("emp_id = 20").first().ghost == 7


def test_load_file_and_metadata(spark, store, tmp_path):
    f = tmp_path / "people.csv"
    f.write_text('﻿Id,Full Name,Joined Date,Pay\n1,"Ann ""A""\nB",9/12/2024,"$1,200.5"\n2,NA,1/2/2023,$3\n', encoding="utf-8")
    meta = tmp_path / "m.json"
    out = load(spark, store, str(f), "people", "replace", infer=True, metadata=str(meta))
    assert out["rows"] == 2 and out["keys"] == ["Id"]
    row = store.read("people").orderBy("Id").first()
    assert row.Pay == 1200.5 and row.Full_Name.startswith('Ann "A"') and row.Joined_Date.month == 9
    assert json.loads(meta.read_text())["table"] == "people"
    assert load(spark, store, [], "people")["rows"] == 0
    assert load(spark, store, [{"Id": 3, "Pay": float("nan")}], "people", "upsert", ["Id"])["rows"] == 3
    with pytest.raises(ValueError):
        readers.read(spark, "x.txt")


def test_harness(spark, store):
    df = spark.createDataFrame([(i, f"T_{i % 5}", 10.5 * i, i % 2 == 0) for i in range(1, 41)], "id long, tenant string, value double, active boolean")
    report = CrudHarness(store, df, "crud", ["id"]).run()
    assert report.all_passed, str(report)
    with pytest.raises(ValueError):
        CrudHarness(store, df.limit(3), "crud", ["id"])
    assert run_file(spark, store, df, "crud2", outlier_factor=1.5).all_passed


def test_batch_and_cli(spark, store, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("k,v\n1,x\n2,y\n")
    config = tmp_path / "jobs.json"
    config.write_text(json.dumps({"store": store.root, "jobs": [{"source": str(f), "table": "a", "mode": "replace", "pk": "k"}, {"table": "b"}, {"source": "/no/such.csv", "table": "c"}]}))
    assert [r["status"] for r in batch.run_jobs(spark, str(config))] == ["success", "skipped", "failed"]
    assert cli.main(["--store", store.root, "load", str(f), "a2", "--ops", "replace", "--pk", "k"], spark) == 0
    assert cli.main(["load", str(f), "a2"], spark) == 2
    assert store.tables() == ["a", "a2"]


def test_watch_folder(spark, store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "My Table.csv").write_text("k,v\n1,x\n2,y\n")
    (folder / "empty.csv").write_text("")
    manifest = str(tmp_path / "m.json")
    assert watch.scan_folder(spark, store, f"file://{folder}", manifest) == {"my_table": "success", "empty": "failed"}
    assert watch.scan_folder(spark, store, f"file://{folder}", manifest) == {"my_table": "skipped", "empty": "skipped"}
    import os

    (folder / "My Table.csv").write_text("k,v\n2,z\n3,w\n")
    os.utime(folder / "My Table.csv", (1, 2_000_000_000))
    assert watch.scan_folder(spark, store, f"file://{folder}", manifest)["my_table"] == "success"
    assert sorted((r.k, r.v) for r in store.read("my_table").collect()) == [(1, "x"), (2, "z"), (3, "w")]


def test_stream_upsert(spark, store, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "1.csv").write_text("k,v\n1,a\n1,b\n2,c\n")
    store.create(TableSpec("s", {"k": ColumnSpec("k", Family.INTEGER), "v": ColumnSpec("v", Family.STRING)}))
    stream = watch.stream_files(spark, f"file://{tmp_path}/s", store.spec("s").struct)
    watch.upsert_stream(spark, store, stream, "s", ["k"], f"file://{tmp_path}/cp").awaitTermination()
    assert sorted((r.k, r.v) for r in store.read("s").collect()) == [(1, "b"), (2, "c")]


def test_helpers():
    assert diagnose("duplicate key value violates unique constraint")[0] == "Duplicate key violation"
    assert diagnose("?")[0] == "Unknown"
    assert sniff('insert into "abc" values (1)') == ("INSERT", "ABC")
    tries = []
    assert retry(lambda: tries.append(1) or (1 / (len(tries) - 1)), 3, 0.01) == 1.0
    with pytest.raises(ZeroDivisionError):
        retry(lambda: 1 / 0, 2, 0.01)


def test_execute_changes(spark, emp, tmp_path):
    from alignspark.plans.analyze import Change
    from alignspark.plans.execute import execute
    from alignspark.plans.model import Policies

    add = Change("ADD_COLUMN", "emp", "age", None, "INT", True)
    widen = Change("WIDEN_COLUMN", "emp", "name", "50", "80", True)
    dry = execute(emp, "emp", [add, widen], log=str(tmp_path / "log"))
    assert dry.status == "DRY_RUN" and len(dry.sql) == 2 and "age" not in emp.columns("emp")
    p = Policies()
    p.ddl.enabled, p.ddl.dry_run = True, False
    done = execute(emp, "emp", [add, widen], p)
    assert done.status == "SUCCESS" and emp.spec("emp").columns["name"].max_length == 80 and emp.read("emp").count() == 3
    assert execute(emp, "emp", [add], p).status == "FAILURE"
    drop = Change("DROP_COLUMN", "emp", "age", None, None, False)
    assert execute(emp, "emp", [drop], p).status == "FAILURE"  # unsafe changes need the policy's leave
    assert execute(emp, "nowhere", [add], p).refused
