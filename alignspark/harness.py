"""Verification cycle: insert, upsert and update slices of a frame and compare the table with what it should hold."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .capture import diagnose
from .functions.casting import cast_frame
from .functions.text import robust_clean
from .operators import dml, outliers, profile
from .operators.dml import ORDER
from .pipeline import Pipeline
from .plans.fingerprint import diff, fingerprint
from .plans.model import ConstraintSpec, spec_of
from .sources.readers import read_any
from .sources.store import TableStore


@dataclass
class Step:
    name: str
    passed: bool
    rows: int
    seconds: float
    detail: str = ""


@dataclass
class Report:
    table: str
    keys: list[str]
    steps: list[Step] = field(default_factory=list)
    drift: str = ""

    @property
    def all_passed(self) -> bool:
        return bool(self.steps) and all(s.passed for s in self.steps)

    def __str__(self) -> str:
        lines = [f"{self.table}: key {', '.join(self.keys)}"]
        lines += [f"{'PASS' if s.passed else 'FAIL'} {s.name}: {s.rows} rows, {s.seconds} s {s.detail}".rstrip() for s in self.steps]
        return "\n".join([*lines, f"schema: {self.drift}"])


def expected_states(df: DataFrame, keys: list[str], n: int) -> dict[str, DataFrame]:
    """The table after each step, for a frame with a dense _ord.

    After insert the first 60 % are there; the upsert changes the rows from 30
    to 60 % and adds those up to 80 %; the update changes three rows.
    """
    parts = profile.harness_slices(df, n)
    extra = ["in_insert", "in_upsert", "is_mutated", "in_update"]
    rows = df.columns
    first = parts.where("in_insert").select(*rows)
    changed = profile.mutate_frame(parts.where("is_mutated").select(*rows), keys)
    second = parts.where("in_insert AND NOT in_upsert").select(*rows).unionByName(changed).unionByName(parts.where("in_upsert AND NOT is_mutated").select(*rows))
    marked = second.join(parts.where("in_update").select(ORDER, F.lit(True).alias("_u")), ORDER, "left")
    third = profile.mutate_frame(marked.where("_u").select(*rows), keys, "_fin").unionByName(marked.where("_u IS NULL").select(*rows))
    assert not set(extra) & set(rows)
    return {"insert": first, "upsert": second, "update": third}


class CrudHarness:
    def __init__(self, store: TableStore, df: DataFrame, table: str, keys: list[str]) -> None:
        self.store, self.table, self.keys = store, table, keys
        self.df = dml.with_order(df, keys)
        self.n = df.count()
        self.states = expected_states(self.df, keys, self.n)

    def _step(self, report: Report, name: str, rows: DataFrame, **kw: Any) -> None:
        began = time.perf_counter()
        try:
            Pipeline(self.store).run(rows, self.table, name, **kw)
            found = profile.compare(self.store.read(self.table), self.states[name].drop(ORDER), self.keys).first()
            ok = found["missing"] == found["unexpected"] == found["different"] == 0
            report.steps.append(Step(name, ok, found["equal"], round(time.perf_counter() - began, 3), "" if ok else str(found.asDict())))
        except Exception as e:
            cause, advice = diagnose(str(e))
            report.steps.append(Step(name, False, 0, round(time.perf_counter() - began, 3), f"{cause}: {advice} ({str(e)[:200]})"))

    def run(self) -> Report:
        report = Report(self.table, self.keys)
        if self.store.exists(self.table):
            self.store.drop(self.table)
        self.store.create(spec_of(self.df.drop(ORDER).schema, self.table, [ConstraintSpec("PRIMARY_KEY", list(self.keys))]))
        before = fingerprint(self.store.spec(self.table))
        parts = profile.harness_slices(self.df, self.n)
        rows = self.df.columns
        self._step(report, "insert", self.states["insert"])
        changed = profile.mutate_frame(parts.where("is_mutated").select(*rows), self.keys)
        self._step(report, "upsert", changed.unionByName(parts.where("in_upsert AND NOT is_mutated").select(*rows)), constrain=self.keys)
        touched = self.states["update"].join(parts.where("in_update").select(ORDER), ORDER, "left_semi")
        self._step(report, "update", touched, where=[(k, "=", "?") for k in self.keys])
        report.drift = str(diff(before, fingerprint(self.store.spec(self.table))))
        return report


def run_file(spark: SparkSession, store: TableStore, source: Any, table: str, keys: list[str] | None = None, outlier_factor: float | None = None, report_path: str | None = None) -> Report:
    """Read, clean, cast, blank outliers of columns that are no key, find a key, and run the cycle."""
    df = cast_frame(robust_clean(read_any(spark, source)))
    keys = keys or profile.infer_key(df).columns
    if outlier_factor is not None:
        df = outliers.treat(df, [c for c in outliers.numeric_columns(df) if c not in keys], "nullify", factor=outlier_factor, per_column=True)
    report = CrudHarness(store, df, table, keys).run()
    if report_path:
        with open(report_path, "w", encoding="utf-8") as f:
            f.write(f"{report}\n")
    return report
