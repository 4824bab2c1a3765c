"""Loading a frame into a stored table: align, analyse, evolve, coerce, write."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .capture import note
from .functions.casting import CastConfig, cast_frame
from .functions.coerce import CoercionReport, coerce_frame
from .functions.text import robust_clean
from .operators import dml, outliers
from .operators.dml import ORDER
from .operators.profile import infer_key
from .plans import analyze as planning
from .plans.ddl import schema_json
from .plans.model import ConstraintSpec, DdlPolicy, Policies, TableSpec, spec_of
from .sources.readers import read_any
from .sources.store import TableStore

MODES = ("insert", "upsert", "update", "update_track", "replace")


@dataclass
class Result:
    table: str
    mode: str
    counts: dict[str, int]
    analysis: planning.Analysis | None = None
    coercion: CoercionReport | None = None
    changes: list[planning.Change] = field(default_factory=list)
    version: int | None = None
    seconds: float = 0.0
    quarantine: DataFrame | None = None


class AlignmentError(RuntimeError):
    pass


def sync_case(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns renamed to the table's spelling where they differ in case only."""
    names = {c.lower(): c for c in columns}
    return df.select(*(F.col(f"`{c}`").alias(names.get(c.lower(), c)) for c in df.columns))


class Pipeline:
    def __init__(self, store: TableStore, policies: Policies | None = None) -> None:
        self.store, self.policies = store, policies or Policies()
        self.policies.validate()

    def align(self, df: DataFrame, table: str) -> tuple[DataFrame, planning.Analysis, CoercionReport]:
        """Dry analysis: the coerced frame and the reports, nothing written."""
        spec = self.store.spec(table)
        named = sync_case(df, list(spec.columns))
        found = planning.analyze(named.drop(ORDER), spec, self.policies)
        coerced, report = coerce_frame(named.drop(ORDER), spec, self.policies, {m.source: m.target for m in found.mappings})
        return coerced, found, report

    def run(self, df: DataFrame, table: str, mode: str = "insert", constrain: list[str] | None = None, where: Any = None, expression: str | None = None, apply_ddl: bool = False, dry_run: bool = False, chunk: int = 10_000, tolerance: int = 5, trace: str | None = None) -> Result:
        """Write a frame; the target's old version stays readable throughout.

        insert keeps back rows that break NOT NULL or a declared key, with the
        tolerance for each chunk; all counts come from the written data.
        """
        began = time.perf_counter()
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        if mode == "upsert" and not constrain:
            raise ValueError("upsert needs key columns")
        if mode.startswith("update") and not where:
            raise ValueError("update needs conditions")
        if df.isEmpty() and mode != "replace":
            return Result(table, mode, {"rows": 0})
        if not self.store.exists(table):
            if not apply_ddl or dry_run:
                raise ValueError(f"table {table} does not exist")
            keys = [ConstraintSpec("PRIMARY_KEY", list(constrain))] if constrain else []
            self.store.create(spec_of(df.drop(ORDER).schema, table, keys))
        spec = self.store.spec(table)
        ordered = df if ORDER in df.columns else dml.with_order(df, dense=mode == "insert")
        named = sync_case(ordered, list(spec.columns))
        found = planning.analyze(named.drop(ORDER), spec, self.policies)
        errors = [i for i in found.issues if i.severity.value == "error" and not (mode.startswith("update") and i.code.value == "MISSING_DB_COLUMN")]
        if errors:
            raise AlignmentError("Alignment errors: " + "; ".join(f"{i.code.value} {i.column or ''} {i.message}" for i in errors))
        changes = planning.plan_changes(named.drop(ORDER), found, self.policies) if apply_ddl and self.policies.ddl.enabled else []
        bad = planning.check_plan(changes, self.policies)
        if bad:
            raise AlignmentError("; ".join(i.message for i in bad))
        if dry_run:
            coerced, report = coerce_frame(named.drop(ORDER), spec, self.policies)
            return Result(table, mode, {"rows": coerced.count()}, found, report, changes, None, time.perf_counter() - began)
        if changes and not self.policies.ddl.dry_run:
            self.store.evolve(table, changes)
            spec = self.store.spec(table)
        rename = {m.source: m.target for m in found.mappings}
        treated = named
        if self.policies.outliers.enabled:
            numeric = outliers.numeric_columns(named.drop(ORDER), [m.source for m in found.mappings])
            treated = outliers.treat(named, numeric, self.policies.outliers.action, self.policies.outliers.method, self.policies.outliers.factor, self.policies.outliers.rule, per_column=True)
        data, report = coerce_frame(treated, _with_order(spec), self.policies, rename)
        base = self.store.version(table)
        target = self.store.read(table, base)
        counts, quarantine = {}, None
        if mode == "insert":
            split = self._isolate(data, target, spec, chunk, tolerance)
            new, quarantine = split.good.drop(ORDER), split.bad
            dml.check_columns(target, new.columns)
            sums = split.summary.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "success", "failed", "unprocessed"))).first().asDict()
            if sums["total"] and not sums["success"]:
                raise AlignmentError(f"no row could be loaded: {sums}")
            counts |= sums
        elif mode == "replace":
            new = dml.insert(target.limit(0), data)
        elif mode == "upsert":
            new = dml.upsert(target, data, constrain, spec.unique_sets)
        else:
            if mode == "update_track":
                keys = [c.column for c in dml.predicates.parse(where if isinstance(where, list) else [where])]
                kept = dml.tracker_rows(target, data, keys)
                counts["tracked"] = kept.count()
                if not counts["tracked"]:
                    return Result(table, mode, {"tracked": 0, "updated": 0}, found, report)
                self._track(table, kept)
            counts["updated"] = dml.update_count(target, data, where, expression).first()[0]
            new = dml.update(target, data, where, expression)
        note(mode, table, new)
        if trace:
            with open(trace, "a", encoding="utf-8") as f:
                f.write(f"-- {mode} {table}\n{new._jdf.queryExecution().toString()}\n")
        # an insert adds a part; the other modes make the table anew from the version that they read
        version = self.store.append(table, new) if mode == "insert" else self.store.write(table, new, spec, base)
        counts["rows"] = self.store.read(table).count()
        return Result(table, mode, counts, found, report, changes, version, round(time.perf_counter() - began, 3), quarantine)

    def _isolate(self, data: DataFrame, target: DataFrame, spec: TableSpec, chunk: int, tolerance: int) -> dml.Isolation:
        valid = F.lit(True)
        for c in spec.columns.values():
            if not c.nullable and c.default is None and c.name in data.columns:
                valid &= F.col(f"`{c.name}`").isNotNull()
        rows = data
        for keys in spec.unique_sets:
            if all(k in data.columns for k in keys):
                clash = dml.key_conflicts(target, rows.select(ORDER, *keys), keys).select(ORDER).distinct().withColumn("_clash", F.lit(True))
                rows = rows.join(clash, ORDER, "left").withColumn("_taken", F.coalesce("_clash", F.lit(False)) | (F.col("_taken") if "_taken" in rows.columns else F.lit(False))).drop("_clash")
        if "_taken" in rows.columns:
            valid &= ~F.col("_taken")
        split = dml.isolate(rows, valid, chunk, tolerance)
        return dml.Isolation(split.good.drop("_taken"), split.bad.drop("_taken"), split.summary)

    def _track(self, table: str, rows: DataFrame) -> None:
        name = f"{table}_tracker"
        if not self.store.exists(name):
            self.store.create(spec_of(T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema]), name))
        self.store.append(name, rows)


def _with_order(spec: TableSpec) -> TableSpec:
    from .plans.model import ColumnSpec, Family

    return TableSpec(spec.name, spec.columns | {ORDER: ColumnSpec(ORDER, Family.INTEGER)}, spec.constraints, spec.indexes)


def load(spark: SparkSession, store: TableStore, source: Any, table: str, if_exists: str = "insert", keys: list[str] | None = None, clean: bool = True, cast: bool = True, infer: bool = False, outlier_factor: float | None = None, add_columns: bool = True, apply_ddl: bool = True, metadata: str | None = None, policies: Policies | None = None, **kw: Any) -> dict:
    """Read, clean, cast, find keys, and write: a path, records or a frame into a table.

    Outliers are left alone unless a factor is given; then their rows are
    dropped over numeric columns that are no keys, and counted.  The caller's
    policies are followed and never changed; without any, new columns are added
    where ``add_columns`` allows it.  ``apply_ddl`` false makes no table and
    changes none.
    """
    df = read_any(spark, source)
    if not df.columns or df.isEmpty():
        return {"table": table, "rows": 0, "issues": []}
    if if_exists not in MODES:
        raise ValueError(f"unknown mode {if_exists!r}")
    if clean:
        df = robust_clean(df)
    if cast:
        df = cast_frame(df, CastConfig())
    if infer and not keys:
        keys = infer_key(df).columns
    dropped = 0
    if outlier_factor is not None:
        names = [c for c in outliers.numeric_columns(df) if c not in (keys or [])]
        dropped = outliers.summarise(df, names, factor=outlier_factor).outlier_rows
        df = outliers.treat(df, names, "drop", factor=outlier_factor)
    if policies is None:
        policies = Policies(ddl=DdlPolicy(enabled=add_columns, dry_run=not add_columns))
    elif not add_columns:
        policies = replace(policies, ddl=replace(policies.ddl, allow_add_columns=False))
    result = Pipeline(store, policies).run(df, table, if_exists, constrain=keys, apply_ddl=apply_ddl, **kw)
    if metadata:
        with open(metadata, "w", encoding="utf-8") as f:
            json.dump(schema_json(store.spec(table)), f, indent=2)
    issues = [f"{i.code.value}: {i.column or ''} {i.message}" for i in (result.analysis.issues if result.analysis else [])]
    return {"table": table, "mode": if_exists, "keys": keys, "rows": result.counts.get("rows", 0), "counts": result.counts, "outliers_dropped": dropped, "issues": issues}
