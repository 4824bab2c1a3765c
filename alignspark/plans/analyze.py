"""Comparing a frame with a table: issues, an alignment plan, and the schema changes it would need."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import outliers
from ..operators.profile import duplicate_count
from . import mapping
from .model import Family, Issue, IssueCode, Policies, Severity, TableSpec, compatible, family_of


@dataclass
class FrameStats:
    rows: int
    nulls: dict[str, int]
    max_length: dict[str, int | None]
    max_abs: dict[str, float | None]


def frame_stats(df: DataFrame) -> FrameStats:
    """Rows, nulls, longest text and largest number of every column, in one aggregation."""
    aggs = [F.count("*").alias("n")]
    for k, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count_if(c.isNull()).alias(f"n{k}"))
        if isinstance(f.dataType, T.StringType):
            aggs.append(F.max(F.char_length(c)).alias(f"l{k}"))
        if isinstance(f.dataType, T.NumericType):
            aggs.append(F.max(F.abs(c.cast("double"))).alias(f"m{k}"))
    row = df.agg(*aggs).first().asDict()
    return FrameStats(row["n"], *({f.name: row.get(f"{p}{k}") for k, f in enumerate(df.schema)} for p in "nlm"))


@dataclass
class Analysis:
    spec: TableSpec
    mappings: list[mapping.Mapping]
    extra: list[str]
    missing: list[str]
    issues: list[Issue] = field(default_factory=list)
    outliers: outliers.OutlierSummary | None = None
    stats: FrameStats | None = None

    @property
    def has_errors(self) -> bool:
        return any(i.severity is Severity.ERROR for i in self.issues)

    @property
    def confidence(self) -> float:
        return sum(m.confidence for m in self.mappings) / len(self.mappings) if self.mappings else 0.0

    def by_severity(self, severity: Severity) -> list[Issue]:
        return [i for i in self.issues if i.severity is severity]


def type_issues(df: DataFrame, spec: TableSpec, found: list[mapping.Mapping], stats: FrameStats, policies: Policies) -> list[Issue]:
    fields = {f.name: f for f in df.schema}
    out = []
    for m in found:
        f, s = fields[m.source], spec.columns[m.target]
        own = family_of(f.dataType)
        if not compatible(own, s.family):
            out.append(Issue(IssueCode.COLUMN_TYPE_MISMATCH, Severity.ERROR if policies.strict else Severity.WARNING, f"{own.value} into {s.family.value}", m.target))
        if policies.validation.check_nullability and not s.nullable and stats.nulls[m.source]:
            fill = policies.columns.fill_not_null or s.default is not None
            out.append(Issue(IssueCode.COLUMN_NULLABILITY_VIOLATION, Severity.WARNING if fill else Severity.ERROR, f"{stats.nulls[m.source]} nulls", m.target))
        if s.family is Family.STRING and s.max_length and (stats.max_length[m.source] or 0) > s.max_length:
            cut = policies.columns.string_overflow == "truncate"
            out.append(Issue(IssueCode.COLUMN_LENGTH_OVERFLOW, Severity.WARNING if cut else Severity.ERROR, f"{stats.max_length[m.source]} characters, {s.max_length} fit", m.target))
        if s.family is Family.DECIMAL and s.precision and (stats.max_abs[m.source] or 0) >= 10 ** (s.precision - (s.scale or 0)):
            cut = policies.columns.numeric_overflow == "round"
            out.append(Issue(IssueCode.COLUMN_PRECISION_OVERFLOW, Severity.WARNING if cut else Severity.ERROR, f"{stats.max_abs[m.source]} exceeds precision {s.precision}", m.target))
        if s.family is Family.DATETIME and isinstance(f.dataType, T.TimestampType) and not s.zone:
            out.append(Issue(IssueCode.DATETIME_TZ_MISMATCH, Severity.INFO, "the time zone is dropped", m.target))
    return out


def constraint_issues(df: DataFrame, spec: TableSpec, found: list[mapping.Mapping], stats: FrameStats) -> list[Issue]:
    """Nulls and duplicates in key columns; a foreign key's nulls."""
    source = {m.target: m.source for m in found}
    out = []
    for c in spec.constraints:
        if not all(x in source for x in c.columns):
            continue
        cols = [source[x] for x in c.columns]
        nulls = sum(stats.nulls[x] for x in cols)
        if c.kind == "PRIMARY_KEY" and nulls:
            out.append(Issue(IssueCode.CONSTRAINT_VIOLATION, Severity.ERROR, f"{nulls} nulls in the primary key", ",".join(c.columns)))
        if c.kind in ("PRIMARY_KEY", "UNIQUE"):
            n = duplicate_count(df, cols).first()[0]
            if n:
                out.append(Issue(IssueCode.CONSTRAINT_VIOLATION, Severity.WARNING, f"{n} duplicate keys", ",".join(c.columns)))
        if c.kind == "FOREIGN_KEY" and nulls:
            out.append(Issue(IssueCode.REFERENTIAL_INTEGRITY_VIOLATION, Severity.WARNING, f"{nulls} nulls in a foreign key", ",".join(c.columns)))
    return out


def analyze(df: DataFrame, spec: TableSpec, policies: Policies | None = None) -> Analysis:
    p = policies or Policies()
    found, extra, missing = mapping.match_columns(df.columns, list(spec.columns), p.validation.confidence_threshold)
    stats = frame_stats(df)
    out = Analysis(spec, found, extra, missing, stats=stats)
    error = p.columns.extra_columns == "error"
    out.issues += [Issue(IssueCode.EXTRA_DF_COLUMN, Severity.ERROR if error else Severity.INFO, "not in the table", c) for c in extra]
    for c in missing:
        s = spec.columns[c]
        needed = not s.nullable and s.default is None and not s.identity
        out.issues.append(Issue(IssueCode.MISSING_DB_COLUMN, Severity.ERROR if needed else Severity.WARNING, "not in the frame", c))
    out.issues += [Issue(IssueCode.MAPPING_CONFIDENCE_LOW, Severity.INFO, f"{m.source}: {m.confidence}", m.target) for m in found if m.confidence < 0.95]
    out.issues += type_issues(df, spec, found, stats, p)
    if p.validation.check_constraints:
        out.issues += constraint_issues(df, spec, found, stats)
    if p.outliers.enabled:
        names = outliers.numeric_columns(df, [m.source for m in found])
        fits, out.outliers = outliers.within_cap(df, names, p.outliers.max_share, method=p.outliers.method, factor=p.outliers.factor, rule=p.outliers.rule)
        if not fits:
            out.issues.append(Issue(IssueCode.OUTLIER_RATE_EXCEEDS_CAP, Severity.ERROR, f"{out.outliers.percentage:.2f} % flagged"))
        elif out.outliers.outlier_rows:
            out.issues.append(Issue(IssueCode.OUTLIERS_DETECTED, Severity.INFO, f"{out.outliers.outlier_rows} rows ({out.outliers.band})"))
    return out


@dataclass
class Change:
    kind: str  # ADD_COLUMN, WIDEN_COLUMN, ALTER_TYPE, ADD_INDEX, DROP_COLUMN, DROP_INDEX
    table: str
    column: str | None
    before: str | None
    after: str | None
    safe: bool

    @property
    def seconds(self) -> int:
        """Planning estimate only."""
        return 5 if self.safe else 30


def plan_changes(df: DataFrame, a: Analysis, policies: Policies | None = None, dialect: str = "spark") -> list[Change]:
    """Columns to add, to widen (a quarter longer, two digits more) or to retype, and indexes on foreign keys."""
    d, spec = (policies or Policies()).ddl, a.spec
    fields = {f.name: f for f in df.schema}
    out = []
    if d.allow_add_columns:
        from .model import ColumnSpec

        out += [Change("ADD_COLUMN", spec.name, c, None, ColumnSpec(c, family_of(fields[c].dataType)).sql(dialect), True) for c in a.extra]
    for m in a.mappings:
        s, own = spec.columns[m.target], family_of(fields[m.source].dataType)
        longest, most = a.stats.max_length[m.source] or 0, a.stats.max_abs[m.source] or 0
        if d.allow_widen_columns and s.family is Family.STRING and s.max_length and longest > s.max_length:
            out.append(Change("WIDEN_COLUMN", spec.name, m.target, str(s.max_length), str(int(longest * 1.25)), True))
        elif d.allow_widen_columns and s.family is Family.DECIMAL and s.precision and most >= 10 ** (s.precision - (s.scale or 0)):
            digits = len(str(int(most))) + (s.scale or 0) + 2
            out.append(Change("WIDEN_COLUMN", spec.name, m.target, f"{s.precision},{s.scale or 0}", f"{min(digits, 38)},{s.scale or 0}", True))
        elif d.allow_alter_type and not compatible(own, s.family):
            out.append(Change("ALTER_TYPE", spec.name, m.target, s.family.value, own.value, False))
    if d.allow_add_indexes:
        indexed = {tuple(i.columns) for i in spec.indexes}
        out += [Change("ADD_INDEX", spec.name, ",".join(c.columns), None, None, True) for c in spec.constraints if c.kind == "FOREIGN_KEY" and tuple(c.columns) not in indexed]
    return out


def check_plan(changes: list[Change], policies: Policies | None = None, supported: dict[str, bool] | None = None) -> list[Issue]:
    d = (policies or Policies()).ddl
    allowed = {"ADD_COLUMN": d.allow_add_columns, "WIDEN_COLUMN": d.allow_widen_columns, "ALTER_TYPE": d.allow_alter_type, "ADD_INDEX": d.allow_add_indexes}
    out = []
    for c in changes:
        if not c.safe and not allowed.get(c.kind, False):
            out.append(Issue(IssueCode.UNSAFE_DDL_OPERATION, Severity.ERROR, c.kind, c.column))
        if supported is not None and not supported.get(c.kind, True):
            out.append(Issue(IssueCode.DDL_EXECUTION_FAILED, Severity.ERROR, f"{c.kind} is not supported", c.column))
    return out


def batches(changes: list[Change], policies: Policies | None = None) -> list[list[Change]]:
    """Safe changes together, unsafe ones one by one."""
    d = (policies or Policies()).ddl
    size = d.max_batch_size if d.batch_ddl else 1
    safe = [c for c in changes if c.safe]
    return [safe[i : i + size] for i in range(0, len(safe), size)] + [[c] for c in changes if not c.safe]


def summarise_plan(changes: list[Change]) -> dict:
    unsafe = sum(not c.safe for c in changes)
    return {"changes": len(changes), "unsafe": unsafe, "seconds": sum(c.seconds for c in changes), "risk": "high" if unsafe > 2 else "medium" if unsafe else "low"}
