"""Types, table descriptions, policies and reports. Plain data, no Spark jobs."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import types as T


class Family(str, Enum):
    INTEGER = "INTEGER"
    FLOAT = "FLOAT"
    DECIMAL = "DECIMAL"
    BOOLEAN = "BOOLEAN"
    DATETIME = "DATETIME"
    DATE = "DATE"
    TIME = "TIME"
    STRING = "STRING"
    TEXT = "TEXT"
    BINARY = "BINARY"
    JSON = "JSON"
    UNKNOWN = "UNKNOWN"


DIALECTS = ("oracle", "postgresql", "mssql", "mysql", "sqlite", "spark")

# The SQL type of each family in the order of DIALECTS; {n} length, {p} precision, {s} scale.
SQL_TYPES = {
    Family.INTEGER: ("NUMBER(10)", "INTEGER", "INT", "INT", "INTEGER", "BIGINT"),
    Family.FLOAT: ("BINARY_DOUBLE", "DOUBLE PRECISION", "FLOAT", "DOUBLE", "REAL", "DOUBLE"),
    Family.DECIMAL: ("NUMBER({p},{s})", "NUMERIC({p},{s})", "DECIMAL({p},{s})", "DECIMAL({p},{s})", "NUMERIC({p},{s})", "DECIMAL({p},{s})"),
    Family.BOOLEAN: ("CHAR(1)", "BOOLEAN", "BIT", "BOOLEAN", "INTEGER", "BOOLEAN"),
    Family.DATETIME: ("TIMESTAMP", "TIMESTAMP", "DATETIME2", "DATETIME", "TEXT", "TIMESTAMP_NTZ"),
    Family.DATE: ("DATE", "DATE", "DATE", "DATE", "TEXT", "DATE"),
    Family.TIME: ("TIMESTAMP", "TIME", "TIME", "TIME", "TEXT", "STRING"),
    Family.STRING: ("VARCHAR2({n})", "VARCHAR({n})", "VARCHAR({n})", "VARCHAR({n})", "TEXT", "STRING"),
    Family.TEXT: ("CLOB", "TEXT", "TEXT", "LONGTEXT", "TEXT", "STRING"),
    Family.BINARY: ("BLOB", "BYTEA", "VARBINARY(MAX)", "LONGBLOB", "BLOB", "BINARY"),
    Family.JSON: ("JSON", "JSONB", "NVARCHAR(MAX)", "JSON", "TEXT", "STRING"),
    Family.UNKNOWN: ("TEXT", "TEXT", "TEXT", "TEXT", "TEXT", "STRING"),
}
WITH_ZONE = {"oracle": "TIMESTAMP WITH TIME ZONE", "postgresql": "TIMESTAMP WITH TIME ZONE", "spark": "TIMESTAMP"}

# What each family may be loaded into besides itself.
COMPATIBLE = {
    Family.INTEGER: (Family.FLOAT, Family.DECIMAL),
    Family.FLOAT: (Family.DECIMAL,),
    Family.STRING: (Family.TEXT, Family.BOOLEAN, Family.DATETIME, Family.DATE, Family.TIME, Family.JSON),
    Family.BOOLEAN: (Family.INTEGER,),
    Family.TEXT: (Family.STRING,),
}


def sql_type(family: Family, dialect: str, length: int | None = None, precision: int | None = None, scale: int | None = None, zone: bool = False) -> str:
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}")
    if family is Family.DATETIME and zone and dialect in WITH_ZONE:
        return WITH_ZONE[dialect]
    return SQL_TYPES[family][DIALECTS.index(dialect)].format(n=length or 255, p=precision or 38, s=scale or 0)


def compatible(source: Family, target: Family) -> bool:
    return source == target or target in COMPATIBLE.get(source, ())


def family_of(dtype: T.DataType) -> Family:
    if isinstance(dtype, T.IntegralType):
        return Family.INTEGER
    if isinstance(dtype, T.DecimalType):
        return Family.DECIMAL
    if isinstance(dtype, T.FractionalType):
        return Family.FLOAT
    table = (
        (T.BooleanType, Family.BOOLEAN),
        (T.DateType, Family.DATE),
        ((T.TimestampType, T.TimestampNTZType), Family.DATETIME),
        (T.DayTimeIntervalType, Family.STRING),
        (T.StringType, Family.STRING),
        (T.BinaryType, Family.BINARY),
        ((T.StructType, T.ArrayType, T.MapType, T.VariantType), Family.JSON),
    )
    return next((f for kind, f in table if isinstance(dtype, kind)), Family.UNKNOWN)


def spark_type(family: Family, precision: int | None = None, scale: int | None = None, zone: bool = False) -> T.DataType:
    if family is Family.DECIMAL:
        return T.DecimalType(min(precision or 38, 38), scale or 0)
    if family is Family.DATETIME:
        return T.TimestampType() if zone else T.TimestampNTZType()
    return {Family.INTEGER: T.LongType(), Family.FLOAT: T.DoubleType(), Family.BOOLEAN: T.BooleanType(), Family.DATE: T.DateType(), Family.BINARY: T.BinaryType()}.get(family, T.StringType())


@dataclass
class ColumnSpec:
    name: str
    family: Family
    nullable: bool = True
    max_length: int | None = None
    precision: int | None = None
    scale: int | None = None
    zone: bool = False
    default: Any = None
    comment: str | None = None
    identity: bool = False

    def __post_init__(self) -> None:
        self.family = Family(self.family)

    @property
    def spark(self) -> T.DataType:
        return spark_type(self.family, self.precision, self.scale, self.zone)

    def sql(self, dialect: str) -> str:
        return sql_type(self.family, dialect, self.max_length, self.precision, self.scale, self.zone)


@dataclass
class ConstraintSpec:
    kind: str  # PRIMARY_KEY, FOREIGN_KEY, UNIQUE, CHECK
    columns: list[str]
    name: str = ""
    definition: str | None = None
    references: tuple[str, list[str]] | None = None


@dataclass
class IndexSpec:
    name: str
    columns: list[str]
    unique: bool = False


@dataclass
class TableSpec:
    name: str
    columns: dict[str, ColumnSpec]
    constraints: list[ConstraintSpec] = field(default_factory=list)
    indexes: list[IndexSpec] = field(default_factory=list)
    schema: str | None = None
    comment: str | None = None

    @property
    def primary_key(self) -> list[str]:
        return next((c.columns for c in self.constraints if c.kind == "PRIMARY_KEY"), [])

    @property
    def unique_sets(self) -> list[list[str]]:
        return [c.columns for c in self.constraints if c.kind in ("PRIMARY_KEY", "UNIQUE")] + [i.columns for i in self.indexes if i.unique]

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark, c.nullable, {"max_length": c.max_length} if c.max_length else None) for c in self.columns.values()])


def spec_of(schema: T.StructType, name: str, constraints: list[ConstraintSpec] | None = None) -> TableSpec:
    """Reflect a Spark schema; lengths come from field metadata."""
    columns = {}
    for f in schema:
        decimal = isinstance(f.dataType, T.DecimalType)
        columns[f.name] = ColumnSpec(f.name, family_of(f.dataType), f.nullable, (f.metadata or {}).get("max_length"), f.dataType.precision if decimal else None, f.dataType.scale if decimal else None, isinstance(f.dataType, T.TimestampType))
    return TableSpec(name, columns, list(constraints or []))


class Severity(str, Enum):
    ERROR = "error"
    WARNING = "warning"
    INFO = "info"


class IssueCode(str, Enum):
    EXTRA_DF_COLUMN = "EXTRA_DF_COLUMN"
    MISSING_DB_COLUMN = "MISSING_DB_COLUMN"
    COLUMN_TYPE_MISMATCH = "COLUMN_TYPE_MISMATCH"
    COLUMN_NULLABILITY_VIOLATION = "COLUMN_NULLABILITY_VIOLATION"
    COLUMN_LENGTH_OVERFLOW = "COLUMN_LENGTH_OVERFLOW"
    COLUMN_PRECISION_OVERFLOW = "COLUMN_PRECISION_OVERFLOW"
    OUTLIER_RATE_EXCEEDS_CAP = "OUTLIER_RATE_EXCEEDS_CAP"
    OUTLIERS_DETECTED = "OUTLIERS_DETECTED"
    CONSTRAINT_VIOLATION = "CONSTRAINT_VIOLATION"
    REFERENTIAL_INTEGRITY_VIOLATION = "REFERENTIAL_INTEGRITY_VIOLATION"
    DDL_EXECUTION_FAILED = "DDL_EXECUTION_FAILED"
    UNSAFE_DDL_OPERATION = "UNSAFE_DDL_OPERATION"
    MAPPING_CONFIDENCE_LOW = "MAPPING_CONFIDENCE_LOW"
    DATETIME_TZ_MISMATCH = "DATETIME_TZ_MISMATCH"
    CONVERSION_ERROR = "CONVERSION_ERROR"


@dataclass
class Issue:
    code: IssueCode
    severity: Severity
    message: str
    column: str | None = None


@dataclass
class ColumnPolicy:
    extra_columns: str = "drop"  # drop, keep, error
    string_overflow: str = "truncate"  # truncate, error
    numeric_overflow: str = "round"  # round, error
    time_zone: str = "assume_utc"  # assume_utc, assume_local, error
    fill_not_null: bool = False
    bool_to_int: bool = True


@dataclass
class OutlierPolicy:
    enabled: bool = False
    max_share: float = 0.05
    action: str = "drop"
    method: str = "iqr"
    rule: str = "any"
    iqr_factor: float = 1.5
    mad_factor: float = 3.0
    zscore_threshold: float = 3.0

    @property
    def factor(self) -> float:
        return {"iqr": self.iqr_factor, "mad": self.mad_factor, "zscore": self.zscore_threshold}[self.method]


@dataclass
class DdlPolicy:
    enabled: bool = False
    dry_run: bool = True
    allow_add_columns: bool = True
    allow_widen_columns: bool = True
    allow_alter_type: bool = False
    allow_add_indexes: bool = True
    lock_timeout_seconds: int = 30
    statement_timeout_seconds: int = 300
    batch_ddl: bool = True
    max_batch_size: int = 10


@dataclass
class ValidationPolicy:
    check_nullability: bool = True
    check_constraints: bool = True
    check_referential_integrity: bool = False
    confidence_threshold: float = 0.8


@dataclass
class Policies:
    columns: ColumnPolicy = field(default_factory=ColumnPolicy)
    outliers: OutlierPolicy = field(default_factory=OutlierPolicy)
    ddl: DdlPolicy = field(default_factory=DdlPolicy)
    validation: ValidationPolicy = field(default_factory=ValidationPolicy)
    strict: bool = False

    def validate(self) -> None:
        """The cap on corrected outliers may be lowered, not raised."""
        if not 0 <= self.outliers.max_share <= 0.05:
            raise ValueError("outliers.max_share may not exceed 0.05")
        if not 0 <= self.validation.confidence_threshold <= 1:
            raise ValueError("confidence_threshold lies between 0 and 1")
