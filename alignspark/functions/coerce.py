"""Coercion of columns to a target specification, as one projection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.model import ColumnSpec, Family, Policies, TableSpec, family_of
from .casting import parse_boolean, parse_datetime


@dataclass
class CoercionReport:
    columns: list[dict] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    issues: list[str] = field(default_factory=list)


def to_string(c: Column, spec: ColumnSpec, p: Policies) -> Column:
    out = c.cast("string")
    if spec.max_length and p.columns.string_overflow == "truncate":
        out = F.substring(out, 1, spec.max_length)
    return out


def to_number(c: Column, dtype: T.DataType, spec: ColumnSpec, p: Policies) -> Column:
    """Integers round half to even; decimals round to scale and are clipped to the precision."""
    if isinstance(dtype, T.BooleanType):
        c = c.cast("int") if p.columns.bool_to_int else F.lit(None).cast("int")
    if spec.family is Family.FLOAT:
        return c.try_cast("double")
    if spec.family is Family.INTEGER:
        if isinstance(dtype, T.IntegralType):
            return c.cast("long")
        exact = c.try_cast("decimal(38,10)")
        return F.coalesce(F.bround(exact, 0).try_cast("long"), F.bround(c.try_cast("double"), 0).try_cast("long"))
    precision, scale = spec.precision or 38, spec.scale or 0
    number = F.bround(c.try_cast(f"decimal(38,{min(scale + 6, 18)})"), scale)
    if p.columns.numeric_overflow == "round":
        most = 10 ** (precision - scale) - 10**-scale if scale else 10**precision - 1
        limit = F.lit(f"{most:.{scale}f}" if scale else str(most)).cast(f"decimal(38,{scale})")
        wide = number.cast(f"decimal(38,{scale})")
        number = F.greatest(F.least(wide, limit), -limit)
    return number.try_cast(f"decimal({min(precision, 38)},{scale})")


def to_datetime(c: Column, dtype: T.DataType, spec: ColumnSpec, p: Policies) -> Column:
    """Text by the known formats, numbers as epoch seconds; zones dropped in UTC unless the target keeps them."""
    if isinstance(dtype, T.StringType):
        out = parse_datetime(c)
    elif isinstance(dtype, T.NumericType):
        out = F.timestamp_seconds(c)
    else:
        out = c
    if spec.zone:
        return out.cast("timestamp")
    zoned = isinstance(dtype, T.TimestampType)
    if zoned and p.columns.time_zone == "error":
        raise ValueError(f"{spec.name}: a time zone would be lost")
    if zoned and p.columns.time_zone == "assume_utc":
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), out.cast("timestamp_ntz"))
    return out.cast("timestamp_ntz")


def to_json(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    quoted = F.regexp_extract(F.to_json(F.struct(c.cast("string").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(F.try_parse_json(c.cast("string")).isNotNull(), c.cast("string")).when(c.isNotNull(), quoted)


def to_binary(c: Column, dtype: T.DataType, spec: ColumnSpec, p: Policies) -> Column:
    out = c if isinstance(dtype, T.BinaryType) else F.encode(c.cast("string"), "UTF-8")
    return F.substring(out, 1, spec.max_length) if spec.max_length and p.columns.string_overflow == "truncate" else out


_FILL = {Family.STRING: "", Family.TEXT: "", Family.INTEGER: 0, Family.FLOAT: 0.0, Family.DECIMAL: 0, Family.BOOLEAN: False, Family.JSON: "{}", Family.BINARY: b""}


def coerce(c: Column, dtype: T.DataType, spec: ColumnSpec, policies: Policies | None = None) -> Column:
    """One column to its target; what does not convert becomes NULL and stays NULL unless filling is asked for."""
    p = policies or Policies()
    if spec.family is Family.STRING:
        out = to_string(c, spec, p)
    elif spec.family in (Family.INTEGER, Family.FLOAT, Family.DECIMAL):
        out = to_number(c, dtype, spec, p)
    elif spec.family is Family.DATETIME:
        out = to_datetime(c, dtype, spec, p)
    elif spec.family is Family.DATE:
        out = (parse_datetime(c) if isinstance(dtype, T.StringType) else c).cast("date")
    elif spec.family is Family.BOOLEAN:
        out = parse_boolean(c) if isinstance(dtype, T.StringType) else c.cast("boolean")
    elif spec.family is Family.JSON:
        out = to_json(c, dtype)
    elif spec.family is Family.BINARY:
        out = to_binary(c, dtype, spec, p)
    else:
        out = c.cast("string") if spec.family in (Family.TEXT, Family.TIME) else c
    if p.columns.fill_not_null and not spec.nullable:
        out = F.coalesce(out, F.current_timestamp().cast(spec.spark) if spec.family is Family.DATETIME else F.lit(_FILL.get(spec.family)).cast(spec.spark)) if spec.family is Family.DATETIME or spec.family in _FILL else out
    return out


def coerce_frame(df: DataFrame, spec: TableSpec, policies: Policies | None = None, rename: dict[str, str] | None = None) -> tuple[DataFrame, CoercionReport]:
    """The frame in the target's types and names; extra columns by policy, missing ones are left to the writer."""
    p = policies or Policies()
    targets = {c.lower(): c for c in spec.columns}
    rename = {k: v for k, v in (rename or {}).items()}
    report, out = CoercionReport(), []
    for f in df.schema:
        target = rename.get(f.name) or targets.get(f.name.lower())
        c = F.col(f"`{f.name}`")
        if target is None:
            if p.columns.extra_columns == "error":
                raise ValueError(f"column {f.name} is not in table {spec.name}")
            if p.columns.extra_columns == "drop":
                report.dropped.append(f.name)
            else:
                out.append(c)
            continue
        s = spec.columns[target]
        report.columns.append({"column": target, "before": f.dataType.simpleString(), "after": s.spark.simpleString(), "same_family": family_of(f.dataType) == s.family})
        out.append(coerce(c, f.dataType, s, p).alias(target))
    return df.select(*out), report


def coercion_counts(before: DataFrame, after: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Nulls and distinct values of each column before and after, one row a column."""
    spark = before.sparkSession
    rows = []
    b = before.agg(*(x for k, s in enumerate(columns) for x in (F.count_if(F.col(f"`{s}`").isNull()).alias(f"n{k}"), F.count_distinct(F.col(f"`{s}`")).alias(f"d{k}")))).first()
    a = after.agg(*(x for k, t in enumerate(columns.values()) for x in (F.count_if(F.col(f"`{t}`").isNull()).alias(f"n{k}"), F.count_distinct(F.col(f"`{t}`")).alias(f"d{k}")))).first()
    for k, t in enumerate(columns.values()):
        rows.append((t, b[f"n{k}"], a[f"n{k}"], b[f"d{k}"], a[f"d{k}"]))
    return spark.createDataFrame(rows, "column string, nulls_before long, nulls_after long, distinct_before long, distinct_after long")
