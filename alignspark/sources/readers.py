"""Reading files and records into frames."""

from __future__ import annotations

import re
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.text import nan_to_null

#: Texts that stand for a missing value in CSV files.
NA_TOKENS = ("", "NA", "N/A", "NaN", "nan", "NULL", "null", "None", "n/a", "#N/A", "<NA>")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, nulls: tuple[str, ...] = NA_TOKENS, **options: Any) -> DataFrame:
    """Header, quoted line breaks, byte-order mark, and the usual tokens for missing values.

    Types are inferred by Spark unless a schema is given; give one for large
    files, since inference reads them twice.  Missing-value tokens are nulled
    before types are inferred, so a column of numbers and NA stays numeric.
    """
    from pyspark.sql import functions as F

    reader = spark.read.options(header=True, multiLine=True, escape='"', encoding="UTF-8", **options)
    if schema is not None:
        return reader.schema(schema).csv(path)
    raw = reader.option("inferSchema", False).csv(path)
    raw = raw.toDF(*(c.lstrip("\ufeff") for c in raw.columns))
    cleaned = raw.select(*(F.when(~F.col(f"`{c}`").isin(*nulls), F.col(f"`{c}`")).alias(c) for c in raw.columns))
    return _infer(cleaned)


def _infer(df: DataFrame) -> DataFrame:
    """Long, double or boolean where every value converts, in one aggregation."""
    from pyspark.sql import functions as F

    aggs = []
    for k, c in enumerate(df.columns):
        x = F.col(f"`{c}`")
        fits = {"n": x, "l": F.when(x.rlike(r"^[+-]?\d+$"), x.try_cast("long")), "d": F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), x.try_cast("double")), "b": F.when(F.lower(x).isin("true", "false"), True)}
        aggs += [F.count(v).alias(f"{p}{k}") for p, v in fits.items()]
    if not aggs:
        return df
    row = df.agg(*aggs).first()
    out = []
    for k, c in enumerate(df.columns):
        n = row[f"n{k}"]
        kind = next((t for p, t in (("l", "long"), ("d", "double"), ("b", "boolean")) if n and row[f"{p}{k}"] == n), "string")
        out.append(F.col(f"`{c}`").cast(kind).alias(c))
    return df.select(*out)


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """Workbooks have no Spark source: read on the driver, if openpyxl is there."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise ValueError("reading workbooks needs openpyxl; save the sheet as CSV") from e
    import pandas as pd

    return nan_to_null(spark.createDataFrame(pd.read_excel(path, sheet_name=sheet)))


def read(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """By suffix: csv, parquet, json, orc, xls and xlsx; a web address without one of these is taken for CSV."""
    suffix = PurePosixPath(re.sub(r"[?#].*$", "", path)).suffix.lower()
    if suffix == ".parquet":
        return spark.read.options(**options).parquet(path)
    if suffix == ".json":
        return spark.read.options(multiLine=True, **options).json(path)
    if suffix == ".orc":
        return spark.read.options(**options).orc(path)
    if suffix in (".xls", ".xlsx"):
        return read_excel(spark, path, **options)
    if suffix == ".csv" or re.match(r"https?://", path):
        return read_csv(spark, path, **options)
    raise ValueError(f"unsupported file type {suffix!r}: {path}")


def from_records(spark: SparkSession, records: dict | list[dict], schema: T.StructType | str | None = None) -> DataFrame:
    """A frame from one dict of columns or a list of row dicts; missing keys are NULL."""
    if isinstance(records, dict):
        lists = {k: v if isinstance(v, (list, tuple)) else [v] for k, v in records.items()}
        n = max(map(len, lists.values()), default=0)
        records = [{k: v[i] for k, v in lists.items()} for i in range(n)]
    if schema is None and records:
        names = list(dict.fromkeys(k for r in records for k in r))
        records = [{k: r.get(k) for k in names} for r in records]
    if not records:
        return spark.createDataFrame([], schema or T.StructType([]))
    return nan_to_null(spark.createDataFrame(records, schema))


def read_any(spark: SparkSession, source: Any, **options: Any) -> DataFrame:
    """A frame as it is, records, or a path."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, (dict, list)):
        return from_records(spark, source)
    return read(spark, str(source), **options)


def execute_sql(spark: SparkSession, sql: str, params: dict | None = None) -> DataFrame:
    """Spark SQL with named parameters."""
    return spark.sql(sql, args=params or {})
