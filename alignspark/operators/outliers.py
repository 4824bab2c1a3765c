"""Outlier detection by quartiles, MAD or z-score, and what to do with flagged rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import quantiles

FLAG = "_is_outlier"
METHODS = ("iqr", "mad", "zscore")


@dataclass
class OutlierSummary:
    total_rows: int
    outlier_rows: int
    method: str
    columns: dict[str, int]

    @property
    def percentage(self) -> float:
        return 100.0 * self.outlier_rows / self.total_rows if self.total_rows else 0.0

    @property
    def band(self) -> str:
        p = self.percentage
        return "none" if p == 0 else "low" if p < 1 else "moderate" if p < 5 else "high" if p < 10 else "very high"


def numeric_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and (columns is None or f.name in columns)]


def bounds(df: DataFrame, columns: list[str], method: str = "iqr", factor: float | None = None) -> dict[str, tuple[float, float]]:
    """Inclusive limits of each column from whole-column statistics; columns without spread for MAD and z-score are left out."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    factor = {"iqr": 1.5, "mad": 3.0, "zscore": 3.0}[method] if factor is None else factor
    if factor <= 0:
        raise ValueError("the factor must be positive")
    names = numeric_columns(df, columns)
    if not names:
        return {}
    col = {n: F.col(f"`{n}`").cast("double") for n in names}
    if method == "iqr":
        row = quantiles(df, col, [0.25, 0.75])
        return {n: (row[n][0] - factor * (row[n][1] - row[n][0]), row[n][1] + factor * (row[n][1] - row[n][0])) for n in names if row[n]}
    if method == "zscore":
        row = df.agg(*(F.struct(F.avg(col[n]).alias("m"), F.stddev_samp(col[n]).alias("s")).alias(n) for n in names)).first()
        return {n: (row[n]["m"] - factor * row[n]["s"], row[n]["m"] + factor * row[n]["s"]) for n in names if row[n]["s"]}
    med = {n: m[0] for n, m in quantiles(df, col, [0.5]).items() if m}
    known = list(med)
    if not known:
        return {}
    mad = {n: m[0] for n, m in quantiles(df, {n: F.abs(col[n] - F.lit(med[n])) for n in known}, [0.5]).items()}
    return {n: (med[n] - factor * mad[n] / 0.6745, med[n] + factor * mad[n] / 0.6745) for n in known if mad[n]}


def flag(df: DataFrame, columns: list[str], method: str = "iqr", factor: float | None = None, rule: str = "any", limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """The frame with a boolean column _is_outlier; rule any or all over the columns."""
    if rule not in ("any", "all"):
        raise ValueError(f"unknown rule {rule!r}")
    limits = bounds(df, columns, method, factor) if limits is None else limits
    masks = [outside(F.col(f"`{n}`"), lo, hi) for n, (lo, hi) in limits.items()]
    mask = reduce((lambda a, b: a | b) if rule == "any" else (lambda a, b: a & b), masks) if masks else F.lit(False)
    return df.withColumn(FLAG, mask)


def outside(c: Column, low: float, high: float) -> Column:
    return F.coalesce((c < F.lit(low)) | (c > F.lit(high)), F.lit(False))


def summarise(df: DataFrame, columns: list[str], method: str = "iqr", factor: float | None = None, rule: str = "any") -> OutlierSummary:
    limits = bounds(df, columns, method, factor)
    flagged = flag(df, columns, method, factor, rule, limits)
    row = flagged.agg(F.count("*").alias("n"), F.count_if(FLAG).alias("o"), *(F.count_if(outside(F.col(f"`{n}`"), lo, hi)).alias(f"c_{k}") for k, (n, (lo, hi)) in enumerate(limits.items()))).first()
    return OutlierSummary(row["n"], row["o"], method, {n: row[f"c_{k}"] for k, n in enumerate(limits)})


def treat(df: DataFrame, columns: list[str], action: str = "drop", method: str = "iqr", factor: float | None = None, rule: str = "any", per_column: bool = False) -> DataFrame:
    """drop: remove flagged rows; nullify or clip: every listed column of a flagged row (per_column: only the offending one)."""
    limits = bounds(df, columns, method, factor)
    flagged = flag(df, columns, method, factor, rule, limits)
    if action == "drop":
        return flagged.where(~F.col(FLAG)).drop(FLAG)
    if action not in ("nullify", "clip"):
        raise ValueError(f"unknown action {action!r}")
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if f.name not in columns or (f.name not in limits and (action == "clip" or per_column)):
            out.append(c)
            continue
        hit = outside(c, *limits[f.name]) if per_column else F.col(FLAG)
        new = F.lit(None) if action == "nullify" else F.greatest(F.least(c, F.lit(limits[f.name][1])), F.lit(limits[f.name][0]))
        out.append(F.when(hit, new).otherwise(c).cast("double" if action == "clip" else f.dataType).alias(f.name))
    return flagged.select(*out)


def within_cap(df: DataFrame, columns: list[str], cap: float = 0.05, **kw) -> tuple[bool, OutlierSummary]:
    """Whether the share of flagged rows is within the hard cap; above it no correction may be applied."""
    s = summarise(df, columns, **kw)
    return s.total_rows == 0 or s.outlier_rows / s.total_rows <= cap, s


def zero_outliers(df: DataFrame, column: str, method: str = "iqr", factor: float | None = None) -> DataFrame:
    """Outliers of one column, numeric text included, replaced by 0."""
    numeric = df.withColumn(column, F.col(f"`{column}`").try_cast("double"))
    limits = bounds(numeric, [column], method, factor)
    if column not in limits:
        return numeric
    return numeric.withColumn(column, F.when(outside(F.col(f"`{column}`"), *limits[column]), F.lit(0.0)).otherwise(F.col(f"`{column}`")))
