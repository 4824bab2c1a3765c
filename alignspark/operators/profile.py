"""Profiles, key inference, samples, slices and comparisons."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casting import parse_datetime
from ..functions.text import escape_join
from .dml import ORDER
from .quantiles import quantiles

#: count_distinct expands the rows once for each column, so columns go in batches.
BATCH = 8


def profile(df: DataFrame) -> DataFrame:
    """One row for each column: nulls, distinct values, and what follows from them."""
    spark = df.sparkSession
    rows = []
    fields = list(df.schema)
    for at in range(0, len(fields), BATCH):
        part = fields[at : at + BATCH]
        aggs = [F.count("*").alias("n")]
        for k, f in enumerate(part):
            c = F.col(f"`{f.name}`")
            aggs += [F.count(c).alias(f"c{k}"), F.count_distinct(c).alias(f"d{k}")]
            aggs.append(F.count_if(c.isNotNull() & parse_datetime(c).isNull()).alias(f"t{k}") if isinstance(f.dataType, T.StringType) else F.lit(1).alias(f"t{k}"))
        r = df.agg(*aggs).first()
        for k, f in enumerate(part):
            n, filled, distinct = r["n"], r[f"c{k}"], r[f"d{k}"]
            is_time = isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) or (isinstance(f.dataType, T.StringType) and filled > 0 and r[f"t{k}"] == 0)
            rows.append((f.name, f.dataType.simpleString(), n - filled, filled, round(100.0 * (n - filled) / n, 2) if n else 0.0, distinct, bool(filled) and distinct / filled <= 0.1, bool(filled) and distinct == filled, is_time))
    return spark.createDataFrame(rows, "column string, dtype string, null_count long, non_null long, null_pct double, distinct_count long, is_categorical boolean, all_unique boolean, is_datetime boolean")


@dataclass
class KeyGuess:
    columns: list[str]
    unique: bool
    rule: str
    tested: list[list[str]] = field(default_factory=list)

    @property
    def name(self) -> str:
        return self.columns[0] if len(self.columns) == 1 else "_".join(self.columns) + "_pk"


def infer_key(df: DataFrame, info: DataFrame | None = None, max_size: int = 5) -> KeyGuess:
    """First all-unique column; else the most distinct one, a date column, and more until rows without nulls are unique."""
    stats = [r.asDict() for r in (info if info is not None else profile(df)).collect()]  # one row a column
    if not stats or not any(s["non_null"] for s in stats):
        raise ValueError("an empty frame has no key")
    for s in stats:
        if s["all_unique"]:
            return KeyGuess([s["column"]], True, "unique column")
    ratio = {s["column"]: s["distinct_count"] / s["non_null"] if s["non_null"] else 0.0 for s in stats}
    ranked = sorted(ratio, key=lambda c: (-ratio[c], c))
    chosen = [ranked[0] if ratio[ranked[0]] >= 0.8 else df.columns[0]]
    dates = [s["column"] for s in stats if s["is_datetime"] and s["column"] not in chosen]
    rest = dates[:1] + [c for c in ranked if c not in chosen and c not in dates[:1]]
    tested = []
    while True:
        tested.append(list(chosen))
        if _unique(df, chosen):
            return KeyGuess(chosen, True, "composite", tested)
        if not rest or len(chosen) >= max_size:
            return KeyGuess(chosen, False, "fallback", tested)
        chosen = chosen + [rest.pop(0)]


def _unique(df: DataFrame, columns: list[str]) -> bool:
    return df.select(*columns).na.drop("any").groupBy(*columns).count().where("count > 1").isEmpty()


def minimal_keys(df: DataFrame, candidates: list[str], size: int = 2) -> list[list[str]]:
    """All sets of at most `size` of the candidates that are unique and hold no smaller unique set."""
    found: list[list[str]] = []
    for k in range(1, size + 1):
        for cols in combinations(candidates, k):
            if not any(set(f) <= set(cols) for f in found) and _unique(df, list(cols)):
                found.append(list(cols))
    return found


def add_key(df: DataFrame, columns: list[str], name: str = "pk") -> DataFrame:
    """The key as one column: the value itself, or the escaped values joined."""
    return df.withColumn(name, F.col(f"`{columns[0]}`") if len(columns) == 1 else escape_join([F.col(f"`{c}`") for c in columns]))


def duplicate_count(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row, `duplicates`: rows after the first of each key, NULLs equal to each other."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns))


def orphan_count(child: DataFrame, parent: DataFrame, keys: list[str], parent_keys: list[str]) -> DataFrame:
    """One row, `orphans`: child rows whose non-null keys are not in the parent."""
    p = parent.select(*(F.col(f"`{b}`").alias(a) for a, b in zip(keys, parent_keys, strict=True))).distinct()
    return child.na.drop("any", subset=keys).join(p, keys, "left_anti").agg(F.count("*").cast("long").alias("orphans"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles and max, one row for each column."""
    double = {c: F.col(f"`{c}`").cast("double") for c in columns}
    row = df.agg(*(F.struct(F.count(x), F.avg(x), F.stddev_samp(x), F.min(x), F.max(x)).alias(f"s{k}") for k, x in enumerate(double.values()))).first()
    middle = quantiles(df, double, [0.25, 0.5, 0.75])
    rows = [(c, *row[f"s{k}"][:4], *(middle[c] or [None] * 3), row[f"s{k}"][4]) for k, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "column string, count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double")


def string_lengths(df: DataFrame, columns: list[str]) -> DataFrame:
    wide = df.agg(*(F.struct(F.lit(c).alias("column"), F.max(F.char_length(c)).alias("max_length"), F.min(F.char_length(c)).alias("min_length"), F.avg(F.char_length(c)).alias("avg_length")).alias(f"s{k}") for k, c in enumerate(columns)))
    return wide.select(F.inline(F.array(*(f"s{k}" for k in range(len(columns))))))


def head_tail(df: DataFrame, order: list[str], percent: float) -> DataFrame:
    """max(1, n * percent / 200) rows from each end of the order, without overlap.

    Each end is an ordered limit, which Spark takes by partition, so nothing is
    numbered over a single partition.
    """
    n = df.count()
    k = max(1, int(n * percent / 200)) if n else 0
    head = df.orderBy(*order).limit(k)
    tail = df.orderBy(*(F.desc(c) for c in order)).limit(min(k, n - k) if n > k else 0)
    return head.unionByName(tail)


def harness_slices(df: DataFrame, n: int) -> DataFrame:
    """Rows with their parts in the verification cycle, by position in _ord (dense from 0)."""
    if n < 5:
        raise ValueError("the cycle needs at least 5 rows")
    o, a, b, c = F.col(ORDER), int(n * 0.3), int(n * 0.6), int(n * 0.8)
    return df.select("*", (o < b).alias("in_insert"), ((o >= a) & (o < c)).alias("in_upsert"), ((o >= a) & (o < b)).alias("is_mutated"), o.isin(0, int(n * 0.4), int(n * 0.7)).alias("in_update"))


def mutate(c: Column, dtype: T.DataType, mark: str = "_upd") -> Column:
    """A changed value of the same type: not, plus one, plus a day, or marked text."""
    if isinstance(dtype, T.BooleanType):
        return ~c
    if isinstance(dtype, T.NumericType):
        return (c + F.lit(1)).cast(dtype)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c + F.expr("INTERVAL 1 DAY")
    if isinstance(dtype, T.DateType):
        return F.date_add(c, 1)
    return F.concat(c.cast("string"), F.lit(mark))


def mutate_frame(df: DataFrame, keys: list[str], mark: str = "_upd") -> DataFrame:
    return df.select(*(F.col(f"`{f.name}`") if f.name in keys or f.name == ORDER else mutate(F.col(f"`{f.name}`"), f.dataType, mark).alias(f.name) for f in df.schema))


def near(a: Column, b: Column, dtype: T.DataType, rtol: float = 1e-5, atol: float = 1e-8, seconds: int = 5) -> Column:
    """Equal within tolerance; NULL equals NULL."""
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        close = F.abs(a.cast("double") - b.cast("double")) <= F.lit(atol) + F.lit(rtol) * F.abs(b.cast("double"))
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        close = F.abs(F.unix_timestamp(a.cast("timestamp")) - F.unix_timestamp(b.cast("timestamp"))) <= seconds
    else:
        close = a == b
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(close)


def compare(actual: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows only in one frame, and rows whose values differ beyond tolerance."""
    a = actual.select(*(F.col(f"`{c}`").alias(f"a_{c}") for c in expected.columns), F.lit(True).alias("_a"))
    e = expected.select(*(F.col(f"`{c}`").alias(f"e_{c}") for c in expected.columns), F.lit(True).alias("_e"))
    on = reduce(lambda x, y: x & y, (a[f"a_{k}"].eqNullSafe(e[f"e_{k}"]) for k in keys))
    same = reduce(lambda x, y: x & y, (near(F.col(f"a_{f.name}"), F.col(f"e_{f.name}"), f.dataType) for f in expected.schema if f.name not in keys), F.lit(True))
    both = a.join(e, on, "full_outer")
    return both.agg(F.count_if(F.col("_a").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("unexpected"), F.count_if(F.col("_a") & F.col("_e") & ~same).alias("different"), F.count_if(F.col("_a") & F.col("_e") & same).alias("equal"))


def coalesce_update(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Index-aligned update: values of the source that are not NULL overwrite, rows only in the source are left out."""
    names = [c for c in source.columns if c not in keys]
    src = source.select(*keys, *(F.col(f"`{c}`").alias(f"_s_{c}") for c in names))
    return target.join(src, keys, "left").select(*(F.coalesce(F.col(f"`_s_{c}`"), F.col(f"`{c}`")).alias(c) if c in names else F.col(f"`{c}`") for c in target.columns))
