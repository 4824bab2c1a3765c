"""Recording what is run, retries, diagnosis of errors, freshness of tables."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Causes by what an error names: Spark's error conditions, the SQLSTATE that Spark and databases give, and words of messages without either.
CAUSES = (
    ("NOT NULL violation", "Fill or drop the rows with NULL, or allow NULL in the column.", ("NOT_NULL_CONSTRAINT_VIOLATION", "NULL_VALUE_NOT_ALLOWED", "DELTA_NOT_NULL"), ("23502",), ("null value", "is not nullable", "keeps no null")),
    ("Duplicate key violation", "Deduplicate the source, or upsert instead of inserting.", ("DUPLICATE_KEY", "MERGE_CARDINALITY_VIOLATION", "DUPLICATED_MAP_KEY"), ("23505", "23K01", "23001"), ("duplicate key", "duplicate entry", "repeated keys", "is no declared key")),
    ("Foreign key violation", "Load the parent rows first.", (), ("23503", "23506"), ("foreign key", "parent row", "orphan")),
    ("Data truncation", "Widen the column or trim the source.", ("EXCEED_LIMIT_LENGTH", "EXCEEDS_CHAR_VARCHAR_LIMIT"), ("22001",), ("too long for", "longer than the column", "would be cut")),
    ("Numeric overflow", "Use a wider numeric type.", ("ARITHMETIC_OVERFLOW", "NUMERIC_VALUE_OUT_OF_RANGE", "CAST_OVERFLOW", "BINARY_ARITHMETIC_OVERFLOW"), ("22003",), ("overflow",)),
    ("Type casting failure", "Clean the source values.", ("CAST_INVALID_INPUT", "CANNOT_PARSE_TIMESTAMP", "DATATYPE_MISMATCH", "CONVERSION_INVALID_INPUT"), ("22018", "22007", "22P02", "42K09"), ("malformed", "cannot be cast")),
    ("Column mismatch", "Check the column names.", ("UNRESOLVED_COLUMN", "COLUMN_NOT_FOUND", "AMBIGUOUS_REFERENCE", "FIELD_NOT_FOUND"), ("42703", "42702", "42704"), ("unknown column",)),
    ("Table not found", "Create the table first.", ("TABLE_OR_VIEW_NOT_FOUND", "PATH_NOT_FOUND"), ("42P01", "42K03"), ("does not exist",)),
    ("Connection lost", "Try again; look at the database and the network.", (), ("08001", "08003", "08006"), ("connection refused", "connection reset", "timed out")),
)


def diagnose(error: str) -> tuple[str, str]:
    """(cause, advice) of an error text: by its condition, else its SQLSTATE, else its words."""
    low = error.lower()
    for named in (
        lambda conditions, _, __: any(re.search(rf"\b{c}\b", error) for c in conditions),
        lambda _, states, __: any(re.search(rf"SQLSTATE\W*{s}\b", error, re.I) for s in states),
        lambda _, __, words: any(w in low for w in words),
    ):
        for cause, advice, *how in CAUSES:
            if named(*how):
                return cause, advice
    return "Unknown", "Look at the rows kept back and at the error."


def retry(work: Callable[[], Any], attempts: int = 3, first_wait: float = 0.5, most_wait: float = 30.0) -> Any:
    """Run with exponential back-off; the last error is raised."""
    for k in range(attempts):
        try:
            return work()
        except Exception:
            if k + 1 == attempts:
                raise
            time.sleep(min(most_wait, first_wait * 2**k))
    raise ValueError("at least one attempt is needed")


def sniff(sql: str) -> tuple[str, str | None]:
    """Verb and table of a statement."""
    words = sql.split()
    m = re.search(r"\b(?:INTO|FROM|UPDATE|TABLE(?:\s+IF\s+NOT\s+EXISTS)?|JOIN)\s+([`\"\[]?[\w.]+)", sql, re.I)
    return (words[0].upper() if words else ""), m[1].strip('`"[').upper() if m else None


@dataclass
class Capture:
    """Statements and plans recorded while active."""

    records: list[dict] = field(default_factory=list)

    def add(self, op: str, table: str, df: DataFrame | None = None, sql: str | None = None) -> None:
        plan = df._jdf.queryExecution().optimizedPlan().toString() if df is not None else None
        self.records.append({"op": op.upper(), "table": table, "sql": sql, "plan": plan, "at": time.time()})

    def add_sql(self, sql: str) -> None:
        op, table = sniff(sql)
        self.add(op, table or "", sql=sql)

    def by_op(self, op: str) -> list[dict]:
        return [r for r in self.records if r["op"] == op.upper()]

    def clear(self) -> None:
        self.records.clear()

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            for r in self.records:
                f.write(f"-- {r['op']} {r['table']}\n{r['sql'] or r['plan'] or ''}\n\n")


_active: list[Capture] = []


@contextmanager
def capture():
    log = Capture()
    _active.append(log)
    try:
        yield log
    finally:
        _active.remove(log)


def note(op: str, table: str, df: DataFrame | None = None, sql: str | None = None) -> None:
    for log in _active:
        log.add(op, table, df, sql)


def time_columns(catalog: DataFrame, types: tuple[str, ...] = ("timestamp", "timestamp_ntz", "date")) -> DataFrame:
    """Columns of (table_name, column_name, data_type) that may say when a row came."""
    return catalog.where(F.col("data_type").isin(*types) | F.upper("column_name").rlike("TIME|DATE"))


def active_time_columns(tables: DataFrame, catalog: DataFrame, since: Any) -> DataFrame:
    """Recently changed tables (table_name, modified_at) joined with their time columns."""
    return tables.where(F.col("modified_at") >= F.lit(since)).join(time_columns(catalog), "table_name")


def freshness(frames: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """table_name and its latest value of the named time column, one row a table, in one job."""
    rows = [df.agg(F.lit(name).alias("table_name"), F.max(F.col(f"`{c}`").cast("timestamp_ntz")).alias("latest")) for name, (df, c) in frames.items()]
    return reduce(DataFrame.unionByName, rows)


def catalog_columns(spark: SparkSession, database: str | None = None) -> DataFrame:
    db = database or spark.catalog.currentDatabase()
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables(db) for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")
