"""DDL text for five databases and Spark, and what each of them supports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T

from .analyze import Change
from .model import DIALECTS, ColumnSpec, ConstraintSpec, TableSpec

# What the dialects support, in the order of DIALECTS.
CAPABILITIES = {
    "ADD_COLUMN": (True, True, True, True, True, True),
    "DROP_COLUMN": (True, True, True, True, False, True),
    "ALTER_TYPE": (True, True, True, True, False, False),
    "WIDEN_COLUMN": (True, True, True, True, False, True),
    "ADD_INDEX": (True, True, True, True, True, False),
    "DROP_INDEX": (True, True, True, True, True, False),
    "TRANSACTIONAL_DDL": (False, True, True, False, True, False),
    "IF_NOT_EXISTS": (False, True, False, True, True, True),
    "ENFORCED_KEYS": (True, True, True, True, True, False),
}
_NAME_LIMIT = {"oracle": 30}
_IDENTITY = {
    "oracle": "GENERATED BY DEFAULT AS IDENTITY",
    "postgresql": "GENERATED BY DEFAULT AS IDENTITY",
    "mssql": "IDENTITY(1,1)",
    "mysql": "AUTO_INCREMENT",
    "sqlite": "",
    "spark": "",
}


def capabilities(dialect: str) -> dict[str, bool]:
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}")
    at = DIALECTS.index(dialect)
    return {k: v[at] for k, v in CAPABILITIES.items()}


def advice(dialect: str, changes: Iterable[Change]) -> list[str]:
    can = capabilities(dialect)
    notes = [f"{c.kind} on {c.column} is not supported by {dialect}: rewrite the table" for c in changes if not can.get(c.kind, True)]
    return notes if can["TRANSACTIONAL_DDL"] else [*notes, f"{dialect} commits each change by itself"]


def quote(name: str, dialect: str) -> str:
    if dialect in ("mysql", "spark"):
        return f"`{name.replace('`', '``')}`"
    if dialect == "mssql":
        return f"[{name.replace(']', ']]')}]"
    plain = name.replace("_", "a").isalnum() and not name[0].isdigit() and name.isascii()
    if dialect == "oracle" and plain:
        return name.upper()
    if dialect == "postgresql" and plain and name == name.lower():
        return name
    return '"' + name.replace('"', '""') + '"'


def qualified(spec: TableSpec, dialect: str) -> str:
    return ".".join(quote(p, dialect) for p in (spec.schema, spec.name) if p)


def _clause(c: ConstraintSpec, table: str, dialect: str) -> str | None:
    cols = ", ".join(quote(x, dialect) for x in c.columns)
    name = (c.name or f"{ {'PRIMARY_KEY': 'pk', 'UNIQUE': 'uq', 'FOREIGN_KEY': 'fk', 'CHECK': 'ck'}[c.kind] }_{table}_{'_'.join(c.columns)}")[: _NAME_LIMIT.get(dialect, 128)]
    lead = "" if dialect == "sqlite" else f"CONSTRAINT {quote(name, dialect)} "
    if dialect == "spark":
        return None  # kept in the table's sidecar and checked by validation
    if c.kind == "PRIMARY_KEY":
        return f"{lead}PRIMARY KEY ({cols})"
    if c.kind == "UNIQUE":
        return f"{lead}UNIQUE ({cols})"
    if c.kind == "FOREIGN_KEY" and c.references:
        table, columns = c.references
        return f"{lead}FOREIGN KEY ({cols}) REFERENCES {quote(table, dialect)} ({', '.join(quote(x, dialect) for x in columns)})"
    return f"{lead}CHECK ({c.definition})" if c.kind == "CHECK" and c.definition else None


def column_sql(c: ColumnSpec, dialect: str) -> str:
    parts = [quote(c.name, dialect), c.sql(dialect)]
    if c.identity and _IDENTITY[dialect]:
        parts.append(_IDENTITY[dialect])
    if not c.nullable:
        parts.append("NOT NULL")
    return " ".join(parts)


def partition_sql(kind: str, columns: list[str], dialect: str, pieces: list[str] | None = None, interval: str | None = None) -> str:
    """PARTITION BY clause; Spark partitions by value only."""
    cols = ", ".join(quote(c, dialect) for c in columns)
    if dialect == "spark":
        return f"PARTITIONED BY ({cols})"
    if kind not in ("range", "list", "hash"):
        raise ValueError(f"unknown partition kind {kind!r}")
    if interval and kind != "range":
        raise ValueError("an interval goes with range partitions only")
    if dialect not in ("oracle", "postgresql", "mysql"):
        raise ValueError(f"{dialect} partitions through a function and scheme")
    text = f"PARTITION BY {kind.upper()} ({cols})"
    if interval:
        text += f" INTERVAL ({interval})"
    return text + (f" ({', '.join(pieces)})" if pieces else "")


def mssql_partition(name: str, column_type: str, boundaries: list[str], filegroups: list[str]) -> list[str]:
    if not boundaries:
        raise ValueError("a partition function needs boundaries")
    if len(filegroups) != len(boundaries) + 1:
        raise ValueError("there is one more filegroup than boundaries")
    return [
        f"CREATE PARTITION FUNCTION {quote('pf_' + name, 'mssql')} ({column_type}) AS RANGE RIGHT FOR VALUES ({', '.join(boundaries)})",
        f"CREATE PARTITION SCHEME {quote('ps_' + name, 'mssql')} AS PARTITION {quote('pf_' + name, 'mssql')} TO ({', '.join(quote(f, 'mssql') for f in filegroups)})",
    ]


def create_table(spec: TableSpec, dialect: str, partition: str | None = None) -> list[str]:
    """CREATE TABLE, then the indexes."""
    lines = [column_sql(c, dialect) for c in spec.columns.values()]
    lines += [x for c in spec.constraints if (x := _clause(c, spec.name, dialect))]
    head = "CREATE TABLE IF NOT EXISTS" if capabilities(dialect)["IF_NOT_EXISTS"] else "CREATE TABLE"
    text = f"{head} {qualified(spec, dialect)} (\n  " + ",\n  ".join(lines) + "\n)"
    if dialect == "spark":
        text += " USING parquet"
    out = [text + (f"\n{partition}" if partition else "")]
    if capabilities(dialect)["ADD_INDEX"]:
        out += [f"CREATE {'UNIQUE ' if i.unique else ''}INDEX {quote(i.name, dialect)} ON {qualified(spec, dialect)} ({', '.join(quote(c, dialect) for c in i.columns)})" for i in spec.indexes]
    return out


def change_sql(c: Change, spec: TableSpec, dialect: str) -> str:
    if not capabilities(dialect).get(c.kind, False):
        raise ValueError(f"{c.kind} is not supported by {dialect}")
    table = qualified(spec, dialect)
    if c.kind == "ADD_COLUMN":
        return f"ALTER TABLE {table} ADD {'' if dialect in ('oracle', 'mssql') else 'COLUMN '}{quote(c.column, dialect)} {c.after}"
    if c.kind == "DROP_COLUMN":
        return f"ALTER TABLE {table} DROP COLUMN {quote(c.column, dialect)}"
    if c.kind in ("WIDEN_COLUMN", "ALTER_TYPE"):
        s = spec.columns[c.column]
        new = ColumnSpec(s.name, s.family, s.nullable, int(c.after)) if c.kind == "WIDEN_COLUMN" and "," not in c.after else ColumnSpec(s.name, s.family, s.nullable, None, *map(int, c.after.split(","))) if c.kind == "WIDEN_COLUMN" else ColumnSpec(s.name, c.after, s.nullable)
        verb = {"oracle": "MODIFY {c} {t}", "postgresql": "ALTER COLUMN {c} TYPE {t}", "mysql": "MODIFY COLUMN {c} {t}"}.get(dialect, "ALTER COLUMN {c} {t}")
        return f"ALTER TABLE {table} " + verb.format(c=quote(c.column, dialect), t=new.sql(dialect))
    name = quote(f"ix_{spec.name}_{c.column.replace(',', '_')}"[: _NAME_LIMIT.get(dialect, 128)], dialect)
    cols = ", ".join(quote(x, dialect) for x in c.column.split(","))
    return f"CREATE INDEX {name} ON {table} ({cols})" if c.kind == "ADD_INDEX" else f"DROP INDEX {name}"


def struct_source(schema: T.StructType, name: str) -> str:
    """Python source of a StructType."""
    fields = ",\n    ".join(f"T.StructField({f.name!r}, T.{f.dataType!r}, {f.nullable})" for f in schema)
    return f"from pyspark.sql import types as T\n\n{name} = T.StructType([\n    {fields},\n])\n"


def schema_json(spec: TableSpec) -> dict:
    return {"table": spec.name, "schema": spec.schema, "primary_keys": spec.primary_key or None, "dtypes": {c.name: c.spark.simpleString() for c in spec.columns.values()}}
