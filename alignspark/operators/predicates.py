"""The WHERE language: conditions, a boolean expression over their numbers, and SQL text.

A condition is text ("col OP value"), a tuple (col, op, value), a dict with
field, operator and value, or a list of these.  The value "?" stands for the
source row's column of the same name, which turns the condition into a join
condition.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = ("=", "!=", ">=", "<=", ">", "<", "BETWEEN", "IN", "LIKE")
DIALECTS = ("oracle", "postgresql", "mssql", "mysql", "sqlite", "spark")
_TEXT = re.compile(r"^\s*(?P<col>\"[^\"]+\"|`[^`]+`|\w+)\s*(?P<op>!=|>=|<=|=|>|<|\bBETWEEN\b|\bIN\b|\bLIKE\b)\s*(?P<value>.*?)\s*$", re.I | re.S)


@dataclass(frozen=True)
class Condition:
    column: str
    op: str
    value: Any

    @property
    def from_source(self) -> bool:
        return self.value == "?"


def _unquote(v: str) -> str:
    v = v.strip()
    return v[1:-1].replace("''", "'") if len(v) > 1 and v[0] == v[-1] == "'" else v


def _list(value: Any) -> list:
    """Members of an IN list: a sequence, or text with commas outside single quotes."""
    if isinstance(value, (list, tuple, set)):
        return list(value)
    if not isinstance(value, str):
        return [value]
    inner = value.strip()
    inner = inner[1:-1] if inner[:1] == "(" and inner[-1:] == ")" else inner
    if not inner.strip():
        return []
    return [_unquote(m) for m in re.findall(r"'(?:[^']|'')*'|[^,]+", inner) if m.strip()]


def _pair(value: Any) -> tuple:
    if isinstance(value, str):
        parts = re.split(r"\s+and\s+", value, maxsplit=1, flags=re.I)
        value = [_unquote(p) for p in parts]
    value = list(value) if isinstance(value, (list, tuple)) else [value]
    return (value[0], value[1]) if len(value) == 2 else (value[0], value[0])


def parse(item: Any) -> list[Condition]:
    if isinstance(item, list):
        return [c for part in item for c in parse(part)]
    if isinstance(item, dict):
        item = (item["field"], item["operator"], item["value"])
    if isinstance(item, str):
        m = _TEXT.match(item)
        if not m:
            raise ValueError(f"cannot read condition {item!r}")
        op = m["op"].upper()
        value = m["value"] if op in ("IN", "BETWEEN") else _unquote(m["value"])
        item = (m["col"].strip('"`'), op, value)
    if not isinstance(item, tuple) or len(item) != 3:
        raise ValueError(f"a condition needs column, operator and value: {item!r}")
    column, op, value = item
    if op.upper() not in OPERATORS:
        raise ValueError(f"unknown operator {op!r}")
    return [Condition(column, op.upper(), value)]


def _resolve(df: DataFrame, name: str) -> str:
    for c in df.columns:
        if c.lower() == name.lower():
            return c
    raise ValueError(f"unknown column {name!r}")


def condition(c: Condition, left: Column, right: Column | None = None) -> Column:
    """One condition; SQL's three-valued logic, so a comparison with NULL is never true."""
    if right is not None:
        return {"=": left == right, "!=": left != right, ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right, "LIKE": F.contains(left.cast("string"), right.cast("string")), "IN": left == right, "BETWEEN": left == right}[c.op]
    if c.op == "IN":
        members = _list(c.value)
        return left.isin(*members) if members else F.lit(False)
    if c.op == "BETWEEN":
        low, high = _pair(c.value)
        return left.between(F.lit(low), F.lit(high))
    if c.op == "LIKE":
        return F.contains(left.cast("string"), F.lit(str(c.value)))  # contains, so % and _ are plain characters
    v = F.lit(c.value)
    return {"=": left == v, "!=": left != v, ">": left > v, ">=": left >= v, "<": left < v, "<=": left <= v}[c.op]


def combine(parts: dict[int, Any], expression: str | None, both, either, negate):
    """Evaluate an expression such as "1 AND (2 OR 3)" over numbered parts; all ANDed without one."""
    if not expression:
        return reduce(both, parts.values())
    tokens = re.findall(r"\d+|[()]|\w+", expression.upper())
    if re.sub(r"\d+|[()]|\w+|\s+", "", expression):
        raise ValueError(f"cannot read expression {expression!r}")
    at = 0

    def level(op: str, below, join):
        nonlocal at
        out = below()
        while at < len(tokens) and tokens[at] == op:
            at += 1
            out = join(out, below())
        return out

    def one():
        nonlocal at
        if at >= len(tokens):
            raise ValueError(f"expression {expression!r} ends early")
        t = tokens[at]
        at += 1
        if t == "NOT":
            return negate(one())
        if t == "(":
            out = any_of()
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError(f"unbalanced parentheses in {expression!r}")
            at += 1
            return out
        if t.isdigit() and int(t) in parts:
            return parts[int(t)]
        raise ValueError(f"expression names {t}, but there are conditions {sorted(parts)}")

    def all_of():
        return level("AND", one, both)

    def any_of():
        return level("OR", all_of, either)

    out = any_of()
    if at != len(tokens):
        raise ValueError(f"cannot read expression {expression!r} from {tokens[at]!r}")
    return out


def where(df: DataFrame, items: Any, expression: str | None = None, source: DataFrame | None = None) -> Column:
    """The predicate over df's columns, and source's where a value is "?"; conditions keep their declared numbers."""
    conditions = parse(items if isinstance(items, list) else [items])
    parts: dict[int, Column] = {}
    for n, c in enumerate(conditions, 1):
        if c.from_source and source is None:
            raise ValueError("a ? value needs a source")
        if c.from_source and c.column.lower() not in (x.lower() for x in source.columns):
            continue  # the source does not say
        right = source[_resolve(source, c.column)] if c.from_source else None
        parts[n] = condition(c, df[_resolve(df, c.column)], right)
    if not parts:
        raise ValueError("no condition is left")
    if expression:  # skipped conditions hold
        parts |= {n: F.lit(True) for n in range(1, len(conditions) + 1) if n not in parts}
    return combine(parts, expression, lambda a, b: a & b, lambda a, b: a | b, lambda a: ~a)


def select(df: DataFrame, items: Any, expression: str | None = None, columns: list[str] | None = None) -> DataFrame:
    found = df.where(where(df, items, expression))
    return found.select(*(_resolve(df, c) for c in columns)) if columns else found


# --- SQL text, for JDBC targets and previews -------------------------------


def quote(name: str, dialect: str = "spark") -> str:
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}")
    if dialect in ("mysql", "spark"):
        return f"`{name.replace('`', '``')}`"
    if dialect == "mssql":
        return f"[{name.replace(']', ']]')}]"
    return '"' + name.replace('"', '""') + '"'


def where_sql(items: Any, expression: str | None = None, dialect: str = "sqlite", row: dict[str, Any] | None = None) -> tuple[str, dict[str, Any]]:
    """SQL text with named parameters, and their values."""
    quote("x", dialect)
    params: dict[str, Any] = {}
    parts: dict[int, str] = {}
    for n, c in enumerate(parse(items if isinstance(items, list) else [items]), 1):
        value = c.value
        if c.from_source:
            found = {k.lower(): v for k, v in (row or {}).items()}
            if c.column.lower() not in found:
                continue
            value = found[c.column.lower()]
        name, col = f"{re.sub(r'[^0-9A-Za-z_]', '_', c.column)}_{n}", quote(c.column, dialect)
        if c.op == "IN":
            members = _list(value)
            names = [f"{name}_{k}" for k in range(len(members))]
            params |= dict(zip(names, members, strict=True))
            parts[n] = f"{col} IN ({', '.join(':' + x for x in names)})" if members else "1 = 0"
        elif c.op == "BETWEEN":
            params[f"{name}_0"], params[f"{name}_1"] = _pair(value)
            parts[n] = f"{col} BETWEEN :{name}_0 AND :{name}_1"
        elif c.op == "LIKE":
            params[name] = "%" + re.sub(r"([\\%_])", r"\\\1", str(value)) + "%"
            parts[n] = f"{col} LIKE :{name}" + ("" if dialect == "sqlite" else " ESCAPE '\\'")
        else:
            params[name] = value
            parts[n] = f"{col} {c.op} :{name}"
    if not parts:
        return "", params
    return combine(parts, expression, lambda a, b: f"({a} AND {b})", lambda a, b: f"({a} OR {b})", lambda a: f"(NOT {a})"), params


def select_sql(table: str, items: Any, expression: str | None = None, dialect: str = "sqlite", row: dict | None = None, columns: list[str] | None = None) -> tuple[str, dict]:
    text, params = where_sql(items, expression, dialect, row)
    what = ", ".join(quote(c, dialect) for c in columns) if columns else "*"
    return f"SELECT {what} FROM {quote(table, dialect)}" + (f" WHERE {text}" if text else ""), params


def update_sql(rows: list[dict], table: str, items: Any, expression: str | None = None, dialect: str = "sqlite", update_cols: list[str] | None = None) -> tuple[str, dict]:
    if len(rows) != 1:
        raise ValueError(f"an update takes exactly one row, not {len(rows)}")
    text, params = where_sql(items, expression, dialect, rows[0])
    chosen = {k: v for k, v in rows[0].items() if not update_cols or k in update_cols}
    sets = {f"set_{re.sub(r'[^0-9A-Za-z_]', '_', k)}": v for k, v in chosen.items()}
    listed = ", ".join(f"{quote(k, dialect)} = :{p}" for k, p in zip(chosen, sets, strict=True))
    return f"UPDATE {quote(table, dialect)} SET {listed} WHERE {text}", params | sets


def insert_sql(rows: list[dict], table: str, dialect: str = "sqlite") -> tuple[str, dict]:
    if len(rows) != 1:
        raise ValueError(f"an insert takes exactly one row, not {len(rows)}")
    names = list(rows[0])
    return f"INSERT INTO {quote(table, dialect)} ({', '.join(quote(n, dialect) for n in names)}) VALUES ({', '.join(':' + n for n in names)})", dict(rows[0])
