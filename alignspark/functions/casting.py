"""Type inference and casting of string columns.

All decisions come from one aggregation over the whole column (no sampling, no
per-chunk types); the casts are one projection of tolerant built-ins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip_currency

# Texts read as booleans.
TRUE_TOKENS = ("true", "yes", "y", "t", "1", "on")
FALSE_TOKENS = ("false", "no", "n", "f", "0", "off")
# Parts of a column's name that suggest a date or time.
TIME_HINTS = ("date", "time", "timestamp", "_at", "created", "updated")
# Value patterns of each type, in order of precedence.
PATTERNS = {
    "timestamp": [r"\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}"],
    "date": [r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}"],
    "boolean": ["true", "false", "yes", "no", "y", "n"],
    "integer": [r"-?\d+"],
    "float": [r"-?\d*\.?\d+", r"-?\d*\.?\d*[eE][+-]?\d+"],
}
_MONTH_FIRST = r"(0?[1-9]|1[0-2])/\d{1,2}/\d{4}"
#: Formats tried in turn, month before day as in the usual lenient reader, each only on values of its form: a parse that fails costs an exception.
DATE_FORMATS = {
    "yyyy-MM-dd HH:mm:ss": r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}",
    "yyyy-MM-dd'T'HH:mm:ss": r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
    "yyyy-MM-dd HH:mm": r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}",
    "yyyy-MM-dd": r"\d{4}-\d{2}-\d{2}",
    "M/d/yyyy H:mm:ss": rf"{_MONTH_FIRST} \d{{1,2}}:\d{{2}}:\d{{2}}",
    "M/d/yyyy H:mm": rf"{_MONTH_FIRST} \d{{1,2}}:\d{{2}}",
    "M/d/yyyy": _MONTH_FIRST,
    "d/M/yyyy": r"\d{1,2}/(0?[1-9]|1[0-2])/\d{4}",
}
#: A number as written: digits with or without a point, and an exponent.
_NUMBER = r"^-?(?:[0-9]+|[0-9]*[.][0-9]+)(?:[eE][-+]?[0-9]+)?$"


@dataclass
class CastConfig:
    mode: str = "transform"  # or "pattern", "segment"
    threshold: float = 0.9
    max_null_increase: float = 0.1
    validate: bool = True
    dtypes: dict[str, str] = field(default_factory=dict)


def parse_boolean(c: Column) -> Column:
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low.isin(*TRUE_TOKENS), True).when(low.isin(*FALSE_TOKENS), False)


def parse_datetime(c: Column) -> Column:
    return F.coalesce(*(F.when(c.rlike(f"^{form}$"), F.try_to_timestamp(c, F.lit(f))) for f, form in DATE_FORMATS.items()))


def parse_number(c: Column) -> Column:
    return strip_currency(c).try_cast("double")


def is_json(c: Column) -> Column:
    """Objects and arrays only: a bare number or word is not taken for JSON."""
    return c.rlike(r"^\s*[\[{]") & F.try_parse_json(c).isNotNull()


def _fits(c: Column, kind: str) -> Column:
    if kind == "boolean":
        return F.lower(F.trim(c)).isin(*PATTERNS[kind])
    return F.trim(c).rlike(f"^(?:{'|'.join(PATTERNS[kind])})$")


def value_kind(c: Column) -> Column:
    """Name of the first pattern that the whole value fits."""
    out = None
    for kind in PATTERNS:
        out = F.when(_fits(c, kind), kind) if out is None else out.when(_fits(c, kind), kind)
    return out.otherwise("string")


def column_stats(df: DataFrame, columns: list[str]) -> dict[str, dict[str, float]]:
    """One aggregation: shares of values that look like each type, nulls before and after each cast."""
    if not columns:
        return {}
    aggs = [F.count("*").cast("double").alias("n")]
    for k, name in enumerate(columns):
        c = F.col(f"`{name}`")
        some = c.isNotNull()
        for key, cond in {
            "filled": some,
            "numeric": strip_currency(c).rlike(_NUMBER),
            "boolean": parse_boolean(c).isNotNull(),
            "json": is_json(c),
            "as_number": parse_number(c).isNotNull(),
            "as_datetime": parse_datetime(c).isNotNull(),
            **{f"is_{kind}": F.col(f"_kind{k}") == kind for kind in PATTERNS},
        }.items():
            aggs.append(F.count_if(some & cond).cast("double").alias(f"{k}_{key}"))
    # each value's kind is found once, in a projection of its own
    row = df.select(*(F.col(f"`{n}`") for n in columns), *(value_kind(F.col(f"`{n}`")).alias(f"_kind{k}") for k, n in enumerate(columns))).agg(*aggs).first().asDict()
    return {name: {"n": row["n"]} | {key.split("_", 1)[1]: v for key, v in row.items() if key.split("_", 1)[0] == str(k)} for k, name in enumerate(columns)}


def infer_kind(name: str, s: dict[str, float], config: CastConfig) -> str:
    """timestamp, double, boolean or string for one column's statistics."""
    n, filled = s["n"], s["filled"]
    if not filled:
        return "string"

    def loses(key: str) -> bool:
        return config.validate and (filled - s[key]) / n > config.max_null_increase

    if config.mode == "segment":
        whole = [k for k in PATTERNS if s[f"is_{k}"] == filled]
        return {"timestamp": "timestamp", "date": "timestamp", "boolean": "boolean", "integer": "bigint", "float": "double"}.get(whole[0], "string") if whole else "string"
    if config.mode == "pattern":
        best = max(PATTERNS, key=lambda k: s[f"is_{k}"])
        if s[f"is_{best}"] / filled >= config.threshold:
            kind = {"timestamp": "timestamp", "date": "timestamp", "boolean": "boolean", "integer": "bigint", "float": "double"}[best]
            lost = {"timestamp": "as_datetime", "bigint": "as_number", "double": "as_number"}.get(kind)
            if lost is None or not loses(lost):
                return kind
        if s["as_number"] / filled >= config.threshold:
            return "double"
        return "timestamp" if s["as_datetime"] / filled >= config.threshold else "string"
    low = name.lower()
    if any(h in low for h in TIME_HINTS) and s["json"] < filled * config.threshold and not loses("as_datetime"):
        return "timestamp"
    if s["numeric"] / filled > config.threshold and not loses("as_number"):
        return "double"
    return "boolean" if s["boolean"] / filled >= config.threshold else "string"


def cast_to(c: Column, kind: str) -> Column:
    if kind == "timestamp":
        return parse_datetime(c)
    if kind == "boolean":
        return parse_boolean(c)
    if kind in ("double", "bigint", "int", "float") or kind.startswith("decimal"):
        return strip_currency(c.cast("string")).try_cast(kind)
    return c.try_cast(kind)


def infer_types(df: DataFrame, config: CastConfig | None = None) -> dict[str, str]:
    """Target type of every string column that changes; explicit types win."""
    config = config or CastConfig()
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in config.dtypes]
    found = {n: infer_kind(n, s, config) for n, s in column_stats(df, names).items()}
    return {n: k for n, k in found.items() if k != "string"} | config.dtypes


def cast_frame(df: DataFrame, config: CastConfig | None = None) -> DataFrame:
    types = infer_types(df, config)
    return df.select(*(cast_to(F.col(f"`{n}`"), types[n]).alias(n) if n in types else F.col(f"`{n}`") for n in df.columns))


def auto_cast(df: DataFrame) -> DataFrame:
    return cast_frame(df, CastConfig())


def fast_cast(df: DataFrame) -> DataFrame:
    return cast_frame(df, CastConfig(validate=False))


def safe_cast(df: DataFrame) -> DataFrame:
    return cast_frame(df, CastConfig(mode="pattern", threshold=0.95, max_null_increase=0.05))


def smart_convert(df: DataFrame, name: str, kind: str, max_null_points: float = 0.05) -> DataFrame:
    """Convert one column if the share of nulls grows by less than so many points; else leave it."""
    c = F.col(f"`{name}`")
    new = cast_to(c, kind)
    row = df.agg(F.avg(c.isNull().cast("double")).alias("before"), F.avg(new.isNull().cast("double")).alias("after")).first()
    if row["before"] is None or row["after"] - row["before"] >= max_null_points:
        return df
    return df.withColumn(name, new)


def object_kind(dtype: T.DataType) -> str:
    """How a column's values are kept: text, structured or scalar."""
    if isinstance(dtype, T.StringType):
        return "STRING"
    return "STRUCTURED" if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)) else "SCALAR"
