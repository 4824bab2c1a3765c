"""Text cleaning as Column expressions, and header cleaning on the driver."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import reduce
from keyword import iskeyword

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters and what they are replaced by.
REPLACEMENTS = {
    "\u00a0": " ",
    "\u200b": "",
    "\u200c": "",
    "\u200d": "",
    "\u2060": "",
    "\ufeff": "",
    "\u180e": "",
    "\u202f": " ",
    "\u201c": '"',
    "\u201d": '"',
    "\u2018": "'",
    "\u2019": "'",
    "\u201b": "'",
    "\u201e": '"',
    "\u201f": '"',
    "\u2013": "-",
    "\u2014": "-",
    "\u2015": "-",
    "\u2026": "...",
    "\u0410": "A",
    "\u0430": "a",
    "\u0412": "B",
    "\u0415": "E",
    "\u0435": "e",
    "\u041a": "K",
    "\u043a": "k",
    "\u041c": "M",
    "\u041d": "H",
    "\u041e": "O",
    "\u043e": "o",
    "\u0420": "P",
    "\u0440": "p",
    "\u0421": "C",
    "\u0441": "c",
    "\u0422": "T",
    "\u0425": "X",
    "\u0445": "x",
    "\u0443": "y",
    "\u0391": "A",
    "\u03b1": "a",
    "\u0392": "B",
    "\u03b2": "b",
    "\u0395": "E",
    "\u03b5": "e",
    "\u0397": "H",
    "\u0399": "I",
    "\u03b9": "i",
    "\u039a": "K",
    "\u03ba": "k",
    "\u039d": "N",
    "\u03bd": "v",
    "\u039f": "O",
    "\u03bf": "o",
    "\u03a1": "P",
    "\u03c1": "p",
    "\u03a4": "T",
    "\u03c4": "t",
    "\u03a5": "Y",
    "\u03c5": "y",
    "\u03a7": "X",
    "\u03c7": "x",
}
# Texts that stand for a missing value, exactly as written.
NULL_TOKENS = ("nan", "None", "NAT", "NAN", "null")
# Words that no dialect accepts as a bare identifier.
RESERVED = frozenset(
    (
        "SELECT",
        "FROM",
        "WHERE",
        "GROUP",
        "ORDER",
        "LIMIT",
        "JOIN",
        "TABLE",
        "COLUMN",
        "INSERT",
        "UPDATE",
        "DELETE",
        "CREATE",
        "DROP",
        "ALTER",
        "SCHEMA",
        "INDEX",
        "VIEW",
        "TRIGGER",
        "PROCEDURE",
        "FUNCTION",
        "DATABASE",
        "USER",
        "ROLE",
        "GRANT",
        "REVOKE",
    )
)

_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"


@dataclass
class CleaningConfig:
    handle_na: bool = True
    replacements: dict[str, str] = field(default_factory=lambda: dict(REPLACEMENTS))
    normalize_unicode: str | None = "NFKC"
    remove_control_chars: bool = True
    remove_special_chars: bool = False
    trim: bool = True
    lowercase_headers: bool = False


def replace_chars(c: Column, mapping: dict[str, str] | None = None) -> Column:
    """One translate for one-to-one and deleted characters, one replace for each that grows."""
    mapping = REPLACEMENTS if mapping is None else mapping
    short = {k: v for k, v in mapping.items() if len(k) == 1 and len(v) <= 1}
    kept = [k for k, v in short.items() if v]
    gone = [k for k, v in short.items() if not v]
    out = F.translate(c, "".join(kept + gone), "".join(short[k] for k in kept)) if short else c
    return reduce(lambda o, k: F.replace(o, F.lit(k), F.lit(mapping[k])), (k for k in mapping if k not in short), out)


def normalize_text(c: Column, form: str = "NFKC") -> Column:
    """Unicode normalisation; Spark has no built-in, so an Arrow UDF that only non-ASCII values need."""

    @F.pandas_udf(T.StringType())
    def normal(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize(form, v))

    return normal(c)


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_text(c: Column, config: CleaningConfig | None = None) -> Column:
    """Null tokens, character map, normalisation, control and special characters, outer white space."""
    config = config or CleaningConfig()
    out = F.when(~c.isin(*NULL_TOKENS), c) if config.handle_na else c
    if config.replacements:
        out = replace_chars(out, config.replacements)
    if config.normalize_unicode:
        out = normalize_text(out, config.normalize_unicode)
    if config.remove_control_chars:
        out = F.regexp_replace(out, _CONTROL, "")
    if config.remove_special_chars:
        out = F.regexp_replace(out, r"[^\w\s]", "")
    return strip_space(out) if config.trim else out


def clean_value(value: str, config: CleaningConfig | None = None) -> str:
    """The scalar form, for headers: normalise first, then the map, then drop every control category."""
    config = config or CleaningConfig()
    if config.normalize_unicode:
        value = unicodedata.normalize(config.normalize_unicode, value)
    value = "".join(config.replacements.get(ch, ch) for ch in value)
    if config.remove_control_chars:
        value = "".join(ch for ch in value if ch in "\n\r\t" or unicodedata.category(ch)[0] != "C")
    return value.strip() if config.trim else value


def _numbered(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(f"{n}_{k}" if k else n)
    return out


def clean_headers(names: list[str], config: CleaningConfig | None = None) -> list[str]:
    config = config or CleaningConfig()
    out = []
    for at, name in enumerate(names, 1):
        n = re.sub("_+", "_", re.sub(r"[^A-Za-z0-9_]", "_", clean_value(str(name), config))).strip("_") or f"col_{at}"
        out.append(n.lower() if config.lowercase_headers else n)
    return _numbered(out)


def sanitize_names(names: list[str], allow_space: bool = True, to_lower: bool = True, dialect: str = "postgresql", fallback: str = "col_", max_length: int | None = None) -> list[str]:
    """Identifiers: odd characters to underscores, no leading digit, no reserved word, no duplicates."""
    blanks = iter(range(1, len(names) + 1))

    def one(name: str) -> str:
        n = re.sub(r"[^\w\s]" if allow_space else r"\W", "_", str(name).strip())
        n = re.sub(r"\s+", " ", n)
        n = re.sub("_{2,}", "_", n.lower() if to_lower else n).strip("_")
        if n[:1].isdigit():
            n = f"N{n}" if dialect == "oracle" else f"_{fallback}{next(blanks)}"
        n = n or f"{fallback}{next(blanks)}"
        if n.upper() in RESERVED or iskeyword(n):
            n += "_"
        return n[:max_length] if max_length else n

    return _numbered([one(n) for n in names])


def sanitize(df: DataFrame, **kw) -> tuple[DataFrame, dict[str, str]]:
    """The frame with sanitised names, and old name -> new name."""
    names = sanitize_names(df.columns, **kw)
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def robust_clean(df: DataFrame, config: CleaningConfig | None = None) -> DataFrame:
    """Headers and every string column, in one projection."""
    named = df.toDF(*clean_headers(df.columns, config))
    return named.select(*(clean_text(F.col(f"`{f.name}`"), config).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in named.schema))


def strip_currency(c: Column) -> Column:
    return F.regexp_replace(c, r"[$€£¥₹,\s]", "")


def escape_join(columns: list[Column], delimiter: str = "|") -> Column:
    """Composite key text: backslash and delimiter escaped, nulls as the word None."""
    parts = [F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("None")), F.lit("\\"), F.lit("\\\\")), F.lit(delimiter), F.lit("\\" + delimiter)) for c in columns]
    return F.concat_ws(delimiter, *parts)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float columns to NULL, since Spark keeps them apart and sorts NaN last."""
    return df.select(*(F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema))
