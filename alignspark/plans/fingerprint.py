"""Schema fingerprints and drift."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import TableSpec


@dataclass(frozen=True)
class Fingerprint:
    table: str
    columns: dict[str, tuple] = field(hash=False)
    digest: str = ""


def fingerprint(spec: TableSpec) -> Fingerprint:
    """First 16 hex digits of SHA-256 over the columns sorted by name, so their order does not matter."""
    columns = {c.name: (c.spark.simpleString(), c.nullable, c.max_length, c.name in spec.primary_key, c.identity) for c in spec.columns.values()}
    text = json.dumps(sorted([n, *v] for n, v in columns.items()), default=str)
    return Fingerprint(spec.name, columns, hashlib.sha256(text.encode()).hexdigest()[:16])


@dataclass
class Drift:
    added: list[str]
    removed: list[str]
    modified: dict[str, tuple[tuple, tuple]]

    @property
    def changed(self) -> bool:
        return bool(self.added or self.removed or self.modified)

    def __str__(self) -> str:
        lines = [f"+ {c}" for c in self.added] + [f"- {c}" for c in self.removed] + [f"~ {c}: {a} -> {b}" for c, (a, b) in self.modified.items()]
        return "\n".join(lines) or "no drift"


def diff(before: Fingerprint, after: Fingerprint) -> Drift:
    a, b = before.columns, after.columns
    return Drift(sorted(set(b) - set(a)), sorted(set(a) - set(b)), {c: (a[c], b[c]) for c in sorted(set(a) & set(b)) if a[c] != b[c]})


def data_digest(df: DataFrame) -> DataFrame:
    """One row: row count and an order-free sum of row hashes."""
    row = F.xxhash64(*(F.col(f"`{c}`") for c in sorted(df.columns)))
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))
