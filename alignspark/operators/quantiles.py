"""Exact quantiles without sorting a column in one task.

A mergeable sketch brackets each order statistic, one aggregation counts the
values below and inside each bracket, and the few distinct values inside are
counted by value and read by the driver.  Brackets that still hold more than
``most`` rows are narrowed again, so what one task or the driver holds is bounded
whatever the column.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sketch accuracy: ranks are off by at most 1 / ACCURACY of the rows.
ACCURACY = 10_000


@dataclass
class _Bracket:
    column: str
    first: int  # the order statistics wanted, from 0
    last: int
    low: float
    high: float
    below: int = 0
    inside: int = 0


def quantiles(df: DataFrame, columns: dict[str, Column], shares: list[float], most: int = 50_000) -> dict[str, list[float] | None]:
    """For each named double column its quantiles, interpolated between neighbours; None where it has no value.

    Nulls are left out; NaN counts as larger than any number.
    """
    names = list(columns)
    rows = df.select(*(columns[n].cast("double").alias(f"_{k}") for k, n in enumerate(names)))
    near = sorted({min(1.0, max(0.0, q + d / ACCURACY)) for q in shares for d in (-3, 3)})
    found = rows.agg(*(F.struct(F.count(f"_{k}").alias("n"), F.min(f"_{k}").alias("low"), F.max(f"_{k}").alias("high"), F.approx_percentile(f"_{k}", F.array(*map(F.lit, near)), ACCURACY).alias("near")).alias(f"_{k}") for k in range(len(names)))).first()
    open_: list[_Bracket] = []
    for k in range(len(names)):
        f = found[f"_{k}"]
        for q in shares if f["n"] else ():
            at = q * (f["n"] - 1)
            low, high = (f["near"][near.index(min(1.0, max(0.0, q + d / ACCURACY)))] for d in (-3, 3))
            open_.append(_Bracket(f"_{k}", floor(at), ceil(at), f["low"] if q * ACCURACY <= 3 else low, f["high"] if (1 - q) * ACCURACY <= 3 else high))
    limits = {f"_{k}": (found[f"_{k}"]["low"], found[f"_{k}"]["high"]) for k in range(len(names))}
    _counted(rows, open_, limits)
    while wide := [b for b in open_ if b.inside > most and b.low < b.high]:
        before = [(b.low, b.high) for b in wide]
        _narrowed(rows, wide)
        if before == [(b.low, b.high) for b in wide]:  # a few values hold all these rows, so their counts are short
            break
        _counted(rows, open_, limits)
    values = _values(rows, open_)
    out: dict[str, list[float] | None] = {}
    for k, n in enumerate(names):
        f = found[f"_{k}"]
        out[n] = None
        if f["n"]:
            at = iter([i for i, b in enumerate(open_) if b.column == f"_{k}"])
            out[n] = []
            for q in shares:
                i = next(at)
                position = q * (f["n"] - 1)
                low, high = (_pick(values[i], open_[i], r) for r in (open_[i].first, open_[i].last))
                out[n].append(low if low == high else low + (position - floor(position)) * (high - low))
    return out


def _counted(rows: DataFrame, brackets: list[_Bracket], limits: dict[str, tuple[float, float]]) -> None:
    """Rows below and inside each bracket; a bracket that misses its order statistics is widened to the whole column."""
    if not brackets:
        return
    for again in (False, True):
        counts = rows.agg(*(F.struct(F.count_if(F.col(b.column) < b.low).alias("below"), F.count_if(F.col(b.column).between(b.low, b.high)).alias("inside")).alias(f"b{i}") for i, b in enumerate(brackets))).first()
        missed = False
        for i, b in enumerate(brackets):
            b.below, b.inside = counts[f"b{i}"]["below"], counts[f"b{i}"]["inside"]
            if not b.below <= b.first <= b.last < b.below + b.inside:
                b.low, b.high = limits[b.column]
                missed = True
        if not missed or again:
            return


def _narrowed(rows: DataFrame, brackets: list[_Bracket]) -> None:
    """Brackets cut again by sketches of the rows inside them."""
    aggs = []
    for i, b in enumerate(brackets):
        inside = F.when(F.col(b.column).between(b.low, b.high), F.col(b.column))
        shares = [min(1.0, max(0.0, (b.first - b.below) / b.inside - 3 / ACCURACY)), min(1.0, max(0.0, (b.last + 1 - b.below) / b.inside + 3 / ACCURACY))]
        aggs.append(F.approx_percentile(inside, F.array(*map(F.lit, shares)), ACCURACY).alias(f"b{i}"))
    found = rows.agg(*aggs).first()
    for i, b in enumerate(brackets):
        b.low, b.high = found[f"b{i}"]


def _values(rows: DataFrame, brackets: list[_Bracket]) -> list[list[tuple[float, int]]]:
    """Distinct values inside each bracket with their counts, in order."""
    out: list[list[tuple[float, int]]] = [[] for _ in brackets]
    if not brackets:
        return out
    marked = F.filter(F.array(*(F.when(F.col(b.column).between(b.low, b.high), F.struct(F.lit(i).alias("i"), F.col(b.column).alias("v"))) for i, b in enumerate(brackets))), lambda x: x.isNotNull())
    for r in rows.select(F.inline(marked)).groupBy("i", "v").count().collect():  # at most `most` rows a bracket
        out[r["i"]].append((r["v"], r["count"]))
    for i, found in enumerate(out):
        out[i] = sorted(found, key=lambda x: (x[0] != x[0], x[0]))
    return out


def _pick(values: list[tuple[float, int]], bracket: _Bracket, rank: int) -> float:
    at = bracket.below
    for value, n in values:
        at += n
        if rank < at:
            return value
    raise AssertionError("an order statistic lies outside its bracket")
