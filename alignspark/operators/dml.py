"""INSERT, UPSERT, UPDATE and tracked UPDATE as DataFrame algebra.

Nothing is changed in place: each function returns the new table.  Row order in
the source matters (the last of several rows for a key wins), so a source may
carry an order column; ``with_order`` adds one at ingest.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import predicates

ORDER = "_ord"


def with_order(df: DataFrame, by: list[str] | None = None, dense: bool = False) -> DataFrame:
    """Attach the order column: dense by the given columns, else increasing in file order, dense if asked.

    Dense file order takes one more pass, which counts the rows of each
    partition; df must give the same partitions both times, as files do.

    A dense number needs a global sort; its offsets come from one count for each
    range partition, not from a single-partition window.  The sorted rows are
    kept on disk, since a second sampling could cut the ranges elsewhere.
    """
    if not by:
        numbered = df.withColumn(ORDER, F.monotonically_increasing_id())
        if not dense:
            return numbered
        part = F.shiftright(F.col(ORDER), 33)
        starts, at = [], 0
        for r in sorted(numbered.groupBy(part.alias("p")).count().collect(), key=lambda r: r["p"]):  # one row a partition
            starts += [F.lit(r["p"]), F.lit(at)]
            at += r["count"]
        return numbered.withColumn(ORDER, F.element_at(F.create_map(*starts), part).cast("long") + F.col(ORDER) - F.shiftleft(part, 33)) if starts else numbered
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
    part = F.shiftright(F.col("_id"), 33)
    sizes = sorted(ranged.groupBy(part.alias("p")).count().collect(), key=lambda r: r["p"])  # one row a partition
    starts, at = [], 0
    for r in sizes:
        starts += [F.lit(r["p"]), F.lit(at)]
        at += r["count"]
    if not starts:
        return df.withColumn(ORDER, F.lit(0).cast("long"))
    first = F.create_map(*starts)
    return ranged.withColumn(ORDER, F.element_at(first, part).cast("long") + F.col("_id") - F.shiftleft(part, 33)).drop("_id")


def check_columns(df: DataFrame, columns: list[str]) -> None:
    known = {c.lower() for c in df.columns}
    unknown = sorted(c for c in columns if c.lower() not in known)
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")


def check_keys(keys: list[str], unique_sets: list[list[str]]) -> None:
    """Keys must be a declared primary key or unique set, in any order."""
    asked = {k.lower() for k in keys}
    if not any(asked == {c.lower() for c in s} for s in unique_sets):
        raise ValueError(f"{sorted(asked)} is no declared key; declared: {unique_sets}")


def _aligned(source: DataFrame, target: DataFrame) -> DataFrame:
    """The source with the target's spelling and types of column names; order column kept."""
    names = {c.lower(): c for c in target.columns}
    types = {f.name: f.dataType for f in target.schema}
    out = []
    for c in source.columns:
        if c == ORDER:
            out.append(F.col(c))
        elif c.lower() in names:
            out.append(F.col(f"`{c}`").cast(types[names[c.lower()]]).alias(names[c.lower()]))
    return source.select(*out)


def insert(target: DataFrame, source: DataFrame) -> DataFrame:
    """Append by name; columns the source lacks are NULL, unknown ones raise."""
    check_columns(target, [c for c in source.columns if c != ORDER])
    return target.unionByName(_aligned(source, target).drop(ORDER), allowMissingColumns=True)


def last_wins(source: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows of each key the one with the highest order; aggregated before the shuffle, so a hot key is no hot task.

    Without an order column the row with the largest hash of all its columns
    wins, so that the choice does not change when a task runs again.
    """
    if ORDER not in source.columns:
        source = source.withColumn(ORDER, F.xxhash64(*(F.col(f"`{c}`") for c in source.columns)))
        return last_wins(source, keys).drop(ORDER)
    rest = [c for c in source.columns if c not in keys]
    packed = source.groupBy(*keys).agg(F.max(F.struct(F.col(ORDER), *(F.col(f"`{c}`") for c in rest if c != ORDER))).alias("_last"))
    return packed.select(*keys, *(F.col(f"_last.`{c}`").alias(c) for c in rest))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], unique_sets: list[list[str]] | None = None) -> DataFrame:
    """Matched rows take every supplied non-key column, NULLs too; the rest is inserted.

    NULL keys never match: such source rows are inserted.  Of equal keys the
    last row wins.
    """
    if unique_sets is not None:
        check_keys(keys, unique_sets)
    check_columns(target, [c for c in source.columns if c != ORDER])
    src = _aligned(source, target)
    names = {c.lower(): c for c in target.columns}
    keys = [names[k.lower()] for k in keys]
    no_null = F.lit(True)
    for k in keys:
        no_null &= F.col(f"`{k}`").isNotNull()
    keyed = last_wins(src.where(no_null), keys).drop(ORDER)
    supplied = [c for c in keyed.columns if c not in keys]
    renamed = keyed.select(*(F.col(f"`{c}`").alias(f"_s_{c}") for c in keyed.columns), F.lit(True).alias("_new"))
    on = None
    for k in keys:
        on = target[k] == renamed[f"_s_{k}"] if on is None else on & (target[k] == renamed[f"_s_{k}"])
    both = target.withColumn("_old", F.lit(True)).join(renamed, on, "full_outer")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.when(F.col("_old"), F.col(f"`{c}`")).otherwise(F.col(f"`_s_{c}`")).alias(c))
        elif c in supplied:
            out.append(F.when(F.col("_new"), F.col(f"`_s_{c}`")).otherwise(F.col(f"`{c}`")).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    merged = both.select(*out)
    return merged.unionByName(src.where(~no_null).drop(ORDER), allowMissingColumns=True)


def _equal_pairs(items: Any) -> list[predicates.Condition] | None:
    """The conditions, if all are equalities with the source."""
    found = predicates.parse(items if isinstance(items, list) else [items])
    return found if all(c.from_source and c.op == "=" for c in found) else None


def needs_order(source: DataFrame, items: Any) -> bool:
    """Whether a row's update could change which target rows a later source row meets.

    That is so if a column that is set is also tested by anything but equality
    with the same source column.
    """
    found = predicates.parse(items if isinstance(items, list) else [items])
    names = {c.lower() for c in source.columns}
    return any(c.column.lower() in names and not (c.from_source and c.op == "=") for c in found)


def update(target: DataFrame, source: DataFrame, items: Any, expression: str | None = None) -> DataFrame:
    """For each source row SET its columns on the target rows its predicate meets; later rows win.

    Equalities with the source are one equi-join after an aggregation that
    leaves one source row for each key.  Conditions on literals alone need no
    join: the last source row decides.  Any other predicate is an outer join on
    it, of which each target row keeps the last source row.  A source whose
    rows could see each other's changes (``needs_order``) is refused with more
    than one row.
    """
    check_columns(target, [c for c in source.columns if c != ORDER])
    src = _aligned(source, target)
    sets = [c for c in src.columns if c != ORDER]
    conditions = predicates.parse(items if isinstance(items, list) else [items])
    equal = _equal_pairs(items) if not expression else None
    if equal:
        names = {c.lower(): c for c in target.columns}
        keys = [names[c.column.lower()] for c in equal if c.column.lower() in {x.lower() for x in src.columns}]
        if not keys:
            raise ValueError("no condition is left")
        one = last_wins(src.dropna(subset=keys), keys).drop(ORDER).select(*(F.col(f"`{c}`").alias(f"_s_{c}") for c in sets), F.lit(True).alias("_hit"))
        on = None
        for k in keys:
            on = target[k] == one[f"_s_{k}"] if on is None else on & (target[k] == one[f"_s_{k}"])
        both = target.join(one, on, "left")
    else:
        if needs_order(src.drop(ORDER), items) and len(src.take(2)) > 1:
            raise ValueError("rows of this source could change what later rows meet; update with one row at a time")
        order = F.col(ORDER) if ORDER in src.columns else F.lit(0)
        values = F.struct(*(F.col(f"`{c}`").alias(c) for c in sets)).alias("_v")
        if not any(c.from_source for c in conditions):
            last = src.agg(F.max_by(F.struct(*(F.col(f"`{c}`").alias(c) for c in sets)), order).alias("_v"))  # one row
            met = target.withColumn("_met", predicates.where(target, items, expression)).join(F.broadcast(last))
            merged = met.withColumn("_hit", F.coalesce("_met", F.lit(False)) & F.col("_v").isNotNull())
        else:
            rows = target.withColumn("_row", F.monotonically_increasing_id())
            packed = src.select("*", order.alias("_o"), values)
            joined = rows.join(packed, predicates.where(rows, items, expression, packed), "left")
            # the row number is made once, before the join, and grouped after it
            grouped = joined.groupBy("_row").agg(F.first(F.struct(*(rows[c].alias(c) for c in target.columns))).alias("_t"), F.max_by("_v", "_o").alias("_v"))
            merged = grouped.select("_t.*", "_v", F.col("_v").isNotNull().alias("_hit"))
        both = merged.select(*(F.col(f"`{c}`") for c in target.columns), *(F.col(f"_v.`{c}`").alias(f"_s_{c}") for c in sets), "_hit")
    return both.select(*(F.when(F.col("_hit"), F.col(f"`_s_{c}`")).otherwise(F.col(f"`{c}`")).alias(c) if c in sets else F.col(f"`{c}`") for c in target.columns))


def update_count(target: DataFrame, source: DataFrame, items: Any, expression: str | None = None) -> DataFrame:
    """One row, `updated`: matches summed over source rows, so a target row that two of them meet counts twice."""
    src = _aligned(source, target)
    equal = _equal_pairs(items) if not expression else None
    if equal:
        names = {c.lower(): c for c in target.columns}
        keys = [names[c.column.lower()] for c in equal]
        a = target.groupBy(*keys).agg(F.count("*").alias("_a"))
        b = src.groupBy(*keys).agg(F.count("*").alias("_b"))
        return a.join(b, keys).agg(F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0)).cast("long").alias("updated"))
    return target.join(src, predicates.where(target, items, expression, src), "inner").agg(F.count("*").cast("long").alias("updated"))


def snapshot(target: DataFrame, source: DataFrame, keys: list[str], exact: bool = False) -> DataFrame:
    """Target rows a tracked update keeps: each key's value occurs in the source.

    Keys are tested one by one, so for several keys this is a superset;
    ``exact`` tests them together.
    """
    src = _aligned(source, target)
    if exact:
        return target.join(src.select(*keys).distinct(), keys, "left_semi")
    out = target
    for k in keys:
        out = out.join(src.select(k).distinct(), k, "left_semi")
    return out.select(*target.columns)


def tracker_rows(target: DataFrame, source: DataFrame, keys: list[str], at: Column | None = None, exact: bool = False) -> DataFrame:
    return snapshot(target, source, keys, exact).withColumn("track_inserted_at", F.current_timestamp() if at is None else at)


def update_track(target: DataFrame, source: DataFrame, items: Any, expression: str | None = None, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows for the tracker table, new target); without a match neither has changes."""
    keys = [c.column for c in predicates.parse(items if isinstance(items, list) else [items])]
    return tracker_rows(target, source, keys, at), update(target, source, items, expression)


@dataclass
class Isolation:
    """A load split by validity: rows to write, and rows kept back with the reason."""

    good: DataFrame
    bad: DataFrame
    summary: DataFrame = field(repr=False)


def isolate(source: DataFrame, valid: Column, chunk: int = 10_000, tolerance: int = 5) -> Isolation:
    """Bulk load with row isolation: in each chunk of rows by order, rows after the tolerance-th bad one are not tried.

    The running count is a window within a chunk, so its partitions hold at
    most ``chunk`` rows.
    """
    chunked = source.withColumn("_chunk", F.floor(F.col(ORDER) / chunk)).withColumn("_bad", ~F.coalesce(valid, F.lit(False)))
    w = Window.partitionBy("_chunk").orderBy(ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = chunked.withColumn("_run", F.sum(F.col("_bad").cast("int")).over(w))
    tried = (F.col("_run") < tolerance) | ((F.col("_run") == tolerance) & F.col("_bad"))
    status = F.when(~tried, "unprocessed").when(F.col("_bad"), "failed").otherwise("success")
    judged = counted.withColumn("_status", status).drop("_bad", "_run")
    summary = judged.groupBy("_chunk").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("_status") == "success").alias("success"),
        F.count_if(F.col("_status") == "failed").alias("failed"),
        F.count_if(F.col("_status") == "unprocessed").alias("unprocessed"),
    )
    return Isolation(judged.where("_status = 'success'").drop("_status", "_chunk"), judged.where("_status <> 'success'"), summary)


def key_conflicts(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows an insert would refuse: key present in the target, or not the first of its key in the source."""
    src = _aligned(source, target)
    first = src.groupBy(*keys).agg(F.min(ORDER).alias("_first"))
    inside = src.join(first, keys).where(F.col(ORDER) > F.col("_first")).select(*src.columns)
    return src.join(target.select(*keys).distinct(), keys, "left_semi").select(*src.columns).unionByName(inside).dropDuplicates([ORDER])
