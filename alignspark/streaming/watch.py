"""Incremental loading: a manifest watcher for files that change in place, and streams for files that only come.

The streaming aggregates at the end are additions of this engine.
"""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.casting import cast_frame
from ..functions.text import robust_clean
from ..operators import dml
from ..operators.profile import infer_key
from ..pipeline import load
from ..sources.readers import read_csv
from ..sources.store import TableStore

log = logging.getLogger(__name__)


def listed(spark: SparkSession, folder: str, pattern: str = "*.csv") -> dict[str, int]:
    """Files and their modification times (ms) through Hadoop's file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return {s.getPath().toString(): s.getModificationTime() for s in found or []}


def scan_folder(spark: SparkSession, store: TableStore, folder: str, manifest: str) -> dict[str, str]:
    """Load new and changed CSV files of a folder; success, failed or skipped for each table.

    The first time a key is inferred and the table replaced, later rows are
    upserted by the key.  A file is left alone until it changes, after a
    failure too.  The manifest is written after every file.
    """
    at = Path(manifest)
    try:
        state = json.loads(at.read_text(encoding="utf-8")) if at.exists() else {}
    except json.JSONDecodeError:
        log.warning("%s cannot be read; starting anew", manifest)
        state = {}
    out = {}
    for path, mtime in sorted(listed(spark, folder).items()):
        table = Path(path).stem.lower().replace(" ", "_")
        known = state.get(table, {})
        if known.get("mtime") == mtime:
            out[table] = "skipped"
            continue
        keys = known.get("pk")
        try:
            df = cast_frame(robust_clean(read_csv(spark, path)))
            first = not keys or not store.exists(table)
            keys = keys or infer_key(df).columns
            found = load(spark, store, df, table, "replace" if first else "upsert", keys, clean=False, cast=False)
            state[table] = {"mtime": mtime, "pk": keys, "status": "success", "file": path, "rows": found["rows"]}
            out[table] = "success"
        except Exception as e:
            log.error("%s: %s", table, e)
            state[table] = {"mtime": mtime, "pk": known.get("pk"), "status": "failed", "file": path, "error": str(e)}
            out[table] = "failed"
        # replaced as a whole: a crash leaves the manifest of before
        beside = at.with_suffix(".next")
        beside.write_text(json.dumps(state, indent=2), encoding="utf-8")
        beside.replace(at)
    return out


def upsert_stream(spark: SparkSession, store: TableStore, stream: DataFrame, table: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Upsert every micro-batch; a batch that runs twice leaves the same table."""

    def one(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            base = store.version(table)
            store.write(table, dml.upsert(store.read(table, base), dml.with_order(batch), keys), base=base)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_files(spark: SparkSession, folder: str, schema: T.StructType, kind: str = "csv", **options) -> DataFrame:
    return spark.readStream.schema(schema).options(**({"header": True} if kind == "csv" else {}), **options).format(kind).load(folder)


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 day", late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts and sums in event-time windows; works on streams and tables alike."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def without_repeats(events: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Repeated events dropped within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def sessions(events: DataFrame, time: str = "ts", gap: str = "30 minutes", by: str = "user_id", late: str = "1 hour") -> DataFrame:
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
