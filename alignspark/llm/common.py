"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def byte_words(text: str) -> list[bytes]:
    """Words of a text in UTF-8: A-Z lower-cased, split at runs of the six ASCII white-space bytes."""
    return text.encode("utf-8").lower().split()


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder in local mode (tests); an error on a
    cluster, whose executors would each write to a folder of their own.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local($|\[)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="alignspark-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of df with a Parquet table in the shared folder; a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """A column's name for F.col: names with dots or backticks are taken whole."""
    return "`" + name.replace("`", "``") + "`"


def fold(column: str | Column, n: int) -> Column:
    """crc32 of an id as decimal text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary") if isinstance(column, str) else column.cast("string").cast("binary")) % F.lit(n)


def one_row(df: DataFrame, keys: list[Column]) -> DataFrame:
    """One row, with all its columns, for each value of the keys: the one whose other columns have the smallest hash."""
    columns = [df[quoted(c)] for c in df.columns]
    hashed = [c for c, (_, kind) in zip(columns, df.dtypes, strict=True) if "map<" not in kind and "variant" not in kind]
    picked = df.groupBy(*(k.alias(f"_{i}") for i, k in enumerate(keys))).agg(F.min_by(F.struct(*columns), F.xxhash64(*hashed)).alias("_row"))
    return picked.select("_row.*")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows: a batch of long texts then stays some MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
