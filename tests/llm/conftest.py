import duckdb
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts():
    """doc_id -> text of the smallest documents table."""
    return dict(duckdb.connect().execute(f"SELECT doc_id, text FROM read_parquet('{SF}/documents.parquet')").fetchall())


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, and columns whose names clash."""
    rows = [
        (1, "one two three four five six seven", "x"),
        (2, "one two three four five six seven", "y"),
        (2, "one two three four five six seven", "y"),
        (3, "", "x"),
        (4, None, None),
        (None, "lonely text without an id", "x"),
        (5, "  \n\t ", "x"),
        (6, "word " * 30000, "x"),
        (7, "ünï cödé ▁ 中文 🙂 \x00\x1c end", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("label", "score", "_len", "_sha", "fp", "node", "block", "shard", "start", "length", "host", "_h"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
