import duckdb
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alignspark.operators.quantiles import quantiles

SHARES = [0.0, 0.25, 0.5, 0.9, 1.0]


def exact(values):
    t = pd.DataFrame({"v": values})  # noqa: F841
    return duckdb.sql(f"SELECT quantile_cont(v, {SHARES}) FROM t WHERE v IS NOT NULL").fetchall()[0][0]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-1e6, 1e6)), min_size=1, max_size=60))
def test_small_columns(spark, values):
    got = quantiles(spark.createDataFrame([(v,) for v in values], "v double"), {"v": F.col("v")}, SHARES)["v"]
    want = exact(values) if any(v is not None for v in values) else None
    assert got == (None if want is None else pytest.approx(want))


@pytest.mark.parametrize("most", [50_000, 40])
def test_large_columns(spark, most):
    """Continuous, skewed and nearly constant columns; with a small bound the brackets are cut again."""
    df = spark.range(120_000).select(
        (F.xxhash64("id") / 1e15).alias("spread"),
        F.when(F.col("id") % 10 < 7, 3.0).otherwise(F.col("id") * 1.0).alias("hot"),
        F.lit(5.0).alias("same"),
        F.lit(None).cast("double").alias("none"),
    )
    got = quantiles(df, {c: F.col(c) for c in df.columns}, SHARES, most)
    wide = df.toPandas()
    for c in ("spread", "hot", "same"):
        assert got[c] == pytest.approx(exact(wide[c].tolist()))
    assert got["none"] is None
