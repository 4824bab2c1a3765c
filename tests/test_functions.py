from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alignspark.functions import casting, coerce, text
from alignspark.plans.model import ColumnSpec, Family, Policies, TableSpec


def test_clean_text(spark):
    df = spark.createDataFrame([(" ﬁne\x00 ",), ("nan",), ("“a”…",), (None,)], "s string")
    assert [r[0] for r in df.select(text.clean_text(F.col("s"))).collect()] == ["fine", None, '"a"...', None]


def test_headers():
    assert text.clean_headers(["Total ($)", "a  b", "a-b", "!!"]) == ["Total", "a_b", "a_b_1", "col_4"]
    assert text.sanitize_names(["ORDER", "User Name", "123Col", "from"]) == ["order_", "user name", "_col_1", "from_"]
    assert text.sanitize_names(["123Col"], dialect="oracle", to_lower=False) == ["N123Col"]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(max_size=8), min_size=1, max_size=6))
def test_headers_are_valid(names):
    assert all(n for n in text.clean_headers(names))


def test_cast_frame(spark):
    df = spark.createDataFrame([("$1,000.50", "yes", "9/12/2024", "x"), ("2", "off", "2024-01-05", "7"), (None, None, None, "y")], "price string, ok string, made_date string, s string")
    out = casting.cast_frame(df)
    assert dict(out.dtypes) == {"price": "double", "ok": "boolean", "made_date": "timestamp", "s": "string"}
    r = out.first()
    assert r.price == 1000.5 and r.ok is True and (r.made_date.month, r.made_date.day) == (9, 12)


def test_cast_guard_and_segment(spark):
    df = spark.createDataFrame([("1",), ("2",), ("x",)], "n string")
    assert casting.infer_types(df) == {}
    assert casting.infer_types(df.where("n <> 'x'"), casting.CastConfig(mode="segment")) == {"n": "bigint"}
    assert casting.smart_convert(df, "n", "bigint").dtypes == [("n", "string")]
    assert casting.infer_types(df.limit(0)) == {}


def test_coerce(spark):
    df = spark.createDataFrame([(2.5, "abcdef", "on", 12345.678), (3.5, None, "?", -99999.0)], "i double, s string, b string, d double")
    spec = TableSpec("t", {"i": ColumnSpec("i", Family.INTEGER), "s": ColumnSpec("s", Family.STRING, max_length=3), "b": ColumnSpec("b", Family.BOOLEAN), "d": ColumnSpec("d", Family.DECIMAL, precision=6, scale=2)})
    out, report = coerce.coerce_frame(df, spec)
    assert [tuple(r) for r in out.collect()] == [(2, "abc", True, Decimal("9999.99")), (4, None, None, Decimal("-9999.99"))]
    assert [c["column"] for c in report.columns] == ["i", "s", "b", "d"]
    p = Policies()
    p.columns.extra_columns = "error"
    with pytest.raises(ValueError):
        coerce.coerce_frame(df.withColumn("z", F.lit(1)), spec, p)
