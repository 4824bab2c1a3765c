import math
import unicodedata

import duckdb
import pytest

import __spark_entry__ as entry
from alignspark import catalogue

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "-"
        return f"{float(v):.6g}" if not isinstance(v, (str, bool)) and hasattr(v, "__float__") else str(v)

    return [columns[i] for i in order], sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.execute(catalogue.oracle_sql()[name])
    want = canonical([d[0] for d in rel.description], rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_clean_unicode_takes_whole_texts(spark, duck):
    want = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    assert max(len(t) for t in want.values()) > 200
    got = {r.doc_id: r.text for r in catalogue.queries()["clean_unicode"](spark, SF).collect()}
    assert got == {i: unicodedata.normalize("NFKC", t) for i, t in want.items()}


def test_key_of_lineitem_is_composite(spark, duck):
    (got,) = catalogue.queries()["pk_infer_lineitem"](spark, SF).collect()
    key = got["columns"].split(",")
    assert len(key) > 1 and got.tested == len(key) and got.is_unique
    for n in range(1, len(key) + 1):
        repeated = duck.execute(f"SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY {','.join(key[:n])} HAVING count(*) > 1)").fetchone()[0]
        assert (repeated == 0) == (n == len(key))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
