import math

import duckdb
from pyspark.sql import functions as F

from alignspark.llm import queries
from alignspark.llm import url_filter as U

from .conftest import SF


def test_query_matches_sql(spark):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = con.execute(queries.SQL["op1_url_filter"])
    names = [d[0] for d in rel.description]
    want = sorted(str([r[names.index(n)] if n != "bound" else f"{r[names.index(n)]:.5f}" for n in sorted(names)]) for r in rel.fetchall())
    got = queries.op1_url_filter(spark, SF)
    assert sorted(str([r[n] if n != "bound" else f"{r[n]:.5f}" for n in sorted(got.columns)]) for r in got.collect()) == want


def test_urls_and_rules(spark):
    urls = ["http://A.Example.NET/en/x?q#f", "http://example.net", "https://example.net/de/", "ftp://x.example.com/de/?a", "http://é.org/fr/a", "http://badnet/x", "no scheme", None, "", "http://", "x://h://y/z", "http://h.net?x/y", "HTTP://U@H.ORG:80/FR/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    none = spark.createDataFrame([], "host string, good int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(pages, none, queries.URL_RULES).collect()}
    assert len(got) == len(urls)
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1][:3] == ("example.net", "", None)
    assert got[2] == ("example.net", "/de/", "net/", "block")
    assert got[3] == ("x.example.com", "/de/", "example.com/de/", "block")
    assert got[4] == ("é.org", "/fr/a", "org/fr/", "allow")
    assert got[5][2] is None and got[6][:2] == got[7][:2] == got[8][:2] == got[9][:2] == ("", "")
    assert got[10][:2] == ("h:", "//y/z") and got[11][:3] == ("h.net", "", None)
    assert got[12][:2] == ("u@h.org:80", "/FR/")
    assert U.filter_urls(pages.where("false"), none, {}).count() == 0


def test_reputation_shrinks(spark):
    rows = [("good.a.com", 1)] * 40 + [("bad.a.com", 0)] * 40 + [("few.a.com", 0)] * 2 + [("x.b.com", 1)] * 30 + [(None, 1), ("x.b.com", None)]
    rep = {(r.level, r.key): r for r in U.reputation(spark.createDataFrame(rows, "host string, good int")).collect()}
    good, bad, few = (rep["host", f"{h}.a.com"].mean for h in ("good", "bad", "few"))
    assert bad < few < good and few < rep["domain", "a.com"].mean
    total = rep["all", ""]
    assert math.isclose(total.mean, 71 / 114)
    assert all(r.bound < r["mean"] for r in rep.values())
    pages = spark.createDataFrame([(1, "http://new.a.com/"), (2, "http://q.org/"), (3, "http://bad.a.com/"), (3, "http://bad.a.com/")], "page_id long, url string")
    got = U.filter_urls(pages, spark.createDataFrame(rows, "host string, good int"), {}).collect()
    assert {(r.page_id, r.level) for r in got} == {(1, "domain"), (2, "all"), (3, "host")} and len(got) == 4
    assert {r.verdict for r in got if r.page_id == 3} == {"block"}


def test_public_suffixes(spark):
    rows = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk",), ("co.uk",), ("x.example.com",), ("com",), ("",)], "host string")
    got = [tuple(r) for r in rows.select(U.domain_of(rows.host), U.suffix_of(rows.host)).collect()]
    assert got == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("example.com", "com"), ("com", "com"), ("", "")]
