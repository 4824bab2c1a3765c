import hashlib
from collections import defaultdict

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alignspark.llm import exact_dedup as E
from alignspark.llm import queries

from .conftest import SF


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=12), max_size=40), st.integers(0, 2000))
def test_trie(keys, keep):
    trie, want = E.PatriciaTrie(), {}
    for i, k in enumerate(keys):
        trie.add(k, i, i, 1)
        old = want.get(k, (i, i, 0))
        want[k] = (old[0], i, old[2] + 1)
    assert {k: tuple(e) for k, e in trie.terminals()} == want
    spilled = {k: tuple(e) for k, e in trie.spill(keep)}
    assert spilled | {k: tuple(e) for k, e in trie.terminals()} == want


def test_deep_trie():
    trie = E.PatriciaTrie()
    for n in range(3000):
        trie.add(b"a" * n, n, n, 1)
    assert sum(1 for _ in trie.terminals()) == 3000


def brute(pairs, pick):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t or ""].append(i)
    out = []
    for i, t in pairs:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = pick(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_query(spark, texts):
    assert sorted((tuple(r) for r in queries.op3_exact_dedup(spark, SF).collect()), key=str) == brute(list(texts.items()), max)


def test_odd_rows_and_spill(odd, none):
    pairs = [(r.doc_id, r.text) for r in odd.collect()]
    for keep, pick in (("largest", max), ("smallest", min)):
        got = E.exact_dedup(odd, keep=keep, trie_bytes=300)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(pairs, pick)
    assert E.exact_dedup(none).count() == 0
    kept = E.distinct_rows(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [2, 4, None, 5, 6, 7]))
    assert E.distinct_rows(none).count() == 0


def test_one_row_of_each_text_stays(spark):
    """Repeated winners, groups of null ids, clashing and dotted names; nothing rests on the order of rows."""
    docs = spark.createDataFrame([(1, "t", 0), (2, "t", 1), (2, "t", 2), (None, "t", 3), (None, "u", 4), (None, "u", 5), (3, None, 6), (4, "", 7)], "doc_id long, text string, n int")
    for name in ("_row", "_id", "_keep", "_len", "_sha", "_order", "_min", "a.b"):
        docs = docs.withColumn(name, F.lit("clash"))
    out = sorted(map(tuple, E.distinct_rows(docs).collect()), key=str)
    assert sorted(((r[0], r[1]) for r in out), key=str) == sorted([(2, "t"), (None, "u"), (4, "")], key=str)
    assert out == sorted(map(tuple, E.distinct_rows(docs.repartition(5)).collect()), key=str)
    assert E.distinct_rows(docs).columns == docs.columns


def test_partition_trie_spills_finished_texts():
    rows = sorted((len(k), hashlib.sha256(k).digest(), k, i, i, 1) for i, k in enumerate(str(j % 70).encode() * 20 for j in range(200)))
    batch = pa.RecordBatch.from_pylist([dict(zip(E._OUT.names, r, strict=True)) for r in rows], schema=E._OUT)
    for most in (1 << 20, 500):
        got = [r for b in E._merge(most)(iter([batch])) for r in b.to_pylist()]
        assert len(got) == 70 and sum(r["_n"] for r in got) == 200
