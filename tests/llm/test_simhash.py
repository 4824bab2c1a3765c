import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from alignspark.llm import queries, simhash

from .conftest import SF


def brute_print(t, width=4):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, distance=4):
    up = {i: i for i in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = list(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_query(spark, texts):
    fps = {i: brute_print(t) for i, t in texts.items()}
    groups = brute_groups(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, SF).collect()}
    assert got == {i: (f"{fps[i]:016x}", groups[i]) for i in fps}


def near_prints(n, seed=1):
    rnd = random.Random(seed)
    out = set()
    while len(out) < n:
        base = rnd.getrandbits(64)
        for _ in range(rnd.choice((1, 1, 1, 30))):
            out.add(base)
            for _ in range(rnd.randint(0, 5)):
                base ^= 1 << rnd.randrange(64)
    return {i: f for i, f in enumerate(sorted(out))}


@pytest.mark.parametrize("blocks,tile", [(6, 8192), (5, 8), (7, 16)])
def test_links_lose_nothing(spark, blocks, tile):
    fps = near_prints(300)
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()], "node long, fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.hamming_links(nodes, 4, blocks, tile)).collect()}
    want = brute_groups(fps)
    assert {i: roots.get(i, i) for i in fps} == want


def test_large_key_is_compared_in_blocks():
    fps = np.array(sorted(near_prints(1500, 3).values()), np.uint64)
    links = simhash._links(fps, np.arange(len(fps)), 4, step=64)
    forest = {i: i for i in range(len(fps))}

    def root(x):
        while forest[x] != x:
            x = forest[x]
        return x

    for a, b in links:
        forest[max(root(a), root(b))] = min(root(a), root(b))
    assert {i: root(i) for i in forest} == brute_groups({i: int(f) for i, f in enumerate(fps)})


def test_chain_components(spark):
    links = spark.range(1, 60).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v")).where("u <> 40")
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    assert all(roots[i] == (0 if i < 40 else 40) for i in roots if i != 40)


def test_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[3] == by[4] == by[5] == {("0" * 16, 3)}
    assert by[1] == by[2] and {c for _, c in by[2]} == {1} and {c for _, c in by[None]} == {None}
    assert simhash.near_duplicates(none).count() == 0
    stay = simhash.one_of_each(odd)
    assert stay.columns == odd.columns and sorted(str(r.doc_id) for r in stay.collect()) == sorted(map(str, [1, 3, None, 6, 7]))
    assert simhash.one_of_each(none).count() == 0


def test_nodes_are_fingerprints(spark):
    """A repeated id with two texts links neither of them to the other's group."""
    base = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(1, base), (5, base + " x"), (5, "quite another text of some words"), (None, base)], "doc_id long, text string")
    rows = simhash.near_duplicates(docs).collect()
    got = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    other = f"{brute_print('quite another text of some words'):016x}"
    assert got[5, other] == 5 and {c for (i, f), c in got.items() if f != other} == {1}


def test_one_row_of_each_group_stays(spark):
    """Null and repeated ids, repeated rows, clashing and dotted names."""
    t1, t2, q = ("one two three four five six", "seven eight nine ten eleven twelve", "a b c d e f g")
    docs = spark.createDataFrame([(1, t1, 0), (None, t1, 1), (None, t2, 2), (5, t1, 3), (5, q, 4), (5, q, 4), (None, t2, 5), (7, None, 6), (8, "", 7)], "doc_id long, text string, n int")
    for name in ("_row", "_i", "_a", "_stay", "fp", "k0", "root", "a.b", "_0"):
        docs = docs.withColumn(name, F.lit("clash"))
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, t1), (None, t2), (5, q), (7, None)], key=str)
    assert sorted(map(str, out.collect())) == sorted(map(str, simhash.one_of_each(docs.repartition(5)).collect()))
