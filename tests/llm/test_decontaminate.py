import math
import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from alignspark.llm import decontaminate as D
from alignspark.llm import queries

from .conftest import SF


@pytest.mark.parametrize("length", range(12, 21))
def test_masks_survive_substitutions(length):
    """Every window keeps a whole mask under any choice of a fifth of its tokens, rounded down."""
    places = [(m, at) for m in D.MASKS for at in range(length - len(m) + 1)]
    care = [frozenset(at + i for i in D._care(m)) for m, at in places]
    missed = [c for c in combinations(range(length), length // 5) if all(p & set(c) for p in care)]
    assert not missed


@pytest.mark.parametrize("length", range(1, 12))
def test_runs_survive_substitutions(length):
    """Every short item keeps a whole run under any choice of the tokens that may differ."""
    may = length - math.ceil(length * 0.8)
    pieces = [set(range(a, a + n)) for a, n in D.runs(length)]
    assert sorted(x for p in pieces for x in p) == list(range(length))
    assert all(any(not p & set(c) for p in pieces) for c in combinations(range(length), may))


def test_items_of_every_length(spark):
    """One item for each length from 1 to 20; every pattern of substitutions (400 at most) is found, and one more is not."""
    rnd = random.Random(3)
    items = {n: [f"i{n}t{k}" for k in range(n)] for n in range(1, 21)}
    docs, want, d = [], set(), 0
    for n, item in items.items():
        may = n - math.ceil(n * 0.8)
        patterns = list(combinations(range(n), may))
        for c in rnd.sample(patterns, min(400, len(patterns))):
            docs.append((d, " ".join(["x", "y", *("z" if k in c else t for k, t in enumerate(item)), "w"])))
            want.add((d, n))
            d += 1
        if n > 1:
            c = rnd.sample(range(n), may + 1)
            docs.append((d, " ".join("z" if k in c else t for k, t in enumerate(item))))
            d += 1
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(n, " ".join(t)) for n, t in items.items()], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_scripts_without_spaces(spark):
    docs = spark.createDataFrame([(1, "前文天地玄黄宇宙洪荒日月盈昃后文"), (2, "天地玄黄")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "天地玄黄宇宙洪荒日月盈昃")], "item_id long, text string")
    assert [(r.doc_id, r.matched, r.window) for r in D.contaminated(docs, bench).collect()] == [(1, 12, 12)]


def tokens(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items, window=20, share=0.8):
    out = {}
    for d, t in docs.items():
        w = tokens(t)
        for i, x in items.items():
            it = tokens(x)
            k = min(window, len(it))
            best = 0
            for shift in range(-len(it) + 1, len(w)):
                a, b = max(0, -shift), min(len(it), len(w) - shift)
                same = [w[j + shift] == it[j] for j in range(a, b)]
                if sum(same) >= k * share:
                    best = max(best, max(sum(same[s : s + k]) for s in range(max(1, len(same) - k + 1))))
            if best >= k * share:
                out[d, i] = best
    return out


def test_planted_passages(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    items = {i: " ".join(rnd.choices(words, k=rnd.choice((15, 20, 40)))) for i in range(8)}
    docs = {}
    for d in range(60):
        t = rnd.choices(words, k=rnd.randint(0, 120))
        if d % 3:
            part = items[d % 8].split()
            for p in rnd.sample(range(len(part)), (d % 4) * len(part) // 25):
                part[p] = "changed"
            at = rnd.randint(0, len(t))
            t[at:at] = part
        docs[d] = " ".join(t).title() + "."
    got = D.contaminated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.matched for r in got.collect()} == brute(docs, items)


def test_query(spark, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    found = {(r.doc_id, r.item_id): r.matched for r in queries.op8_decontaminate(spark, SF).collect()}
    assert found == brute(texts, items)


def test_shuffled_join_gives_the_same(spark):
    a = queries.op8_decontaminate(spark, SF)
    b = D.contaminated(queries.table(spark, SF, "documents"), queries.table(spark, SF, "benchmark"), broadcast_bytes=0)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_odd_rows(spark, odd, none):
    item = "one two three four five six seven"
    bench = spark.createDataFrame([(1, item, "c"), (1, item, "c"), (2, None, "c"), (None, "word " * 30, "c"), (3, "short", "c")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): (r.matched, r.window) for r in D.contaminated(odd, bench).collect()}
    assert got[1, 1] == got[2, 1] == (7, 7) and {k for k in got if k[1] is not None} == {(1, 1), (2, 1)}
    assert D.contaminated(none, bench).count() == 0 and D.contaminated(odd, bench.where("false")).count() == 0
    clean = D.clean_rows(odd, bench)
    assert clean.columns == odd.columns and clean.count() == 6


def test_clean_rows_judge_by_text(spark):
    """A copy of an item goes whatever its id; another text under the same id stays; clashing and dotted names pass."""
    item = " ".join(f"t{i}" for i in range(15))
    docs = spark.createDataFrame([(None, item, 1), (None, "clean", 2), (3, item, 3), (3, "other", 4), (3, item, 5), (4, None, 6)], "doc_id long, text string, n int")
    for name in ("_leak", "_k0", "_k1", "_dt", "_of__k0", "item_id", "a.b", "shift"):
        docs = docs.withColumn(name, F.lit("clash"))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = D.clean_rows(docs, bench)
    assert clean.columns == docs.columns and sorted(r.n for r in clean.collect()) == [2, 4, 6]
    assert D.clean_rows(docs, bench.where("false")).count() == 6 and D.clean_rows(docs.where("false"), bench).count() == 0
