import corpus_pipeline
from alignspark.llm import decontaminate, queries, simhash, toxicity

from .conftest import SF
from .test_decontaminate import brute as leaks
from .test_simhash import brute_groups, brute_print


def test_pipeline_matches_brute_force(spark, texts, tmp_path):
    docs = queries.table(spark, SF, "documents")
    model = toxicity.fit(docs, queries.table(spark, SF, "labels"))
    left = {i: t for i, t in texts.items() if next(model.scores([toxicity.word_terms(t)]))[0] < 0.5}
    last = {}
    for i, t in left.items():
        last[t] = max(last.get(t, i), i)
    left = {i: t for t, i in last.items()}
    groups = brute_groups({i: brute_print(t, 5) for i, t in left.items()})
    left = {i: t for i, t in left.items() if groups[i] == i}
    items = {r.item_id: r.text for r in queries.table(spark, SF, "benchmark").collect()}
    bad = {d for d, _ in leaks(left, items)}
    left = {i: t for i, t in left.items() if i not in bad}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(left)
    assert all(got[i].decoded == left[i] and got[i].n_tokens == len(got[i].ids) for i in got)


def test_stages_keep_columns(spark, tmp_path):
    docs = queries.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontaminate", "sentencepiece"]
    assert simhash and decontaminate


def test_stages_on_odd_rows(spark, odd, none):
    """Null ids, repeated rows, empty tables: each stage judges rows by their text and leaves one row of a group."""
    docs = odd.select("doc_id", "text", "source")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        left = sorted(str(r.doc_id) for r in out.collect())
        want = {"toxicity": [1, 2, 2, 3, 4, None, 5, 6, 7], "exact_dedup": [2, 4, None, 5, 6, 7], "near_dedup": [1, 3, None, 6, 7], "decontaminate": [1, 2, 2, 3, 4, None, 5, 6, 7]}
        assert left == sorted(map(str, want[name])), name
        assert stage(spark, none.select("doc_id", "text", "source"), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
