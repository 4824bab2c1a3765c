import hashlib
import io
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from alignspark.llm import byte_bpe, queries, token_counts, token_files
from alignspark.llm import sentencepiece_codec as S

from .conftest import SF

BPE, SP = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
ODD = ["", " ", "a  b", " a b ", "\n\n a \n b", "héllo wörld 中文 テスト 🙂🙂", "foo▁bar ▁ x", "x\u00a0y \u2003z", "it's don't 's 'll we'LL", "<s> </s> <0x0A> <|endoftext|> x<|endoftext|>y", "\x00\x01\x1c \x1d a", "a" * 5000, "tab\tsep \t two", "end space ", "ⅷ² ½ a½ é äb", "... !!! word.\nNext?!", "ss" * 3000 + " " + "▁" * 40]


@pytest.fixture(scope="module")
def bpe():
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=SP)


def test_byte_bpe(bpe, texts):
    own = byte_bpe.ByteBpe(BPE, limit=50)  # small: generations turn over
    for t in [*ODD, *list(texts.values())[:60]]:
        want = bpe.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == want
        assert own.count(t) == len(want)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\t'.!aAé1½中▁-s\u00a0", max_size=40))
def test_any_text(t):
    assert np.frombuffer(byte_bpe.encoder(BPE).encode(t), "<u4").tolist() == byte_bpe.encoder(BPE).tokenizer.encode(t, add_special_tokens=False).ids
    codec = S.encoder(SP)
    assert codec.encode(t) == codec.processor.encode(t)


def test_sentencepiece(sp, texts):
    codec = S.encoder(SP)
    for t in [*ODD, *texts.values()]:
        assert codec.encode(t) == sp.encode(t)


def test_backtracking_steps_back():
    codec = S.encoder(SP)
    words = sorted(codec.reachable, key=lambda t: (len(t), t))[-400:]
    for a, b in zip(words, reversed(words), strict=True):
        text = (a + b).replace(S.MARK, "")
        assert codec.encode(text) == codec.processor.encode(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=30), max_size=12), st.sampled_from(["bit", "byte"]))
def test_planes_round_trip(docs, kind):
    out = io.BytesIO()
    w = token_files.PlaneWriter(out, block=16, kind=kind)
    for i, d in enumerate(docs):
        w.add(i or None, np.array(d, "<u4"))
    assert w.close() == sum(map(len, docs))
    back = list(token_files.PlaneReader(out).documents())
    assert [(i or 0, a.tolist()) for i, a in back] == list(enumerate(docs))


def test_bad_file():
    with pytest.raises(ValueError):
        token_files.PlaneReader(io.BytesIO(b"x" * 40))


def test_token_file_query(spark, bpe, texts):
    start, want = 0, []
    for i in sorted(texts):
        ids = [*bpe.encode(texts[i], add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op6_token_files(spark, SF).collect()) == want


def test_token_files_odd_rows(odd, none):
    got = token_files.token_file_digest(odd, BPE, kind="bit", block=64).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 2, 3, 4, 5, 6, 7]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    assert token_files.token_file_digest(none, BPE).count() == 0


def test_codec_query(spark, sp, texts):
    want = {i: (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()) for i, ids in ((i, sp.encode(t)) for i, t in texts.items())}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op7_sentencepiece(spark, SF).collect()} == want


def test_codec_odd_rows(odd, none, sp):
    got = S.encode_decode(odd, SP).collect()
    want = odd.collect()
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in got) == sorted((str(r.doc_id), sp.encode(r.text or ""), sp.decode(sp.encode(r.text or ""))) for r in want)
    assert S.encode_digest(none, SP).count() == 0


def test_token_counts(spark, bpe, texts):
    n = sorted(len(bpe.encode(t, add_special_tokens=False).ids) for t in texts.values())
    sums = queries.op10_token_counts(spark, SF).cache()
    rows = {r.context_limit: r for r in sums.collect()}
    assert set(rows) == set(n)
    for limit, r in rows.items():
        assert (r.docs_at, r.docs_ge, r.tokens_ge, r.total_tokens) == (n.count(limit), sum(x >= limit for x in n), sum(x for x in n if x >= limit), sum(n))
        assert r.truncated_tokens == sum(min(x, limit) for x in n) and r.lost_tokens == sum(max(0, x - limit) for x in n)
    for limit in (0, 7, 100, 10**9):
        a = token_counts.answer(sums, limit)
        assert a["truncated_tokens"] == sum(min(x, limit) for x in n) and a["docs_ge"] == sum(x >= limit for x in n)
    assert token_counts.quantile(sums, 0.5) == n[len(n) // 2 - 1]


def test_token_counts_odd_rows(odd, none):
    sums = token_counts.suffix_sums(token_counts.length_histogram(odd, BPE), width=4)
    assert sums.where("context_limit = 0").first().docs_at == 2
    assert sums.agg(F.max("docs_ge")).first()[0] == 9
    empty = token_counts.suffix_sums(token_counts.length_histogram(none, BPE))
    assert empty.count() == 0 and token_counts.answer(empty, 5)["total_tokens"] == 0
