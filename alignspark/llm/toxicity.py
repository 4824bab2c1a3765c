"""Toxicity by nearest labelled examples under TF-IDF cosine, found with a block-max inverted index.

Terms are the words of a text and, as stems, the first five characters of
longer words.  Every term that two examples of the bounded sample share is
indexed.  A term's weight is its inverse document frequency times the number of
standard errors by which its shares among toxic and other examples differ, so
that words which say nothing about the label count little and no word is left
out; vectors of (1 + log count) * weight are unit length.

Examples are dealt into blocks of similar ones.  For each term the index holds
an entry for each block where it occurs: its largest weight there and its
postings (example, weight).  A query's product with the largest weights bounds
each block; the blocks of the largest bounds are opened, then all others whose
bound reaches the k-th best similarity, so the nearest neighbours are exact.
They vote weighted by similarity; a logistic fit on the leave-one-out votes of
all examples calibrates the score.  The nearest examples are the evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .examples import FOLDS, Counted, class_weights, counted_terms, fit_logistic, labelled_sample

_WORD = re.compile(r"[^\W\d_]+")
STEM = 5


def word_terms(text: str) -> dict[str, int]:
    """Counts of words, and of the first characters of longer words (marked with a star)."""
    found = Counter(_WORD.findall(text.lower()))
    stems: dict[str, int] = {}
    for word, n in found.items():
        if len(word) > STEM:
            stem = word[:STEM] + "*"
            stems[stem] = stems.get(stem, 0) + n
    found.update(stems)
    return found


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


@dataclass
class BlockMaxIndex:
    """Examples in block order, and for each term its entries (block, largest weight, postings).

    Terms that more than one in ``dense`` examples hold have rows of all
    examples' weights instead, in a matrix that is made from the postings where
    it is first used.
    """

    index: dict[str, int]
    weights: np.ndarray  # of the terms
    term_at: np.ndarray  # first entry of each term, and the number of entries
    entry_block: np.ndarray
    entry_most: np.ndarray
    entry_at: np.ndarray  # first posting of each entry, and the number of postings
    example: np.ndarray
    value: np.ndarray
    ids: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    block: int
    k: int
    prior: float
    slope: float = 0.0
    shift: float = 0.0
    dense: int = 32

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k not in ("common", "rows")}

    def _rows(self) -> None:
        """Rows of the frequent terms (by block, padded), and each term's row or -1."""
        postings = self.entry_at[self.term_at]
        often = np.flatnonzero(np.diff(postings) * self.dense > len(self.ids))
        self.common = np.full(len(self.weights), -1, np.int64)
        self.common[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), -(-len(self.ids) // self.block) * self.block), np.float32)
        for r, t in enumerate(often.tolist()):
            own = slice(int(postings[t]), int(postings[t + 1]))
            self.rows[r, self.example[own]] = self.value[own]

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Known terms and their unit-length weights."""
        at = np.fromiter(map(self.index.get, counts, repeat(-1)), np.int64, len(counts))
        known = at >= 0
        at = at[known]
        v = ((1 + np.log(np.fromiter(counts.values(), np.float64, len(counts))[known])) * self.weights[at]).astype(np.float64)
        length = np.sqrt((v * v).sum())
        return (at, v / length) if length > 0 else (at[:0], v[:0])

    def nearest(self, queries: list[dict[str, int]], without: list[int] | None = None, first: int = 8) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, places and similarities of the k nearest examples with a common term, best first; ties by place."""
        if not hasattr(self, "rows"):
            self._rows()
        vectors = [self.vector(q) for q in queries]
        often = np.zeros((len(queries), len(self.rows)), np.float32)
        for i, (at, v) in enumerate(vectors):
            row = self.common[at]
            often[i, row[row >= 0]] = v[row >= 0]
        parts = often @ self.rows
        return [self._search(at, v, parts[i], None if without is None else without[i], first) for i, (at, v) in enumerate(vectors)]

    def _search(self, at: np.ndarray, v: np.ndarray, sims: np.ndarray, without: int | None, first: int) -> tuple[np.ndarray, np.ndarray]:
        """From the similarities by the frequent terms: blocks in order of their bounds, the other terms' postings in them."""
        rare = self.common[at] < 0
        at, v = at[rare], v[rare].astype(np.float32)
        sizes = self.term_at[at + 1] - self.term_at[at]
        entries, of = _ranges(self.term_at[at], sizes), np.repeat(v, sizes)
        blocks = self.entry_block[entries]
        bounds = sims.reshape(-1, self.block).max(axis=1) if len(sims) else np.zeros(0)
        bounds = bounds + np.bincount(blocks, weights=of * self.entry_most[entries], minlength=len(bounds))
        if without is not None:
            sims[without] = -np.inf

        def opened(wanted: np.ndarray) -> None:
            some = wanted[blocks]
            e = entries[some]
            sizes = self.entry_at[e + 1] - self.entry_at[e]
            p = _ranges(self.entry_at[e], sizes)
            np.add(sims, np.bincount(self.example[p], weights=np.repeat(of[some], sizes) * self.value[p], minlength=len(sims)), out=sims, casting="same_kind")

        now = np.zeros(len(bounds), bool)
        now[np.argsort(-bounds, kind="stable")[:first]] = True
        opened(now)
        inside = sims[np.repeat(now, self.block)]
        least = np.partition(inside, len(inside) - self.k)[len(inside) - self.k] if len(inside) > self.k else 0.0
        rest = ~now & (bounds > 0) & (bounds >= least - 1e-5)
        opened(rest)
        found = np.flatnonzero(np.where(np.repeat(now | rest, self.block), sims, 0) > 1e-9)
        if len(found) > self.k:  # ties of the k-th stay until they are put in order
            found = found[sims[found] >= np.partition(sims[found], len(found) - self.k)[len(found) - self.k]]
        best = found[np.lexsort((found, -sims[found]))[: self.k]]
        return best, sims[best].astype(np.float64)

    def vote(self, places: np.ndarray, sims: np.ndarray) -> float:
        w = sims**2 * self.weight[places]
        return float(((w * self.label[places]).sum() + self.prior) / (w.sum() + 1))

    def scores(self, queries: list[dict[str, int]], step: int = 64) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Calibrated score and neighbours of each query; without neighbours the vote is the share of toxic labels."""
        for a in range(0, len(queries), step):
            for places, sims in self.nearest(queries[a : a + step]):
                z = self.slope * self.vote(places, sims) + self.shift
                yield 1 / (1 + float(np.exp(-np.clip(z, -30, 30)))), places, sims


def build(found: Counted, counts: dict[int, int], k: int, block: int) -> BlockMaxIndex:
    """The index of counted examples."""
    y, size, words = found.label, len(found.ids), len(found.vocab)
    term, doc, df = found.term, found.row, found.df
    ones, zeros = max(float(y.sum()), 1e-9), max(float((1 - y).sum()), 1e-9)
    toxic = np.bincount(term, weights=y[doc], minlength=words)
    share = df / max(1, size)
    errors = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / ones + 1 / zeros))
    weights = np.log((1 + size) / np.maximum(df, 1)) * np.abs(toxic / ones - (df - toxic) / zeros) / errors
    value = (1 + np.log(found.count)) * weights[term]
    lengths = np.sqrt(np.bincount(doc, weights=value * value, minlength=size))
    value /= np.maximum(lengths[doc], 1e-12)
    # examples in order of the term that weighs most in them, so that blocks hold similar ones
    main = np.full(size, words)
    by_value = np.lexsort((term, value))
    main[doc[by_value]] = term[by_value]
    order = np.argsort(main, kind="stable")
    place = np.empty(size, np.int64)
    place[order] = np.arange(size)
    sort = np.lexsort((place[doc], term))
    term, example, value = term[sort], place[doc][sort], value[sort]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (example[1:] // block != example[:-1] // block)
    starts = np.flatnonzero(new)
    return BlockMaxIndex(
        {t: i for i, t in enumerate(found.vocab)}, weights, np.searchsorted(term[starts], np.arange(words + 1)).astype(np.int32), (example[starts] // block).astype(np.int16), (np.maximum.reduceat(value, starts) if len(starts) else value).astype(np.float32), np.append(starts, len(term)).astype(np.int32),
        example.astype(np.int32), value.astype(np.float32), found.ids[order], y[order], class_weights(y, found.n, counts)[order], block, k, counts.get(1, 0) / max(1, sum(counts.values())),
    )


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_each: int = 2000, least: int = 2, k: int = 15, block: int = 32, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text") -> BlockMaxIndex:
    """Fit on at most ``max_each`` labelled rows of each class; the driver holds their counted terms.

    The votes that calibrate the score are taken by Spark, one for each example
    without itself.
    """
    common.small_batches(docs.sparkSession)
    sample, counts = labelled_sample(docs, labels, label, max_each, folds, id_col, text_col)
    sample = common.written(sample, "sample")
    model = build(counted_terms(sample, word_terms, least), counts, k, block)
    sent = docs.sparkSession.sparkContext.broadcast((model, {i: p for p, i in enumerate(model.ids.tolist())}))  # at most 2 * max_each examples

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, place = sent.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = [f for a in range(0, len(ids), 64) for f in index.nearest([word_terms(t) for t in batch.column(1)[a : a + 64].to_pylist()], [place[i] for i in ids[a : a + 64]])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([index.vote(*f) for f in found], pa.float64())], ["doc_id", "vote"])

    at = sent.value[1]
    told = [(at[r["doc_id"]], r["vote"]) for r in sample.select("doc_id", "text").repartition(16).mapInArrow(votes, "doc_id long, vote double").collect()]
    if not told:
        return model
    x = np.empty(len(told))
    x[[p for p, _ in told]] = [v for _, v in told]
    slope, shift = fit_logistic(x, model.label, model.weight)
    return replace(model, slope=slope, shift=shift)


def score(docs: DataFrame, model: BlockMaxIndex, threshold: float = 0.5, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, and as evidence the nearest examples with their similarities.

    Texts that are null, empty or without an indexed term have no neighbours;
    their vote is the share of toxic labels.  Null ids have a null held_out;
    repeated rows score alike; long texts are read whole; an empty table gives
    no rows; without labelled rows every score is one half.  Columns other
    than the two named are not read.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # at most 2 * max_each examples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            scores, near, sims = [], [], []
            for s, p, c in index.scores([word_terms(t) for t in batch.column(2).to_pylist()]):
                scores.append(s)
                near.append(index.ids[p[:3]].tolist())
                sims.append(c[:3].tolist())
            every = np.array(scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(every), pa.array((every >= threshold).astype(np.int32)), pa.array(near, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float64()))],
                ["doc_id", "held_out", "score", "predicted", "evidence_ids", "evidence_similarities"],
            )

    doc_id = F.col(common.quoted(id_col)).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), (common.fold(doc_id, folds) == 0).alias("held_out"), F.coalesce(F.col(common.quoted(text_col)), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence_ids array<long>, evidence_similarities array<double>")


def clean_rows(docs: DataFrame, model: BlockMaxIndex, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold; nothing is joined or moved.

    A row is judged by its text alone: null texts count as empty, repeated
    rows and null ids go or stay by their text, an empty table stays empty,
    and other columns pass through whatever their names.
    """
    common.small_batches(docs.sparkSession)
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            yield batch.filter(pa.array([s < threshold for s, _, _ in index.scores([word_terms(t or "") for t in batch.column(at).to_pylist()])], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
