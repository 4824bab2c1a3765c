"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

Terms are a text's words, its pairs of words, and, as a second view, how it is
written: the shapes of its words (letter case, digits, punctuation), words that
repeat the one before, and the order of its length.  Each view of a text is a
unit-length TF-IDF vector over the terms that ``least`` labelled examples
share; the two together are projected on the latent directions of the examples
(truncated decomposition).  The examples' latent vectors are broadcast, and
every document's exact cosines with all of them are computed in blocks.  The
nearest, ties included, vote with weights that fall with distance, and class
weights undo the sample's balance.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .examples import FOLDS, Counted, class_weights, counted_terms, labelled_sample

_LOWER = re.compile("[a-zß-öø-ÿ]+")
_UPPER = re.compile("[A-ZÀ-ÖØ-Þ]+")
_DIGIT = re.compile("[0-9]+")
_STYLE = "\t"  # marks terms of the second view; no word holds it


def text_terms(text: str) -> dict[str, int]:
    """Counts of words, word pairs and, marked, of word shapes, repeats and the order of length."""
    plain = text.split()
    words = text.lower().split()
    found: dict[str, int] = Counter(words)
    found.update(map(" ".join, zip(words, words[1:], strict=False)))
    found.update(map(_STYLE.__add__, _DIGIT.sub("0", _UPPER.sub("A", _LOWER.sub("a", text))).split()))
    repeats = sum(map(str.__eq__, plain, plain[1:]))
    if repeats:
        found[f"{_STYLE}= of ten"] = round(10 * repeats / len(plain)) or 1
        found[f"{_STYLE}="] = repeats
    if plain:
        found[f"{_STYLE}# {len(plain).bit_length()}"] = 1
    return found


def _times(row: np.ndarray, column: np.ndarray, value: np.ndarray, right: np.ndarray, rows: int, step: int = 1 << 17) -> np.ndarray:
    """Product of a sparse matrix, given in order of its rows, with a dense one."""
    out = np.zeros((rows, right.shape[1]), np.float32)
    for a in range(0, len(row), step):
        part = row[a : a + step]
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        out[part[starts]] += np.add.reduceat(value[a : a + step, None] * right[column[a : a + step]], starts, axis=0)
    return out


@dataclass
class LatentVotes:
    """A fitted classifier; its size is bounded by the sample and its terms."""

    index: dict[str, int]
    style: np.ndarray  # which terms belong to the second view
    idf: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    label_weight: np.ndarray
    weight: np.ndarray
    prior: float
    k: int
    sharp: float

    def vector(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms (those at -1 are not known) and their weights; each view is of unit length."""
        known = at >= 0
        at = at[known]
        v = (1 + np.log(counts[known].astype(np.float32))) * self.idf[at]
        style = self.style[at]
        lengths = np.sqrt([max((v[~style] ** 2).sum(), 1e-18), max((v[style] ** 2).sum(), 1e-18)])
        return at, (v / lengths[style.astype(np.int64)]).astype(np.float32)

    def project(self, terms: list[dict[str, int]]) -> np.ndarray:
        out = np.zeros((len(terms), self.directions.shape[1]), np.float32)
        for r, counts in enumerate(terms):
            at, v = self.vector(np.fromiter(map(self.index.get, counts, repeat(-1)), np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts)))
            out[r] = v @ self.directions[at]
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.maximum(norms, 1e-9)

    def score(self, terms: list[dict[str, int]], block: int = 256) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(terms), self.prior)
        every, out = self.project(terms), np.empty(len(terms))
        k = min(self.k, len(self.vectors))
        for at in range(0, len(every), block):
            cosine = every[at : at + block] @ self.vectors.T
            least = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k, None]
            near = np.exp(self.sharp * (cosine - 1)) * (cosine >= least - 1e-6)
            votes, total = near @ self.label_weight, near @ self.weight
            out[at : at + block] = (votes + 1e-12 * self.prior) / (total + 1e-12)
        return np.clip(out, 0.0, 1.0)


def build(found: Counted, counts: dict[int, int], rank: int, k: int, sharp: float) -> LatentVotes:
    """Fit on counted examples."""
    y, vocab, size = found.label, found.vocab, len(found.ids)
    prior = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    idf = np.log((1 + size) / np.maximum(found.df, 1)).astype(np.float32)
    model = LatentVotes({t: i for i, t in enumerate(vocab)}, np.array([t.startswith(_STYLE) for t in vocab], bool), idf, np.zeros((len(vocab), 1), np.float32), np.zeros((0, 1), np.float32), y, y, prior, k, sharp)
    if not size or not vocab:
        return model
    row, column = found.row, found.term
    value = (1 + np.log(found.count.astype(np.float32))) * idf[column]
    view = 2 * row + model.style[column]
    value = (value / np.sqrt(np.maximum(np.bincount(view, weights=value**2, minlength=2 * size), 1e-18))[view]).astype(np.float32)
    back = np.argsort(column, kind="stable")
    turned = column[back], row[back], value[back]
    # randomised range finder with power steps; a fixed seed makes fits repeatable
    basis = np.random.default_rng(0).standard_normal((len(vocab), min(len(vocab), size, rank + 16))).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(_times(*turned, _times(row, column, value, basis, size), len(vocab)))
    _, _, vt = np.linalg.svd(_times(row, column, value, basis, size), full_matrices=False)
    directions = (basis @ vt[:rank].T).astype(np.float32)
    vectors = _times(row, column, value, directions, size)
    vectors /= np.maximum(np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), 1e-9)
    weight = class_weights(y, found.n, counts)
    return LatentVotes(model.index, model.style, idf, directions, vectors.astype(np.float32), weight * y, weight, prior, k, sharp)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_each: int = 2000, least: int = 3, rank: int = 48, k: int = 25, sharp: float = 20.0, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text") -> LatentVotes:
    """Fit on at most ``max_each`` labelled rows of each class; the driver holds their counted terms."""
    common.small_batches(docs.sparkSession)
    sample, counts = labelled_sample(docs, labels, label, max_each, folds, id_col, text_col)
    return build(counted_terms(sample, text_terms, least), counts, rank, k, sharp)


def score(docs: DataFrame, model: LatentVotes, threshold: float = 0.3, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null and empty texts have no terms: all examples are equally far and the
    score is near the labels' share.  Null ids have a null held_out; repeated
    rows score alike; long texts are read whole; an empty table gives no rows;
    without labelled rows every score is 0.5.  Columns other than the two
    named are not read, whatever their names.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # at most 2 * max_each vectors, and directions of the terms that `least` of them share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = sent.value
        for batch in batches:
            scores = votes.score([text_terms(t) for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    doc_id = F.col(common.quoted(id_col)).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), (common.fold(doc_id, folds) == 0).alias("held_out"), F.coalesce(F.col(common.quoted(text_col)), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
