"""Bounded samples of labelled rows, and small fits on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FOLDS = 5


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_each: int, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """Distinct texts of at most ``max_each`` labelled ids of each class, and the class counts: (doc_id, label, n, text).

    Ids are taken in order of their hash.  Rows whose crc32 of the id is 0
    modulo ``folds`` are held out.  Labels other than 0 and 1 and null ids are
    left out; an id labelled twice counts with its larger label; of an id's
    documents the text with the smallest SHA-256 counts.  Equal texts of
    several ids make one row: their smallest id, their mean label, their
    number.  Nothing rests on the order of rows.
    """
    known = labels.select(F.col(common.quoted(id_col)).cast("long").alias("doc_id"), F.col(common.quoted(label)).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (common.fold("doc_id", folds) != 0))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_each) for c in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * max_each rows of two numbers
    text = F.coalesce(F.col(common.quoted(text_col)), F.lit(""))
    rows = docs.select(F.col(common.quoted(id_col)).cast("long").alias("doc_id"), text.alias("text")).join(ids, "doc_id")
    each = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.sha2("text", 256).alias("sha"), "text")).alias("t"))
    every = each.groupBy("t.text").agg(F.min("doc_id").alias("doc_id"), F.avg("label").alias("label"), F.count("*").alias("n"))
    return every.select("doc_id", "label", "n", "text"), counts


@dataclass
class Counted:
    """Examples in order of id: ids, mean labels, numbers of equal texts, and a count for each (example, term) in order of example."""

    ids: np.ndarray
    label: np.ndarray
    n: np.ndarray
    vocab: list[str]
    df: np.ndarray
    row: np.ndarray
    term: np.ndarray
    count: np.ndarray


def counted_terms(sample: DataFrame, terms: Callable[[str], dict[str, int]], least: int) -> Counted:
    """The sample's texts with their counts of the terms that at least ``least`` of them hold; terms hold no line break.

    The driver gets each text's terms compressed, and opens one text at a time:
    once to count by hash which terms may occur often enough, once to number
    those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(t) for t in batch.column(3).to_pylist()]
            packed = [zstandard.ZstdCompressor(level=3).compress("\n".join(f).encode()) for f in found]
            counts = [np.fromiter(f.values(), "<u4", len(f)).tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(packed, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "label", "n", "terms", "counts"])

    rows = sample.mapInArrow(run, "doc_id long, label double, n long, terms binary, counts binary").toArrow().sort_by("doc_id")
    ids, label, n = (rows.column(c).to_numpy() for c in ("doc_id", "label", "n"))
    packed, counts = rows.column("terms"), [np.frombuffer(c.as_py(), "<u4").astype(np.int64) for c in rows.column("counts")]

    def listed(i: int) -> list[str]:
        return zstandard.ZstdDecompressor().decompress(packed[i].as_py()).decode().split("\n") if len(counts[i]) else []

    hashes = [np.fromiter(map(hash, listed(i)), np.int64, len(counts[i])) for i in range(len(ids))]
    every, times = np.unique(np.concatenate(hashes or [np.zeros(0, np.int64)]), return_counts=True)
    often = every[times >= least]
    index: dict[str, int] = {}
    at, kept = [], []
    for i, h in enumerate(hashes):
        some = often[np.minimum(np.searchsorted(often, h), len(often) - 1)] == h if len(often) else np.zeros(len(h), bool)
        at.append(np.fromiter((index.setdefault(t, len(index)) for t in compress(listed(i), some)), np.int64, int(some.sum())))
        kept.append(counts[i][some])
    row, term, count = np.repeat(np.arange(len(at)), [len(x) for x in at]), np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([np.zeros(0, np.int64), *kept])
    df = np.bincount(term, minlength=len(index))
    # in order of the terms, without those that only share a hash with another
    order = np.array(sorted((i for i, t in enumerate(index) if df[i] >= least), key=list(index).__getitem__), np.int64)
    rank = np.full(len(index), -1)
    rank[order] = np.arange(len(order))
    words, some = list(index), rank[term] >= 0 if len(term) else np.zeros(0, bool)
    return Counted(ids, label, n.astype(np.float64), [words[i] for i in order], df[order], row[some], rank[term[some]] if len(term) else term, count[some])


def class_weights(y: np.ndarray, n: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights that give the sample, in which text i stands n[i] times with mean label y[i], the class shares of all labelled rows."""
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    ones = float((y * n).sum() / max(1, n.sum())) if len(y) else 0.5
    return n * (y * share / max(ones, 1e-9) + (1 - y) * (1 - share) / max(1 - ones, 1e-9))


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of a weighted one-variable logistic fit by Newton steps."""
    beta = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (w * (y - p)) - ridge * beta
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])
