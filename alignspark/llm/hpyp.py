"""Language-model scores from a hierarchical Pitman-Yor model over words.

The words that follow a context word sit in that context's restaurant, a
Pitman-Yor process with discount d and a strength; all context restaurants
share one parent, the distribution G of the empty context over the V distinct
training tokens and one unknown, which is a Pitman-Yor process of discount 0
over the uniform distribution: a Dirichlet with `weight` for each outcome.
Every token that occurs in training is a context, however rare; after a token
that does not, a word comes from the parent.

Seating is kept as the customers c and tables t of each dish of a restaurant;
each table is a customer of the parent.  Two auxiliary draws make a Gibbs sweep
exact though all dishes are seated at once:

* for each restaurant u with T tables, g(u) ~ Gamma(strength / d + T), under
  which its dishes no longer depend on each other, and
* the parent G itself, Dirichlet over its customers, under which restaurants no
  longer depend on each other.

Given both, a dish's tables have p(t) proportional to S(c, t) (d g(u) G(w)) ** t
with the generalised Stirling numbers S, and t is drawn from that directly:
every customer of every dish is seated anew in every sweep, and one drawn table
count stands for all seatings that have it.  S comes from its recursion up to
256 customers and beyond from its generating function by a contour integral; the
draws' distributions agree to 2e-4 at worst.  Predictive probabilities are averaged over the sweeps after burn-in; they are

    G(w)      = (tables of w + weight) / (all tables + weight (V + 1))
    p(w | u)  = (c - d t) / (strength + C(u)) + (strength + d T(u)) / (strength + C(u)) G(w)

with the means of t, T and G over sweeps, so they sum to one over the V + 1
outcomes.  Every draw is a function of the seed, the sweep and the words'
places in the order of their frequency, so scores do not depend on the number
of shards, blocks or partitions, nor on tasks that run again.

The state is sharded by the hash of the word: a word's cells (context, count)
under all contexts lie together, and a context's cells are spread over shards.
A cell of one customer has one table for ever, so a sweep reads the other cells
only; tables of their contexts are added up by the shard that owns the context.

Texts are read once, into a table of blocks of documents in the shared folder.
Every block sends each shard one row with its cells there, and is scored from
the answers, so no task, and not the driver, holds the vocabulary or the
contexts.  The number of shards follows the bytes of text, up to the number of
shuffle partitions, and a block sends no row to a shard without words of it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common
from .token_files import from_planes, to_planes

HELD = 7
END = b""  # the end token; no word is empty
BUCKETS = 4096  # words are numbered within buckets of their hash, whatever the shards
_EXACT = 256


# --- packing ----------------------------------------------------------------


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers from 0 as compressed byte planes, 4 or 8 as they need."""
    width = 8 if len(numbers) and int(numbers.max()) >> 32 else 4
    flat = numbers.astype(f"<u{width}")
    planes = to_planes(flat, "byte") if width == 4 else to_planes(flat.view("<u4")[0::2].copy(), "byte") + to_planes(flat.view("<u4")[1::2].copy(), "byte")
    return bytes([width]) + len(numbers).to_bytes(8, "little") + _zip(b"".join(planes))


def _unpack(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    if not n:
        return np.zeros(0, np.int64)
    flat = _unzip(data[9:])
    halves = [from_planes([flat[(h + k) * n : (h + k + 1) * n] for k in range(4)], n, "byte").astype(np.int64) for h in range(0, width, 4)]
    return halves[0] if width == 4 else halves[0] | halves[1] << 32


def _pack_sorted(numbers: np.ndarray) -> bytes:
    return _pack(np.diff(numbers, prepend=0))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data))


def _join(words: list[bytes]) -> bytes:
    return _zip(b" ".join(words))


def _split(data: bytes, n: int) -> list[bytes]:
    return _unzip(data).split(b" ") if n else []


def _row(schema: pa.Schema, **values) -> pa.RecordBatch:
    """One row; columns that are not named are null."""
    return pa.RecordBatch.from_pylist([values], schema=schema)


def _schema(text: str) -> tuple[pa.Schema, str]:
    """An Arrow schema, and Spark's text of it, from 'name type, ...'."""
    types = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_(), "longs": pa.list_(pa.int64()), "flags": pa.list_(pa.bool_())}
    named = [field.split() for field in text.split(", ")]
    return pa.schema([(n, types[t]) for n, t in named]), ", ".join(f"{n} {({'longs': 'array<long>', 'flags': 'array<boolean>'}).get(t, t)}" for n, t in named)


# --- draws ------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (fixed constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniforms(*keys: int | np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that are functions of the keys."""
    x = np.zeros(1, np.uint64)
    for k in keys:
        x = _mix(x + np.atleast_1d(np.asarray(k, np.int64)).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def gammas(shape: np.ndarray, *keys: int | np.ndarray) -> np.ndarray:
    """Gamma draws of shapes from 1 on, by the rejection method of Marsaglia and Tsang."""
    shape = np.asarray(shape, np.float64)
    keys = [np.broadcast_to(k, shape.shape) for k in keys]
    out, left, attempt = np.empty(len(shape)), np.arange(len(shape)), 0
    while len(left):
        d = shape[left] - 1 / 3
        a, b, u = (uniforms(*(k[left] for k in keys), 3 * attempt + j) for j in range(3))
        x = np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)
        v = (1 + x / np.sqrt(9 * d)) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            fits = (v > 0) & (np.log(u) < 0.5 * x * x + d * (1 - v + np.log(v)))
        out[left[fits]] = (d * v)[fits]
        left, attempt = left[~fits], attempt + 1
    return out


@lru_cache(maxsize=4)
def log_stirling(discount: float, n: int = _EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) for c, t up to n."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(n + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, n + 1):
            stay = np.log(np.maximum(c - 1 - discount * t, 0)) + out[c - 1]
            new = np.concatenate(([-np.inf], out[c - 1, :-1]))
            out[c] = np.logaddexp(np.where(np.isnan(stay), -np.inf, stay), new)
    return out


def _pick(weights: np.ndarray, u: np.ndarray) -> np.ndarray:
    """For each row of weights, the place where its share u falls."""
    sums = np.cumsum(weights, axis=1)
    return np.minimum((sums < u[:, None] * sums[:, -1:]).sum(axis=1), weights.shape[1] - 1)


def draw_tables(c: np.ndarray, log_z: np.ndarray, u: np.ndarray, discount: float, exact: int = _EXACT, most: int = 1 << 18) -> np.ndarray:
    """For each dish of c customers, t with p(t) proportional to S(c, t) z ** t, at the share u of its distribution."""
    out = np.ones(len(c), np.int64)
    if not len(c):
        return out
    order = np.argsort(c, kind="stable")
    sizes, starts = np.unique(c[order], return_index=True)
    table = log_stirling(discount, max(exact, 2))
    for n, lo, hi in zip(sizes.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
        if n < 2:
            continue
        if n > exact:
            break
        for a in range(lo, hi, max(1, most // n)):
            i = order[a : min(hi, a + max(1, most // n))]
            logs = table[n, 1 : n + 1] + log_z[i, None] * np.arange(1, n + 1)
            logs -= logs.max(axis=1, keepdims=True)
            out[i] = 1 + _pick(np.exp(logs, out=logs), u[i])
    large = np.flatnonzero(c > exact)
    if len(large):
        low, high, saddle = _window(c[large], log_z[large], discount)
        width = high - low + 1
        for part in _by_width(width, most):
            i = large[part]
            out[i] = low[part] + _pick(contour_weights(c[i], log_z[i], low[part], high[part], saddle[part], discount), u[i])
    return out


def _by_width(width: np.ndarray, most: int, nodes: int = 48) -> Iterator[np.ndarray]:
    """Places in order of width, in parts that hold at most `most` numbers a node set."""
    order, a = np.argsort(width, kind="stable"), 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b - a + 1) * int(width[order[b]]) * nodes <= 8 * most:
            b += 1
        yield order[a:b]
        a = b


def _window(c: np.ndarray, log_z: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of t ten deviations about its mean, and 1 less the saddle point x of z x (1 - x) ** (d - 1) = c.

    With a Poisson number of tables of mean z g(x), c is the mean of the sum of
    their sizes; the deviation is that of their number given the sum.
    """
    low, high = np.full(len(c), -700.0), np.full(len(c), -1e-15)
    for _ in range(70):
        middle = (low + high) / 2
        more = log_z + np.log(-np.expm1(middle)) + (discount - 1) * middle > np.log(c)
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    mean = -np.exp(log_z) * np.expm1(discount * high) / discount
    rest = np.exp(high)
    spread = 10 * np.sqrt(mean * np.maximum(1 - c / (mean * (1 + (1 - discount) * (1 - rest) / rest)), 0))
    first = np.clip(np.floor(mean - spread - 10), 1, c).astype(np.int64)
    return first, np.clip(np.ceil(mean + spread + 20), 1, c).astype(np.int64), rest


def contour_weights(c: np.ndarray, log_z: np.ndarray, low: np.ndarray, high: np.ndarray, saddle: np.ndarray, discount: float, nodes: int = 48) -> np.ndarray:
    """S(c, t) z ** t for t from low to high, up to a factor for each row; 0 beyond high.

    S(c, t) is c! / t! times the coefficient of x ** c in g(x) ** t with
    g(x) = (1 - (1 - x) ** d) / d.  The coefficient is an integral over a curve
    about 0: where the saddle point is near 1, over x = 1 - s (1 + iu) ** 2,
    which wraps the cut from 1 on; where it is near 0, over a circle.  Both
    integrands fall like a normal density, so a few equidistant nodes do.
    """
    d, n = discount, c.astype(np.float64)[:, None]
    near = saddle[:, None] <= 0.2
    s = np.minimum(np.maximum(saddle[:, None], 6 / n), 0.2)
    x0 = np.where(near, 1 - s, 1 - saddle[:, None])
    middle = np.exp(log_z)[:, None] * -np.expm1(d * np.log1p(-x0)) / d

    def parts(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log g(x), and the logarithm of what else is under the integral, at the nodes u."""
        turn = 1 + 1j * u
        curve, circle = 1 - s * turn * turn, x0 * np.exp(1j * u)
        g = np.where(near, 1 - s**d * turn ** (2 * d), 1 - (1 - circle) ** d) / d
        return np.log(g), np.where(near, np.log(turn) - (n + 1) * np.log(curve), -1j * n * u - n * np.log(x0))

    log_0, rest_0 = parts(np.zeros((len(c), 1)))
    # the curve ends where its integrand has fallen by 38 in logarithm
    grid = np.geomspace(1e-5, 50, 160)[None, :]
    log_g, rest = parts(np.broadcast_to(grid, (len(c), grid.shape[1])))
    tall = (middle * (log_g - log_0) + rest - rest_0).real > -38
    last = grid.shape[1] - 1 - np.argmax(tall[:, ::-1], axis=1)
    # a circle ends at ten deviations of the sum of table sizes, or after a half
    slope = x0 * (1 - x0) ** (d - 1)
    spread = np.exp(log_z)[:, None] * slope * (1 + (1 - d) * x0 / (1 - x0) + slope * d / np.expm1(d * np.log1p(-x0)))
    end = np.where(near, grid[0, np.minimum(last + 1, grid.shape[1] - 1)][:, None], np.minimum(10 / np.sqrt(np.maximum(spread, 1e-9)), np.pi))
    log_g, rest = parts(end * np.arange(nodes + 1)[None, :] / nodes)
    width = int((high - low).max()) + 1
    steps = np.arange(width)
    t = low[:, None] + steps
    terms = np.repeat(np.exp(log_g - log_0)[:, None, :], width, axis=1)
    terms[:, 0, :] = np.exp(low[:, None] * (log_g - log_0) + rest - rest_0) * np.where(np.arange(nodes + 1) % nodes == 0, 0.5, 1.0)
    total = np.maximum(np.cumprod(terms, axis=1).real.sum(axis=2), 1e-290)
    logs = np.log(total) + steps * (log_z[:, None] + log_0.real) - np.cumsum(np.where(steps > 0, np.log(t), 0.0), axis=1)
    logs = np.where(t <= high[:, None], logs, -np.inf)
    return np.exp(logs - logs.max(axis=1, keepdims=True))


# --- blocks of documents, numbers of words ------------------------------------


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


_BLOCK, _BLOCK_SQL = _schema("block long, words binary, sizes binary, counts binary, doc_ids longs, train flags, lengths binary, places binary")


def _blocks(shards: int, block_bytes: int):
    """Documents to blocks: the block's words ordered by shard, and all tokens as places in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        index, held, docs = _Index(), 0, []

        def close() -> pa.RecordBatch:
            words = sorted(index)
            shard = np.fromiter((xxh64_intdigest(w) % BUCKETS % shards for w in words), np.int64, len(words))
            order = np.argsort(shard, kind="stable")
            old = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
            place = np.empty(len(words), np.int64)
            place[old[order]] = np.arange(len(words))
            tokens = place[np.concatenate([d[2] for d in docs])]
            lengths = np.array([len(d[2]) for d in docs], np.int64)
            learn = np.repeat(np.array([d[1] for d in docs]), lengths)
            return _row(
                _BLOCK,
                block=number,
                words=_join([words[i] for i in order]),
                sizes=_pack(np.bincount(shard, minlength=shards)),
                counts=_pack(np.bincount(tokens[learn], minlength=len(words))),
                doc_ids=[d[0] for d in docs],
                train=[d[1] for d in docs],
                lengths=_pack(lengths),
                places=_pack(tokens),
            )

        for batch in batches:
            for doc_id, train, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = common.byte_words(text)
                words.append(END)
                docs.append((doc_id, bool(train), np.fromiter(map(index.__getitem__, words), np.int32, len(words))))
                held += len(text) + 16
                if held >= block_bytes:
                    yield close()
                    number += 1
                    index, held, docs = _Index(), 0, []
        if docs:
            yield close()

    return run


def _cells(ids: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For every token, its cell's key (place * words + place of the token before), or -1 after a token that was not learnt."""
    before = np.empty(len(tokens), np.int64)
    before[1:] = tokens[:-1]
    ends = np.cumsum(lengths)
    # a text begins after the end token of another
    before[np.concatenate(([0], ends[:-1]))] = tokens[ends - 1]
    return np.where(ids[before] > 0, tokens * len(ids) + before, -1)


_COUNTED, _COUNTED_SQL = _schema("shard long, block long, size long, words binary, counts binary")


def _word_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block and shard: the block's words of that shard and their training counts."""
    for batch in batches:
        for block, words, sizes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sizes, counts = _unpack(sizes), _unpack(counts)
            listed, ends = _split(words, len(counts)), np.cumsum(sizes)
            for s in np.flatnonzero(sizes).tolist():
                part = slice(int(ends[s] - sizes[s]), int(ends[s]))
                yield _row(_COUNTED, shard=s, block=block, size=int(sizes[s]), words=_join(listed[part]), counts=_pack(counts[part]))


_NUMBERED, _NUMBERED_SQL = _schema("block long, shard long, ids binary, n long, v long")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts sorted by shard: for each, 1 + the words' ids (0 where not learnt), and a row without block of the shard's totals.

    A word's id is its rank by frequency (then by hash) in its bucket, times
    the buckets, plus the bucket: the same whatever the shards.
    """
    now, index, parts, seen = None, _Index(), [], []

    def close() -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index), np.int64)
        for (_, own), c in zip(parts, seen, strict=True):
            total[own] += c
        hashes = np.fromiter((xxh64_intdigest(w) for w in index), np.uint64, len(index))
        bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64)
        order = np.lexsort((hashes, -total, bucket))
        starts = np.searchsorted(bucket[order], np.arange(BUCKETS))
        rank = np.empty(len(total), np.int64)
        rank[order] = np.arange(len(total)) - starts[bucket[order]]
        ids = np.where(total > 0, rank * BUCKETS + bucket + 1, 0)
        for block, own in parts:
            yield _row(_NUMBERED, block=block, shard=now, ids=_pack(ids[own]))
        yield _row(_NUMBERED, n=int(total.sum()), v=int((total > 0).sum()))

    for batch in batches:
        for shard, block, size, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard != now:
                if now is not None:
                    yield from close()
                now, index, parts, seen = shard, _Index(), [], []
            parts.append((block, np.fromiter(map(index.__getitem__, _split(words, size)), np.int32, size)))
            seen.append(_unpack(counts).astype(np.uint32))
    if now is not None:
        yield from close()


_KNOWN, _KNOWN_SQL = _schema("block long, ids binary, sizes binary, counts binary, doc_ids longs, train flags, lengths binary, places binary")


def _with_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, kind and shard: the ids of its words (kind 0), then the block itself (kind 1), whose words become ids."""
    ids: list[np.ndarray] = []
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 0:
                ids.append(_unpack(row["ids"]))
                continue
            yield _row(_KNOWN, **{k: v for k, v in row.items() if k not in ("kind", "ids")}, ids=_pack(np.concatenate(ids)))
            ids = []


# --- the state of a shard -------------------------------------------------------


_REQUEST, _REQUEST_SQL = _schema("shard long, block long, ids binary, counts binary, spans binary, contexts binary, times binary")


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block and shard: word ids, training counts, and the words' cells (context ids) with their training counts."""
    for batch in batches:
        for block, ids, sizes, counts, train, lengths, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids, sizes, counts, lengths, tokens = _unpack(ids), _unpack(sizes), _unpack(counts), _unpack(lengths), _unpack(places)
            keys = _cells(ids, tokens, lengths)
            learn = np.repeat(np.array(train), lengths)
            cells, at = np.unique(keys[keys >= 0], return_inverse=True)
            times = np.bincount(at, weights=learn[keys >= 0], minlength=len(cells)).astype(np.int64)
            contexts = ids[cells % len(ids)] - 1
            spans = np.bincount(cells // len(ids), minlength=len(ids))
            starts = np.concatenate(([0], np.cumsum(spans)))
            ends = np.cumsum(sizes)
            for s in np.flatnonzero(sizes).tolist():
                a, b = int(ends[s] - sizes[s]), int(ends[s])
                x, y = int(starts[a]), int(starts[b])
                yield _row(_REQUEST, shard=s, block=block, ids=_pack(ids[a:b]), counts=_pack(counts[a:b]), spans=_pack(spans[a:b]), contexts=_pack(contexts[x:y]), times=_pack(times[x:y]))


def _owned(contexts: np.ndarray, shards: int) -> np.ndarray:
    """Context ids as keys that sort by the shard that owns them, then by id."""
    return (contexts % BUCKETS % shards) << 50 | contexts


_ID = (1 << 50) - 1


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of n over each."""
    order = np.argsort(key)
    key, n = key[order], n[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    return key[starts], np.add.reduceat(n, starts) if len(starts) else n


def _named(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of names in order, and the sums of n over each."""
    firsts, a = np.unique(first, return_inverse=True)
    seconds, b = np.unique(second, return_inverse=True)
    k = max(1, len(seconds))
    key, n = _summed(a * k + b, n)
    return firsts[key // k], seconds[key % k], n


# words are ids in order, contexts keys of _owned in order; a cell is the place of its word times the contexts plus the place of its context
_STATE, _STATE_SQL = _schema("shard long, words binary, counts binary, contexts binary, cells binary, times binary, live_contexts binary, live_cells binary, live_times binary, singles binary, n1 long, n2 long")


def _sum_shards(shards: int, most: int = 1 << 21):
    """Requests sorted by shard to one row for each shard; cells are added up whenever `most` have come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, cells, held = None, [], [], 0

        def close() -> pa.RecordBatch:
            ids, counts = _summed(*(np.concatenate(x) for x in zip(*words, strict=True)))
            word, context, times = _named(*(np.concatenate(x) for x in zip(*cells, strict=True)))
            word = np.searchsorted(ids, word)

            def listed(of: np.ndarray) -> tuple[bytes, bytes, bytes]:
                contexts, place = np.unique(context[of], return_inverse=True)
                return _pack_sorted(contexts), _pack_sorted(word[of] * max(1, len(contexts)) + place), _pack(times[of])

            every, live = listed(slice(None)), listed(times > 1)
            singles = np.bincount(word[times == 1], minlength=len(ids))
            return _row(_STATE, **dict(zip(_STATE.names, (now, _pack_sorted(ids), _pack(counts), *every, *live, _pack(singles), int((times == 1).sum()), int((times == 2).sum())), strict=True)))

        for batch in batches:
            for shard, _, ids, counts, spans, contexts, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now:
                    if now is not None:
                        yield close()
                    now, words, cells, held = shard, [], [], 0
                ids, counts, spans, times = _unpack(ids) - 1, _unpack(counts), _unpack(spans), _unpack(times)
                words.append((ids[counts > 0], counts[counts > 0]))
                learnt = times > 0
                cells.append((np.repeat(ids, spans)[learnt], _owned(_unpack(contexts)[learnt], shards), times[learnt]))
                held += len(cells[-1][0])
                if held > most:
                    words, cells = ([f(*(np.concatenate(x) for x in zip(*y, strict=True)))] for f, y in ((_summed, words), (_named, cells)))
                    held = len(cells[0][0]) // 2
        if now is not None:
            yield close()

    return run


_PART, _PART_SQL = _schema("owner long, kind long, shard long, ids binary, tables binary")


def _by_owner(shard: int, kind: int, keys: np.ndarray, tables: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each owner of the contexts: their ids, and their tables here."""
    owners, starts = np.unique(keys >> 50, return_index=True)
    for owner, a, b in zip(owners.tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)][: len(owners)], strict=True):
        yield _row(_PART, owner=owner, kind=kind, shard=shard, ids=_pack_sorted(keys[a:b] & _ID), tables=_pack(tables[a:b]))


def _single_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tables of each context's cells of one customer."""
    for batch in batches:
        for shard, contexts, cells, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keys = _unpack_sorted(contexts)
            k = max(1, len(keys))
            tables = np.bincount(_unpack_sorted(cells)[_unpack(times) == 1] % k, minlength=k)[: len(keys)]
            some = tables > 0
            yield from _by_owner(shard, 0, keys[some], tables[some])


def _live_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tables of each context's other cells."""
    for batch in batches:
        for shard, contexts, cells, tables in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keys = _unpack_sorted(contexts)
            k = max(1, len(keys))
            yield from _by_owner(shard, 1, keys, np.bincount(_unpack_sorted(cells) % k, weights=_unpack(tables), minlength=k).astype(np.int64))


_TOTAL, _TOTAL_SQL = _schema("shard long, owner long, ids binary, tables binary")


def _totals(reply: bool):
    """Parts sorted by owner: the totals of each part's contexts for its shard (where asked), or one row of all for the owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def close() -> Iterator[pa.RecordBatch]:
            ids, place = np.unique(np.concatenate([i for _, _, i, _ in parts]), return_inverse=True)
            sums = np.bincount(place, weights=np.concatenate([t for *_, t in parts])).astype(np.int64)
            if not reply:
                yield _row(_TOTAL, shard=now, owner=now, ids=_pack_sorted(ids), tables=_pack(sums))
                return
            for kind, shard, own, _ in parts:
                if kind == 1:
                    yield _row(_TOTAL, shard=shard, owner=now, tables=_pack(sums[np.searchsorted(ids, own)]))

        for batch in batches:
            for owner, kind, shard, ids, tables in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if owner != now:
                    if now is not None:
                        yield from close()
                    now, parts = owner, []
                parts.append((kind, shard, _unpack_sorted(ids), _unpack(tables)))
        if now is not None:
            yield from close()

    return run


# --- sweeps -----------------------------------------------------------------


def sweep(words: np.ndarray, singles: np.ndarray, roots: np.ndarray, contexts: np.ndarray, tables: np.ndarray, cells: np.ndarray, times: np.ndarray, total: float, seed: int, turn: int, discount: float, strength: float, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """One Gibbs sweep over a shard's cells of two customers and more: their tables, and the parent's customers of every word.

    words and contexts are ids, roots the parent's customers of the words so
    far, tables those of each context over all shards, total the sum of the
    parent's Gamma draws over all words and the unknown one.
    """
    k = max(1, len(contexts))
    word, context = cells // k, cells % k
    rooms = gammas(strength / discount + tables, seed, turn, 1, contexts)
    parent = parent_draws(words, roots, seed, turn, weight) / total
    log_z = np.log(discount) + np.log(rooms)[context] + np.log(parent)[word]
    drawn = draw_tables(times, log_z, uniforms(seed, turn, 3, words[word], contexts[context]), discount)
    return drawn, singles + np.bincount(word, weights=drawn, minlength=len(words)).astype(np.int64)


def parent_draws(words: np.ndarray, roots: np.ndarray, seed: int, turn: int, weight: float) -> np.ndarray:
    """The parent's Gamma draws for a sweep; over their sum they are its Dirichlet draw."""
    return gammas(roots + weight + 1, seed, turn, 2, words) * uniforms(seed, turn, 4, words) ** (1 / (roots + weight))


def unknown_draw(seed: int, turn: int, weight: float) -> float:
    """The parent's Gamma draw of the unknown word."""
    return float(parent_draws(np.array([-1]), np.zeros(1), seed, turn, weight)[0])


_LIVE, _LIVE_SQL = _schema("shard long, words binary, singles binary, contexts binary, cells binary, times binary, tables binary, kept binary, roots binary, history binary, sum double, customers long")


def _start(seed: int, weight: float):
    """The first seating: a table for each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, words, singles, contexts, cells, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, keys, at = _unpack_sorted(words), _unpack_sorted(contexts), _unpack_sorted(cells)
                roots = _unpack(singles) + np.bincount(at // max(1, len(keys)), minlength=len(ids))
                ones, none = np.ones(len(at), np.int64), np.zeros(len(at), np.int64)
                yield _row(_LIVE, shard=shard, words=words, singles=singles, contexts=contexts, cells=cells, times=times, tables=_pack(ones), kept=_pack(none), roots=_pack(roots), history=_pack(roots[:0]), sum=float(parent_draws(ids, roots, seed, 1, weight).sum()), customers=int(roots.sum()))

    return run


def _turn(seed: int, turn: int, keep: bool, total: float, discount: float, strength: float, weight: float):
    """Rows sorted by shard, kind and owner: tables of its contexts (kind 0), then the shard's seating (kind 1), which is drawn anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: list[np.ndarray] = [np.zeros(0, np.int64)]
        for batch in batches:
            for row in batch.to_pylist():
                kind, told = row.pop("kind"), row.pop("told")
                row.pop("owner")
                if kind == 0:
                    totals.append(_unpack(told))
                    continue
                ids, contexts = _unpack_sorted(row["words"]), _unpack_sorted(row["contexts"]) & _ID
                drawn, roots = sweep(ids, _unpack(row["singles"]), _unpack(row["roots"]), contexts, np.concatenate(totals), _unpack_sorted(row["cells"]), _unpack(row["times"]), total, seed, turn, discount, strength, weight)
                row |= {"tables": _pack(drawn), "roots": _pack(roots), "sum": float(parent_draws(ids, roots, seed, turn + 1, weight).sum()), "customers": int(roots.sum())}
                if keep:
                    row |= {"kept": _pack(_unpack(row["kept"]) + drawn), "history": _pack(np.concatenate((_unpack(row["history"]), roots)))}
                totals = [np.zeros(0, np.int64)]
                yield _row(_LIVE, **row)

    return run


# --- answers and scores -------------------------------------------------------


_REPLY, _REPLY_SQL = _schema("block long, shard long, counts binary, parents binary, tables binary, times binary, seats binary")


def _answer(customers: list[int], weight: float, v: int, sweeps: int):
    """Rows sorted by shard, kind and order: tables of the contexts it owns (kinds 0, 1), its seating (2), its cells (3), then the blocks' requests (4).

    Tables are summed over the kept sweeps, those of cells of one customer too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = live = state = None
        for batch in batches:
            for row in batch.to_pylist():
                kind = row["kind"]
                if kind in (0, 1):
                    if own is None or own[0] != row["shard"]:
                        own = (row["shard"], {})
                    own[1][kind] = (_unpack_sorted(row["contexts"]), _unpack(row["tables"]))
                    continue
                if kind == 2:
                    live = (row["shard"], _unpack_sorted(row["contexts"]), _unpack_sorted(row["cells"]), _unpack(row["tables"]), _unpack(row["history"]))
                    continue
                if kind == 3:
                    state = _loaded(row, own, live, customers, weight, v, sweeps)
                    own = live = None
                    continue
                assert row["shard"] == state.shard  # every asked shard has a row
                yield state.reply(row["block"], _unpack(row["ids"]) - 1, _unpack(row["spans"]), _unpack(row["contexts"]))

    return run


class _Loaded:
    """A shard's words and cells, ready for requests."""

    def __init__(self, shard: int, words, counts, parent, word_tables, contexts, cells, times, seats) -> None:
        self.shard, self.words, self.counts, self.parent, self.word_tables = shard, words, counts, parent, word_tables
        self.contexts, self.cells, self.times, self.seats = contexts, cells, times, seats
        top = int(contexts[-1]) + 1 if len(contexts) else 0
        self.places = None
        if top <= 64 * len(contexts) + (1 << 20):  # ids are dense: a table finds them faster than bisection
            self.places = np.full(top, -1, np.int32)
            self.places[contexts] = np.arange(len(contexts))

    def placed(self, contexts: np.ndarray) -> np.ndarray:
        """Places of the contexts here, -1 for others."""
        if self.places is not None:
            known = contexts < len(self.places)
            return np.where(known, self.places[np.where(known, contexts, 0)], -1)
        place = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        return np.where(self.contexts[place] == contexts, place, -1)

    def reply(self, block: int, ids: np.ndarray, spans: np.ndarray, contexts: np.ndarray) -> pa.RecordBatch:
        seen = ids >= 0
        at = np.where(seen, np.searchsorted(self.words, ids), 0)
        counts, tables, parents = (np.zeros(len(ids), t) for t in (np.int64, np.int64, np.float64))
        counts[seen], tables[seen], parents[seen] = self.counts[at[seen]], self.word_tables[at[seen]], self.parent[at[seen]]
        times = seats = np.zeros(len(contexts), np.int64)
        if len(self.cells) and len(contexts):
            place = self.placed(contexts)
            keys = np.where((place >= 0) & np.repeat(seen, spans), np.repeat(at, spans) * len(self.contexts) + place, -1)
            order = np.argsort(keys)  # bisection in order stays in cache
            where = np.empty(len(keys), np.int64)
            where[order] = np.minimum(np.searchsorted(self.cells, keys[order]), len(self.cells) - 1)
            found = self.cells[where] == keys
            times, seats = np.where(found, self.times[where], 0), np.where(found, self.seats[where], 0)
        return _row(_REPLY, block=block, shard=self.shard, counts=_pack(counts), parents=_zip(parents.astype("<f4").tobytes()), tables=_pack(tables), times=_pack(times), seats=_pack(seats))


def _loaded(row: dict, own, live, customers: list[int], weight: float, v: int, sweeps: int) -> _Loaded:
    shard, words, counts, times = row["shard"], _unpack_sorted(row["words"]), _unpack(row["counts"]), _unpack(row["times"])
    keys, cells = _unpack_sorted(row["contexts"]), _unpack_sorted(row["cells"])
    # G averaged over the kept sweeps
    parent = parent_means(live[4].reshape(len(customers), len(words)), customers, weight, v)
    # tables of each word as a context, summed over the kept sweeps
    tables = np.zeros(len(words), np.int64)
    for kind, factor in ((0, sweeps), (1, 1)):
        if own is not None and own[0] == shard and kind in own[1]:
            ids, n = own[1][kind]
            tables[np.searchsorted(words, ids)] += factor * n
    seats = np.where(times == 1, sweeps, 0)
    if len(live[2]):
        seats[times > 1] = live[3]  # both are in order of word and context
    # the requests name contexts by their ids
    order = np.argsort(keys & _ID, kind="stable")
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys))
    k = max(1, len(keys))
    renamed = cells // k * k + rank[cells % k] if len(keys) else cells
    by_id = np.argsort(renamed, kind="stable")
    return _Loaded(shard, words, counts, parent, tables, (keys & _ID)[order], renamed[by_id], times[by_id], seats[by_id])


def parent_means(history: np.ndarray, customers: list[int], weight: float, v: int) -> np.ndarray:
    """G of each word averaged over sweeps, from its customers in each (a row a sweep)."""
    return ((history + weight) / (np.array(customers, np.float64)[:, None] + weight * (v + 1))).mean(axis=0)


def predictive(times: np.ndarray, seats: np.ndarray, count: np.ndarray, tables: np.ndarray, parent: np.ndarray, sweeps: int, discount: float, strength: float) -> np.ndarray:
    """p(w | u) from the cell's customers and summed tables, the context's customers and summed tables, and G(w)."""
    return (times - discount * seats / sweeps + (strength + discount * tables / sweeps) * parent) / (strength + count)


_SCORE, _SCORE_SQL = _schema("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _score(n: int, v: int, unknown: float, sweeps: int, discount: float, strength: float):
    """Rows sorted by block, kind and shard: the answers (kind 0), then the block itself (kind 1)."""
    room = n + (v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, answers = None, []
        for batch in batches:
            for block, kind, c, parents, tables, times, seats, ids, doc_ids, lengths, places in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if block != now:
                    now, answers = block, []
                if kind == 0:
                    answers.append((_unpack(c), np.frombuffer(_unzip(parents), "<f4").astype(np.float64), _unpack(tables), _unpack(times), _unpack(seats)))
                    continue
                count, parent, table, times, seats = (np.concatenate(x) for x in zip(*answers, strict=True))
                parent = np.where(count > 0, parent, unknown)
                lengths, tokens = _unpack(lengths), _unpack(places)
                keys = _cells(_unpack(ids), tokens, lengths)
                per_token = np.log10(parent)[tokens]
                if (keys >= 0).any():
                    cells, at = np.unique(keys[keys >= 0], return_inverse=True)
                    word, context = cells // len(count), cells % len(count)
                    per_token[keys >= 0] = np.log10(predictive(times, seats, count[context], table[context], parent[word], sweeps, discount, strength))[at]
                starts = np.cumsum(lengths) - lengths
                sums = [np.add.reduceat(x, starts) for x in (np.log10((count + 1) / room)[tokens], per_token, (count > 0)[tokens].astype(np.int64))]
                held = [None if d is None else zlib.crc32(str(d).encode()) % HELD == 2 for d in doc_ids]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((doc_ids, held, lengths, sums[2], np.full(len(lengths), n), sums[0], sums[1]), _SCORE, strict=True)], schema=_SCORE)

    return run


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sweeps: int = 3, burn: int = 2, strength: float = 1.0, weight: float = 0.5, seed: int = 7, shards: int | None = None, shard_bytes: int = 32 << 20, block_bytes: int = 6 << 20) -> DataFrame:
    """Scores of all texts: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32 of the id is not 2 modulo 7; scores are log10
    probabilities, and 10 ** (-score / n_tokens) is a text's perplexity.  Null
    and empty texts have the end token alone; rows with a null id are scored
    but not learned from, and their held_out is null; repeated rows count each
    time; an empty table gives no rows; columns other than the two named are
    not read.  Words are compared as bytes, so nothing rests on their hashes.
    The discount is the estimate n1 / (n1 + 2 n2) from the cells of one and two
    customers.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    doc_id = F.col(common.quoted(id_col)).cast("long")
    text = F.coalesce(F.col(common.quoted(text_col)), F.lit(""))
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(common.fold(doc_id, HELD) != 2, F.lit(False)).alias("train"), text.alias("text"))
    if shards is None:
        text_bytes = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        shards = max(1, min(BUCKETS, parts, -(-text_bytes // shard_bytes)))
    none, zero = F.lit(None), F.lit(0).cast("long")
    made: list[str] = []

    def stored(df: DataFrame, name: str) -> DataFrame:
        made.append(common.table_path(spark, name))
        df.write.parquet(made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    def dealt(df: DataFrame, key: str, *order: str) -> DataFrame:
        return df.repartition(parts, key).sortWithinPartitions(key, *order)

    blocks = stored(rows.mapInArrow(_blocks(shards, block_bytes), _BLOCK_SQL), "blocks")
    pieces = blocks.select("block", "words", "sizes", "counts").mapInArrow(_word_parts, _COUNTED_SQL)
    numbered = stored(dealt(pieces, "shard").mapInArrow(_number, _NUMBERED_SQL), "numbered")
    size = numbered.where("block IS NULL").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v"))).first()
    n, v = size["n"], size["v"]
    rest = ["sizes", "counts", "doc_ids", "train", "lengths", "places"]
    told = numbered.where("block IS NOT NULL").select("block", F.lit(0).alias("kind"), "shard", "ids", *(none.cast(blocks.schema[c].dataType).alias(c) for c in rest))
    both = told.unionByName(blocks.select("block", F.lit(1).alias("kind"), zero.alias("shard"), none.cast("binary").alias("ids"), *rest))
    known = stored(dealt(both, "block", "kind", "shard").drop("shard").mapInArrow(_with_ids, _KNOWN_SQL), "known")
    for path in made[:2]:
        common.remove_path(spark, path)
    asked = known.select("block", "ids", "sizes", "counts", "train", "lengths", "places").mapInArrow(_requests, _REQUEST_SQL)
    state = stored(dealt(asked, "shard").mapInArrow(_sum_shards(shards), _STATE_SQL), "cells")
    seen = state.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2"))).first()
    discount = float(np.clip(seen["n1"] / max(1, seen["n1"] + 2 * seen["n2"]), 0.1, 0.95))
    singles = stored(dealt(state.select("shard", "contexts", "cells", "times").mapInArrow(_single_parts, _PART_SQL), "owner", "kind", "shard").mapInArrow(_totals(False), _TOTAL_SQL), "singles")
    fixed = singles.select("owner", F.lit(0).cast("long").alias("kind"), "shard", "ids", "tables")
    live = stored(state.select("shard", "words", "singles", "live_contexts", "live_cells", "live_times").mapInArrow(_start(seed, weight), _LIVE_SQL), "seating")

    customers = []
    for turn in range(1, burn + sweeps + 1):
        total = (live.agg(F.sum("sum")).first()[0] or 0.0) + unknown_draw(seed, turn, weight)
        mine = live.select("shard", "contexts", "cells", "tables").mapInArrow(_live_parts, _PART_SQL)
        told = dealt(mine.unionByName(fixed), "owner", "kind", "shard").mapInArrow(_totals(True), _TOTAL_SQL)
        told = told.select("shard", F.lit(0).alias("kind"), "owner", F.col("tables").alias("told"), *(none.cast(f.dataType).alias(f.name) for f in live.schema if f.name != "shard"))
        own = live.select("shard", F.lit(1).alias("kind"), zero.alias("owner"), none.cast("binary").alias("told"), *(c for c in live.columns if c != "shard"))
        old = made[-1]
        live = stored(dealt(told.unionByName(own), "shard", "kind", "owner").mapInArrow(_turn(seed, turn, turn > burn, total, discount, strength, weight), _LIVE_SQL), "seating")
        common.remove_path(spark, old)
        if turn > burn:
            customers.append(live.agg(F.coalesce(F.sum("customers"), F.lit(0))).first()[0])

    kept = dealt(live.select("shard", "contexts", "cells", "kept").mapInArrow(_live_parts, _PART_SQL), "owner", "kind", "shard").mapInArrow(_totals(False), _TOTAL_SQL)
    columns = {"words": "binary", "counts": "binary", "contexts": "binary", "cells": "binary", "times": "binary", "tables": "binary", "history": "binary", "block": "long", "ids": "binary", "spans": "binary"}

    def placed(df: DataFrame, kind: int, **named: str) -> DataFrame:
        return df.select("shard", F.lit(kind).alias("kind"), *((F.col(named[c]) if c in named else none.cast(t)).alias(c) for c, t in columns.items()))

    every = [
        placed(singles, 0, contexts="ids", tables="tables"),
        placed(kept, 1, contexts="ids", tables="tables"),
        placed(live, 2, contexts="contexts", cells="cells", tables="kept", history="history"),
        placed(state, 3, words="words", counts="counts", contexts="contexts", cells="cells", times="times"),
        placed(asked, 4, block="block", ids="ids", spans="spans", contexts="contexts"),
    ]
    for df in every[1:]:
        every[0] = every[0].unionByName(df)
    answers = dealt(every[0], "shard", "kind", "block").mapInArrow(_answer(customers, weight, v, sweeps), _REPLY_SQL)
    unknown = float(parent_means(np.zeros((sweeps, 1)), customers, weight, v)[0])
    told, kept_columns = ["counts", "parents", "tables", "times", "seats"], ["ids", "doc_ids", "lengths", "places"]
    replies = answers.select("block", F.lit(0).alias("kind"), "shard", *told, *(none.cast(known.schema[c].dataType).alias(c) for c in kept_columns))
    own = known.select("block", F.lit(1).alias("kind"), zero.alias("shard"), *(none.cast("binary").alias(c) for c in told), *kept_columns)
    joined = dealt(replies.unionByName(own), "block", "kind", "shard").drop("shard")
    return joined.mapInArrow(_score(n, v, unknown, sweeps, discount, strength), _SCORE_SQL)
