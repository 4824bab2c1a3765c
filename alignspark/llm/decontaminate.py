"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

A mask is a fixed pattern of token positions that count (1) and that are
ignored (0).  Benchmark and documents are hashed under every mask at every
position and joined on the hash; a substitution under an ignored position does
not disturb the hit.  With the default masks every window of 12 to 20 tokens
keeps a hit when any fifth of its tokens is substituted.  Items of fewer tokens
are cut into one run more than the substitutions they may have, so that a run
stays whole; masks of the runs' lengths are only used where the benchmark has
such items.  A hit fixes how item and document lie against each other; the item
is then compared there token by token, and the pair is reported if some window
of the item matches to the share ``share``.

Plan: the first pass over the documents is generators, hashes and a hash join
in one code-generated stage whose output rows are three numbers (document, item,
how they lie); they are counted per document before the shuffle and written to
the shared folder.  The second pass compares only documents that have a hit.
The benchmark's hashes, its items, and the hits are broadcast only if their
summed bytes are at most ``broadcast_bytes``; beyond that the joins shuffle,
and seeds are repeated over salts, so that a seed of common words is many tasks'.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Spaced seeds of weight 5.
MASKS = ("111101", "1100111")
#: Items of fewer tokens are found by runs.
SHORT = 12
_NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"
_UNSPACED = r"[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]"  # Thai, kana, Han


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits; a null text has none.

    In scripts without spaces (Han, kana, Thai) each character is a token.
    """
    lower = F.lower(F.coalesce(text, F.lit("")))
    spaced = F.when(lower.rlike(_UNSPACED), F.regexp_replace(lower, f"({_UNSPACED})", " $1 ")).otherwise(lower)
    return F.array_remove(F.split(spaced, _NOT_WORD), "")


def runs(length: int, share: float = 0.8) -> list[tuple[int, int]]:
    """(start, tokens) of the runs of a short item, one more than the tokens that may differ."""
    parts = length - ceil(length * share) + 1
    edges = [length * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _care(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _at_every_position(df: DataFrame, tokens: str, at: str, keep: list[str], masks: tuple[str, ...]) -> DataFrame:
    """A row for each position (from 0) and mask that fits there, with the hash of the tokens that count.

    Tokens are hashed once each; the masks are rows, so that one short
    expression serves them all and the generated code stays small enough to be
    compiled.
    """
    span, weight = min(map(len, masks)), max(len(_care(m)) for m in masks)
    # a mask of less weight repeats its last position
    listed = F.array(*(F.struct(F.lit(k).alias("_m"), F.lit(len(m)).alias("_len"), *(F.lit([*_care(m), *[_care(m)[-1]] * weight][i]).alias(f"_o{i}") for i in range(weight))) for k, m in enumerate(masks)))
    hashed = df.where(F.size(tokens) >= span).select(*keep, tokens, F.transform(tokens, lambda t: F.xxhash64(t)).alias("_th"))
    places = hashed.select(*keep, tokens, "_th", F.explode(F.sequence(F.lit(0), F.size("_th") - F.lit(span))).alias(at))
    masked = places.select(*keep, tokens, "_th", at, F.inline(listed)).where(F.col(at) + F.col("_len") <= F.size("_th"))
    return masked.select(*keep, tokens, at, "_m", F.xxhash64("_m", *(F.get("_th", F.col(at) + F.col(f"_o{i}")) for i in range(weight))).alias("_h"))


def _sent_if_small(df: DataFrame, most: int, width: Column) -> tuple[DataFrame, bool]:
    """df, marked for broadcast if the sum of its rows' widths in bytes is at most `most`; and whether it is."""
    small = (df.agg(F.sum(width)).first()[0] or 0) <= most
    return (F.broadcast(df), True) if small else (df, False)


def _seeds(items: DataFrame, masks: tuple[str, ...], share: float) -> tuple[DataFrame, tuple[str, ...]]:
    """_h, _m, item_id, _q of the items, and the masks that documents need: the given ones, and those of the runs of short items."""
    lengths = sorted(r["n"] for r in items.select(F.size("_it").alias("n")).where(F.col("n").between(1, SHORT - 1)).distinct().collect())  # at most 11
    every = (*masks, *("1" * n for n in sorted({n for length in lengths for _, n in runs(length, share)})))
    seeds = _at_every_position(items.where(F.size("_it") >= SHORT), "_it", "_q", ["item_id"], masks).select("_h", "_m", "item_id", "_q")
    for length in lengths:
        short = _at_every_position(items.where(F.size("_it") == length), "_it", "_q", ["item_id"], every)
        listed = [(F.col("_q") == start) & (F.col("_m") == every.index("1" * n)) for start, n in runs(length, share)]
        seeds = seeds.unionByName(short.where(reduce(Column.__or__, listed)).select("_h", "_m", "item_id", "_q"))
    return seeds, every


def seed_hits(rows: DataFrame, keys: list[str], items: DataFrame, masks: tuple[str, ...] = MASKS, share: float = 0.8, broadcast_bytes: int = 64 << 20, salts: int = 16) -> DataFrame:
    """The documents' keys, item_id, shift (document position less item position) and the number of seeds that agree there."""
    seeds, every = _seeds(items, masks, share)
    seeds = common.written(seeds, "seeds")
    places = _at_every_position(rows, "_dt", "_p", keys, every).select("_h", "_m", *keys, "_p")
    sent, small = _sent_if_small(seeds, broadcast_bytes, F.lit(40))
    if small:
        hits = places.join(sent, ["_h", "_m"])
    else:
        salted = seeds.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        hits = places.withColumn("_s", F.pmod(F.xxhash64(*keys, "_p"), F.lit(salts)).cast("int")).join(salted, ["_h", "_m", "_s"])
    return hits.groupBy(*keys, "item_id", (F.col("_p") - F.col("_q")).alias("shift")).agg(F.count("*").alias("seeds"))


def _pairs(rows: DataFrame, keys: list[str], benchmark: DataFrame, masks: tuple[str, ...], window: int, share: float, broadcast_bytes: int, item_col: str, item_text: str) -> DataFrame:
    """The documents' keys, item_id, matched, window for rows of keys and tokens (_dt)."""
    items = benchmark.select(F.col(common.quoted(item_col)).cast("long").alias("item_id"), word_tokens(F.col(common.quoted(item_text))).alias("_it"))
    hits = common.written(seed_hits(rows, keys, items, masks, share, broadcast_bytes), "seed_hits")
    found, _ = _sent_if_small(hits.select(*(F.col(k).alias(f"_of_{k}") for k in keys), "item_id", "shift"), broadcast_bytes, F.lit(40))
    listed, _ = _sent_if_small(items, broadcast_bytes, F.octet_length(F.array_join("_it", " ")) + F.lit(40))
    same_row = reduce(Column.__and__, (rows[k].eqNullSafe(found[f"_of_{k}"]) for k in keys))
    # equal ids with different texts, on either side, are compared with each other's hits; the best match counts
    pairs = rows.join(found, same_row).join(listed, "item_id")
    first = F.greatest(F.lit(0), -F.col("shift"))  # of the item's tokens that lie on the document
    length = F.least(F.size("_it"), F.size("_dt") - F.col("shift")) - first
    same = F.zip_with(F.slice("_dt", first + F.col("shift") + 1, F.greatest(length, F.lit(0))), F.slice("_it", first + 1, F.greatest(length, F.lit(0))), lambda a, b: (a == b).cast("int"))
    compared = pairs.select(*keys, "item_id", same.alias("_same"), F.least(F.lit(window), F.size("_it")).alias("window"))
    sums = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("_same") - F.col("window") + 1, F.lit(1))),
        lambda s: F.aggregate(F.slice("_same", s, F.col("window")), F.lit(0), lambda a, b: a + b),
    )
    best = compared.select(*keys, "item_id", "window", F.array_max(sums).alias("matched"))
    close = best.where((F.col("window") > 0) & (F.col("matched") >= F.ceil(F.col("window") * F.lit(share))))
    return close.groupBy(*keys, "item_id").agg(F.max("matched").alias("matched"), F.max("window").alias("window"))


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = 20, share: float = 0.8, broadcast_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of document and benchmark item that overlap: doc_id, item_id, matched, window.

    ``window`` of a pair is the asked window or the item's length if that is
    less; ``matched`` is the most tokens that agree in one such window.  Null
    and empty texts have no tokens and are never reported; an item of one to
    four tokens is found where it occurs word for word; an empty table on
    either side gives no rows; repeated ids give one row a pair with the best
    match; null ids of documents are reported as null, items with a null id are
    left out; other columns are not read.
    """
    rows = docs.select(F.col(common.quoted(id_col)).cast("long").alias("doc_id"), word_tokens(F.col(common.quoted(text_col))).alias("_dt"))
    return _pairs(rows, ["doc_id"], benchmark, masks, window, share, broadcast_bytes, item_col, item_text)


def clean_rows(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = 20, share: float = 0.8, broadcast_bytes: int = 64 << 20, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text overlaps no benchmark item.

    Rows are judged by their text (two 64-bit hashes of it), not by their ids:
    null and repeated ids go or stay by their own text, repeated rows alike,
    null and empty texts stay, an empty benchmark leaves all rows, and other
    columns pass through whatever their names.
    """

    def keys(text: Column) -> list[Column]:
        return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]

    text = docs[common.quoted(text_col)]
    rows = docs.select(*(k.alias(f"_k{i}") for i, k in enumerate(keys(text))), word_tokens(text).alias("_dt"))
    found = _pairs(rows, ["_k0", "_k1"], benchmark, masks, window, share, broadcast_bytes, item_col, item_text).select("_k0", "_k1").distinct()
    a, b = keys(text)
    return docs.join(found, (a == found["_k0"]) & (b == found["_k1"]), "left_anti")
