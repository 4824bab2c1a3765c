"""SimHash near-duplicate groups by pigeonhole blocks.

Fingerprints are computed from word shingles.  The 64 bits are cut into
``blocks`` pieces; two fingerprints that differ in at most ``distance`` bits
agree on at least ``blocks - distance`` pieces, so each distinct fingerprint is
keyed by every choice of that many pieces and only fingerprints under one key
are compared.  Comparison happens inside the task that holds the key; a task
emits a spanning forest of the links it verified, never all pairs.  Keys that
hold more than ``tile`` fingerprints are cut into tiles, pairs of chunks, that
go to different tasks.  Components come from alternating large-star and
small-star steps; each round's links are a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common

SEED = 42


def fingerprint(text: str, width: int = 4) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    words = common.byte_words(text)
    if not words:
        return 0
    if len(words) <= width:
        return xxh64_intdigest(b" ".join(words), SEED)
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return _majority([xxh64_intdigest(g, SEED) for g in grams])


def _majority(hashes: list[int]) -> int:
    ones = np.zeros(64, np.int64)
    every = np.array(hashes, np.uint64)
    for at in range(0, len(every), 65536):
        part = every[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(every)).astype(np.uint8), bitorder="little")
    return int(bits.view(np.uint64)[0])


def _prints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t or "", width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id and the fingerprint as a signed long, one row for each input row."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_prints(width), "doc_id long, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """Masks of the kept bits, one for each choice of blocks - distance blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def blocks_for(n: int, distance: int) -> int:
    """Fewest blocks, beyond one spare, whose narrowest key still tells n fingerprints apart to within a few."""
    for blocks in range(distance + 2, distance + 7):
        if 64 * (blocks - distance) / blocks >= log2(max(n, 2)) - 3:
            return blocks
    return distance + 6


class _Forest:
    """Union-find over the rows of one key."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def roots(self) -> np.ndarray:
        up = self.up
        while not np.array_equal(up, up[up]):
            up = up[up]
        self.up = up
        return up


def _links(fp: np.ndarray, node: np.ndarray, distance: int, step: int = 512) -> list[tuple[int, int]]:
    """Spanning forest of the links among the fingerprints of one key; memory step x rows."""
    n, forest, out = len(fp), _Forest(len(fp)), []
    for at in range(0, n, step):
        a = fp[at : at + step]
        b = fp[at:]
        close = np.bitwise_count(a[:, None] ^ b[None, :]) <= distance
        known = forest.roots()
        # links inside a known tree add nothing: look only at pairs of different trees
        close &= known[at : at + step][:, None] != known[at:][None, :]
        for i, j in zip(*np.nonzero(close), strict=True):
            x, y = forest.root(at + int(i)), forest.root(at + int(j))
            if x != y:
                x, y = (x, y) if node[x] < node[y] else (y, x)
                forest.up[y] = x
                out.append((int(node[x]), int(node[y])))
    return out


def _verify(distance: int):
    """Rows sorted by key: vectorised comparison for small keys, blocked comparison for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]  # mask no, masked bits, tile, fp, node
            cols = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            n = len(cols[0])
            if not n:
                continue
            new = np.ones(n, bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
            last = int(np.flatnonzero(new)[-1])
            yield from emit([c[:last] for c in cols], new[:last])
            rest = [c[last:] for c in cols]
        if rest is not None:
            new = np.zeros(len(rest[0]), bool)
            new[:1] = True
            yield from emit(rest, new)

    def emit(cols: list[np.ndarray], new: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = len(new)
        if n < 2:
            return
        fp, node = cols[3].view(np.uint64), cols[4]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, n))
        small = sizes <= 32
        group = np.repeat(np.arange(len(starts)), sizes)
        ok = small[group]
        a_all, b_all = [], []
        for k in range(1, int(sizes[small].max(initial=1))):
            i = np.flatnonzero(ok[:-k] & (group[k:] == group[:-k]))
            if len(i):
                i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= distance]
                a_all.append(node[i])
                b_all.append(node[i + k])
        pairs = [(int(a), int(b)) for s, z in zip(starts[~small], sizes[~small], strict=True) for a, b in _links(fp[s : s + z], node[s : s + z], distance)]
        if pairs:
            a_all.append(np.array([p[0] for p in pairs], np.int64))
            b_all.append(np.array([p[1] for p in pairs], np.int64))
        if a_all:
            a, b = np.concatenate(a_all), np.concatenate(b_all)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["u", "v"])

    return run


def hamming_links(nodes: DataFrame, distance: int = 4, blocks: int | None = None, tile: int = 8192) -> DataFrame:
    """Links (u > v) that connect the same components as all pairs of fingerprints within the distance.

    nodes: node long (unique) and fp long (distinct).  Exact: every pair within
    the distance shares a key, and each key's comparison is complete.
    """
    spark = nodes.sparkSession
    blocks = blocks or blocks_for(nodes.count(), distance)
    masks = block_masks(blocks, distance)
    table = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in masks))
    keyed = nodes.select("node", "fp", F.posexplode(table).alias("m", "mask")).select("m", F.col("fp").bitwiseAND(F.col("mask")).alias("k"), "fp", "node")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    crowded = common.written(keyed.groupBy("m", "k").count().where(F.col("count") > tile).select("m", "k", F.ceil(F.col("count") / tile).cast("int").alias("_c")), "crowded")
    rows = keyed.withColumn("tile", F.lit(0))
    if not crowded.isEmpty():
        known = keyed.join(crowded, ["m", "k"], "left")
        own = F.pmod(F.xxhash64("fp"), F.col("_c"))
        tiles = F.when(F.col("_c").isNull(), F.array(F.lit(0))).otherwise(
            F.transform(F.sequence(F.lit(0), F.col("_c") - 1), lambda j: (F.least(j.cast("long"), own) * F.col("_c") + F.greatest(j.cast("long"), own)).cast("int"))
        )
        rows = known.select("m", "k", "fp", "node", F.explode(F.array_distinct(tiles)).alias("tile"))
    dealt = rows.select("m", "k", "tile", "fp", "node").repartition(n, "m", "k", "tile").sortWithinPartitions("m", "k", "tile")
    return dealt.mapInArrow(_verify(distance), "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable for every node of the links (u, v): node, root. Alternating stars until nothing changes."""
    spark = links.sparkSession

    def stored(df: DataFrame) -> tuple[DataFrame, str]:
        path = common.table_path(spark, "stars")
        df.write.parquet(path)
        return spark.read.schema("u long, v long").parquet(path), path

    now, path = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(state) == before or state[0] == 0:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        before, old = tuple(state), path
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lowest, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(lowest.select("u", F.col("m").alias("v")))
        now, path = stored(small.distinct())
        common.remove_path(spark, old)


def _hex16(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def _linked(prints: DataFrame, distance: int, blocks: int | None) -> DataFrame:
    """fp and the smallest fingerprint that it reaches (root), for each distinct fingerprint of the table prints.

    Nodes are the fingerprints themselves, so ids may repeat or be null.
    """
    nodes = common.written(prints.select("fp").distinct(), "nodes")
    roots = components(hamming_links(nodes.select(F.col("fp").alias("node"), "fp"), distance, blocks))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """Near-duplicate groups: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null and empty texts have fingerprint zero and are linked like any other;
    an empty table gives no rows; repeated ids yield a row each, and an id with
    several texts may stand in several components.  Rows with a null id link
    others like any row; a component without an id has a null component_id.
    Columns other than the two named are not read.
    """
    prints = common.written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    linked = common.written(_linked(prints, distance, blocks), "linked")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(linked, "fp")
    groups = least.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = linked.join(groups, "root").select("fp", "component_id")
    return prints.join(labelled, "fp").select("doc_id", _hex16(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """One row of each near-duplicate group, with all its columns: that of the smallest id.

    Texts are linked as by near_duplicates, here over five words.  A group's
    row is the one of its smallest id that is not null, if it has one; of rows
    that share that id, the one whose text (two 64-bit hashes), then whose
    other columns hash smallest; so exactly one row stays, whatever ids are
    null or repeated.  Null texts count as empty, an empty table stays empty,
    and columns may have any names.
    """
    common.small_batches(docs.sparkSession)
    text = F.coalesce(docs[common.quoted(text_col)], F.lit(""))
    doc_id = docs[common.quoted(id_col)].cast("long")
    keys = [F.xxhash64(text), F.xxhash64(F.lit(1), text)]
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), *(k.alias(f"k{i}") for i, k in enumerate(keys)))
    prints = common.written(rows.mapInArrow(_keyed_prints(width), "doc_id long, fp long, k0 long, k1 long"), "fingerprints")
    linked = _linked(prints, distance, blocks)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k0", "k1")
    first = prints.groupBy("fp").agg(F.min(order).alias("m")).join(linked, "fp").groupBy("root").agg(F.min("m").alias("m"))
    stay = first.select(F.col("m.doc_id").alias("_i"), F.col("m.k0").alias("_a"), F.col("m.k1").alias("_b"))
    found = docs.join(stay, doc_id.eqNullSafe(stay["_i"]) & (keys[0] == stay["_a"]) & (keys[1] == stay["_b"]), "left_semi")
    return common.one_row(found, [doc_id, *keys])


def _keyed_prints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), batch.column(2), batch.column(3)], ["doc_id", "fp", "k0", "k1"])

    return run
