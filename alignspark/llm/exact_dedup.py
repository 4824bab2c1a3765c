"""Exact deduplication with Patricia tries.

Every task inserts the whole byte strings of its rows into a compressed radix
trie whose terminal nodes hold the smallest and largest identifier and a count,
so that copies collapse before the shuffle however many there are.  The
terminals are dealt out by (length, SHA-256); each such partition inserts its
full byte strings into one trie again, whose terminals own the texts.  Equality
never rests on the hash: two different texts under one hash raise an error
instead of being merged.

Memory: a trie that holds more than ``trie_bytes`` spills whole first-level
subtrees, largest first: those of the first stage as partial terminals, which
the second merges, those of the second as finished ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving over slices."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class PatriciaTrie:
    """Compressed radix trie over byte strings; a terminal is [smallest id, largest id, count]."""

    __slots__ = ("root", "held")

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]  # edge label, children by first byte, terminal
        self.held = 0

    def add(self, key: bytes, smallest: int | None, largest: int | None, count: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = node = [key[at:], {}, None]
                self.held += len(key) - at + 200
                break
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            cut = _shared(label, key[at : at + len(label)])
            middle = [label[:cut], {label[cut]: child}, None]
            child[0] = label[cut:]
            node[1][middle[0][0]] = middle
            self.held += 200
            node, at = middle, at + cut
        end = node[2]
        if end is None:
            node[2] = [smallest, largest, count]
        else:
            if smallest is not None:
                end[0] = smallest if end[0] is None else min(end[0], smallest)
                end[1] = largest if end[1] is None else max(end[1], largest)
            end[2] += count

    def terminals(self, node: list | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, list]]:
        """Full strings with their terminals; iterative, as a chain of prefixes can be deep."""
        stack = [(node or self.root, prefix)]
        while stack:
            at, before = stack.pop()
            key = before + at[0]
            if at[2] is not None:
                yield key, at[2]
            stack.extend((child, key) for child in at[1].values())

    def spill(self, keep: int) -> Iterator[tuple[bytes, list]]:
        """Take out first-level subtrees, largest first, until at most `keep` bytes are held."""

        def weight(node: list) -> int:
            total, stack = 0, [node]
            while stack:
                at = stack.pop()
                total += len(at[0]) + 200
                stack.extend(at[1].values())
            return total

        sizes = {first: weight(child) for first, child in self.root[1].items()}
        for first in sorted(sizes, key=sizes.get, reverse=True):
            if self.held <= keep:
                return
            yield from self.terminals(self.root[1].pop(first))
            self.held -= sizes[first]


_OUT = pa.schema([("_len", pa.int64()), ("_sha", pa.binary()), ("_bytes", pa.binary()), ("_min", pa.int64()), ("_max", pa.int64()), ("_n", pa.int64())])
_OUT_SQL = "_len long, _sha binary, _bytes binary, _min long, _max long, _n long"


def _pack(rows: list[tuple[bytes, list]], with_bytes: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "_len": [len(k) for k, _ in rows],
            "_sha": [hashlib.sha256(k).digest() for k, _ in rows],
            "_bytes": [k if with_bytes else None for k, _ in rows],
            "_min": [e[0] for _, e in rows],
            "_max": [e[1] for _, e in rows],
            "_n": [e[2] for _, e in rows],
        },
        schema=_OUT,
    )


def _chunks(rows: Iterator[tuple[bytes, list]], with_bytes: bool = True, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[0])
        if size >= most or len(part) >= 2000:
            yield _pack(part, with_bytes)
            part, size = [], 0
    if part:
        yield _pack(part, with_bytes)


def _local(trie_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie()
        for batch in batches:
            for i, key in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                trie.add(key, i, i, 1)
            if trie.held > trie_bytes:
                yield from _chunks(trie.spill(trie_bytes // 2))
        yield from _chunks(trie.terminals())

    return run


def _merge(trie_bytes: int):
    """Rows sorted by (length, hash) to the terminals of one trie for the whole partition.

    When the trie holds more than ``trie_bytes`` between two hashes, subtrees
    are given out and dropped: their texts are complete, as a text's rows
    follow each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, text, trie = None, None, PatriciaTrie()
        for batch in batches:
            for length, sha, key, low, high, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (length, sha) != now:
                    if trie.held > trie_bytes:
                        yield from _chunks(trie.spill(trie_bytes // 2), with_bytes=False)
                    now, text = (length, sha), key
                elif key != text:
                    raise ValueError(f"different texts share length and SHA-256 {sha.hex()}")
                trie.add(key, low, high, n)
        yield from _chunks(trie.terminals(), with_bytes=False)

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = 48 << 20) -> DataFrame:
    """One row for each distinct text: _len (bytes), _sha (binary), smallest and largest id, number of rows."""
    rows = docs.select(F.col(common.quoted(id_col)).cast("long").alias("_id"), F.coalesce(F.col(common.quoted(text_col)), F.lit("")).alias("_text"))
    local = rows.mapInArrow(_local(trie_bytes), _OUT_SQL)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = local.repartition(n, "_len", "_sha").sortWithinPartitions("_len", "_sha")
    return dealt.mapInArrow(_merge(trie_bytes), _OUT_SQL).drop("_bytes")


def _judged(docs: DataFrame, id_col: str, text_col: str, keep: str, trie_bytes: int, columns: list) -> DataFrame:
    if keep not in ("largest", "smallest"):
        raise ValueError("keep must be 'largest' or 'smallest'")
    common.small_batches(docs.sparkSession)
    groups = exact_groups(docs, id_col, text_col, trie_bytes).withColumnRenamed("_max" if keep == "largest" else "_min", "_keep")
    text = F.coalesce(F.col(common.quoted(text_col)), F.lit(""))
    rows = docs.select(*columns, F.octet_length(text).cast("long").alias("_len"), F.unhex(F.sha2(text, 256)).alias("_sha"))
    return rows.join(groups, ["_len", "_sha"], "inner")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", trie_bytes: int = 48 << 20) -> DataFrame:
    """Decide for every row which row of its group of identical texts stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row for each
    input row.  A null text counts as empty; an empty table gives no rows; a
    null id takes no part in the choice unless all ids of the group are null,
    and then all rows stay; rows repeated with the winning id are all marked
    kept.  Columns other than the two named are neither read nor returned.
    """
    joined = _judged(docs, id_col, text_col, keep, trie_bytes, [F.col(common.quoted(id_col)).cast("long").alias("doc_id")])
    return joined.select(
        "doc_id",
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", trie_bytes: int = 48 << 20) -> DataFrame:
    """Exactly one row, with all its columns, of each group of identical texts: the one of the winning id.

    Of rows repeated with the winning id, or of a group whose ids are all
    null, the row whose columns have the smallest hash stays.  A null text
    counts as empty, an empty table stays empty, and columns may have any names.
    """
    columns = [docs[common.quoted(c)] for c in docs.columns]
    hashed = [c for c, (_, kind) in zip(columns, docs.dtypes, strict=True) if "map<" not in kind and "variant" not in kind]
    joined = _judged(docs, id_col, text_col, keep, trie_bytes, [F.struct(*columns).alias("_row"), F.xxhash64(*hashed).alias("_order"), F.col(common.quoted(id_col)).cast("long").alias("_id")])
    kept = joined.where(F.col("_id").eqNullSafe(F.col("_keep")))
    return kept.groupBy("_len", "_sha").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")
