"""Exact SentencePiece merge-type encoding by backtracking, and decoding.

A text's merge-type (BPE) encoding is the one split into reachable vocabulary
pieces in which every two adjacent pieces are compatible: merging their joint
text again gives just these two.  So instead of merging, the encoder walks the
text: an Aho-Corasick automaton lists the pieces that start at each position,
the longest compatible with the piece before is taken, and on a dead end the
position is marked in a bitfield of failed positions and the walk steps back.
Compatibility is settled once for each pair, by merging, and remembered.

A piece never holds a space mark after another character (checked on loading),
so a text may be cut before each run of space marks; the parts repeat and a
bounded cache keeps their ids.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .byte_bpe import Pieces

MARK = "▁"
_RUNS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class BacktrackingEncoder:
    """Encoder for one merge-type SentencePiece model with byte fallback."""

    def __init__(self, path: str, limit: int = 300_000) -> None:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        proto = ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != 2:
            raise ValueError("not a merge-type (BPE) model")
        norm = proto.normalizer_spec
        if norm.name != "identity" or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only the identity normaliser with escaped white space is supported")
        if any(p.type == p.USER_DEFINED for p in proto.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.prefix = norm.add_dummy_prefix
        self.processor = SentencePieceProcessor(model_file=path)
        self.unknown = self.processor.unk_id()
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == p.BYTE}
        if len(self.bytes) != 256:
            raise ValueError("only models with a piece for every byte are supported")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == p.NORMAL}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == p.NORMAL}
        self.text = {i: t for t, i in self.ids.items()}
        if any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError("a piece holds a space mark after another character")
        self.newline = not any("\n" in t for t in self.ids)
        self.reachable = {t for t in self.ids if self.merge(t) == [t]}
        self.matches = ahocorasick.Automaton()
        for t in self.reachable:
            self.matches.add_word(t, (len(t), self.ids[t]))
        self.matches.make_automaton()
        self.letters = {t for t in self.reachable if len(t) == 1}
        self.names = [str(i) for i in range(len(proto.pieces))]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.marked = Pieces(self._marked, limit)
        self.plain = Pieces(self._unit, limit // 4)

    def merge(self, text: str) -> list[str]:
        """Merge adjacent symbols, best score first and then leftmost, until none joins."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            x, y = self.text[a], self.text[b]
            found = self.pairs[a, b] = self.merge(x + y) == [x, y]
        return found

    def walk(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are in the vocabulary."""
        n = len(text)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (length, i) in self.matches.iter(text):
            starts[end - length + 1].append((end + 1, i))  # shorter pieces end first: the longest is last
        failed = bytearray(n + 1)  # bitfield of positions from which no valid rest exists
        ids: list[int] = []
        at: list[int] = [0]
        left = [len(starts[0])] if n else []
        known, pairs = self.compatible, self.pairs
        while at[-1] < n:
            here, before = starts[at[-1]], ids[-1] if ids else -1
            k = left[-1]
            while k:
                k -= 1
                end, i = here[k]
                if not failed[end] and (before < 0 or (pairs.get((before, i)) if (before, i) in pairs else known(before, i))):
                    left[-1] = k
                    ids.append(i)
                    at.append(end)
                    left.append(len(starts[end]) if end < n else 0)
                    break
            else:
                failed[at.pop()] = 1
                left.pop()
                if not ids:
                    raise AssertionError(f"no encoding for {text!r}")
                ids.pop()
        return ids

    def _unit(self, unit: str) -> tuple[int, ...]:
        """Ids of a part that is cut out of an escaped text; characters outside the vocabulary become bytes."""
        if self.letters.issuperset(unit):
            return tuple(self.walk(unit))
        out: list[int] = []
        known = ""
        for c in unit:
            if c in self.letters:
                known += c
                continue
            if known:
                out += self.walk(known)
                known = ""
            out += map(self.bytes.__getitem__, c.encode("utf-8")) if self.bytes else [self.unknown]
        return tuple(out + (self.walk(known) if known else []))

    def _marked(self, piece: str) -> tuple[int, ...]:
        if self.newline and "\n" in piece and self.bytes:
            first, *rest = piece.split("\n")
            out = self.marked[first] if first else self._unit(MARK)
            for r in rest:
                out += (self.bytes[10],) + (self.plain[r] if r else ())
            return out
        return self._unit(MARK + piece)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if self.prefix and "  " not in text and text[0] != " " and MARK not in text:
            return list(chain.from_iterable(map(self.marked.__getitem__, text.split(" "))))
        escaped = (MARK if self.prefix else "") + text.replace(" ", MARK)
        return list(chain.from_iterable(map(self.plain.__getitem__, _RUNS.findall(escaped))))

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids)

    def digest(self, ids: list[int]) -> str:
        return hashlib.sha256(",".join(map(self.names.__getitem__, ids)).encode()).hexdigest()


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> BacktrackingEncoder:
    """One encoder for each model file and process, kept between tasks."""
    return BacktrackingEncoder(path)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in _DIGEST.names}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = codec.encode(text)
                back = codec.decode(ids)
                for k, v in zip(rows, (doc_id, len(ids), codec.digest(ids), hashlib.sha256(back.encode("utf-8")).hexdigest()), strict=True):
                    rows[k].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=_DIGEST)

    return run


def _encodings(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        for batch in batches:
            ids = [codec.encode(t) for t in batch.column(1).to_pylist()]
            back = [codec.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    common.small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, decoded text, one row for each input row.

    A null text counts as empty and has no ids; long texts are walked whole;
    repeated rows and null ids pass through; an empty table gives no rows.
    The model file must be readable on every executor under the same path.
    """
    return _rows(docs, id_col, text_col).mapInArrow(_encodings(model), "doc_id long, n_tokens long, ids array<int>, decoded string")


def encode_digest(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_decode, with digests in place of the ids and the text, which then never leave the worker."""
    return _rows(docs, id_col, text_col).mapInArrow(_digests(model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
