"""Byte-level BPE encoding and decoding over length-bucketed padded matrices.

The distinct pieces of some texts are put, by length, into padded matrices of token ids, one piece a
row. Each round every row merges its leftmost pair of minimum rank: ranks come from a hashed pair
table, the row is compacted, and rows without a mergeable pair leave the matrix. Results equal those
of the tiktoken library for the same rank file and pattern, without special tokens.

Bounds: a worker holds the vocabulary (its size is fixed by the rank file), one Arrow batch of texts,
and a cache of encoded pieces that is emptied at ``CACHE_PIECES``. There is no shuffle.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from meldframe.llm.shared import bounded_batches, releasing, require

#: Pieces kept encoded between batches; the cache starts anew beyond that.
CACHE_PIECES = 1 << 18
#: Bytes of text whose pieces are encoded together.
GROUP_BYTES = 1 << 21
#: Pieces of more bytes than this have a matrix of their own, of one row.
LONG_PIECE = 512
#: Ids of a padded matrix, about: bounds what a round of merges takes beside it.
MATRIX_IDS = 1 << 18
_NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of their concatenation, looked up in bulk."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, _NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slots, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            at = slots[todo]
            empty = self.keys[at] == -1
            self.keys[at[empty]] = keys[todo[empty]]  # of pairs with one slot, the last written stays
            placed = self.keys[at] == keys[todo]
            self.values[at[placed]] = merged[todo[placed]]
            todo = todo[~placed]
            slots[todo] = (slots[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids, ``_NONE`` for pairs without one; negative ids are padding."""
        keys = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], _NONE)
        open_ = np.flatnonzero((out == _NONE) & (self.keys[slot] != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot.flat[open_] = (slot.flat[open_] + 1) & self.mask
            held = self.keys[slot.flat[open_]]
            same = held == keys.flat[open_]
            out.flat[open_[same]] = self.values[slot.flat[open_[same]]]
            open_ = open_[~same & (held != -1)]
        out[(left < 0) | (right < 0)] = _NONE
        return out


class Vocabulary:
    """A rank file of the tiktoken library: each line a base64 token and its rank, which is its id."""

    def __init__(self, path: str):
        self.ranks = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        left, right, merged = (np.array(x, np.int32) for x in (left, right, merged))
        self.pairs = PairTable(left, right, merged)
        size = max(self.ranks.values()) + 1
        lengths = np.zeros(size, np.int64)
        for token, rank in self.ranks.items():
            lengths[rank] = len(token)
        self.lengths = lengths
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        by_id = sorted(self.ranks.items(), key=lambda x: x[1])
        self.bytes = np.frombuffer(b"".join(t for t, _ in by_id), np.uint8)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each non-empty piece."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = np.array([rank], np.int32)
            elif len(piece) > LONG_PIECE:
                out[i] = self._merge_long(piece)
            else:
                buckets.setdefault((len(piece) - 1).bit_length(), []).append(i)
        for rows in buckets.values():
            width = max(len(pieces[i]) for i in rows)
            step = max(1, MATRIX_IDS // width)
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                for i, ids in zip(some, self._merge_matrix([pieces[i] for i in some]), strict=True):
                    out[i] = ids
        return out  # type: ignore[return-value]

    def _merge_matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        sizes = np.array([len(p) for p in pieces])
        width = int(sizes.max())
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(pieces), 0), _NONE)
        done: list[np.ndarray] = [ids[0]] * len(pieces)
        rows = np.arange(len(pieces))
        while len(rows):
            least = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            merged = ranks[np.arange(len(rows)), least] if ranks.shape[1] else np.full(len(rows), _NONE)
            live = merged != _NONE
            for k in np.flatnonzero(~live):
                done[rows[k]] = ids[k, : sizes[rows[k]]].copy()
            rows, least, merged = rows[live], least[live], merged[live]
            if not len(rows):
                break
            ids, ranks = ids[live], ranks[live]
            each, columns = np.arange(len(rows)), np.arange(ids.shape[1] - 1)
            # The pair's right part goes: what stands after it moves one place to the left.
            ids[each, least] = merged
            ids = np.take_along_axis(ids, columns + (columns > least[:, None]), 1)
            ranks = np.take_along_axis(ranks, columns[:-1] + (columns[:-1] > least[:, None]), 1)
            sizes[rows] -= 1
            width = int(sizes[rows].max())
            ids, ranks = ids[:, :width], ranks[:, : width - 1]
            if ranks.shape[1]:
                has = np.flatnonzero(least > 0)
                ranks[has, least[has] - 1] = self.pairs.find(ids[has, least[has] - 1], ids[has, least[has]])
                has = np.flatnonzero(least < width - 1)
                ranks[has, least[has]] = self.pairs.find(ids[has, least[has]], ids[has, least[has] + 1])
        return done

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """One long row: a round merges the occurrences of the minimum pair from left to right, up to the
        first merge that makes a pair of the same rank or less, which the next round has to take first."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.find(ids[:-1], ids[1:])
        while len(ranks) and (least := ranks.min()) != _NONE:
            at = np.flatnonzero(ranks == least)
            begins = np.concatenate([[True], np.diff(at) > 1])
            first = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            padded, merged = np.concatenate([[-1], ids, [-1]]).astype(np.int32), np.full(len(at), least, np.int32)
            after_merge = np.concatenate([[False], np.diff(at) == 2])
            before = np.where(after_merge, least, padded[at]).astype(np.int32)
            early = np.minimum(self.pairs.find(before, merged), self.pairs.find(merged, padded[at + 3])) <= least
            if early.any():
                at = at[: int(early.argmax()) + 1]
            ids[at] = least
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids[keep]
            ranks = np.append(ranks, _NONE)[keep][: len(ids) - 1]
            at = np.cumsum(keep)[at] - 1
            again = np.unique(np.concatenate([at - 1, at]))
            again = again[(again >= 0) & (again < len(ids) - 1)]
            ranks[again] = self.pairs.find(ids[again], ids[again + 1])
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths)):
            raise ValueError("id outside the vocabulary")
        return self.bytes[ragged(self.starts[ids], self.lengths[ids])].tobytes()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all slices, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Known(dict):
    """The number of each piece seen; a piece asked for the first time gets the next one and is listed in ``new``."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = at = len(self)
        self.new.append(piece)
        return at


class Encoder:
    """Encodes texts piece by piece, keeping what it has encoded."""

    def __init__(self, vocab: Vocabulary, pattern: str):
        self.vocab, self.pieces = vocab, regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        self.known, self.size = _Known(), 0
        self.flat, self.starts, self.counts = np.empty(1 << 16, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHE_PIECES:
            self._forget()
        number = self.known.__getitem__
        at = [np.fromiter(map(number, self.pieces.findall(t)), np.int64) for t in texts]
        if new := self.known.new:
            self.known.new = []
            ids = self.vocab.merge([p.encode() for p in new])
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            self.starts = np.concatenate([self.starts, self.size + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            end = self.size + int(counts.sum())
            if end > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.size], np.empty(2 * end - self.size, np.int32)])
            self.flat[self.size : end] = np.concatenate(ids)
            self.size = end
        return [self.flat[ragged(self.starts[k], self.counts[k])] for k in at]


@lru_cache(maxsize=1)
def encoder(ranks_path: str, pattern: str) -> Encoder:
    """One a worker process; a task forgets what it encoded, as later stages need the memory."""
    return Encoder(vocabulary(ranks_path), pattern)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about ``GROUP_BYTES`` together."""
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size > GROUP_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def _int_lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)]).astype(np.int32)
    values = np.concatenate(rows) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def encode(df: DataFrame, text: str, ranks_path: str, pattern: str, *, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with the array column ``ids``: the token ids of the whole text. No shuffle. With ``decoded`` also the bytes
    these ids decode to, in a column of that name: one worker process does both, where ``decode`` takes another.

    A NULL or empty text gives an empty array. Other columns pass unchanged; an input column
    named like ``ids`` or ``decoded`` is replaced.
    Every executor must be able to open ``ranks_path`` (for instance a file shipped with the job).
    """
    require(df, text)
    if text == decoded:
        raise ValueError("decoded must have a name of its own")
    df = df.drop(ids, *([decoded] if decoded else []))
    bounded_batches(df.sparkSession)
    at, data = df.columns.index(text), [T.StructField(decoded, T.BinaryType())] if decoded else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            rows = [x for some in _groups(texts) for x in own.encode(some)]
            back = [pa.array(map(own.vocab.decode, rows), pa.binary())] if decoded else []
            yield pa.RecordBatch.from_arrays([*batch.columns, _int_lists(rows), *back], [*batch.schema.names, ids, *([decoded] if decoded else [])])
        own._forget()

    return df.mapInArrow(releasing(run), T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), *data]))


def decode(df: DataFrame, ids: str, ranks_path: str, *, data: str = "decoded") -> DataFrame:
    """``df`` with the binary column ``data``: the bytes of the ids. No shuffle. NULL ids give NULL bytes;
    an input column named like ``data`` is replaced; an id outside the vocabulary is an error."""
    require(df, ids)
    df = df.drop(data)
    bounded_batches(df.sparkSession)
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(ranks_path)
        for batch in batches:
            rows = [None if not x.is_valid else vocab.decode(x.values.to_numpy(zero_copy_only=False)) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.binary())], [*batch.schema.names, data])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(data, T.BinaryType())]))
