"""Links between texts by the Jaccard similarity of their word shingles.

A text is the set of its shingles' XXH64. ``BANDS`` keys of ``ROWS`` minwise hashes each bring similar sets
together: two sets of similarity 0.8 share no key with probability 0.002, of 0.85 with 0.0001. Sets that meet
under a key are compared whole, so no link is made up.

Pairs that another method found near, such as SimHash fingerprints, are compared whole too, and before all others.

Under each key a few sets, chosen by a hash of set and key, are the hubs that the others are compared to. A group of
near copies so makes rows in proportion to its size, and each of its sets meets hubs under all its keys. Where sets of
different components still stand under a key, other hubs are chosen, until a round links nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meldframe.llm.lines import BITMAP, _bitmap
from meldframe.llm.shared import bounded_batches, releasing, written

WORDS = 5
SIMILARITY = 0.8
SEED = 42
BANDS, ROWS = 16, 5
#: Hubs of a key in the first round, twice as many in each later one, and the most.
HUBS, MOST_HUBS = 4, 64
_LOCAL_SETS = 1 << 18
_BLOCK = 1 << 12


def shingle_set(data: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct XXH64 of a UTF-8 text's shingles. A text of fewer words is one shingle, one without words has none."""
    tokens = data.lower().split()  # of bytes: A-Z only, and exactly space and \t to \r
    if not tokens:
        return np.empty(0, np.uint64)
    text = b" ".join(tokens)
    words = min(words, len(tokens))
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[: len(tokens) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(text[i:j], SEED) for i, j in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64))


def majority(digests: bytes) -> int:
    """SimHash of 64-bit digests, big-endian: a bit is 1 if set in over half of them."""
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(0, dtype=np.int64) * 2 > len(bits)).tobytes(), "big")


def set_name(hashes: np.ndarray) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest(hashes.tobytes())], np.uint64).view(np.int64)[0])


@lru_cache(maxsize=1)
def _multipliers() -> np.ndarray:
    made = [xxhash.xxh64_intdigest(k.to_bytes(4, "big"), SEED) | 1 for k in range(BANDS * ROWS)]
    return np.array(made, np.uint64)[:, None]


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The set's keys; a set without shingles has none."""
    if not len(hashes):
        return np.empty(0, np.int64)
    by, least = _multipliers(), np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        np.minimum(least, (hashes[None, at : at + _BLOCK] * by).min(1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


def sketches(df: DataFrame, text: str, *, words: int = WORDS) -> DataFrame:
    """``df`` with the text replaced by the ``node`` that names its set of shingles, the set's ``size`` and ``keys`` and its
    SimHash ``fingerprint``, a signed long; 0 of a set without shingles."""
    bounded_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name != text]
    data = df.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text}`").cast("binary").alias("_data"))
    last = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size, keys, prints = [], [], [], []
            for x in batch.column(last):
                own = shingle_set(x.as_py() or b"", words)
                node.append(set_name(own)), size.append(len(own)), keys.append(band_keys(own)), prints.append(majority(own.astype(">u8").tobytes()))
            new = [pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(np.array(prints, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], *new], [*batch.schema.names[:last], "node", "size", "keys", "fingerprint"])

    fields = [T.StructField("node", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("fingerprint", T.LongType())]
    return data.mapInArrow(releasing(run), T.StructType([*kept, *fields]))


def _sets(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``node, hashes`` of the ``wanted`` (node, mark: the text's xxhash64) among ``texts`` (mark, data)."""
    maybe = texts.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = maybe.value, set()
        for batch in batches:
            marks, found = batch.column(0).to_numpy(), []
            at = marks & (BITMAP - 1)
            for i in np.flatnonzero(bits[at >> 6] >> (at & 63) & 1).tolist():
                if len(seen) > _LOCAL_SETS:
                    seen.clear()
                if marks[i] not in seen:
                    seen.add(marks[i])
                    hashes = shingle_set(batch.column(1)[i].as_py() or b"", words)
                    found.append((set_name(hashes), hashes.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], ["node", "hashes"])

    found = texts.mapInArrow(releasing(run), "node long, hashes binary")
    return found.join(wanted.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (a, b and more) whose sets are similar."""
    side = lambda s: sets.select(F.col("node").alias(s), F.col("hashes").alias(f"{s}_set"))
    last = len(pairs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(last), batch.column(last + 1), strict=True):
                a, b = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(both >= similarity * (len(a) + len(b) - both) - 1e-6)
            yield batch.select(list(range(last))).filter(pa.array(ok, pa.bool_()))

    return pairs.join(side("b"), "b").join(side("a"), "a").select(*pairs.columns, "a_set", "b_set").mapInArrow(releasing(run), pairs.schema)


def links(own: DataFrame, texts: DataFrame, near: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``a, b``: edges between sets of similarity ``similarity`` or more.

    ``own`` has a row for each set (node, size, keys, mark); ``texts`` has the texts (mark, data); ``near`` has pairs of
    nodes (a, b) to be compared before those that meet under a key.
    """
    under = own.select(F.explode("keys").alias("key"), "node", "size", "mark")
    shared = under.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    met = written(under.join(shared, "key", "left_semi"), "met")
    near = written(near, "near")
    ends = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node")))
    wanted = met.select("node", "mark").union(own.join(ends, "node", "left_semi").select("node", "mark")).distinct()
    sets = written(_sets(texts, written(wanted, "wanted"), words), "sets")
    found = written(_similar(near.select("a", "b"), sets, similarity), "links")
    start = found.groupBy(F.greatest("a", "b").alias("node")).agg(F.min(F.least("a", "b")).alias("now"))
    alike = lambda a, b: F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - 1e-6
    standing = written(met.join(start, "node", "left").select("key", "node", "size", F.coalesce("now", "node").alias("root")), "standing")
    tried, turn = None, 0
    while True:
        hubs = F.array(*(F.min(F.struct(F.xxhash64("node", "key", F.lit(turn), F.lit(k)), "node", "size", "root")) for k in range(min(HUBS << turn, MOST_HUBS))))
        apart = standing.groupBy("key").agg(hubs.alias("hubs"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        chosen = apart.select("key", F.explode(F.array_distinct(F.transform("hubs", lambda h: F.struct(h["node"].alias("b"), h["size"].alias("b_size"), h["root"].alias("b_root"))))).alias("hub"))
        chosen = written(chosen.select("key", "hub.*"), "hubs")
        pairs = standing.join(chosen, "key").where((F.col("root") != F.col("b_root")) & alike(F.col("size"), F.col("b_size")))
        either = lambda a, b: (F.least(a, b), F.greatest(a, b))
        (a, b), (c, d) = either("node", "b"), either("root", "b_root")
        pairs = pairs.select(a.alias("a"), b.alias("b"), c.alias("low"), d.alias("high")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        new = written(_similar(pairs, sets, similarity), "links")
        found = found.union(new.select("a", "b"))
        if new.isEmpty():
            return found
        tried, turn = pairs.select("a", "b") if tried is None else tried.union(pairs.select("a", "b")), turn + 1
        # Each component takes the least it was linked to. Where that leaves two names for one, some pairs are compared in vain.
        joined = standing.join(new.groupBy(F.col("high").alias("root")).agg(F.min("low").alias("now")), "root", "left")
        standing = written(joined.select("key", "node", "size", F.coalesce("now", "root").alias("root")), "standing")
