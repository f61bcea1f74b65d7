"""Language identification by rank-order profiles of character n-grams.

A profile lists a language's most frequent n-grams (one to three letters, words padded with a space) by
rank. A text's own most frequent n-grams are compared to each profile by out-of-place distance: the sum
of the rank differences, with the profile's length for n-grams that it lacks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meldframe.llm.shared import bounded_batches, require

#: N-grams of a profile, and of a text, that are ranked.
TOP = 300
UNKNOWN = "und"
_BITS = 21
#: N-grams of a language gathered in a task before they are summed up.
_PENDING = 1 << 22


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str) -> np.ndarray:
    """All n-grams of the whole text in lower case, each as one int64; what isn't a letter counts as a space,
    and runs of those as one."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    codes = np.concatenate([[0], np.where(letter, codes, 0), [0]])
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])] + 1
    two = (codes[:-1] << _BITS) | codes[1:]
    three = (two[:-1] << _BITS) | codes[2:]
    return np.concatenate([codes[codes > 1], two, three[codes[1:-1] > 1]])


def ranked(found: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams by falling count, and where that ties by their code."""
    keys, counts = np.unique(found, return_counts=True)
    if len(keys) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))][:top]


@dataclass(frozen=True)
class Profiles:
    """Ranks by language: ``ranks[i, j]`` is the rank of ``keys[j]`` in ``languages[i]``, or ``top``."""

    languages: list[str]
    keys: np.ndarray
    ranks: np.ndarray
    top: int

    def predict(self, text: str) -> tuple[str, float]:
        own = ranked(grams(text), self.top)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        ranks = np.where(self.keys[at] == own, self.ranks[:, at], self.top)
        distance = np.where(ranks < self.top, np.abs(ranks - np.arange(len(own))), self.top).sum(1)
        best = int(distance.argmin())
        return self.languages[best], 1 - float(distance[best]) / (len(own) * self.top)


def train(df: DataFrame, text: str, language: str, *, top: int = TOP) -> Profiles:
    """Profiles from every row of ``df`` with a language; rows with a NULL language are left out.

    Each task sums up its own rows before the shuffle. The driver gets ``top`` n-grams a language.
    """
    require(df, text, language)
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def settle(name: str) -> None:
            keys, counts = np.unique(np.concatenate(pending.pop(name)), return_counts=True)
            sizes.pop(name)
            if name in sums:
                both = np.concatenate([sums[name][0], keys])
                keys, where = np.unique(both, return_inverse=True)
                counts = np.bincount(where, np.concatenate([sums[name][1], counts])).astype(np.int64)
            sums[name] = keys, counts

        for batch in batches:
            for value, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(found := grams(value or "")):
                    pending.setdefault(name, []).append(found)
                    sizes[name] = sizes.get(name, 0) + len(found)
                    if sizes[name] > _PENDING:
                        settle(name)
        for name in list(pending):
            settle(name)
        for name, (keys, counts) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], ["language", "gram", "n"])

    rows = df.where(F.col(language).isNotNull()).select(F.col(text).cast("string"), F.col(language).cast("string"))
    counted = rows.mapInArrow(run, "language string, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("language").orderBy(F.col("n").desc(), "gram")
    best = counted.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < top).select("language", "gram", "rank").collect()
    languages = sorted({r["language"] for r in best})
    keys = np.unique(np.array([r["gram"] for r in best], np.int64))
    ranks = np.full((len(languages), len(keys)), top, np.int64)
    for r in best:
        ranks[languages.index(r["language"]), np.searchsorted(keys, r["gram"])] = r["rank"]
    return Profiles(languages, keys, ranks, top)


def identify(df: DataFrame, text: str, profiles: Profiles, *, language: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the nearest profile's language and a score from 0 to 1: one less the share of the largest
    possible distance. No shuffle; only the text is looked at.

    A NULL text, or one without a letter, is ``und`` with score 0. Of profiles equally near, the first
    by name is taken. Input columns named like the results are replaced.
    """
    require(df, text)
    df = df.drop(*(c for c in (language, score) if c != text))
    bounded_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(x or "") for x in batch.column(at).to_pylist()]
            names, scores = pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, names, scores], [*batch.schema.names, language, score])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(language, T.StringType(), False), T.StructField(score, T.DoubleType(), False)]))
