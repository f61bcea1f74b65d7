"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's sixteen segments of four bits are mapped to their bit counts: a point with sixteen
coordinates from 0 to 4, held in one long. Changing a bit moves the point by one, so the Manhattan
distance of two points is a lower bound of the fingerprints' Hamming distance. Two points within
distance 2 have a point within 1 of both: each fingerprint is put into the grid cells within 1 of its
point (33 at most), and only cells with two fingerprints or more go on. The check is exact and needs
no pairs: two fingerprints differ in at most two bits if and only if some fingerprint is within one
bit of both. In a cell, each fingerprint is put under its one-bit neighbours that lie in the cell, and
those that meet are linked to the smallest among them.

Rows are linear in the number of distinct fingerprints whatever the groups (at most 33 for the grid
and 65 for the check); copies of a fingerprint count once. No link is lost or made up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meldframe.llm import resemblance
from meldframe.llm.components import components
from meldframe.llm.shared import bounded_batches, free_name, require, written

SHINGLE_WORDS = 3
SEED = 42
#: The embedding is exact for this number of differing bits.
MAX_BITS = 2


def fingerprint_of(data: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The unsigned fingerprint of a UTF-8 text: bit i is set if it is set in over half of the shingles' XXH64."""
    tokens = data.lower().split()  # of bytes: A-Z only, and exactly space and \t to \r
    if not tokens:
        return 0
    text = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(text, seed)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[: len(tokens) - words + 1].tolist()
    digest = xxhash.xxh64_digest
    return resemblance.majority(b"".join([digest(text[i:j], seed) for i, j in zip(starts, ends[words - 1 :].tolist(), strict=True)]))


def fingerprints(df: DataFrame, text: str, *, fingerprint: str = "fingerprint", words: int = SHINGLE_WORDS) -> DataFrame:
    """``df`` with the text replaced by its fingerprint as a signed long. No shuffle.

    The whole text counts; with fewer words than a shingle the whole sequence is one. NULL, empty and
    blank texts have fingerprint 0.
    An input column named like ``fingerprint`` is replaced.
    """
    require(df, text)
    kept = [f for f in df.schema.fields if f.name not in (text, fingerprint)]
    bounded_batches(df.sparkSession)
    data = df.select(*(F.col(f"`{f.name}`") for f in kept), F.col(text).cast("binary").alias(free_name("_data", df.columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            values = np.array([fingerprint_of(x.as_py() or b"", words) for x in batch.column(last)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(values.view(np.int64))], [*batch.schema.names[:last], fingerprint])

    return data.mapInArrow(run, T.StructType([*kept, T.StructField(fingerprint, T.LongType(), False)]))


def embedding(fingerprint: Column) -> Column:
    """The bit counts of the sixteen four-bit segments, each in four bits of a long. Only bit operations and
    sums that can't overflow."""
    fives, threes = F.lit(0x5555555555555555), F.lit(0x3333333333333333)
    low, high = fingerprint.bitwiseAND(fives), F.shiftrightunsigned(fingerprint, 1).bitwiseAND(fives)
    pairs = low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))
    return pairs.bitwiseAND(threes) + F.shiftrightunsigned(pairs, 2).bitwiseAND(threes)


def _cells(point: Column) -> Column:
    """The point, and the points at Manhattan distance 1 that are bit counts of some fingerprint: each with the
    segment that changes, or -1, and by how much."""
    near = [F.struct(point.alias("cell"), F.lit(-1).alias("segment"), F.lit(0).alias("by"))]
    for i in range(16):
        count = F.shiftrightunsigned(point, 4 * i).bitwiseAND(F.lit(15))
        near.append(F.when(count < 4, F.struct((point + F.lit(1 << 4 * i)).alias("cell"), F.lit(i).alias("segment"), F.lit(1).alias("by"))))
        near.append(F.when(count > 0, F.struct((point - F.lit(1 << 4 * i)).alias("cell"), F.lit(i).alias("segment"), F.lit(-1).alias("by"))))
    return F.filter(F.array(*near), lambda x: x.isNotNull())


#: The fingerprints within one bit of ``f`` that lie in the cell: ``f`` itself in its own, else ``f`` with one bit of
#: the segment set or cleared.
_NEIGHBOURS = (
    "CASE WHEN segment < 0 THEN array(f) ELSE transform(filter(sequence(segment * 4, segment * 4 + 3), "
    "i -> (shiftrightunsigned(f, i) & 1L) = CASE WHEN by > 0 THEN 0L ELSE 1L END), i -> f ^ shiftleft(1L, i)) END"
)


def links(distinct: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """``a, b``: edges between distinct fingerprints, each within two differing bits, whose components are
    those of all such pairs."""
    # Dealt out before the rows multiply: Spark judges the number of tasks by the few bytes of the fingerprints.
    spread = distinct.select(F.col(fingerprint).alias("f")).repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "f")
    points = spread.withColumn("p", embedding(F.col("f")))
    cells = points.select("f", F.explode(_cells(F.col("p"))).alias("c")).select("f", "c.cell", "c.segment", "c.by")
    shared = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")
    candidates = cells.join(shared, "cell", "left_semi")
    met = candidates.select("f", F.explode(F.expr(_NEIGHBOURS)).alias("z"))
    met = written(met, "met")
    hubs = met.groupBy("z").agg(F.min("f").alias("hub"), F.count("*").alias("n")).where("n > 1").select("z", "hub")
    return met.join(hubs, "z").where("f <> hub").select(F.col("f").alias("a"), F.col("hub").alias("b")).distinct()


def _roots(marked: DataFrame, fingerprint: str, *firsts) -> DataFrame:
    """``_f, _root`` and the aggregates ``firsts`` for each distinct fingerprint of ``marked``."""
    own = marked.groupBy(F.col(f"`{fingerprint}`").alias("_f")).agg(*firsts)
    found = components(links(own.select(F.col("_f").alias("fingerprint"))))
    return own.join(found, F.col("_f") == F.col("node"), "left").drop("node").withColumn("_root", F.coalesce("root", "_f")).drop("root")


def classes(marked: DataFrame, identifier: str, fingerprint: str = "fingerprint", *, component: str = "component_id") -> DataFrame:
    """``marked`` with the smallest identifier reachable over links of at most two differing bits, itself included.

    Equal fingerprints are one class. A NULL identifier is never the smallest; a class of NULLs has NULL.
    An input column named like the component is replaced. ``marked`` is read more than once: pass a written table.
    """
    require(marked, identifier, fingerprint)
    marked = marked.drop(component)
    own = free_name("_f", [*marked.columns, component])
    rooted = _roots(marked, fingerprint, F.min(F.col(f"`{identifier}`")).alias("_first"))
    smallest = rooted.groupBy("_root").agg(F.min("_first").alias("_least"))
    table = rooted.join(smallest, "_root").select(F.col("_f").alias(own), F.col("_least").alias(component))
    return marked.join(table, F.col(f"`{fingerprint}`") == F.col(own), "left").drop(own)


def near_duplicate_classes(df: DataFrame, identifier: str, text: str, *, component: str = "component_id", words: int = SHINGLE_WORDS) -> DataFrame:
    """``identifier, fingerprint, component``: a row for each row of ``df``.

    Repeated rows stay repeated; an empty table gives an empty table; columns of other names are not read.
    """
    marked = written(fingerprints(df.select(identifier, text), text, words=words), "fingerprints")
    return classes(marked, identifier, component=component)


def _near_nodes(one: DataFrame) -> DataFrame:
    """``a, b``: pairs of nodes whose fingerprints differ in ``MAX_BITS`` or fewer, with the components of all such pairs:
    of each fingerprint the smallest node stands for the others."""
    firsts = written(one.groupBy("fingerprint").agg(F.min("node").alias("first")), "prints")
    same = one.join(firsts, "fingerprint").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    by = lambda f, n: firsts.select(F.col("fingerprint").alias(f), F.col("first").alias(n))
    apart = links(firsts.select("fingerprint")).withColumnsRenamed({"a": "_a", "b": "_b"})
    return same.union(apart.join(by("_a", "a"), "_a").join(by("_b", "b"), "_b").select("a", "b"))


def keep_one(df: DataFrame, identifier: str, text: str, *, words: int = resemblance.WORDS, similarity: float = resemblance.SIMILARITY) -> DataFrame:
    """``df`` with one row of each class of texts linked by a Jaccard similarity of ``similarity`` or more of their
    shingles of ``words`` words: that of the smallest identifier, NULL last, and where that repeats, of the
    smallest hash of the text. One of rows that repeat both stays. Texts without words are one class. The rows
    themselves move once, by their key.

    Texts whose SimHash fingerprints, of the same shingles, differ in two bits or fewer are brought together first, by the
    grid of ``links``. At similarity 0.8 fingerprints differ in about ten bits, and a grid of so wide a radius is no
    filter: what the fingerprints leave apart is brought together by minwise keys. All that meet are compared whole.
    Two sets of similarity 0.8 are missed with probability 0.002, more similar ones less often (see
    ``resemblance``); no link is made up."""
    require(df, identifier, text)
    names = [free_name(n, df.columns) for n in ("_unknown", "_doc", "_mark", "_turn")]
    own = (F.col(f"`{identifier}`").isNull(), F.coalesce(F.col(f"`{identifier}`"), F.lit(0).cast(df.schema[identifier].dataType)), F.xxhash64(F.col(f"`{text}`").cast("string")))
    keyed = df.withColumns(dict(zip(names, own, strict=False)))
    key = names[:3]
    plain = keyed.select(*(F.col(n).alias(k) for n, k in zip(key, ("unknown", "doc", "mark"), strict=True)), F.col(f"`{text}`").cast("binary").alias("data"))
    marked = written(resemblance.sketches(plain, "data", words=words), "sketches")
    firsts = written(marked.groupBy("node").agg(F.min(F.struct("unknown", "doc", "mark")).alias("first")), "firsts")
    one = marked.join(firsts.select("node", "first.*"), ["node", "unknown", "doc", "mark"], "left_semi")
    near = _near_nodes(one)
    found = components(resemblance.links(one, plain.select("mark", "data"), near, words=words, similarity=similarity)).withColumnRenamed("node", "own")
    rooted = firsts.join(found, F.col("node") == F.col("own"), "left").withColumn("root", F.coalesce("root", "node"))
    keepers = rooted.groupBy("root").agg(F.min("first").alias("first")).select(*(F.col(f"first.{k}").alias(n) for n, k in zip(key, ("unknown", "doc", "mark"), strict=True)))
    once = Window.partitionBy(*key).orderBy(names[2])
    return keyed.join(keepers, key, "left_semi").withColumn(names[3], F.row_number().over(once)).where(F.col(names[3]) == 1).select(*(F.col(f"`{c}`") for c in df.columns))
