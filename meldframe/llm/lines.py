"""Line deduplication with a segment-partition edit join.

A line goes if an earlier line of the corpus, in order of document and line number, is equal to it or, from
``least`` characters on, within ``threshold`` edits of it: of words if both lines are long, else of characters.
Two lines within k edits have, of the shorter line's k+1 segments, one that stands unchanged in the longer line,
shifted no further than the edits around it allow. So each distinct line puts its segments into an index, and
looks up the substrings of its own that a line of each admissible length could have as segments. Lines that meet
under a key are first compared by signature, then on their texts by a banded bit-parallel edit distance.

Keys travel as packed arrays to buckets by hash and are joined there; a key that very many lines share is
split by pieces of the signature, one of which two near lines must have in common. Equal lines are one before
the join, so a line that many documents share costs as much as one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from meldframe.llm.shared import bounded_batches, free_name, packed, releasing, require, unpacked, written

THRESHOLD = 2
#: Shorter lines, in code points without outer white space, have no near copies: two edits can make another line of them.
LEAST_CHARS = 40
_LOCAL_LINES = 1 << 18
#: Bits of the filter ahead of the join that fetches candidates' texts.
BITMAP = 1 << 26
#: A substitution changes two pairs of neighbours into two others.
SIGN_BITS = 4
#: Lines of so many words or more are compared by words.
LONG_WORDS = 40
#: Entries of a bucket, about, and comparisons from which a key is split up.
BUCKET_ENTRIES, HOT_PAIRS = 1 << 20, 1 << 21
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_BASE = 0xD1342543DE82EF95
_UNBASE = np.uint64(pow(_BASE, -1, 1 << 64))
_BASE = np.uint64(_BASE)
_CHUNK_LINES, _CHUNK_CHARS = 1 << 16, 1 << 24
_ENTRIES = "bucket long, a binary, a_mark binary, a_sign binary, b binary, b_mark binary, b_sign binary"
_MET = "key long, mark long, sign long, hot boolean"


def edit_distance_within(a: Sequence, b: Sequence, most: int) -> bool:
    """Whether at most ``most`` insertions, deletions and substitutions turn ``a`` into ``b``."""
    if a == b:
        return True
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return False
    start, stop = 0, len(b)
    step = 1 << max(0, (stop - 1).bit_length())
    while step:  # the common beginning, by doubling
        if start + step <= stop and a[start : start + step] == b[start : start + step]:
            start += step
        else:
            step >>= 1
    a, b = a[start:], b[start:]
    end, stop = 0, len(b)
    step = 1 << max(0, (stop - 1).bit_length()) if stop else 0
    while step:
        if end + step <= stop and a[len(a) - end - step : len(a) - end] == b[len(b) - end - step : len(b) - end]:
            end += step
        else:
            step >>= 1
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not b:
        return len(a) <= most
    return _banded(a, b, most) <= most


def _banded(rows: Sequence, columns: Sequence, most: int) -> int:
    """The edit distance, or more than ``most``: a column's vertical differences are kept as bits, only for the
    2k+1 diagonals that a distance of k can reach. ``rows`` is not the shorter one."""
    width = 2 * most + 1
    full = (1 << width) - 1
    at: dict = {}
    for i, c in enumerate(rows):
        at[c] = at.get(c, 0) | 1 << i
    up, down = ((1 << most + 1) - 1) << most, 0
    distance, give_up = most, 2 * most + len(columns) - len(rows)
    diagonal, side = 1 << width - 1, 1 << width - 2
    for j, c in enumerate(columns):
        same = at.get(c, 0)
        same = (same >> j - most if j >= most else same << most - j) & full
        zero = ((((same & up) + up) ^ up) | same | down) & full
        right_up = (down | ~(zero | up)) & full
        right_down = zero & up
        if j < len(rows) - most:
            distance += not zero & diagonal
        else:
            distance += bool(right_up & side) - bool(right_down & side)
            side >>= 1
        if distance > give_up:
            return most + 1
        up = (right_down | ~((zero >> 1) | right_up)) & full
        down = (zero >> 1) & right_up
    return distance


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[0]
    return h ^ (h >> np.uint64(29))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, ...]:
    """Powers of the base and of its inverse, from 0 on, and those of their 65,536th powers."""
    table = lambda base: np.cumprod(np.concatenate([[np.uint64(1)], np.full((1 << 16) - 1, base, np.uint64)]))
    low, down = table(_BASE), table(_UNBASE)
    return low, down, table((low[-1:] * _BASE)[0]), table((down[-1:] * _UNBASE)[0])


def _power(which: int, at: np.ndarray) -> np.ndarray:
    """The powers ``at`` (under 2 ** 32) of the base, or of its inverse."""
    return _powers()[which][at & 0xFFFF] * _powers()[which + 2][at >> 16]


class Symbols:
    """Lines as runs of symbols, characters or words, with a hash for each of their pieces. Takes about 40 bytes a symbol."""

    def __init__(self, sizes: np.ndarray, codes: np.ndarray, salt: int):
        n = len(codes)
        self.sizes, self.salt = sizes, np.uint64(salt)
        self.starts = np.cumsum(sizes) - sizes
        self.sums = np.zeros(n + 1, np.uint64)
        powers = _powers()[0]
        for at in range(0, n, len(powers)):
            part = _mixed(codes[at : at + len(powers)] + np.uint64(1))
            part *= powers[: len(part)] * _power(0, np.array([at]))
            np.cumsum(part, out=part)
            np.add(part, self.sums[at], out=self.sums[at + 1 : at + 1 + len(part)])
        bits = np.zeros(n, np.uint64)
        if n > 1:
            bits[:-1] = np.uint64(1) << (_mixed(codes[:-1] * _MIX[0] + codes[1:] * _MIX[1]) >> np.uint64(58))
        bits[self.starts[1:] - 1] = 0  # those of two lines
        #: Which of 64 classes of neighbouring symbols a line holds an odd number of times: an edit changes at most ``SIGN_BITS``.
        self.signs = np.bitwise_xor.reduceat(bits, self.starts) if n else np.empty(0, np.uint64)

    @classmethod
    def characters(cls, lines: list[str]) -> Symbols:
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        return cls(np.fromiter(map(len, lines), np.int64, len(lines)), codes, 1)

    @classmethod
    def words(cls, lines: list[str], known: dict[str, int]) -> Symbols:
        if len(known) > _LOCAL_LINES:
            known.clear()
        split = [x.split() for x in lines]
        for w in set().union(*split) - known.keys():
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        codes = np.fromiter((known[w] for x in split for w in x), np.uint64, sum(map(len, split)))
        return cls(np.fromiter(map(len, split), np.int64, len(lines)), codes, 2)

    def _hash(self, which: np.ndarray, at: np.ndarray, size: np.ndarray, length: np.ndarray, part: int) -> np.ndarray:
        begin = self.starts[which] + at
        piece = (self.sums[begin + size] - self.sums[begin]) * _power(1, begin)
        return _mixed(piece ^ _mixed(length.astype(np.uint64) << np.uint64(8) | np.uint64(part) | self.salt << np.uint64(56)))

    def index_keys(self, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Each line's segments: the lines' numbers and the keys."""
        which = np.arange(len(self.sizes))
        keys = [self._hash(which, *_segment(self.sizes, threshold + 1, i), self.sizes, i) for i in range(threshold + 1)]
        return np.tile(which, threshold + 1), np.concatenate(keys)

    def probe_keys(self, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """The substrings that, for a line of each length from ``threshold`` less up to this one's, can be its
        unchanged segment: of its first i segments at most i can be changed, and of the last likewise."""
        lines, keys = [], []
        for less in range(threshold + 1):
            length = self.sizes - less
            for i in range(threshold + 1):
                a, n = _segment(np.maximum(length, 0), threshold + 1, i)
                low = np.maximum(np.maximum(a - i, a + less - (threshold - i)), 0)
                high = np.minimum(np.minimum(a + i, a + less + (threshold - i)), self.sizes - n)
                for more in range(2 * threshold + 1):
                    which = np.flatnonzero((low + more <= high) & (length > 0))
                    if len(which):
                        lines.append(which)
                        keys.append(self._hash(which, (low + more)[which], n[which], length[which], i))
        return (np.concatenate(lines), np.concatenate(keys)) if lines else (np.empty(0, np.int64), np.empty(0, np.uint64))


def _segment(length: np.ndarray, parts: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Beginning and size of segment ``i`` of lines cut as evenly as can be, the longer segments last."""
    small, longer = np.divmod(length, parts)
    return i * small + np.maximum(0, i - (parts - longer)), small + (i >= parts - longer)


def _identity(line: str) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
    return _signed(digest >> 64), _signed(digest & 0xFFFFFFFFFFFFFFFF)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def lines_of(text: str | None, least: int = LEAST_CHARS) -> Iterator[tuple[int, str]]:
    """Number and stripped text of each line that is long enough to be judged."""
    for number, line in enumerate((text or "").split("\n")):
        line = line.strip(" \t\r\x0b\x0c")
        if len(line) >= least:
            yield number, line


def _mapped(df: DataFrame, names: list[str], rows, schema: str | T.StructType) -> DataFrame:
    """``rows(values...)`` of each row of the columns ``names``, flattened, a bounded number at a time."""
    bounded_batches(df.sparkSession)
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = rows()
        made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, target, strict=True)], schema=target)
        for batch in batches:
            out: list[list] = [[] for _ in target]
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for row in own(*values):
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                if len(out[0]) >= 50_000:
                    yield made(out)
                    out = [[] for _ in target]
            if out[0]:
                yield made(out)

    return df.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, kind)


def near_lines(a: str, b: str, threshold: int, long_words: int) -> bool:
    """Whether two lines are within ``threshold`` edits: of words if both have ``long_words``, else of characters."""
    x, y = a.split(), b.split()
    if min(len(x), len(y)) >= long_words:
        return edit_distance_within(x, y, threshold)
    return edit_distance_within(a, b, threshold)


def _entries(least: int, threshold: int, long_words: int, buckets: int):
    """Texts to packed keys by bucket, a bounded number of lines at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        known: dict[str, int] = {}
        marks: list[int] = []
        lines: list[str] = []

        def parts(chosen: np.ndarray) -> list[np.ndarray]:
            """Some of the lines at a time, of a million characters or a line more."""
            sizes = np.cumsum(np.array([len(lines[k]) for k in chosen.tolist()], np.int64))
            return [p for p in np.split(chosen, np.flatnonzero(np.diff(sizes >> 20)) + 1) if len(p)]

        def rows() -> pa.RecordBatch:
            mark = np.array(marks, np.int64)
            long = np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))
            sides: list[list] = [[], []]
            # A pair is compared by characters if the shorter line isn't long; the other can have ``threshold`` words more.
            for chosen, make in ((np.flatnonzero(long < long_words + threshold), Symbols.characters), (np.flatnonzero(long >= long_words), lambda x: Symbols.words(x, known))):
                for chosen in parts(chosen):
                    own = make([lines[k] for k in chosen.tolist()])
                    for side, (which, keys) in zip(sides, (own.index_keys(threshold), own.probe_keys(threshold)), strict=True):
                        side.append((keys, mark[chosen[which]], own.signs[which]))
            columns, cuts = [], []
            for side in sides:
                keys, owners, signs = (np.concatenate(x) for x in zip(*side, strict=True))
                order = np.argsort(keys)
                columns.append((keys[order], owners[order], signs[order]))
                bucket = (columns[-1][0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                cuts.append(np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64)).tolist())
            out = [(k, *(packed(x[c[k] : c[k + 1]]) for side, c in zip(columns, cuts, strict=True) for x in side)) for k in range(buckets) if cuts[0][k + 1] > cuts[0][k] or cuts[1][k + 1] > cuts[1][k]]
            marks.clear(), lines.clear()
            names = [f.split()[0] for f in _ENTRIES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names)

        chars = 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                for _, line in lines_of(value, least):
                    mark = _identity(line)[0]
                    if mark not in seen:
                        seen.add(mark), marks.append(mark), lines.append(line)
                        chars += len(line)
                if len(lines) > _CHUNK_LINES or chars > _CHUNK_CHARS:
                    yield rows()
                    chars = 0
                # A line met again in the same task adds nothing; the set only spares work and starts anew when large.
                if len(seen) > _LOCAL_LINES:
                    seen.clear()
        if lines:
            yield rows()

    return run


def _meet(limit: int, hot_pairs: int):
    """The lines of a bucket that meet another under a key whose signature allows that they are near, once a key. Of
    keys under which too many would be compared all lines are put out, as ``hot``."""

    def once(*columns: np.ndarray) -> list[np.ndarray]:
        key, mark = columns[:2]
        first = np.unique(_mixed(key) ^ mark.view(np.uint64), return_index=True)[1]
        first = first[np.argsort(key[first], kind="stable")]
        return [x[first] for x in columns]

    def run(table: pa.Table) -> pa.Table:
        each = lambda name, kind: np.concatenate([unpacked(x, kind) for x in table[name].to_pylist()])
        (a, a_mark, a_sign), (b, b_mark, b_sign) = (once(each(s, np.uint64), each(f"{s}_mark", np.int64), each(f"{s}_sign", np.uint64)) for s in "ab")
        low, high = np.searchsorted(a, b), np.searchsorted(a, b, side="right")
        met = np.flatnonzero(high > low)
        b, b_mark, b_sign, low, size = b[met], b_mark[met], b_sign[met], low[met], (high - low)[met]
        _, where, probes = np.unique(b, return_inverse=True, return_counts=True)
        heavy = size * probes[where] > hot_pairs
        left_met, right_met, plain = np.zeros(len(a), bool), np.zeros(len(b), bool), np.flatnonzero(~heavy)
        ends = np.cumsum(size[plain])
        for part in np.split(plain, np.searchsorted(ends, np.arange(hot_pairs, int(ends[-1]) if len(ends) else 0, hot_pairs))):
            n = size[part]
            left = np.repeat(low[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            right = np.repeat(part, n)
            near = (np.bitwise_count(a_sign[left] ^ b_sign[right]) <= limit) & (a_mark[left] != b_mark[right])
            left_met[left[near]] = right_met[right[near]] = True
        crowded = np.isin(a, np.unique(b[heavy]))
        groups = []
        for left, right, hot in ((left_met, right_met, False), (crowded, heavy, True)):
            both = [np.concatenate(x) for x in ((a[left], b[right]), (a_mark[left], b_mark[right]), (a_sign[left], b_sign[right]))]
            groups.append([*once(*both), hot])
        key, mark, sign = (np.concatenate([g[k] for g in groups]) for k in range(3))
        hot = np.repeat([g[3] for g in groups], [len(g[0]) for g in groups])
        return pa.Table.from_arrays([pa.array(key.view(np.int64)), pa.array(mark), pa.array(sign.view(np.int64)), pa.array(hot)], ["key", "mark", "sign", "hot"])

    return run


def _members(met: DataFrame, limit: int) -> DataFrame:
    """``key, mark, sign``. Signatures that differ in at most ``limit`` bits agree in one of ``limit + 1`` pieces, so a
    hot key is replaced by keys of itself and each piece."""
    width = 64 // (limit + 1)
    parts = met.where("hot").withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(limit))))
    own = F.xxhash64("key", "piece", F.expr(f"shiftrightunsigned(sign, piece * {width}) & {(1 << width) - 1}L"))
    return met.where("not hot").select("key", "mark", "sign").union(parts.select(own.alias("key"), "mark", "sign"))


def late_lines(
    documents: DataFrame,
    text: str,
    first: DataFrame,
    *,
    threshold: int = THRESHOLD,
    least: int = LEAST_CHARS,
    long_words: int = LONG_WORDS,
    n_lines: int,
    bucket_entries: int = BUCKET_ENTRIES,
    hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """``high, low``: the identities of the lines that are near (see ``near_lines``) an earlier line. ``first`` has
    the place of each line's first occurrence (high, low, first); ``n_lines`` sets the number of buckets.

    First each line is compared to the earliest under each of its keys: in a group of near lines that settles all but
    the first, in rows that grow as the group. Only what isn't settled is compared to every earlier line that it may
    be near to.
    """
    bounded_batches(documents.sparkSession)
    buckets, limit = n_lines * 15 // bucket_entries + 1, SIGN_BITS * threshold
    sent = documents.select(F.col(f"`{text}`")).mapInArrow(releasing(_entries(least, threshold, long_words, buckets)), _ENTRIES)
    met = written(sent.groupBy("bucket").applyInArrow(_meet(limit, hot_pairs), _MET), "met-lines")
    places = first.groupBy(F.col("high").alias("mark")).agg(F.min("first").alias("place"))
    members = written(_members(met, limit).join(places, "mark"), "members")

    wanted = written(members.select("mark").distinct(), "wanted")
    maybe = documents.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def texts():
        bits, seen = maybe.value, set()

        def of(value: str | None) -> Iterator[tuple[int, int, int, str]]:
            if len(seen) > _LOCAL_LINES:
                seen.clear()
            for _, line in lines_of(value, least):
                high, low = _identity(line)
                at = high & (BITMAP - 1)
                if int(bits[at >> 6]) >> (at & 63) & 1 and high not in seen:
                    seen.add(high)
                    yield high, high, low, line

        return of

    found = _mapped(documents, [text], texts, "mark long, high long, low long, line string")
    found = written(found.join(wanted, "mark", "left_semi").dropDuplicates(["high", "low"]), "lines")

    def check():
        def of(high, low, a, b):
            if near_lines(a, b, threshold, long_words):
                yield high, low

        return of

    def near(pairs: DataFrame) -> DataFrame:
        """The later lines of the ``pairs`` (a, b) that are near, b being the later."""
        early = found.select(F.col("mark").alias("a"), F.col("line").alias("a_line"))
        both = pairs.join(early, "a").join(found.withColumnRenamed("mark", "b"), "b").select("high", "low", "a_line", "line")
        return written(_mapped(both, both.columns, check, "high long, low long").distinct(), "late")

    allowed = F.bit_count(F.col("sign").bitwiseXOR(F.col("a_sign"))) <= limit
    hub = F.min(F.struct("place", "mark", "sign")).alias("hub")
    hubs = written(members.groupBy("key").agg(hub, F.count("*").alias("n")).where("n > 1").select("key", F.col("hub.mark").alias("a"), F.col("hub.sign").alias("a_sign")), "hubs")
    tried = members.join(hubs, "key").where((F.col("mark") != F.col("a")) & allowed).select("a", F.col("mark").alias("b")).distinct()
    tried = written(tried, "pairs")
    settled = near(tried)
    open_ = members.join(hubs, "key").where(F.col("mark") != F.col("a")).select("key", "mark", "sign", "place")
    open_ = written(open_.join(settled.select(F.col("high").alias("mark")).distinct(), "mark", "left_anti"), "open")
    early = members.select("key", F.col("mark").alias("a"), F.col("sign").alias("a_sign"), F.col("place").alias("a_place"))
    rest = open_.join(early, (open_["key"] == early["key"]) & allowed & (F.col("a_place") < F.col("place"))).select("a", F.col("mark").alias("b"))
    rest = written(rest.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    return settled.union(near(rest)).distinct()


def _bitmap(wanted: DataFrame) -> np.ndarray:
    """``BITMAP`` bits, set for the low bits of each mark: a filter of fixed size ahead of the exact join. Words
    are put together by key, and the driver gets at most one row a word."""
    at = F.col("mark").bitwiseAND(F.lit(BITMAP - 1))
    words = wanted.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, CAST(mark & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    table, bits = words.toArrow(), np.zeros(BITMAP >> 6, np.int64)
    bits[table["word"].to_numpy()] = table["bits"].to_numpy()
    return bits


def dropped_lines(documents: DataFrame, identifier: str, text: str, *, threshold: int = THRESHOLD, least: int = LEAST_CHARS, least_equal: int = 1, long_words: int = LONG_WORDS) -> DataFrame:
    """``identifier, text_mark, line, near``: the lines that go; ``near`` is false for those equal to an earlier line.

    Lines of ``least_equal`` characters or more (1: all that aren't blank) are compared for equality, those of
    ``least`` or more for nearness too: within ``threshold`` edits of characters, or of words where both lines have
    ``long_words``. Of equal lines the first by identifier and line number stays, unless an earlier line is within
    ``threshold`` edits. Identifiers may have any type with an order; NULL ones come last. ``text_mark`` is the text's xxhash64: rows that share an
    identifier are told apart by it, and whole repeated rows share their decisions.
    """
    require(documents, identifier, text)

    def occurrences():
        def of(doc: int | None, mark: int, value: str | None) -> Iterator[tuple]:
            for number, line in lines_of(value, least_equal):
                yield doc, mark, number, *_identity(line)

        return of

    numbered = documents.select(F.col(f"`{identifier}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    numbered = numbered.select("doc", F.xxhash64("text").alias("mark"), "text")
    lines = _mapped(numbered, ["doc", "mark", "text"], occurrences, T.StructType([numbered.schema["doc"], *T._parse_datatype_string("mark long, line int, high long, low long").fields]))
    lines = written(lines, "line-places")
    place = F.struct(F.col("doc").isNull().alias("unknown"), "doc", "mark", "line")
    first = lines.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    first = written(first, "first-lines")
    n_lines = lines.count()
    late = late_lines(numbered, "text", first, threshold=threshold, least=least, long_words=long_words, n_lines=n_lines).withColumn("near", F.lit(True))
    # Written, so that Spark can split the rows of a line that very many documents share.
    marked = written(first.join(late, ["high", "low"], "left").where("n > 1 or near"), "marked-lines")
    joined = lines.join(marked, ["high", "low"])
    return joined.where(F.col("near").isNotNull() | (place > F.col("first"))).select(
        F.col("doc").alias(identifier), F.col("mark").alias("text_mark"), "line", (~(place > F.col("first"))).alias("near")
    )


def line_drops(documents: DataFrame, identifier: str, text: str, **options) -> DataFrame:
    """``identifier, text_mark, n_equal, n_near, dropped``: a row for each document that loses lines, with their sorted numbers."""
    drops = dropped_lines(documents, identifier, text, **options)
    return drops.groupBy(identifier, "text_mark").agg(
        F.countDistinct(F.when(~F.col("near"), F.col("line"))).alias("n_equal"),
        F.countDistinct(F.when(F.col("near"), F.col("line"))).alias("n_near"),
        F.array_sort(F.collect_set("line")).alias("dropped"),
    )


def dedup_lines(documents: DataFrame, identifier: str, text: str, *, chars: str | None = None, drop_emptied: bool = True, **options) -> DataFrame:
    """``documents`` without the lines of ``dropped_lines``. With ``drop_emptied``, a document that loses lines and
    keeps no word goes too. ``chars`` names a column of text lengths to keep right. Other documents and columns
    stay as they are, NULL and empty texts too."""
    gone, mine, mark = (free_name(n, documents.columns) for n in ("_gone", "_mine", "_mark"))
    drops = line_drops(documents, identifier, text, **options).select(F.col(identifier).alias(mine), F.col("text_mark").alias(mark), F.col("dropped").alias(gone))
    own = F.col(f"`{text}`")
    joined = documents.join(drops, F.col(f"`{identifier}`").eqNullSafe(F.col(mine)) & (F.xxhash64(own.cast("string")) == F.col(mark)), "left")
    kept = F.array_join(F.filter(F.split(own, "\n"), lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    changed = joined.withColumn(text, F.when(F.col(gone).isNotNull(), kept).otherwise(own))
    if chars in documents.columns:
        changed = changed.withColumn(chars, F.when(F.col(gone).isNotNull(), F.length(own).cast(documents.schema[chars].dataType)).otherwise(F.col(f"`{chars}`")))
    if drop_emptied:
        changed = changed.where(F.col(gone).isNull() | own.rlike(r"[^\x20\x09-\x0D]"))
    return changed.select(*(F.col(f"`{c}`") for c in documents.columns))
