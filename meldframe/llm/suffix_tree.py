"""Language-model scoring with a probabilistic suffix tree over words.

A text is its words, A-Z lower-cased, and one end. The root gives each word its add-one unigram
probability. A context is the run of words before a word; the tree grows from its suffixes: the contexts
one word longer than a kept one are looked at if they occur twice. In a context s of n occurrences, with
n(a) of them followed by a and k = n - sum(max(n(a) - 1, 0)), the next word has

    P(a | s) = max(n(a) - 1, 0) / n + k / n * P(a | suffix of s)

(absolute discounting by one: what followed once is no evidence, its mass goes to the suffix). The context
is kept if this diverges from its suffix: the training words after it must be likelier by ``LEAST_GAIN`` nats
in all. A kept context with one follower only isn't extended: no longer one can tell more. A word is scored
by its longest kept context. Depth and number of contexts have no limit but these tests.

No task and no driver holds the tree. Texts are cut into chunks of bounded size that are written once.
Level by level, a chunk lists its distinct (context, word) entries with their counts and sends them to
buckets by the context's hash, in compressed arrays; a bucket sums up the counts of all chunks, tests its
contexts, and sends each chunk the answers for its own entries, in the order asked. Contexts of very many
occurrences are dealt to the buckets by context and word, and tested from a histogram of their counts.

Where few positions are left, several levels go in one exchange: a chunk sends each of them with the words before its
context, and a bucket, which has all that stand after one context, grows the tree below that context by itself.
What is still open behind the last of these words goes on in the next exchange. Nothing ends but by the tests above.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meldframe.llm.shared import bucketed_table, delete_scratch, free_name, kept_table, packed, release_memory, releasing, require, session_settings, unpacked

#: A chunk has fewer positions than this; a longer text is cut into pieces, over whose bounds contexts don't reach.
CHUNK_WORDS = (1 << 20) - 2
#: Nats by which a context must better its suffix on what follows it in training.
LEAST_GAIN = 2.0
#: Entries of a bucket, about.
BUCKET_ENTRIES = 1 << 20
#: Occurrences from which a context is dealt out by context and word; never more than ``MOST_HOT`` such contexts a level.
HOT, MOST_HOT = 1 << 20, 1 << 20
#: Levels that go in one exchange: as many as leave no more words to be sent than an eighth of all positions, and one
#: if those are fewer than the least.
LEAST_SPAN, MOST_SPAN = 4, 256
#: Parent probabilities are tested in steps of a quarter bit.
STEPS = 4
_BITS = 21
_LOW = (1 << _BITS) - 1
_WORD_BITS = 40
_MIX = np.uint64(0x9E3779B97F4A7C15)
_END = 0x5851F42D4C957F2D

_STATE = (
    "chunk long, docs array<string>, rows array<long>, held array<boolean>, sizes array<long>, left array<long>, known array<long>, base array<double>, score array<double>, "
    "words binary, counts binary, ids binary, often binary, hot binary, alive binary, chances binary, asked long, salted long"
)
_ASKED = "bucket long, chunk long, contexts binary, followers binary, words binary, times binary, chances binary"
_OPEN = "bucket long, chunk long, places binary, contexts binary, words binary, followers binary, before array<binary>, train binary, chances binary"
_ENDS = "chunk long, places binary, chances binary, open binary"
_ANSWERS = "chunk long, bucket long, counts binary, totals binary, kinds binary, kept binary, h long, n long, q int, times long"
#: What is large is packed already. Chunk rows are large: few of them in an Arrow batch or a reader's batch.
_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "64", "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20), "spark.sql.parquet.columnarReaderBatchSize": "16"}
_OPTIONS = {"compression": "none", "parquet.page.size.row.check.min": "2", "parquet.block.size.row.check.min": "2"}


def _flags(values: np.ndarray) -> bytes:
    return packed(np.packbits(values))


def _unflags(data: bytes, size: int) -> np.ndarray:
    return np.unpackbits(unpacked(data, np.uint8), count=size).astype(bool) if data else np.zeros(size, bool)


def _arrow(schema: str) -> pa.Schema:
    plain = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
    kinds = plain | {f"array<{k}>": pa.list_(v) for k, v in plain.items()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _table(rows: list[dict], schema: str) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_arrow(schema))


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each of the keys (under 2 ** 42), dense and in their order, and where each number stands first."""
    order = np.sort(keys << _BITS | np.arange(len(keys)))
    at, keys = order & _LOW, order >> _BITS
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    out = np.empty(len(keys), np.int64)
    out[at] = np.cumsum(new) - 1
    return out, at[new]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _short(chances: np.ndarray) -> np.ndarray:
    """Probabilities as floats of 16 bits' precision, whose last byte is zero."""
    return ((chances.astype(np.float32).view(np.uint32) + np.uint32(128)) & np.uint32(0xFFFFFF00)).view(np.float32)


@dataclass
class Chunk:
    """A row of the state, unpacked. ``size`` has the number of training tokens and of different ones. Of each text
    only the ``left`` first positions are still there: up to the last that is alive."""

    row: dict
    size: tuple[int, int]

    def __post_init__(self) -> None:
        self.words, self.ids = unpacked(self.row["words"], np.uint64), unpacked(self.row["ids"], np.uint32).astype(np.int64)
        n = len(self.ids)
        self.often, self.hot, self.alive = (_unflags(self.row[k], n) for k in ("often", "hot", "alive"))
        self.at = np.flatnonzero(self.alive)
        sizes = np.array(self.row["left"], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.train = ~np.array(self.row["held"], bool)[self.text]

    def chances(self, depth: int) -> np.ndarray:
        """The probability of each word to be looked at, by the contexts shorter than ``depth``: the root's follow from
        the words' counts."""
        if depth == 1:
            return _short((unpacked(self.row["counts"], np.int64) + 1) / (sum(self.size) + 1))[self.ids[self.at]]
        return unpacked(self.row["chances"], np.float32)

    def ask(self, depth: int, buckets: int, *, sent: bool = True) -> Asked:
        """The entries; without what only the buckets need if they aren't to be ``sent``."""
        at, ids = self.at, self.ids
        if depth == 0:  # the words themselves, with nothing after them: their counts are the contexts' totals
            h, order = self.words, np.argsort(self.words)
            rank = np.empty(len(h), np.int64)
            rank[order] = np.arange(len(h))
            times = np.bincount(ids[self.train], minlength=len(h)).astype(np.uint32)[order]
            bucket = _bucket(h[order], buckets) * 2
            none = np.zeros(len(h), np.uint64)
            return Asked(rank[ids], h[order], np.arange(len(h)), bucket, none, times, none.astype(np.uint8))
        context, h = ids[at - 1], self.words
        for back in range(2, depth + 1):
            own = context
            context, first = _dense(context << _BITS | ids[at - back])
            h = _mixed(_mixed(h[own[first]]) + self.words[ids[at[first] - back]])
        order = np.argsort(h)
        rank = np.empty(len(h), np.int64)
        rank[order] = np.arange(len(h))
        entry, first = _dense(rank[context] << _BITS | ids[at])
        h, own = h[order], rank[context[first]]
        salted = self.hot[at[first] - 1]
        some = salted.any()
        follower = self.words[ids[at[first]]] >> np.uint64(64 - _WORD_BITS) if sent or some else first
        key = h[own]
        if some:
            key[salted] = _mixed(key[salted] ^ follower[salted])
        bucket = _bucket(key, buckets) * 2 + salted
        times = chances = first
        if sent:
            times = np.bincount(entry[self.train[at]], minlength=len(first)).astype(np.uint32)
            chances = np.round(-STEPS * np.log2(self.chances(depth)[first])).clip(0, 255).astype(np.uint8)
        if not some:
            return Asked(entry, h, own, bucket, follower, times, chances)
        dealt = np.flatnonzero(salted)
        line = np.concatenate([np.flatnonzero(~salted), dealt[np.argsort(bucket[dealt], kind="stable")]])
        place = np.empty(len(line), np.int64)
        place[line] = np.arange(len(line))
        return Asked(place[entry], h, own[line], bucket[line], follower[line], times[line], chances[line])


    def windows(self, depth: int, span: int, buckets: int) -> Iterator[dict]:
        """The alive positions by bucket of their contexts of ``depth`` words, each with the ``span`` words before that, the
        nearest first. Words are places in the row's list of hashes; 0 stands before a text's start."""
        h = self.words[self.ids[self.at - 1]]
        for back in range(2, depth + 1):
            h = _mixed(_mixed(h) + self.words[self.ids[self.at - back]])
        bucket, room, chances = _bucket(h, buckets), self.at - self.starts[self.text[self.at]] - depth, self.chances(depth)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for some in np.split(order, cuts[1:]):
            at = self.at[some]
            columns = [self.ids[at]]
            for back in range(depth + 1, depth + 1 + min(span, int(room[some].max()))):
                columns.append(np.where(room[some] >= back - depth, self.ids[np.maximum(at - back, 0)], -1))
            used = np.zeros(len(self.words) + 1, bool)
            for column in columns:
                used[column] = True  # -1 is the last
            used[-1] = False
            number = np.append(np.cumsum(used[:-1]), 0).astype(np.uint32)
            followers, *before = (packed(number[column]) for column in columns)
            yield {
                "bucket": int(bucket[some[0]]), "chunk": self.row["chunk"], "places": packed(some.astype(np.uint32)), "contexts": packed(h[some]), "words": packed(self.words[used[:-1]]),
                "followers": followers, "before": before, "train": _flags(self.train[at]), "chances": packed(chances[some]),
            }

    def following(self, alive: np.ndarray, chances: np.ndarray) -> dict:
        """The row's columns on positions once only the ``alive`` ones are left, with these ``chances``."""
        row, n, at = self.row, len(self.row["left"]), np.flatnonzero(alive)
        last = np.full(n, -1, np.int64)
        np.maximum.at(last, self.text[at], at)
        here = np.arange(len(self.ids)) <= last[self.text]
        ids, words, counted = self.ids[here], self.words, unpacked(row["counts"], np.int64)
        used = np.zeros(len(words), bool)
        used[ids] = True
        ids = (np.cumsum(used) - 1)[ids]
        out = {"asked": len(at), "salted": int(np.count_nonzero(self.hot[at - 1])), "left": np.bincount(self.text[here], minlength=n).tolist(), "chances": packed(chances)}
        out |= {"words": packed(words[used]), "counts": packed(counted[used]), "ids": packed(ids.astype(np.uint32))}
        return out | {k: _flags(x[here]) for k, x in (("often", self.often), ("hot", self.hot), ("alive", alive))}


@dataclass
class Asked:
    """The entries of a chunk, in the order of asking; ``entry`` has the number of each alive position's."""

    entry: np.ndarray
    h: np.ndarray
    context: np.ndarray
    bucket: np.ndarray
    follower: np.ndarray
    times: np.ndarray
    chances: np.ndarray

    def __post_init__(self) -> None:
        n = len(self.context)
        new = np.ones(n, bool)
        new[1:] = (self.context[1:] != self.context[:-1]) | (self.bucket[1:] != self.bucket[:-1])
        self.group, self.begin = np.cumsum(new) - 1, np.flatnonzero(new)

    def rows(self, chunk: int) -> Iterator[dict]:
        cuts = np.flatnonzero(np.diff(self.bucket, prepend=-1)) if len(self.bucket) else []
        for a, b in zip(cuts, [*cuts[1:], len(self.bucket)], strict=True):
            g = self.begin[self.group[a] : self.group[b - 1] + 1]
            sizes = np.diff(g, append=b).astype(np.uint32)
            yield {"bucket": int(self.bucket[a]), "chunk": chunk, "contexts": packed(self.h[self.context[g]]), "followers": packed(sizes), "words": packed(self.follower[a:b]), "times": packed(self.times[a:b]), "chances": packed(self.chances[a:b])}


def _cut(least_chunk: int):
    """Rows of texts to rows of the state."""

    def row(texts: list) -> pa.RecordBatch:
        docs, rows, held, parts = (list(x) for x in zip(*texts, strict=True))
        n, (words, ids, times) = len(docs), np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")  # small numbers for frequent words pack well
        number = np.empty(len(words), np.uint32)
        number[order] = np.arange(len(words))
        blank = _flags(np.zeros(len(ids), bool))
        state = {"chunk": uuid4().int >> 65, "docs": docs, "rows": rows, "held": held, "sizes": [len(p) for p in parts], "left": [len(p) for p in parts], "known": [0] * n, "base": [0.0] * n, "score": [0.0] * n}
        state |= {"words": packed(words[order]), "counts": b"", "ids": packed(number[ids]), "often": blank, "hot": blank, "alive": _flags(np.ones(len(ids), bool)), "chances": b"", "asked": len(ids), "salted": 0}
        return _table([state], _STATE).to_batches()[0]

    def split(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ends of the texts and the hashes of their words one after the other."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))  # space and \t to \r, as A-Z only
        coded = lists.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary())
        cuts = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1].tolist()
        data, digest = words.buffers()[2].to_pybytes() if words.buffers()[2] else b"", xxhash.xxh3_64_intdigest
        hashes = np.array([digest(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], np.uint64)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        blank = np.flatnonzero(np.diff(cuts) == 0)
        if len(blank):  # white space at a text's ends
            real = at != blank[0]
            ends, at = np.concatenate([[0], np.cumsum(real)])[ends], at[real]
        return ends, hashes[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, size, end_ = [], 0, np.array([_END], np.uint64)
        for batch in batches:
            ends, hashes = split(batch.column(2))
            begin = 0
            for doc, held, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends.tolist(), strict=True):
                one, last = uuid4().int >> 65, False
                while not last:
                    piece = hashes[begin : min(end, begin + least_chunk // 2)]
                    begin += len(piece)
                    last = begin == end
                    if size + len(piece) + 1 > least_chunk:
                        yield row(texts)
                        texts, size = [], 0
                    texts.append((doc, one, held, np.concatenate([piece, end_]) if last else piece))
                    size += len(texts[-1][3])
        if texts:
            yield row(texts)

    return run


def _sent(depth: int, buckets: int, size: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["asked"]:
                    yield from _table(list(Chunk(row, size).ask(depth, buckets).rows(row["chunk"])), _ASKED).to_batches()

    return run


def _answered(depth: int, least_gain: float):
    """Sums up a bucket: counts for each entry asked for, totals, followers and verdict for each context; of
    contexts that are dealt out a histogram of counts instead."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        each = lambda name, kind: [unpacked(r[name], kind) for r in rows]
        contexts, followers, words = each("contexts", np.uint64), each("followers", np.uint32), each("words", np.uint64)
        h, group = np.unique(np.concatenate(contexts), return_inverse=True)
        key = np.repeat(group, np.concatenate(followers)).astype(np.uint64) << np.uint64(_WORD_BITS) | np.concatenate(words)
        key, entry = np.unique(key, return_inverse=True)
        n = np.bincount(entry, np.concatenate(each("times", np.uint32)), len(key)).astype(np.int64)
        q = np.zeros(len(key), np.uint8)
        q[entry] = np.concatenate(each("chances", np.uint8))
        own = (key >> np.uint64(_WORD_BITS)).astype(np.int64)
        sums = lambda w: np.bincount(own, w, len(h))
        total = sums(n).astype(np.int64)
        kinds = total - sums(np.maximum(n - 1, 0)).astype(np.int64)
        out, salted = [], rows[0]["bucket"] % 2 == 1
        kept = np.zeros(len(h), bool)
        if depth and not salted:
            with np.errstate(divide="ignore", invalid="ignore"):
                rest = np.where(total > 0, kinds / np.maximum(total, 1), 1.0)
                parent, twice = 2.0 ** (-q.astype(np.float64) / STEPS), n >= 2
                better = np.where(twice, n * np.log(np.maximum(n - 1, 0) / np.maximum(total, 1)[own] / parent + rest[own]), 0.0)
                kept = sums(better) + (total - sums(np.where(twice, n, 0))) * np.log(rest) > least_gain
        ends = np.cumsum([len(w) for w in words]).tolist()
        heads = np.cumsum([len(c) for c in contexts]).tolist()
        for r, a, b, c, d in zip(rows, [0, *ends], ends, [0, *heads], heads, strict=False):
            some = group[c:d]
            summed = {} if salted else {"totals": packed(total[some]), "kinds": packed(kinds[some]), "kept": _flags(kept[some])}
            out.append({"chunk": r["chunk"], "bucket": r["bucket"], "counts": packed(n[entry[a:b]])} | summed)
        if not depth:
            out.append({"h": 0, "n": int(total.sum()), "times": int(np.count_nonzero(total))})
        if salted:
            trained = n > 0
            cells, times = np.unique(np.stack([own[trained], n[trained], np.where(n > 1, q, 0)[trained]]), axis=1, return_counts=True)
            out += [{"h": int(h[g : g + 1].view(np.int64)[0]), "n": k, "q": p, "times": t} for g, k, p, t in zip(*cells.tolist(), times.tolist(), strict=True)]
        release_memory()
        return _table(out, _ANSWERS)

    return run


def _settled(depth: int, buckets: int, hot: tuple, least_hot: int, size: tuple[int, int]):
    """Takes a chunk's answers: what can't be extended is scored, the rest stays alive."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        chunk, n = Chunk(row, size), len(row["docs"])
        if not row["asked"]:
            return _table([row], _STATE)
        asked = chunk.ask(depth, buckets, sent=False)
        answers = sorted(right.to_pylist(), key=lambda r: (r["bucket"] % 2, r["bucket"]))
        counts = np.concatenate([unpacked(r["counts"], np.int64) for r in answers])
        groups = len(asked.begin)
        total, kinds, kept = np.zeros(groups, np.int64), np.zeros(groups, np.int64), np.zeros(groups, bool)
        plain = [r for r in answers if r["totals"] is not None]
        if plain:
            known = [unpacked(r["totals"], np.int64) for r in plain]
            k = sum(len(x) for x in known)
            total[:k], kinds[:k] = np.concatenate(known), np.concatenate([unpacked(r["kinds"], np.int64) for r in plain])
            kept[:k] = np.concatenate([_unflags(r["kept"], len(x)) for r, x in zip(plain, known, strict=True)])
        salted = np.flatnonzero(asked.bucket[asked.begin] % 2 == 1)
        if len(salted) and len(hot[0]):
            wanted = asked.h[asked.context[asked.begin[salted]]].view(np.int64)
            where = np.minimum(np.searchsorted(hot[0], wanted), len(hot[0]) - 1)
            found = hot[0][where] == wanted
            total[salted[found]], kinds[salted[found]], kept[salted[found]] = (x[where[found]] for x in hot[1:])
        at, entry = chunk.at, asked.entry
        if depth == 0:
            counted = np.empty(len(total), np.int64)
            counted[np.argsort(chunk.words)] = total
            times, more, logs = total[entry], np.ones(len(at), bool), np.log10((total + 1) / (sum(size) + 1))[entry]
            row["counts"] = packed(counted)
            row["known"] = np.bincount(chunk.text[times > 0], minlength=n).tolist()
            row["base"] = np.bincount(chunk.text, logs, n).tolist()
        else:
            group, before = asked.group[entry], chunk.chances(depth)
            times, good = counts[entry], kept[group]
            over = np.maximum(total[group], 1)
            chances = np.where(good, np.maximum(times - 1, 0) / over + kinds[group] / over * before, before)
            more, logs = good & (kinds[group] > 1), np.log10(chances)
        chunk.often[at], chunk.hot[at] = times >= 2, times >= least_hot
        more &= (at - chunk.starts[chunk.text[at]] > depth) & chunk.often[at - 1]
        done = ~more
        row["score"] = (np.array(row["score"]) + np.bincount(chunk.text[at[done]], logs[done], n)).tolist()
        alive = np.zeros(len(chunk.ids), bool)
        alive[at[more]] = True
        row |= chunk.following(alive, _short(chances[more]) if depth else np.empty(0, np.float32))
        release_memory()
        return _table([row], _STATE)

    return run


def _opened(depth: int, span: int, buckets: int, size: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["asked"]:
                    yield from _table(list(Chunk(row, size).windows(depth, span, buckets)), _OPEN).to_batches()

    return run


def _grown(span: int, least_gain: float):
    """Grows the tree below a bucket's contexts, by the tests of ``_answered``, and takes each position as far as the
    words sent with it reach. Positions that end get their probability, the others one for the next exchange."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        words = [np.concatenate([np.zeros(1, np.uint64), unpacked(r["words"], np.uint64)]) for r in rows]
        sizes = [len(unpacked(r["places"], np.uint32)) for r in rows]
        column = lambda packs: np.concatenate([w[unpacked(p, np.uint32)] if p else np.zeros(n, np.uint64) for w, p, n in zip(words, packs, sizes, strict=True)])
        group = np.unique(np.concatenate([unpacked(r["contexts"], np.uint64) for r in rows]), return_inverse=True)[1]
        follower = np.unique(column([r["followers"] for r in rows]), return_inverse=True)[1]
        train = np.concatenate([_unflags(r["train"], n) for r, n in zip(rows, sizes, strict=True)])
        ends = np.concatenate([unpacked(r["chances"], np.float32) for r in rows]).astype(np.float64)
        standing, open_ = np.arange(len(group)), np.zeros(len(group), bool)
        for step in range(span + 1):
            key, first, entry = np.unique(group * (len(ends) + 1) + follower[standing], return_index=True, return_inverse=True)
            own, n = group[first], np.bincount(entry, train[standing], len(key)).astype(np.int64)
            sums = lambda w: np.bincount(own, w)
            total = sums(n).astype(np.int64)
            kinds = total - sums(np.maximum(n - 1, 0)).astype(np.int64)
            before, twice = ends[standing[first]], n >= 2
            rest = np.where(total > 0, kinds / np.maximum(total, 1), 1.0)
            parent = 2.0 ** (-np.round(-STEPS * np.log2(before)).clip(0, 255) / STEPS)
            better = np.where(twice, n * np.log(np.maximum(n - 1, 0) / np.maximum(total, 1)[own] / parent + rest[own]), 0.0)
            kept = sums(better) + (total - sums(np.where(twice, n, 0))) * np.log(rest) > least_gain
            over = np.maximum(total, 1)
            now = np.where(kept[own], np.maximum(n - 1, 0) / over[own] + kinds[own] / over[own] * before, before)
            ends[standing] = now[entry]
            more = (kept & (kinds > 1))[group]
            standing, group = standing[more], group[more]
            if step < span and len(standing):
                # A text that starts here has no longer context.
                word = column([r["before"][step] if step < len(r["before"]) else b"" for r in rows])[standing]
                standing, group, word = standing[word > 0], group[word > 0], word[word > 0]
                ends[standing] = _short(ends[standing])
                word = np.unique(word, return_inverse=True)[1]
                group = np.unique(group * (len(ends) + 1) + word, return_inverse=True)[1]
            if not len(standing):
                break
        open_[standing] = True
        cuts = np.cumsum(sizes)[:-1]
        parts = zip(rows, np.split(ends, cuts), np.split(open_, cuts), strict=True)
        out = [{"chunk": r["chunk"], "places": r["places"], "chances": packed(c), "open": _flags(o)} for r, c, o in parts]
        release_memory()
        return _table(out, _ENDS)

    return run


def _ended(depth: int, span: int, size: tuple[int, int]):
    """Takes a chunk's answers after an exchange of several levels."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        if not row["asked"]:
            return _table([row], _STATE)
        chunk = Chunk(row, size)
        at, chances, more = chunk.at, np.empty(len(chunk.at)), np.zeros(len(chunk.at), bool)
        for r in right.to_pylist():
            places = unpacked(r["places"], np.uint32)
            chances[places], more[places] = unpacked(r["chances"], np.float64), _unflags(r["open"], len(places))
        more &= (at - chunk.starts[chunk.text[at]] > depth + span) & chunk.often[at - 1]
        done = ~more
        row["score"] = (np.array(row["score"]) + np.bincount(chunk.text[at[done]], np.log10(chances[done]), len(row["docs"]))).tolist()
        alive = np.zeros(len(chunk.ids), bool)
        alive[at[more]] = True
        row |= chunk.following(alive, _short(chances[more]))
        release_memory()
        return _table([row], _STATE)

    return run


def _hot_contexts(answers: DataFrame, least_gain: float) -> tuple:
    """Hash, total, followers and verdict of the contexts that were dealt out, sorted: at most ``MOST_HOT``."""
    cells = answers.where("chunk is null").groupBy("h", "n", "q").agg(F.sum("times").alias("times"))
    sums = cells.groupBy("h").agg(F.sum(F.col("n") * F.col("times")).alias("total"), F.sum("times").alias("kinds"))
    # k = n - sum(max(n(a) - 1, 0)) is the number of different followers.
    both, parent = cells.join(sums, "h"), F.pow(F.lit(2.0), -F.col("q") / STEPS)
    rest = F.col("kinds") / F.col("total")
    better = F.when(F.col("n") > 1, F.log((F.col("n") - 1) / F.col("total") / parent + rest)).otherwise(F.log(rest))
    found = both.groupBy("h").agg(F.first("total").alias("total"), F.first("kinds").alias("kinds"), (F.sum(F.col("times") * F.col("n") * better) > least_gain).alias("kept"))
    table = found.toArrow().sort_by("h")
    return tuple(table[c].to_numpy() for c in ("h", "total", "kinds", "kept"))


def score(
    documents: DataFrame, identifier: str, text: str, held_out: Column, *, least_gain: float = LEAST_GAIN, chunk_words: int = CHUNK_WORDS, least_hot: int = HOT, bucket_entries: int = BUCKET_ENTRIES
) -> DataFrame:
    """``identifier, held_out, n_tokens, n_known, train_tokens, base_score, score``: a row for each row of ``documents``.

    Learned from the rows that aren't held out; a NULL ``held_out`` is not held out. ``base_score`` is the root's
    log10 probability of the text, ``score`` the tree's. The whole text counts; NULL, empty and blank texts are just
    an end. Repeated rows count as often as they occur. Without training rows all scores are 0. An identifier
    may have any type that casts to a string and back. Other columns aren't read.
    """
    require(documents, identifier, text)
    spark, kind = documents.sparkSession, documents.schema[identifier].dataType
    plain = documents.select(F.col(f"`{identifier}`").cast("string").alias("doc"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(f"`{text}`").cast("string").alias("data"))
    with session_settings(spark, _SETTINGS | {"spark.sql.execution.arrow.maxRecordsPerBatch": "512"}):
        state, drop = bucketed_table(plain.mapInArrow(releasing(_cut(chunk_words)), _STATE), "chunk", "lm-chunks", **_OPTIONS)
    trained = different = depth = positions = 0
    columns = ("chunk", "docs", "rows", "held", "left", "words", "counts", "ids", "often", "hot", "alive", "chances", "asked")
    with session_settings(spark, _SETTINGS):
        while (here := state.agg(F.sum("asked").alias("asked"), F.sum("salted").alias("salted")).first())["asked"]:
            positions = positions or here["asked"]
            span = min(MOST_SPAN, positions // (8 * here["asked"]))
            several = depth > 0 and not here["salted"] and span >= LEAST_SPAN
            if several:
                buckets = here["asked"] * span // (2 * bucket_entries) + 1
                asked = state.select(*columns).mapInArrow(releasing(_opened(depth, span, buckets, (trained, different))), _OPEN).groupBy("bucket").applyInArrow(_grown(span, least_gain), _ENDS)
            else:
                buckets = here["asked"] // bucket_entries + 1
                asked = state.select(*columns).mapInArrow(releasing(_sent(depth, buckets, (trained, different))), _ASKED).groupBy("bucket").applyInArrow(_answered(depth, least_gain), _ANSWERS)
            answers, answers_path = kept_table(asked, "lm-answers", **_OPTIONS)
            hot = (np.empty(0, np.int64),) * 4
            if depth == 0:
                trained, different = (int(x or 0) for x in answers.where("chunk is null").agg(F.sum("n"), F.sum("times")).first())
                least_hot = max(least_hot, trained // MOST_HOT)
            elif here["salted"]:
                hot = _hot_contexts(answers, least_gain)
            if several:
                step, mine = _ended(depth, span, (trained, different)), answers
            else:
                step = _settled(depth, buckets, hot, least_hot, (trained, different))
                mine = answers.where("chunk is not null").select("chunk", "bucket", "counts", "totals", "kinds", "kept")
            # The chunks are bucketed, so only the answers are shuffled.
            following, drop_following = bucketed_table(state.groupBy("chunk").cogroup(mine.groupBy("chunk")).applyInArrow(step, _STATE), "chunk", "lm-chunks", **_OPTIONS)
            drop(), delete_scratch(spark, answers_path)
            state, drop, depth = following, drop_following, depth + (span + 1 if several else 1)
    results, _ = kept_table(state.select("docs", "rows", "held", "sizes", "known", "base", "score"), "lm-scores")
    drop()
    each = results.select(F.explode(F.arrays_zip("docs", "rows", "held", "sizes", "known", "base", "score")).alias("x")).select("x.*")
    # The pieces of a long text are put together again.
    whole = each.groupBy("rows").agg(F.first("docs").alias("doc"), F.first("held").alias("held"), *(F.sum(c).alias(c) for c in ("sizes", "known", "base", "score")))
    return whole.select(
        F.col("doc").cast(kind).alias(identifier),
        F.col("held").alias(free_name("held_out", [identifier])),
        F.col("sizes").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(trained).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )
