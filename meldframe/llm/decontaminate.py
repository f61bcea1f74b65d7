"""Benchmark decontamination by template windows.

Texts become templates: numbers, names and units turn into typed placeholders, other words into their
lower-case core. Windows of template words, and windows of the plain cores, are hashed on both sides and joined.
Windows that match on neighbouring diagonals form a candidate, which counts as a leak if it covers enough of the
item and its slots are consistent: what one value of the item became is, for at least half of its places, one
value of the document. So a question with other numbers or names is caught, a coincidence of form is not. The
plain windows find verbatim copies of items that are mostly slots or in title case.

The benchmark's windows are a table, joined by key. A bitmap of fixed size keeps documents' windows that can't
be in it from being shuffled; the larger the benchmark, the more of them pass.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meldframe.llm.lines import BITMAP, _bitmap
from meldframe.llm.shared import bounded_batches, free_name, releasing, require, written

WINDOW = 8
#: Items of fewer words identify no passage: they count where a line is the item and nothing else.
LEAST_WORDS = 5
#: Of a template window's words at least this share must be literal.
LITERAL_SHARE = 0.5
#: Of an item's words at least this share must be covered by matching windows.
COVERAGE = 0.5
#: Of the covered slots at least this share must have become what their value mostly became.
CONSISTENT = 0.5
#: Windows whose diagonals differ by at most this are one candidate: so many words may be added or left out.
DRIFT = 3
_CACHE_WORDS = 1 << 18

_NUMBER = re.compile(r"[+-]?[0-9][0-9.,:/]*(?:st|nd|rd|th|%)?\Z", re.IGNORECASE)
_MEASURED = re.compile(r"([0-9][0-9.,]*)([A-Za-z°]+)\Z")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: Units and number words.
UNITS = frozenset(
    "mm cm m km in ft yd mi mile miles meter meters metre metres kilometer kilometers kilometre kilometres inch inches foot feet yard yards "
    "g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes l ml liter liters litre litres gallon gallons "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur gbp percent degree degrees celsius fahrenheit kelvin mph kph watt watts volt volts joule joules hz".split()
)
NUMBER_WORDS = frozenset("two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
_PUNCTUATION = "\"'()[]{}<>.,;:!?*_-"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


_PLACEHOLDERS = np.array([_hash("\0name"), _hash("\0number"), _hash("\0unit")], np.uint64)


_IS_NUMBER, _IS_UNIT, _IS_NAME, _ENDS = 1, 2, 4, 8


class _Words(dict):
    """The number of each word seen; by number its hash, core, and flags: kind, looks like a name, ends a sentence."""

    def __init__(self) -> None:
        self.cores: list[str] = []
        self.hashes, self.flags = np.empty(1 << 12, np.uint64), np.empty(1 << 12, np.uint8)

    def __missing__(self, word: str) -> int:
        core = word.strip(_PUNCTUATION)
        if not core.isalnum():
            core = _EDGE.sub("", word)
        lower = core.lower()
        flags = 0
        if lower in NUMBER_WORDS or (not core.isalpha() and (_NUMBER.match(core) or ((m := _MEASURED.match(core)) and m[2].lower() in UNITS))):
            flags = _IS_NUMBER
        elif lower in UNITS:
            flags = _IS_UNIT
        elif len(core) > 1 and core[0].isupper() and core[1:].islower():
            flags = _IS_NAME
        if word.rstrip("\"')]»”’")[-1:] in (".", "!", "?", ":"):
            flags |= _ENDS
        self[word] = at = len(self)
        if at == len(self.flags):
            self.hashes, self.flags = np.resize(self.hashes, 2 * at), np.resize(self.flags, 2 * at)
        self.hashes[at], self.flags[at] = _hash(lower) if core else 0, flags
        self.cores.append(lower)
        return at


class Templates:
    """Some texts as templates, one after the other: of each word that isn't just signs the hash of its core, that of
    its template word, if it is a slot, its text's number and its place in the text."""

    def __init__(self, words: _Words, texts: list[str]):
        every = [np.fromiter(map(words.__getitem__, t.split()), np.int64) for t in texts]
        sizes = np.fromiter(map(len, every), np.int64, len(every))
        at = np.concatenate(every) if every else np.empty(0, np.int64)
        text = np.repeat(np.arange(len(texts)), sizes)
        plain, flags = words.hashes[at], words.flags[at]
        before = np.concatenate([np.array([_ENDS], np.uint8), flags[:-1]]) if len(at) else flags
        starts = np.cumsum(sizes) - sizes
        before[starts[sizes > 0]] = _ENDS
        name = (flags & _IS_NAME != 0) & (before & _ENDS == 0)
        number = flags & _IS_NUMBER != 0
        unit = (flags & _IS_UNIT != 0) & (before & _IS_NUMBER != 0)
        hashes = plain.copy()
        hashes[name], hashes[number], hashes[unit] = _PLACEHOLDERS
        keep = np.flatnonzero(plain != 0)
        self.plain, self.hashes, self.slots, self.at, self.text = plain[keep], hashes[keep], (name | number | unit)[keep], at[keep], text[keep]
        self.sizes = np.bincount(self.text, minlength=len(texts))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.words = words

    def windows(self, template: bool, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows of ``size`` words; of template windows those that are literal enough."""
        values = self.hashes if template else self.plain
        n = len(values) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        total = np.full(n, 2 * size + template, np.uint64)
        for j in range(size):
            total = total * _BASE + values[j : j + n]
        ok = self.text[:n] == self.text[size - 1 :]
        if template:
            filled = np.cumsum(np.concatenate([[0], self.slots]))
            ok &= filled[size:] - filled[:-size] <= size * (1 - LITERAL_SHARE)
        at = np.flatnonzero(ok)
        total = total[at]
        return at, total ^ (total >> np.uint64(32))

    def cores(self, a: int, b: int) -> list[str]:
        return [self.words.cores[k] for k in self.at[a:b].tolist()]


class _Reader:
    """Makes templates for a task: the words it has seen are kept, and begun anew when they are many."""

    def __init__(self) -> None:
        self.words = _Words()

    def templates(self, texts: list[str]) -> Templates:
        if len(self.words) > _CACHE_WORDS:
            self.words = _Words()
        return Templates(self.words, texts)


def item_sizes(n: int) -> list[tuple[bool, int]]:
    """The windows an item of ``n`` words is looked for by: template or plain, and size. The template windows of a
    short item leave a word over, as its first may be taken for a name in a text."""
    if n < LEAST_WORDS:
        return [(False, n)]
    return [(False, min(WINDOW, n)), (True, min(WINDOW, max(LEAST_WORDS, n - 1)))]


def _signed(values: np.ndarray) -> list[int]:
    return values.view(np.int64).tolist()


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """``item, size, template, h, q, n, own, slots``: the windows of the benchmark's items. An item without words has none."""
    kind = T.StructField("item", benchmark.schema[item].dataType)
    schema = T.StructType([kind, *T._parse_datatype_string("size int, template boolean, h long, q int, n int, own array<string>, slots array<boolean>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            t = reader.templates([x or "" for x in batch.column(1).to_pylist()])
            rows, wanted = [], defaultdict(set)
            for k, n in enumerate(t.sizes.tolist()):
                for each in item_sizes(n) if n else ():
                    wanted[each].add(k)
            for (template, size), own in wanted.items():
                at, h = t.windows(template, size)
                for p, x in zip(at.tolist(), _signed(h), strict=True):
                    k = int(t.text[p])
                    if k in own:
                        rows.append((k, size, template, x, p - int(t.starts[k]), int(t.sizes[k]), t.cores(p, p + size), t.slots[p : p + size].tolist()))
            if rows:
                which, *rest = zip(*rows, strict=True)
                types = (pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.bool_()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), *(pa.array(c, x) for c, x in zip(rest, types, strict=True))], [f.name for f in schema])

    own = benchmark.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    return own.mapInArrow(run, schema)


def _hits(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``key, h, p, found`` of the windows of ``documents`` (key, text) that may be among ``items``."""
    spark = documents.sparkSession
    kinds = [(r["template"], r["size"]) for r in items.select("template", "size").distinct().collect()]
    maybe = spark.sparkContext.broadcast(_bitmap(items.select(F.col("h").alias("mark")).distinct()))
    inside, lines = [k for k in kinds if k[1] >= LEAST_WORDS], any(k[1] < LEAST_WORDS for k in kinds)
    schema = T.StructType([documents.schema["key"], *T._parse_datatype_string("h long, p int, found array<string>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, reader = maybe.value, _Reader()

        def possible(h: np.ndarray) -> np.ndarray:
            at = h & np.uint64(BITMAP - 1)
            return np.flatnonzero(bits[at >> np.uint64(6)].view(np.uint64) >> (at & np.uint64(63)) & np.uint64(1))

        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            rows = []
            t = reader.templates(texts)
            for template, size in inside:
                at, h = t.windows(template, size)
                some = possible(h)
                for p, x in zip(at[some].tolist(), _signed(h[some]), strict=True):
                    k = int(t.text[p])
                    rows.append((k, x, p - int(t.starts[k]), t.cores(p, p + size)))
            if lines:
                short = [(k, line) for k, text in enumerate(texts) for line in text.split("\n") if 0 < len(line.split(None, 2 * LEAST_WORDS)) <= 2 * LEAST_WORDS]
                t = reader.templates([line for _, line in short])
                for size in range(1, LEAST_WORDS):
                    at, h = t.windows(False, size)
                    whole = np.flatnonzero(t.sizes[t.text[at]] == size) if len(at) else at
                    at, h = at[whole], h[whole]
                    some = possible(h)
                    rows += [(short[t.text[p]][0], x, 0, t.cores(p, p + size)) for p, x in zip(at[some].tolist(), _signed(h[some]), strict=True)]
            if rows:
                which, h, p, found = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), pa.array(h, pa.int64()), pa.array(p, pa.int32()), pa.array(found, pa.list_(pa.string()))], ["key", "h", "p", "found"])

    return documents.mapInArrow(releasing(run), schema)


def best_candidate(length: int, matches: list[tuple[int, int, list[str], list[str], list[bool]]]) -> tuple[float, int] | None:
    """Coverage and number of changed slot values of the best candidate among ``matches`` of one text and one item:
    place in the text, place in the item, the text's words, the item's words, and which are slots."""
    matches = sorted((p - q, q, found, own, slots) for p, q, found, own, slots in matches)
    best, begin = None, 0
    for k in range(1, len(matches) + 1):
        if k < len(matches) and matches[k][0] - matches[k - 1][0] <= DRIFT:
            continue
        covered: dict[int, tuple[str, str, bool]] = {}
        for _, q, found, own, slots in matches[begin:k]:
            for i, each in enumerate(zip(own, found, slots, strict=True), q):
                covered.setdefault(i, each)
        begin = k
        coverage = len(covered) / length
        if coverage < COVERAGE:
            continue
        became: dict[str, Counter] = defaultdict(Counter)
        for own, found, slot in covered.values():
            if slot:
                became[own][found] += 1
        mostly = sum(max(c.values()) for c in became.values())
        if mostly >= CONSISTENT * sum(c.total() for c in became.values()):
            best = max(best or (0.0, 0), (coverage, -sum(own not in c for own, c in became.items())))
    return (best[0], -best[1]) if best else None


def _found(documents: DataFrame, benchmark: DataFrame, item: str, item_text: str) -> DataFrame:
    """``key, item, coverage, changed_slots`` for each key of ``documents`` (key, text) and each item it leaks."""
    bounded_batches(documents.sparkSession)
    items = written(_items(benchmark, item, item_text), "items")
    hits = written(_hits(documents, items), "hits")
    match = F.struct("p", "q", "found", "own", "slots")
    met = hits.join(items, "h").groupBy("key", "item").agg(F.first("n").alias("n"), F.collect_list(match).alias("matches"))
    schema = T.StructType([met.schema["key"], met.schema["item"], *T._parse_datatype_string("coverage double, changed_slots long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [best_candidate(n, [tuple(m.values()) for m in matches]) for n, matches in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            which = pa.array([k for k, b in enumerate(best) if b], pa.int64())
            some = [b for b in best if b]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array([b[0] for b in some], pa.float64()), pa.array([b[1] for b in some], pa.int64())], [f.name for f in schema])

    return met.mapInArrow(run, schema)


def leaks(documents: DataFrame, identifier: str, text: str, benchmark: DataFrame, item: str, item_text: str) -> DataFrame:
    """``identifier, item, coverage, changed_slots``: the documents that hold a benchmark item.

    ``changed_slots`` counts the item's distinct slot values that the document replaced; the coverage is that of
    the best candidate. NULL and empty texts hold nothing; repeated rows have repeated results, and items that repeat
    an identifier count as one. An empty benchmark gives an empty table. Where both identifiers have one name, the
    item's gets an underscore. Identifiers may have any type that can be grouped by.
    """
    require(documents, identifier, text), require(benchmark, item, item_text)
    key = F.struct(F.monotonically_increasing_id().alias("row"), F.col(f"`{identifier}`").alias("id")).alias("key")
    found = _found(documents.select(key, F.col(f"`{text}`").cast("string").alias("text")), benchmark, item, item_text)
    return found.select(F.col("key.id").alias(identifier), F.col("item").alias(free_name(item, [identifier])), "coverage", "changed_slots")


def clean(documents: DataFrame, text: str, benchmark: DataFrame, item: str, item_text: str) -> DataFrame:
    """``documents`` without the rows whose text holds a benchmark item. Each row is judged by its own text; equal texts
    are judged once a row and go together. NULL and empty texts stay; other columns are of no concern."""
    require(documents, text), require(benchmark, item, item_text)
    own = F.col(f"`{text}`").cast("string")
    gone = _found(documents.select(F.xxhash64(own).alias("key"), own.alias("text")), benchmark, item, item_text)
    gone = written(gone.select("key").distinct(), "leaking")
    mark, key = free_name("_mark", documents.columns), free_name("_key", documents.columns)
    marked = documents.withColumn(mark, F.xxhash64(own))
    return marked.join(gone.withColumnRenamed("key", key), F.col(mark) == F.col(key), "left_anti").select(*(F.col(f"`{c}`") for c in documents.columns))
