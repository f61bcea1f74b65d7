"""Quality rules: decision lists learned by sequential covering, applied as ordered Spark conditions.

Everything on the data path is DataFrame and SQL functions. What the driver sees is bounded: quantile
thresholds, and counts of good and bad labelled rows by binned feature, from at most ``max_rows``
labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meldframe.llm.shared import free_name, require, written

#: Fixed values of the measures: white space, symbols, words of a window, and the base rule.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 0.2

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: What rules may test: ratios that don't depend on a text's length, and the length itself.
MEASURES = {
    "words": lambda c: c("n_words").cast("double"),
    "mean_word_chars": lambda c: c("word_chars") / c("n_words"),
    "symbols_per_word": lambda c: c("n_symbols") / c("n_words"),
    "dup_lines_per_word": lambda c: c("n_dup_lines") / c("n_words"),
    "repeat_share": lambda c: c("n_repeat_words") / c("n_words"),
}


def text_counts(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the long columns of ``COUNTS`` for the whole text; no shuffle.

    A NULL text counts as empty, with zeros. Input columns named like a count are replaced. Windows of
    five words are compared by their 64-bit hashes, within one text only.
    """
    require(df, text)
    df = df.drop(*(c for c in COUNTS if c != text))
    kept = [F.col(f"`{c}`") for c in df.columns]
    names = {k: free_name(f"_q_{k}", df.columns) for k in ("text", "words", "lines", "hashes", "sorted", "at")}
    n = lambda k: f"`{names[k]}`"
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    trimmed = F.btrim(whole, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    window = ", ".join(f"{n('words')}[i + {k}]" if k else f"{n('words')}[i]" for k in range(WINDOW))
    # A column each, so that no lambda computes an array anew for each element.
    step = df.select(*kept, words.alias(names["words"]), lines.alias(names["lines"]), F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    step = step.withColumn(
        names["hashes"],
        F.expr(f"CASE WHEN size({n('words')}) >= {WINDOW} THEN transform(sequence(0, size({n('words')}) - {WINDOW}), i -> xxhash64({window})) ELSE array() END"),
    )
    step = step.withColumn(
        names["sorted"],
        F.expr(f"CASE WHEN size(array_distinct({n('hashes')})) < size({n('hashes')}) THEN sort_array(transform({n('hashes')}, (h, i) -> struct(h AS h, i AS i))) END"),
    )
    s = n("sorted")
    step = step.withColumn(
        names["at"],
        F.expr(
            f"sort_array(transform(filter({s}, (x, k) -> (k > 0 AND x.h = {s}[CASE WHEN k > 0 THEN k - 1 ELSE 0 END].h) OR "
            f"(k < size({s}) - 1 AND x.h = {s}[CASE WHEN k < size({s}) - 1 THEN k + 1 ELSE k END].h)), x -> x.i))"
        ),
    )
    repeated = F.expr(
        f"aggregate({n('at')}, struct(0L AS n, {-WINDOW} AS last), (a, p) -> struct(a.n + least({WINDOW}, p - a.last) AS n, p AS last), a -> a.n)"
    )
    counted = step.select(
        *kept,
        F.size(names["words"]).cast("long").alias("n_words"),
        F.length(F.concat_ws("", F.col(n("words")))).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size(names["lines"]) - F.size(F.array_distinct(F.col(n("lines"))))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeated, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    # Filters aren't pushed below an observation: pushed down, a test of a count would compute the arrays anew.
    return counted.observe(f"texts-{uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def base_failed(n_words: str = "n_words", n_repeat_words: str = "n_repeat_words") -> Column:
    return (F.col(n_words) < LEAST_WORDS) | (F.col(n_repeat_words) * 100 > F.col(n_words) * int(100 * MOST_REPEATED))


@dataclass(frozen=True)
class Test:
    """``measure >= bound`` if ``above``, else ``measure < bound``."""

    measure: str
    bound: float
    above: bool

    def column(self) -> Column:
        value = MEASURES[self.measure](F.col)
        return value >= self.bound if self.above else value < self.bound

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.above else '<'} {self.bound:g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order: the first whose tests all hold rejects the text; without one it is kept."""

    rules: Sequence[Sequence[Test]] = field(default_factory=tuple)

    def rule(self) -> Column:
        """The number of the first rule that rejects, from 1; NULL if none does."""
        found = F.lit(None).cast("int")
        for i in range(len(self.rules), 0, -1):
            both = self.rules[i - 1][0].column()
            for test in self.rules[i - 1][1:]:
                both = both & test.column()
            found = F.when(both, F.lit(i)).otherwise(found)
        return found

    def __str__(self) -> str:
        return "\n".join(f"{i}. reject if {' and '.join(map(str, r))}" for i, r in enumerate(self.rules, 1)) or "keep all"


def fit(
    counts: DataFrame,
    good: str,
    fold_key: str,
    *,
    bins: int = 24,
    most_tests: int = 3,
    most_rules: int = 12,
    precision: float = 0.9,
    support: int = 5,
) -> DecisionList:
    """Rules for the rows whose boolean ``good`` is false, learned by sequential covering.

    Two thirds of the rows, by a hash of ``fold_key``, grow each rule: the test of the largest gain is added
    until no good row is left or ``most_tests`` stand; a test that a later one implies goes. The rest prune it: the
    test goes whose loss leaves the best precision, as long as that doesn't lower it. A rule counts if both parts
    give it ``precision`` and it has ``support`` rows. Ties go to the first measure, the lowest bound, and ``>=``.
    Rows with a NULL ``good`` or without words are left out; without rows the list is empty.
    """
    values = {m: f(F.col) for m, f in MEASURES.items()}
    rows = counts.where(F.col(good).isNotNull() & (F.col("n_words") > 0)).select(
        F.col(good).cast("int").alias("good"), (F.pmod(F.xxhash64(F.col(fold_key)), F.lit(3)) == 0).alias("prune"), *(v.alias(m) for m, v in values.items())
    )
    at = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    bounds = rows.agg(*(F.percentile_approx(m, at, 10_000).alias(m) for m in MEASURES)).first()
    edges = {m: sorted(set(bounds[m] or [])) for m in MEASURES}
    binned = [sum((F.col(m) >= F.lit(x)).cast("int") for x in edges[m]).alias(m) if edges[m] else F.lit(0).alias(m) for m in MEASURES]
    cells = rows.select("good", "prune", *binned).groupBy("prune", *MEASURES).agg(F.sum("good").alias("g"), F.count("*").alias("n")).collect()
    table = [(r["prune"], tuple(r[m] for m in MEASURES), r["g"], r["n"] - r["g"]) for r in cells]
    grow, prune = ([x[1:] for x in table if x[0] is side] for side in (False, True))
    tests = [(k, j, above) for k, m in enumerate(MEASURES) for j in range(1, len(edges[m]) + 1) for above in (True, False)]

    def holds(cell: tuple[int, ...], t: tuple[int, int, bool]) -> bool:
        return (cell[t[0]] >= t[1]) == t[2]

    def covered(part: list, rule: list) -> tuple[int, int]:
        inside = [x for x in part if all(holds(x[0], t) for t in rule)]
        return sum(x[2] for x in inside), sum(x[1] for x in inside)

    rules = []
    while len(rules) < most_rules:
        rule: list[tuple[int, int, bool]] = []
        inside = grow
        while len(rule) < most_tests:
            bad, ok = sum(x[2] for x in inside), sum(x[1] for x in inside)
            if not bad or not ok:
                break
            before, best = math.log2(bad / (bad + ok)), (0.0, None)
            for t in tests:
                b = o = 0
                for x in inside:
                    if holds(x[0], t):
                        b, o = b + x[2], o + x[1]
                if b and (gain := b * (math.log2(b / (b + o)) - before)) > best[0] + 1e-9:
                    best = (gain, t)
            if best[1] is None:
                break
            rule.append(best[1])
            inside = [x for x in inside if holds(x[0], best[1])]
        implied = lambda t, u: t != u and t[0] == u[0] and t[2] == u[2] and (u[1] > t[1] if t[2] else u[1] < t[1])
        rule = [t for t in rule if not any(implied(t, u) for u in rule)]
        share = lambda bo: (bo[0] + 1) / (sum(bo) + 2)
        while len(rule) > 1:
            shorter = max(([u for u in rule if u != t] for t in rule), key=lambda r: share(covered(prune, r)))
            if share(covered(prune, shorter)) < share(covered(prune, rule)):
                break
            rule = shorter
        if not rule:
            break
        (b, o), (pb, po) = covered(grow, rule), covered(prune, rule)
        if b + pb < support or b < precision * (b + o) or pb < precision * (pb + po):
            break
        rules.append(tuple(Test(list(MEASURES)[k], edges[list(MEASURES)[k]][j - 1], above) for k, j, above in rule))
        grow, prune = ([x for x in part if not all(holds(x[0], t) for t in rule)] for part in (grow, prune))
    return DecisionList(tuple(rules))


def labelled_sample(documents: DataFrame, labels: DataFrame, key: str, *, max_rows: int = 20_000) -> DataFrame:
    """The labelled documents, at most ``max_rows`` labels of them, chosen by a hash of the key.

    The chosen labels are few and of bounded size, so they are broadcast: the texts aren't shuffled.
    """
    chosen = labels.where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(max_rows)
    return documents.join(F.broadcast(chosen), key)


def judge(documents: DataFrame, text: str, rules: DecisionList) -> DataFrame:
    """``documents`` with ``COUNTS``, ``base_failed``, ``rule`` and ``kept``: false if the base rule fails or a
    learned rule rejects. A text without words fails the base rule. Input columns of these names are replaced."""
    counted = text_counts(documents.drop("base_failed", "rule", "kept"), text).withColumn("base_failed", base_failed())
    return counted.withColumn("rule", F.when(~F.col("base_failed"), rules.rule())).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def learned(documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000) -> DecisionList:
    """The list learned from ``labels``, whose ``label`` is 1 for good documents, on documents that the base rule passes."""
    chosen = labels.select(key, (F.col(label) == 1).alias("good"))
    sample = labelled_sample(documents.select(key, text), chosen, key, max_rows=max_rows)
    counted = written(text_counts(sample, text).drop(text), "labelled")
    return fit(counted.where(~base_failed()), "good", key)
