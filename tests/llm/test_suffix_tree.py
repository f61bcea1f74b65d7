import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meldframe.llm import suffix_tree

from .conftest import words_of


def tokens(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words_of(text)] + ["\n"]


class SlowTree:
    """The same model by dictionaries, over whole texts."""

    def __init__(self, texts):
        self.count, self.after = Counter(), defaultdict(Counter)
        lists = [tokens(t) for t in texts]
        for words in lists:
            self.count.update(words)
        self.n, self.v = sum(self.count.values()), len(self.count)
        self.kept = {(): True}
        depth = 0
        while True:
            depth += 1
            after = defaultdict(Counter)
            for words in lists:
                for i in range(depth, len(words)):
                    s = tuple(words[i - depth : i])
                    if depth == 1 or (self.kept.get(s[1:]) and self.kinds(s[1:]) > 1):
                        after[s][words[i]] += 1
            self.after |= after
            for s in after:
                self.kept[s] = self.gain(s) > suffix_tree.LEAST_GAIN
            if not any(self.kept[s] for s in after):
                return

    def kinds(self, s):
        return sum(self.after[s].values()) - sum(max(n - 1, 0) for n in self.after[s].values())

    def gain(self, s):
        total, rest = sum(self.after[s].values()), self.kinds(s) / sum(self.after[s].values())
        out = 0.0
        for a, n in self.after[s].items():
            if n > 1:
                parent = 2.0 ** (-round(-4 * math.log2(np.float32(self.chance(s[1:], a)))) / 4)
                out += n * math.log((n - 1) / total / parent + rest)
            else:
                out += math.log(rest)
        return out

    def chance(self, s, a):
        if not s:
            return (self.count[a] + 1) / (self.n + self.v + 1)
        below = self.chance(s[1:], a)
        if not self.kept.get(s):
            return below
        total = sum(self.after[s].values())
        return max(self.after[s][a] - 1, 0) / total + self.kinds(s) / total * below

    def score(self, text):
        words = tokens(text)
        deepest = lambda i: next((tuple(words[i - d : i]) for d in range(i, 0, -1) if self.kept.get(tuple(words[i - d : i]))), ())
        return sum(math.log10(self.chance(deepest(i), w)) for i, w in enumerate(words))


def texts():
    r = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    phrases = [" ".join(r.choice(words) for _ in range(r.randint(2, 12))) for _ in range(15)]
    rows = [(i, " ".join(r.choice(phrases) if r.random() < 0.6 else r.choice(words) for _ in range(r.randint(0, 40)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \t\n"), (None, "W1 w2"), (3, "The é\u0085x THE"), (504, "tail " + phrases[0]), (505, "| | | | " * 30)]
    return rows + rows[:3]


def test_scores_equal_the_slow_tree(documents):
    rows = texts()
    held = F.col("doc_id") % 5 == 2
    found = suffix_tree.score(documents(rows, extra=True), "doc_id", "text", held, chunk_words=1000, least_hot=40, bucket_entries=300).collect()
    tree = SlowTree([t for d, t in rows if d is None or d % 5 != 2])
    assert max(len(s) for s, kept in tree.kept.items() if kept) >= 3
    base = lambda t: sum(math.log10(tree.chance((), w)) for w in tokens(t))
    row = lambda d, t: (d if d is not None else -1, d is not None and d % 5 == 2, len(tokens(t)), sum(tree.count[w] > 0 for w in tokens(t)), tree.n)
    expected = sorted((*row(d, t), round(base(t), 6), round(tree.score(t), 3)) for d, t in rows)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 3)) for r in found)
    assert [x[:6] for x in got] == [x[:6] for x in expected]
    assert [x[6] for x in got] == pytest.approx([x[6] for x in expected], rel=1e-5, abs=2e-3)


def test_deep_contexts_take_few_exchanges(documents, babble, monkeypatch):
    """The last word tells how many words lead to it, so contexts of 25 words and more are kept, each a level. Exchanges of
    several levels must score as the slow tree does."""
    r = random.Random(2)
    runs = [j for j in range(1, 37) for _ in range(round(900 * 0.85**j))]
    r.shuffle(runs)
    texts = [" ".join([f"from{j}", *(f"p{k}" for k in range(j, 0, -1)), f"to{j}"]) for j in runs]
    rows = [(i, " ".join(texts[40 * i : 40 * i + 40])) for i in range(len(texts) // 40)] + [(900, " ".join(f"p{k}" for k in range(60, 0, -1)) + " to36")]
    rows += [(1000 + i, babble(i, 40)) for i in range(1600)]
    tree = SlowTree([t for d, t in rows if d % 5 != 2])
    assert max(len(s) for s, kept in tree.kept.items() if kept) >= 25
    exchanges, own = [], suffix_tree.bucketed_table
    monkeypatch.setattr(suffix_tree, "bucketed_table", lambda df, key, name, **options: exchanges.append(name) or own(df, key, name, **options))
    monkeypatch.setattr(suffix_tree, "MOST_SPAN", 12)
    found = suffix_tree.score(documents(rows), "doc_id", "text", F.col("doc_id") % 5 == 2, chunk_words=6000, bucket_entries=2000).collect()
    assert {r.doc_id: r.score for r in found} == pytest.approx({d: tree.score(t) for d, t in rows}, rel=1e-5, abs=2e-3)
    assert len(exchanges) < 14


def test_distributions_sum_to_one():
    tree = SlowTree([t for _, t in texts()])
    known = list(tree.count)
    for s in [(), *[s for s, kept in tree.kept.items() if kept][:200]]:
        unknown = tree.chance(s, "never seen")
        assert sum(tree.chance(s, a) for a in known) + unknown == pytest.approx(1)


def test_a_long_text_is_cut_into_pieces_and_put_together(documents, babble):
    long = babble(1, 3000)
    out = suffix_tree.score(documents([(1, long), (2, long)]), "doc_id", "text", F.lit(False), chunk_words=1000).collect()
    assert [r.n_tokens for r in out] == [3001, 3001] and all(r.score > r.base_score for r in out)


def test_no_training_rows_and_no_rows(documents):
    rows = documents([(1, "a b"), (2, None)])
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in suffix_tree.score(rows, "doc_id", "text", F.lit(True)).collect()} == {(0, 0, 0.0, 0.0)}
    assert suffix_tree.score(documents([]), "doc_id", "text", F.lit(False)).isEmpty()


def test_identifiers_of_any_type(documents):
    rows = documents([(1, "a b"), (None, "a b a b")]).withColumn("name", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert {r["name"] for r in suffix_tree.score(rows, "name", "text", F.lit(False)).collect()} == {"d1", None}
