import random
import re

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture
def documents(spark):
    """Makes a documents table of (doc_id, text) pairs, or with a language, with extra columns of clashing names."""

    def make(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("ids", "decoded", "fingerprint", "component_id", "n_words", "kept", "rule", "score", "lang_pred", "pii", "mark", "key", "_text", "_mark", "_gone", "word", "near"):
                df = df.withColumn(name, F.lit("own"))
        return df

    return make


@pytest.fixture
def babble():
    def make(seed, n, vocabulary=400):
        r = random.Random(seed)
        return " ".join("".join(r.choice("bdfklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))

    return make
