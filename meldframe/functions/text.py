"""Text expressions. All are built-in functions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accented letters and the letters they become, place by place. Others turn into spaces.
ACCENTED = "àáâãäåāăąçćčďèéêëēėęěìíîïīįłñńòóôõöøōřśšťùúûüūůýÿžźż"
PLAIN = "aaaaaaaaacccdeeeeeeeeiiiiiilnnooooooorsstuuuuuuyyzzz"


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalize_text(value: str | Column) -> Column:
    """Lower case, known accents dropped, every run of anything but a-z and 0-9 as one space, trimmed; NULL gives ``''``."""
    text = F.lower(F.coalesce(as_column(value).cast("string"), F.lit("")))
    return F.trim(F.regexp_replace(F.translate(text, ACCENTED, PLAIN), "[^a-z0-9]+", " "))


def compact(normalized: str | Column) -> Column:
    return F.replace(as_column(normalized), F.lit(" "), F.lit(""))


def char_ngrams(text: Column, n: int) -> Column:
    """The distinct character n-grams; a text no longer than ``n`` is its own only one, and ``''`` has none."""
    size = F.length(text)
    sliding = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - (n - 1))), lambda i: F.substring(text, i, F.lit(n))))
    return F.when(size == 0, F.array().cast("array<string>")).when(size <= n, F.array(text)).otherwise(sliding)


def edit_similarity(distance: Column, left: Column, right: Column) -> Column:
    """One less the distance as a share of the longer length; 0 for two empty texts."""
    longer = F.greatest(F.length(left), F.length(right))
    return F.when(longer == 0, F.lit(0.0)).otherwise(1.0 - distance / longer)
