"""Operators on keyed rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meldframe.functions.naming import free_name, quoted


def as_list(names: str | Iterable[str] | None) -> list[str]:
    if names is None:
        return []
    return [names] if isinstance(names, str) else list(names)


def latest_by_key(
    df: DataFrame,
    keys: str | Sequence[str],
    order_by: str | Sequence[str],
    *,
    descending: bool | Sequence[bool] = True,
) -> DataFrame:
    """The first row of each key in the given order; one shuffle on the keys.

    ``descending`` is one flag, or one for each ordering column. NULL sorts last when descending and
    first when ascending. Rows equal in every ordering column tie, and any one of them is kept: name
    a unique column last for a fixed choice. Rows with a NULL key form a group of their own.
    """
    keys, order_by = as_list(keys), as_list(order_by)
    if not keys or not order_by:
        raise ValueError("keys and order_by must name at least one column")
    flags = [descending] * len(order_by) if isinstance(descending, bool) else list(descending)
    if len(flags) != len(order_by):
        raise ValueError("descending needs one flag for each ordering column")
    order = [F.col(quoted(c)).desc() if d else F.col(quoted(c)).asc() for c, d in zip(order_by, flags, strict=True)]
    rank = free_name("_rank", df.columns)
    window = Window.partitionBy(*(F.col(quoted(k)) for k in keys)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) == 1).drop(rank)


def ordered_list_by_key(
    df: DataFrame,
    keys: str | Sequence[str],
    value: str,
    order_by: str | Sequence[str],
    *,
    alias: str | None = None,
) -> DataFrame:
    """One row a key with its values as an array, in the order of ``order_by`` and then of the value; one shuffle."""
    keys, order_by = as_list(keys), as_list(order_by)
    entry = F.struct(*(F.col(quoted(c)).alias(f"o{i}") for i, c in enumerate(order_by)), F.col(quoted(value)).alias("v"))
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["v"])
    return df.groupBy(*(F.col(quoted(k)) for k in keys)).agg(listed.alias(alias or value))
