"""Column hygiene."""

from __future__ import annotations

from pyspark.sql import DataFrame

from meldframe.functions.naming import unique_names


def clean_columns(df: DataFrame) -> DataFrame:
    """Snake-case column names without collisions; the same object if no name changes."""
    names = unique_names(df.columns)
    return df if names == df.columns else df.toDF(*names)
