"""Change feeds as streams: each micro-batch is collapsed to one change a key and merged into its target.

The stream's checkpoint is the offset log. A batch that runs again after a failure applies the same last
changes once more, which leaves the target as it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from meldframe.operators.merge import cdf_merge


def read_change_stream(spark: SparkSession, path: str, schema: T.StructType, *, format: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """The change files that arrive in a folder, as a stream."""
    reader = spark.readStream.format(format).schema(schema)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).load(path)


def merge_stream(changes: DataFrame, target: str, pks: Sequence[str], checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Starts a query that merges the changes into ``target``: all there are now, or for as long as it runs."""
    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: cdf_merge(target, batch, pks))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
