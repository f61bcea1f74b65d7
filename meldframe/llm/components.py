"""Connected components by alternating large-star and small-star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meldframe.llm.shared import delete_scratch, kept_table


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of ``edges`` (two long columns): root is its component's smallest node.

    Each round points every node to the smallest node it knows of, in O(log^2 n) rounds on any graph. A
    round's edges are a table in the shared folder, so lineage stays short and a lost executor costs one
    round. Minima are combined before the shuffle and written, so that Spark can split the join's rows of a hub.
    Edges with a NULL end are ignored; a self-loop gives its node as its own root.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    now, path = _keep(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_path = _keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v >= u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, large_path = _keep(large)
        delete_scratch(spark, least_path)
        least, least_path = _keep(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        following, following_path = _keep(small.distinct())
        for done in (path, large_path, least_path):
            delete_scratch(spark, done)
        now, path = following, following_path
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            every = now.union(now.select(F.col("v").alias("u"), "v"))
            return every.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        mark = seen


def _keep(df: DataFrame) -> tuple[DataFrame, str]:
    return kept_table(df, "edges")
