"""Connected components of links between long keys, by label propagation and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackline.llm.staging import removed, staged


def components(links: DataFrame) -> DataFrame:
    """(key, component) of each key in ``links`` (a, b); component is the least key reachable.

    Labels go along links and are combined before the shuffle, so no task holds all links of a
    key. Each round also follows every label to its own label, so rounds grow with the logarithm
    of the longest path. Each round is a table in the shared folder.
    """
    spark = links.sparkSession
    edges = staged(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = staged(edges.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        sent = edges.join(labels, edges["a"] == labels["key"]).select(F.col("b").alias("key"), "component")
        least = sent.unionByName(labels).groupBy("key").agg(F.min("component").alias("component"))
        to = labels.select(F.col("key").alias("component"), F.col("component").alias("next"))
        found = staged(least.join(to, "component").select("key", F.least("component", "next").alias("component")), "labels")
        moved = found.join(labels.withColumnRenamed("component", "before"), "key").where("component <> before").limit(1).count()
        removed(spark, labels)
        labels = found
        if not moved:
            removed(spark, edges)
            return labels
