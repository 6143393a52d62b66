"""Connected components of a graph given as an edge table, by least labels and pointer jumping over stored rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import dropped, stored


def components(edges: DataFrame, name: str) -> DataFrame:
    """(v, root) for every vertex of edges (a, b): root is the least vertex that can be reached. Rounds grow with the
    logarithm of the longest path. Each round is a written table, so a lost executor costs one round at most."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), f"{name}-edges")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.min(F.least("a", "b")).alias("root")), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "root"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        step = labels.select("v", "root").join(near, "v").select("v", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        # the label is a vertex too: go on to its label
        new = stored(step.join(labels.select(F.col("v").alias("root"), F.col("root").alias("further")), "root").select("v", F.least("root", "further").alias("root"), "old"), f"{name}-labels")
        dropped(labels)
        if new.where("root != old").isEmpty():
            dropped(both)
            return new.select("v", "root")
        labels = new
