"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the long pairs (a, b): root is the smallest node that it reaches.

    Each round takes the smallest root among a node's neighbours and then the root's own root, so stars end after two rounds
    and a chain after some log2 of its length. Rounds are written out, nothing is collected but whether anything changed.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jump = lower.select(F.col("node").alias("mid"), F.col("mid").alias("root"))
        moved = stored(lower.join(jump, "mid").select("node", "root", (F.col("root") != F.col("old")).alias("changed")))
        labels = moved.select("node", "root")
        if moved.where("changed").isEmpty():
            return labels
