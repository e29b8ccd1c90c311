"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import stage, staging


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, label): for every node of an edge the smallest node that it reaches.

    Each round lets every vertex adopt its smallest neighbour, jumps pointers, and contracts the edges. A vertex
    that is not a local minimum disappears in its round, so rounds grow as the logarithm of the graph. Nothing is
    gathered by group: the only aggregates are minima. Null ends and loops are ignored; no edges give no rows.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    with staging(edges.sparkSession):
        pairs = stage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        labels = pairs.select(F.col("a").alias("node"), F.col("b").alias("label")).where("false")
        first = True
        while not pairs.isEmpty():
            both = pairs.select("a", "b").unionAll(pairs.select(F.col("b"), F.col("a")))
            hop = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p"))
            hop = stage(hop, "hop")
            for _ in range(2):
                up = hop.select(F.col("v").alias("p"), F.col("p").alias("pp"))
                hop = hop.join(up, "p").select("v", F.col("pp").alias("p"))
            hop = stage(hop, "hop")
            one, two = hop.select(F.col("v").alias("a"), F.col("p").alias("pa")), hop.select(F.col("v").alias("b"), F.col("p").alias("pb"))
            moved = pairs.join(one, "a").join(two, "b").where("pa <> pb")
            pairs = stage(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
            if first:
                labels, first = hop.select(F.col("v").alias("node"), F.col("p").alias("label")), False
            else:
                next_label = hop.select(F.col("v").alias("label"), F.col("p").alias("to"))
                labels = stage(labels.join(next_label, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        return stage(labels, "components", keep=True)
