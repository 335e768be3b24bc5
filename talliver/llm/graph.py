"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talliver.llm.common import cut, discard


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b); comp is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours, then
    replaces a label by its own label, so long chains shrink by a power of
    two.  Every round is written to the shared folder; the loop ends when no
    label changes.  Self-loops are allowed, null ends are ignored.
    """
    both = edges.select("a", "b").dropna().distinct()
    both = cut(both.union(both.select("b", "a")).distinct().toDF("a", "b"), "cc_edges")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "cc_labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.select("node", "comp").join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("comp", "m").alias("next"), F.col("comp").alias("old"))
        step = cut(step, "cc_step")
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("root"))
        new = cut(step.join(jump, "next").select("node", F.col("root").alias("comp"), (F.col("root") != F.col("old")).alias("moved")), "cc_labels")
        discard(step, labels)
        labels = new
        if not new.filter("moved").take(1):
            discard(both)
            return labels.select("node", "comp")
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
