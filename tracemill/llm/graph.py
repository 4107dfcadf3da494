"""Connected components of a graph of any size, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import Run


def components(edges: DataFrame, run: Run, name: str) -> DataFrame:
    """node and root (the smallest node of its component) of every node of ``edges`` (a, b).

    Each round every node takes the smallest label among itself and its neighbours, then the label of that label.  The
    joins shuffle edges by node and nodes by label: a node with very many neighbours, or a label that very many nodes hold, relies on Spark splitting skewed
    joins (``spark.sql.adaptive.skewJoin``); the minima themselves are taken before rows are shuffled again.  Rounds
    end when no label changes; their number grows with the logarithm of the longest path for stars and chains alike.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = run.land(both, f"{name}-edges")
    labels = run.land(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), f"{name}-0")
    step = 0
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        own = labels.join(near, "node").select("node", F.col("root").alias("before"), F.least("root", "near").alias("root"))
        far = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        moved = own.join(far, "root").select("node", F.least("root", "far").alias("root"), (F.least("root", "far") != F.col("before")).alias("changed"))
        step += 1
        landed = run.land(moved, f"{name}-{step}")
        run.drop(f"{name}-{step - 1}")
        labels = landed.select("node", "root")
        if not landed.where("changed").take(1):
            return labels
