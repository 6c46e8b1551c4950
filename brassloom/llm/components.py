"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brassloom.llm.common import discard, save


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (a, b: long) to (node, label): the smallest node reachable from each node that has an edge.

    In every round each node goes to its smallest neighbour's smallest neighbour, and the graph is contracted:
    edges become edges between the nodes they went to, equal ones and loops go. Stars vanish in a round and chains
    shorten fast, so later rounds are small. Rounds are written tables; a node with very many neighbours is reduced
    by partial minima before the shuffle, and only whether edges are left comes to the driver. A round's tables are
    deleted once the next one has been written.
    """
    left = save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    labels = None
    while True:
        both = left.union(left.select("b", "a"))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label"))
        once = save(step, f"{name}-step")
        up = once.select(F.col("node").alias("n"), F.col("label").alias("l"))
        step = save(once.join(up, F.col("label") == F.col("n")).select("node", F.col("l").alias("label")), f"{name}-step")
        discard(once)
        before, of = labels, None
        if labels is None:
            labels = step
        else:
            to = step.select(F.col("node").alias("n"), F.col("label").alias("l"))
            labels = save(labels.join(to, F.col("label") == F.col("n"), "left").select("node", F.coalesce("l", "label").alias("label")), f"{name}-labels")
            of = step
        discard(before)
        one, other = step.toDF("a", "a_"), step.toDF("b", "b_")
        moved = left.join(one, "a").join(other, "b").where("a_ <> b_").select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b"))
        past, left = left, save(moved.distinct(), f"{name}-edges")
        discard(past, of)
        if not left.limit(1).count():
            discard(left)
            return labels
