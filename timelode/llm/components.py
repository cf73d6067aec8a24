"""Connected components of undirected edges by least labels with pointer jumping, all in written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelode.llm._common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b): label is the least node of its component. Rows of nodes without edges don't occur.

    In each round a node takes over the least label of its neighbours, and then the label of its label's node.
    Labels only fall, so an unchanged sum of labels tells that they are final.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    total = lambda df: df.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    labels = written(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "cc-labels")
    before = total(labels)
    while before is not None:
        heard = both.join(labels, both.b == labels.node).select(both.a.alias("node"), "label").unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        fallen = written(heard.join(far, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label")), "cc-labels")
        discard(labels)
        labels, after = fallen, total(fallen)
        if after == before:
            break
        before = after
    discard(both)
    return labels


def merged(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """labels (node, label) after more edges (a, b): components of the edges between labels, without loops and repeats, carried over to the nodes.

    What is walked again is a graph of components, not of nodes, so rounds of merging get cheaper as groups grow.
    """
    if labels is None:
        return components(edges)
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"of_{x}"))
    ends = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    moved = components(ends.filter("a <> b").distinct())
    to = moved.select(F.col("node").alias("label"), F.col("label").alias("to"))
    out = labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return written(out.unionByName(moved.join(labels, "node", "left_anti")), "cc-labels")
