"""Concept hierarchy: descendants, ancestors and descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelode.sources.shared import discard, written

#: The round from which pairs are counted, as cycles call for: paths are longer than 16 links by then.
COUNTED_FROM = 5


def closure(edges: DataFrame, roots: DataFrame | list[str]) -> DataFrame:
    """(root, code): each root with itself and all its descendants.

    Paths double: with all pairs fewer than 2^k steps apart and the links of exactly 2^k steps, one join gives
    the pairs fewer than 2^(k+1) steps apart and another the longer links, so a hierarchy of n levels takes
    log n rounds. A round's pairs and links are written; nothing stays cached. It ends when no longer links
    are left or, as cycles always have some, when a late round adds no pair. An unknown root is its own only
    descendant.
    """
    spark = edges.sparkSession
    if isinstance(roots, list):
        roots = spark.createDataFrame([(r,) for r in roots], "root string")
    pairs = roots.select("root", F.col("root").alias("code")).distinct()
    links = edges.select("parent", "child").filter("parent IS NOT NULL AND child IS NOT NULL AND parent <> child").distinct()
    known, stored, rounds = None, False, 0
    while True:
        further = pairs.join(links, pairs.code == links.parent).select("root", F.col("child").alias("code"))
        longer = written(pairs.unionByName(further).distinct(), "closure")
        rounds += 1
        # Hierarchies without cycles mostly run out of links before pairs are worth counting.
        n = longer.count() if rounds >= COUNTED_FROM else None
        if n is not None and n == known:
            discard(longer)
            return pairs
        if rounds > 1:
            discard(pairs)
        pairs, known, before = longer, n, links
        first, second = before.alias("x"), before.alias("y")
        links = written(first.join(second, F.col("x.child") == F.col("y.parent")).select("x.parent", "y.child").distinct(), "links")
        if stored:
            discard(before)
        stored = True
        if links.isEmpty():
            return pairs


def ancestors(edges: DataFrame, codes: DataFrame) -> DataFrame:
    """(code, ancestor): each code with itself and all that stand above it."""
    up = closure(edges.select(F.col("child").alias("parent"), F.col("parent").alias("child")), codes.select(F.col("code").alias("root")))
    return up.select(F.col("root").alias("code"), F.col("code").alias("ancestor"))


def code_set(edges: DataFrame, roots: list[str], expand: bool = True) -> DataFrame:
    """(code): the roots, with their descendants if expand."""
    if not expand:
        return edges.sparkSession.createDataFrame([(r,) for r in roots], "code string")
    return closure(edges, roots).select("code").distinct()


def described(codes: DataFrame, concepts: DataFrame) -> DataFrame:
    """codes with descriptions; null where there is none."""
    return codes.join(concepts.select("code", "description"), "code", "left")
