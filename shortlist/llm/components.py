"""Connected components of an edge table, by repeated contraction.

In each round every node takes the neighbour (or itself) with the smallest hash as parent and
the edges move to the parents; loops go.  Hash order makes long sorted chains shrink by a
constant share per round.  All tables of a round lie in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (one node of its component) for every node of ``edges`` (a, b longs).

    Rows with a null end and loops are left out; an empty table gives an empty one.
    """
    edges = materialize(_normal(edges), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("hash"), F.col(c).alias("node"))
        parents = materialize(
            both.groupBy(F.col("a").alias("node"))
            .agg(F.min(rank("b")).alias("m"))
            .select("node", F.least(F.col("m"), rank("node"))["node"].alias("parent")),
            "parents",
        )
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("label"))
        else:
            step = parents.toDF("old", "new")
            labels = labels.join(step, labels.label == step.old, "left").select(
                "node", F.coalesce("new", "label").alias("label")
            )
        labels = materialize(labels, "labels")
        moved = (
            edges.join(parents.toDF("a", "pa"), "a")
            .join(parents.toDF("b", "pb"), "b")
            .select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        )
        edges = materialize(_normal(moved), "edges")
        if not edges.take(1):
            return labels


def _normal(edges: DataFrame) -> DataFrame:
    return (
        edges.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
