"""Connected components of a link table, by contraction in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestra.llm.common import Scratch


def components(links: DataFrame) -> DataFrame:
    """id and label (the least id of its component) for every id that occurs in links(a, b).

    Each round hooks every vertex to its least neighbour and contracts the graph, so at least half of the
    vertices that still have neighbours go; the rounds' tables are written to the shared folder and removed at the end. Nothing
    is collected but the number of edges left.
    """
    scratch = Scratch(links.sparkSession)
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    edges = scratch.settled(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = None
    while True:
        hook = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hook = scratch.settled(hook)
        if labels is None:
            labels = hook.select(F.col("u").alias("id"), F.col("m").alias("label"))
        else:
            moved = labels.join(hook, labels.label == hook.u, "left")
            labels = moved.select("id", F.coalesce("m", "label").alias("label"))
        labels = scratch.settled(labels)
        left = edges.join(hook, "u").select(F.col("m").alias("u"), "v")
        left = left.join(hook.select(F.col("u").alias("v"), F.col("m").alias("w")), "v").select("u", F.col("w").alias("v"))
        edges = scratch.settled(left.where("u <> v").distinct())
        if edges.isEmpty():
            return scratch.done(labels)
