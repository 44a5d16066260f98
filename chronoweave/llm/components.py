"""One group identifier for all records linked directly or indirectly.

Minimum labels travel along edges: every vertex hooks onto its smallest neighbour, pointer jumping then
shortens the paths of hooks until no label changes, and the edges are redrawn between the labels found.
Edges inside a group vanish, so the graph shrinks from round to round and a chain of n records takes
O(log n) rounds. Each step is written to the shared folder before the next one reads it. A vertex with a
third of all edges only meets a map-side minimum and equi-joins, never a list of its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.plans.scratch import Scratch


def _jump(hooks: DataFrame, scratch: Scratch) -> DataFrame:
    """Replace each hook by the end of its path: labels of labels, until none changes."""
    while True:
        up = hooks.select(F.col("id").alias("label"), F.col("label").alias("next"))
        longer = scratch.save(hooks.select("id", "label").join(up, "label", "left").select("id", F.coalesce("next", "label").alias("label"), (F.col("next") < F.col("label")).alias("moved")))
        scratch.drop(hooks)
        hooks = longer
        if hooks.where("moved").isEmpty():
            return hooks


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``id`` and ``component`` (the smallest id of its group) of every vertex with an edge to another one.

    Edges have no direction. Null ends, loops and repeated edges count for nothing; an edge table without
    edges gives no rows. Ids are compared as they are (strings by code point). Other columns are not read.
    """
    scratch = Scratch(edges.sparkSession, "components")
    a, b = F.col(src), F.col(dst)
    live = scratch.save(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    levels = []
    while not live.isEmpty():
        both = live.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(live.select(F.col("b").alias("id"), F.col("a").alias("other")))
        labels = _jump(scratch.save(both.groupBy("id").agg(F.min("other").alias("other")).select("id", F.least("id", "other").alias("label"))), scratch)
        levels.append(labels)
        at = lambda c, to: labels.select(F.col("id").alias(c), F.col("label").alias(to))
        drawn = live.join(at("a", "la"), "a").join(at("b", "lb"), "b").where("la != lb")
        shrunk = scratch.save(drawn.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
        scratch.drop(live)
        live = shrunk
    if not levels:
        return live.select(F.col("a").alias("id"), F.col("a").alias("component"))
    found = levels[-1].select("id", F.col("label").alias("component"))
    for labels in reversed(levels[:-1]):
        up = found.select(F.col("id").alias("label"), "component")
        found = labels.select("id", "label").join(up, "label", "left").select("id", F.coalesce("component", "label").alias("component"))
    return found
