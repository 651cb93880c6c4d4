"""Connected components of a link table, by contraction.

In every round each node hooks onto the neighbour (or itself) that comes first in a random
order of that round; edges are rewritten to the nodes hooked onto, and those that close on
themselves go. An order by id would contract a chain by one node a round, a random one
shortens it by a constant factor. Links and labels stay in stored tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.storage import stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all nodes of the links (a, b); a component is named by its smallest id."""
    edges = stored(links.select("a", "b").where("a <> b").distinct(), "links")
    labels, turn = None, 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("id"))
        hooks = both.groupBy("a").agg(F.min(order("b")).alias("near"))
        hooks = stored(hooks.select("a", F.least(order("a"), "near")["id"].alias("to")), "hooks")
        if labels is None:
            labels = hooks.select(F.col("a").alias("id"), F.col("to").alias("component"))
        else:
            step = hooks.select(F.col("a").alias("component"), "to")
            labels = labels.join(step, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        labels = stored(labels, "labels")
        first, second = (hooks.select(F.col("a").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b"))
        moved = edges.join(first, "a").join(second, "b").where("a_to <> b_to")
        moved = moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        edges = stored(moved.distinct(), "links")
        turn += 1
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    names = stored(labels.groupBy("component").agg(F.min("id").alias("name")), "component-names")
    return labels.join(names, "component").select("id", F.col("name").alias("component"))
