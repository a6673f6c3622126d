"""Connected components as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridica.llm.common import discard, materialize


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """(id, to): the least of each node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("to"))


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component) of every id in edges (u, v); component is the smallest id reached.

    Each round contracts every node into the least of itself and its neighbours, and what is left
    of the edges goes to the next; the contractions are composed in the end. A round is one
    group-by with partial aggregation and two joins, written to the shared folder; a component is
    never gathered. A round takes every node but local minima away, so that rounds grow with the
    logarithm of a component's size in all but contrived orders of ids. Null ends and self loops
    are ignored.
    """
    now = edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    now = materialize(now.distinct(), "edges")
    rounds = []
    while not now.isEmpty():
        if len(rounds) == max_rounds:
            raise RuntimeError("components did not settle")
        rounds.append(now)
        step = _least_neighbour(now)
        moved = now.join(step.select(F.col("id").alias("u"), F.col("to").alias("a")), "u").join(step.select(F.col("id").alias("v"), F.col("to").alias("b")), "v")
        now = materialize(moved.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    if not rounds:
        return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    component = None
    for own in reversed(rounds):
        step = _least_neighbour(own)
        if component is None:
            component = step.select("id", F.col("to").alias("component"))
        else:
            later = component.select(F.col("id").alias("to"), F.col("component").alias("later"))
            component = step.join(later, "to", "left").select("id", F.coalesce("later", "to").alias("component"))
    settled = materialize(component, "components")
    discard(now, *rounds)
    return settled
