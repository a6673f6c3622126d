"""Merging entities and undoing it, in batches.

A state is a dict of tables: entities (id, type, name, ...), aliases (id, alias), properties (id, key, value),
relationships (id, source_id, target_id, ...), evidence (evidence_id, entity_id, ...) and annotations
(annotation_id, entity_id, ...). What a merge touches is kept in its log as it was. Both merge() and undo() fold those old rows
under the merges that then hold, so that an undone merge leaves nothing behind, in any order of undoing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridica.operators import graph
from veridica.operators.frames import settle

#: Key of each table, and its columns that name entities.
CHILDREN = {"relationships": ("id", ("source_id", "target_id")), "evidence": ("evidence_id", ("entity_id",)), "annotations": ("annotation_id", ("entity_id",))}


def resolve(pairs: DataFrame, ents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((kept, merged) after chains, refused pairs with their reason) of pairs (kept, merged).

    Pairs that share an entity are one group. It is kept under the entity that no pair merges, the least if there are
    several, or under its least entity if they go in a circle. An entity is not merged with itself, with one of another
    type, or with one that is unknown.
    """
    kind = lambda c: ents.select(F.col("id").alias(c), F.col("type").alias(f"{c}_type"))
    reason = F.when(F.col("kept") == F.col("merged"), "same entity").when(F.col("kept_type").isNull() | F.col("merged_type").isNull(), "unknown entity").when(F.col("kept_type") != F.col("merged_type"), "different type")
    judged = settle(pairs.select("kept", "merged").distinct().join(kind("kept"), "kept", "left").join(kind("merged"), "merged", "left").select("kept", "merged", reason.alias("reason")))
    taken = judged.where("reason is null")
    group = graph.components(taken.select(F.col("kept").alias("u"), F.col("merged").alias("v"), F.lit(1.0).alias("w")))
    root = group.join(taken.select(F.col("merged").alias("id")), "id", "left_anti").groupBy("component").agg(F.min("id").alias("root"))
    kept = group.join(root, "component", "left").select(F.coalesce("root", "component").alias("kept"), F.col("id").alias("merged"))
    return settle(kept.where("kept <> merged")), judged.where("reason is not null")


def _to(table: DataFrame, column: str, merges: DataFrame) -> DataFrame:
    """table with `column` changed from merged entities to those that are kept; _was holds the old value."""
    moves = merges.select(F.col("merged").alias("_was"), F.col("kept").alias("_to"))
    moved = table.withColumn("_was", F.col(column)).join(moves, "_was", "left")
    return moved.withColumn(column, F.coalesce("_to", column)).drop("_to")


def _fold(name: str, old: DataFrame, merges: DataFrame, ents: DataFrame) -> DataFrame:
    """Old rows of a table under merges; ents (id, name) has all entities of the groups."""
    if name == "relationships":
        apart = old.withColumn("_apart", F.col("source_id") != F.col("target_id"))
        moved = _to(_to(apart, "source_id", merges).drop("_was"), "target_id", merges).drop("_was")
        return moved.where(~(F.col("_apart") & (F.col("source_id") == F.col("target_id")))).drop("_apart")
    if name == "aliases":
        names = ents.join(merges.select(F.col("merged").alias("id")), "id", "left_semi").select("id", F.col("name").alias("alias"))
        own = ents.select("id", F.col("name").alias("_name"))
        moved = _to(old.select("id", "alias").unionByName(names), "id", merges).where("alias <> ''").join(own, "id", "left")
        return moved.where((F.col("_was") == F.col("id")) | ~F.col("alias").eqNullSafe(F.col("_name"))).select("id", "alias").distinct()
    if name == "properties":
        moved = _to(old, "id", merges)
        return moved.groupBy("id", "key").agg(F.min_by("value", F.struct(F.col("_was") != F.col("id"), "_was")).alias("value"))
    for column in CHILDREN[name][1]:
        old = _to(old, column, merges).drop("_was")
    return old


def _in(column: str, ids: DataFrame) -> tuple[DataFrame, str]:
    return ids.select(F.col("id").alias(column)), column


def _names_one_of(table: DataFrame, columns: tuple[str, ...], key: str, ids: DataFrame) -> DataFrame:
    """Rows any of whose columns is one of ids."""
    hits = None
    for column in columns:
        found = table.join(*_in(column, ids), "left_semi").select(key)
        hits = found if hits is None else hits.unionByName(found)
    return table.join(hits.distinct(), key, "left_semi")


def merge(state: dict[str, DataFrame], pairs: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame], DataFrame]:
    """(state, log, refused pairs) after merging pairs (kept, merged).

    Relationships, evidence and annotations move to the kept entity; relationships between entities of a
    group go, others from a node to itself stay. Names and aliases of the merged become aliases, unless they are the kept name.
    Properties fill in what the kept entity lacks, those of the least merged id first.
    """
    merges, refused = resolve(pairs, state["entities"])
    merged = merges.select(F.col("merged").alias("id"))
    group = settle(merged.unionByName(merges.select(F.col("kept").alias("id"))).distinct())
    log = {"merges": merges.withColumn("undone", F.lit(False)), "entities": settle(state["entities"].join(group, "id", "left_semi"))}
    out = {"entities": state["entities"].join(merged, "id", "left_anti")}
    for name in ("aliases", "properties"):
        log[name] = settle(state[name].join(group, "id", "left_semi"))
        out[name] = state[name].join(group, "id", "left_anti").unionByName(_fold(name, log[name], merges, log["entities"]))
    for name, (key, columns) in CHILDREN.items():
        log[name] = settle(_names_one_of(state[name], columns, key, merged))
        out[name] = state[name].join(log[name].select(key), key, "left_anti").unionByName(_fold(name, log[name], merges, log["entities"]))
    return out, log, refused


def undo(state: dict[str, DataFrame], log: dict[str, DataFrame], which: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame], DataFrame]:
    """(state, log, refused) after undoing the merges of which (merged); one that is undone already, or unknown, is refused.

    Aliases and properties that entities have got since the merge stay.
    """
    asked = which.select("merged").distinct()
    before = log["merges"].where("not undone").select("kept", "merged")
    fine = settle(asked.join(before, "merged", "left_semi"))
    active = settle(before.join(fine, "merged", "left_anti"))
    out = {"entities": state["entities"].unionByName(log["entities"].join(fine.withColumnRenamed("merged", "id"), "id", "left_semi"))}
    group = log["entities"].select("id")
    for name in ("aliases", "properties"):
        inside = state[name].join(group, "id", "left_semi")
        added = inside.join(_fold(name, log[name], before, log["entities"]), inside.columns, "left_anti")
        out[name] = state[name].join(group, "id", "left_anti").unionByName(_fold(name, log[name], active, log["entities"])).unionByName(added).distinct()
    for name, (key, _) in CHILDREN.items():
        out[name] = state[name].join(log[name].select(key), key, "left_anti").unionByName(_fold(name, log[name], active, log["entities"]))
    marked: Column = F.col("undone") | F.col("_now").isNotNull()
    merges = log["merges"].join(fine.withColumn("_now", F.lit(True)), "merged", "left").select("kept", "merged", marked.alias("undone"))
    return out, log | {"merges": merges}, asked.join(fine, "merged", "left_anti")
