"""Keyed tables and the projection under batches of changes."""

import os

import pytest

from veridica.sources import tables

SCHEMA = "k string, v int, tags array<string>"


def state(spark, table):
    return {(r.k, r.v, tuple(r.tags or ())) for r in tables.read(spark, table, SCHEMA).collect()}


def files(table):
    return {os.path.join(d, f) for d, _, names in os.walk(table) for f in names if "bucket_of_" in d and f.endswith(".parquet")}


def test_batches(spark, tmp_path):
    table = str(tmp_path / "t")
    put = lambda rows, n: tables.upsert(spark.createDataFrame(rows, SCHEMA + ", seq int, deleted boolean"), table, "k", "seq", n, 16)
    assert state(spark, table) == set()
    put([(f"k{i}", i, ["a"], 0, False) for i in range(40)] + [("k0", 7, None, 1, None), (None, 1, None, 9, False), ("k1", 9, None, 0, True)], 3)
    want = {(f"k{i}", i, ("a",)) for i in range(2, 40)} | {("k0", 7, ())}
    assert state(spark, table) == want
    before = files(table)
    change = [("k5", 50, [], 0, False), ("new", 1, ["b"], 0, False), ("k6", None, None, 0, True), ("absent", None, None, 0, True)]
    for _ in range(2):
        put(change, 4)
        want2 = want - {("k5", 5, ("a",)), ("k6", 6, ("a",))} | {("k5", 50, ()), ("new", 1, ("b",))}
        assert state(spark, table) == want2
        kept = before & files(table)
        assert len({os.path.dirname(f) for f in before} - {os.path.dirname(f) for f in kept}) <= 4 and len(kept) >= len(before) - 4
    with pytest.raises(ValueError):
        put(change, 3)
    # all rows go, then some come back; an empty batch changes nothing
    put([(k, None, None, 0, True) for k, _, _ in want2], 5)
    assert state(spark, table) == set() and not files(table)
    put([], 6)
    put([("k5", 1, None, 0, False)], 7)
    assert state(spark, table) == {("k5", 1, ())}


def test_batch_after_a_crash(spark, tmp_path):
    """A bucket lost while being put in place comes back when the batch is given again."""
    table = str(tmp_path / "t")
    rows = spark.createDataFrame([(f"k{i}", i, None, 0, False) for i in range(20)], SCHEMA + ", seq int, deleted boolean")
    tables.upsert(rows, table, "k", "seq", 0, 4)
    whole = state(spark, table)
    for f in list(files(table))[:2]:
        os.remove(f)
    assert state(spark, table) < whole
    tables.upsert(rows, table, "k", "seq", 0, 4)
    assert state(spark, table) == whole


def test_projection(spark, tmp_path):
    path = str(tmp_path)
    ents = lambda rows: spark.createDataFrame(rows, "id string, type string, name string, confidence_score double, seq int, deleted boolean")
    rels = lambda rows: spark.createDataFrame(rows, "id string, type string, source_id string, target_id string, confidence_score double, seq int, deleted boolean")
    first = [(i, "shell_company", i.upper(), 0.5, 1, False) for i in "abcd"]
    tables.project(spark, path, ents(first), rels([("ab", "OWNS", "a", "b", 0.5, 1, False), ("bc", "OWNS", "b", "c", 0.5, 1, False), ("cd", "OWNS", "c", "d", 0.5, 1, False), ("ax", "OWNS", "a", "x", 0.5, 1, False)]), 0, 8)
    nodes = {(r.id, r.label, r.name) for r in tables.read(spark, f"{path}/nodes", tables.NODES).collect()}
    assert nodes == {(i, "ShellCompany", i.upper()) for i in "abcd"}
    edges = lambda: {(r.id, r.confidence_score) for r in tables.read(spark, f"{path}/edges", tables.EDGES).collect()}
    assert edges() == {("ab", 0.5), ("bc", 0.5), ("cd", 0.5)}
    for _ in range(2):
        tables.project(spark, path, ents([("b", None, None, None, 2, True), ("x", "person", "X", 1.0, 2, False)]), rels([("ax", "OWNS", "a", "x", 0.9, 2, False), ("bd", "OWNS", "b", "d", 1.0, 2, False), ("cd", "OWNS", "c", "d", 0.7, 2, False), ("none", None, None, None, None, 2, True)]), 1, 8)
        assert edges() == {("ax", 0.9), ("cd", 0.7)}


def test_changes_are_sorted_once(spark, tmp_path, monkeypatch):
    """Changes are dealt by key, then sorted: not on both sides of the shuffle."""
    settle, plans = tables.settle, []

    def seen(df, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df, *more)

    monkeypatch.setattr(tables, "settle", seen)
    rows = spark.createDataFrame([(f"k{i % 5}", i, [str(i)], i, False) for i in range(20)], SCHEMA + ", seq int, deleted boolean")
    tables.upsert(rows, str(tmp_path / "t"), "k", "seq", 0, 4)
    assert plans[0].count("Sort [") == 1 and plans[0].count("Exchange ") == 1
    assert state(spark, str(tmp_path / "t")) == {(f"k{i % 5}", i, (str(i),)) for i in range(15, 20)}
