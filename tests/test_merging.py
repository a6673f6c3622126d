"""Merging in groups and undoing it."""

import pytest

from veridica.operators import merging


@pytest.fixture
def state(spark):
    make = spark.createDataFrame
    return {
        "entities": make([(x, "person" if x < "p" else "company", x.upper()) for x in "abcdefpq"], "id string, type string, name string"),
        "aliases": make([("a", "al"), ("b", "al"), ("b", "A"), ("c", "ce"), ("f", "x")], "id string, alias string"),
        "properties": make([("b", "k", "of b"), ("c", "k", "of c"), ("a", "own", "1"), ("c", "own", "2")], "id string, key string, value string"),
        "relationships": make([("r1", "b", "f"), ("r2", "c", "a"), ("r3", "c", "c"), ("r4", "e", "f"), ("r5", "f", None)], "id string, source_id string, target_id string"),
        "evidence": make([("e1", "c"), ("e2", "f"), ("e3", None)], "evidence_id string, entity_id string"),
        "annotations": make([("n1", "b")], "annotation_id string, entity_id string"),
    }


def rows(state):
    return {name: sorted(tuple(r) for r in df.collect() if None not in tuple(r)) for name, df in state.items()}


def test_merge_and_undo(spark, state):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("e", "d"), ("a", "p"), ("a", "zz"), ("f", "f"), ("a", "b")], "kept string, merged string")
    before = rows(state)
    after, log, refused = merging.merge(state, pairs)
    got = rows(after)
    assert sorted(tuple(r) for r in refused.collect()) == [("a", "p", "different type"), ("a", "zz", "unknown entity"), ("f", "f", "same entity")]
    assert [r[0] for r in got["entities"]] == ["a", "d", "f", "p", "q"]
    assert got["aliases"] == [("a", "B"), ("a", "C"), ("a", "al"), ("a", "ce"), ("d", "E"), ("f", "x")]
    assert got["properties"] == [("a", "k", "of b"), ("a", "own", "1")]
    assert got["relationships"] == [("r1", "a", "f"), ("r3", "a", "a"), ("r4", "d", "f")]
    assert after["relationships"].count() == 4 and after["evidence"].count() == 3  # those without an end stay
    assert got["evidence"] == [("e1", "a"), ("e2", "f")] and got["annotations"] == [("n1", "a")]

    after["aliases"] = after["aliases"].unionByName(spark.createDataFrame([("a", "later")], "id string, alias string"))
    part, log, refused = merging.undo(after, log, spark.createDataFrame([("c",), ("q",)], "merged string"))
    got = rows(part)
    assert [r.merged for r in refused.collect()] == ["q"]
    assert got["aliases"] == [("a", "B"), ("a", "al"), ("a", "later"), ("c", "ce"), ("d", "E"), ("f", "x")]
    assert got["properties"] == [("a", "k", "of b"), ("a", "own", "1"), ("c", "k", "of c"), ("c", "own", "2")]
    assert got["relationships"] == [("r1", "a", "f"), ("r2", "c", "a"), ("r3", "c", "c"), ("r4", "d", "f")]

    whole, log, refused = merging.undo(part, log, spark.createDataFrame([("b",), ("c",), ("e",)], "merged string"))
    assert [r.merged for r in refused.collect()] == ["c"] and log["merges"].where("not undone").count() == 0
    before["aliases"] = sorted([*before["aliases"], ("a", "later")])
    assert rows(whole) == before
