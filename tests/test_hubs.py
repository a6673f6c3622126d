"""Relationships of a hub pass by hashed entities; they are not sorted in one task."""

from veridica.operators import entities as en
from veridica.operators import graph, identity


def hub(spark):
    ents = spark.createDataFrame([(f"C{i}", "n", "person", 0.5) for i in range(50)] + [("N0", "n", "location", 0.5), ("S1", "n", "company", 0.5)], "id string, name string, type string, confidence_score double")
    rows = [(f"r{i}", "LOCATED_IN", f"C{i}", "N0", 0.9) for i in range(50)] + [("m", "MANAGES", "S1", "C1", 2.0), ("l", "KNOWS", "C2", "C2", 0.1), ("x", "KNOWS", "C3", "gone", 0.7), ("y", "KNOWS", None, "C3", 0.7)]
    return ents, spark.createDataFrame(rows, "id string, type string, source_id string, target_id string, confidence_score double").selectExpr("*", "cast(null as date) as start_date", "cast(null as date) as end_date")


def unsorted(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan


def test_sections(spark):
    ents, rels = hub(spark)
    df = en.sections(rels, ents)
    got = {(r.id, r.section): r.n for r in df.collect()}
    assert got["N0", "connections"] == got["N0", "related"] == 50 and got["C1", "locations"] == 1 and got["C1", "connections"] == 2
    assert ("gone", "connections") in got and unsorted(df)


def test_edge_problems(spark):
    ents, rels = hub(spark)
    df = identity.edge_problems(rels, ents)
    assert {r.problem: r.n for r in df.collect()} == {"self_loop": 1, "unknown_source": 1, "unknown_target": 1, "confidence": 1}
    assert unsorted(df)
