"""Groupings whose tasks hold a bounded number of rows."""

from pyspark.sql import functions as F

from veridica.operators import entities as en
from veridica.operators import frames, graph


def test_parts_grow_with_the_rows(spark):
    parts = lambda n, rows: frames.dealt(spark.range(n), "id", rows=rows).rdd.getNumPartitions()
    assert parts(1000, 100) == 10 and parts(1001, 100) == 11 and parts(10, 100) == 4 and parts(0, 100) == 4


def test_lineage_deals_its_evidence(spark):
    ents = spark.createDataFrame([("a", "person", True), ("b", "person", False), ("d", "document", False)], "id string, type string, is_ai_generated boolean")
    rels = spark.createDataFrame([("r", "ABOUT", "d", "a", 1.0, None, None)], "id string, type string, source_id string, target_id string, confidence_score double, start_date date, end_date date")
    evidence = spark.range(90).select(F.lit("a").alias("entity_id"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"), F.when(F.col("id") < 30, "verified").alias("verification_status"))
    out = en.lineage(ents, rels, evidence)
    assert {r.id: tuple(r)[1:] for r in out.collect()} == {"a": ("AI-extracted", 90, 30, 7, 1), "b": ("analyst-entered", 0, 0, 0, 0), "d": ("analyst-entered", 0, 0, 0, 0)}
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_view_makes_relationships_once(spark, monkeypatch):
    """The relationships are written once; entities and pairs are dealt by their number."""
    written = []
    monkeypatch.setattr(graph, "settle", lambda df, *more: written.append(df) or frames.settle(df, *more))
    ents = spark.createDataFrame([(i, i.upper(), "person", 1.0) for i in "abc"], "id string, name string, type string, confidence_score double")
    rows = [("1", "X", "a", "b", 0.5), ("2", "X", "b", "a", 0.7), ("3", "Y", "a", "c", 0.9), ("4", "X", "a", "z", 0.9), ("5", "X", "c", "c", 0.9), ("6", "X", "c", "b", 0.2)]
    nodes, edges = graph.view(spark.createDataFrame(rows, "id string, type string, source_id string, target_id string, confidence_score double"), ents, rel_types=["X"], min_confidence=0.4)
    assert {tuple(r) for r in edges.collect()} == {("a", "b", 0.7)} and {r.id for r in nodes.collect()} == {"a", "b", "c"}
    assert len(written) == 1 and edges._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 2
