"""Dashboard sections and provenance as rows, on a small graph."""

from veridica.operators import entities as en


def graph(spark):
    ents = spark.createDataFrame([("a", "Ann", "person", True), ("c", "Acme", "company", False), ("d", "Memo", "document", False), ("e", "Gala", "event", False)], "id string, name string, type string, is_ai_generated boolean")
    rows = [("r1", "WORKS_FOR", "a", "c", 0.5), ("r2", "ABOUT", "d", "a", 1.0), ("r3", "CITES", "a", "d", 1.0), ("r4", "KNOWS", "a", "a", 0.1), ("r5", "KNOWS", "a", "gone", 0.1), ("r6", "ATTENDED", "a", "e", 0.2)]
    rels = spark.createDataFrame(rows, "id string, type string, source_id string, target_id string, confidence_score double").selectExpr("*", "id = 'r1' as is_ai_generated", "cast(null as date) as start_date", "cast(null as date) as end_date")
    rows = [("v1", "a", "One", "Times", "supports", "verified"), ("v2", "a", "Two", "Times", "contradicts", "unverified"), ("v3", "a", "Three", "Memo", "supports", "verified"), ("v4", "a", "Four", "", "neutral", None), ("v5", "gone", "Five", "Times", "supports", "verified"), ("v6", None, "Six", "Times", "supports", "verified")]
    return ents, rels, spark.createDataFrame(rows, "evidence_id string, entity_id string, title string, source string, stance string, verification_status string")


def test_dashboard(spark):
    ents, rels, evidence = graph(spark)
    rows = en.dashboard(rels, ents, evidence).collect()
    of = lambda id_, section: sorted((r.ref or "", r.title or "", r.rel_id or "", r.n) for r in rows if r.id == id_ and r.section == section)
    assert of("a", "connections") == [("c", "Acme", "r1", None), ("d", "Memo", "r2", None), ("d", "Memo", "r3", None), ("e", "Gala", "r6", None)]
    assert of("a", "organizations") == [("c", "Acme", "r1", None)] == of("a", "related") and of("a", "events") == [("e", "Gala", "r6", None)]
    # the source Memo is a document already, Times is added once
    assert of("a", "documents") == [("", "Times", "", None), ("d", "Memo", "r2", None), ("d", "Memo", "r3", None)]
    assert [of("a", f"total_{x}")[0][3] for x in ("connections", "evidence", "documents")] == [6, 4, 3]
    assert of("c", "members") == [("a", "Ann", "r1", None)] and {(r.outgoing, r.is_ai_generated, r.confidence) for r in rows if r.section == "members"} == {(False, True, 0.5)}


def test_provenance(spark):
    ents, rels, evidence = graph(spark)
    rows = [tuple(r) for r in en.provenance(ents, rels, evidence).where("id = 'a'").collect()]
    want = [("a", "entity", "a", None, "Ann", True, None), ("a", "summary", None, None, "Ann is AI-extracted; backed by 4 evidence item(s) (2 verified) from 2 source(s).", None, None)]
    want += [("a", "evidence", f"v{i}", None, t, None, v) for i, t, v in ((1, "One", True), (2, "Two", False), (3, "Three", True), (4, "Four", False))]
    want += [("a", "document", n, None, t, None, None) for n, t in (("doc:Times", "Times"), ("doc:Memo", "Memo"), ("d", "Memo"))]
    want += [("a", "edge", f"v{i}", "a", s, None, None) for i, s in ((1, "supports"), (2, "contradicts"), (3, "supports"), (4, "neutral"))]
    want += [("a", "edge", n, t, r, None, None) for n, t, r in (("doc:Times", "v1", "source_of"), ("doc:Times", "v2", "source_of"), ("doc:Memo", "v3", "source_of"), ("d", "a", "mentions"))]
    key = lambda r: tuple(map(str, r))
    assert sorted(rows, key=key) == sorted(want, key=key)
    numbered = en.provenance(ents, rels, evidence.drop("evidence_id")).where("item = 'evidence'").collect()
    assert sorted((r.node, r.label) for r in numbered) == [("a/E1", "Four"), ("a/E2", "One"), ("a/E3", "Three"), ("a/E4", "Two")]
