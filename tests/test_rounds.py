"""Work of iterative and repeated steps: results against plain ones, and what is not done again."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from veridica.functions import text
from veridica.operators import governance, graph
from veridica.streaming import streams


def random_edges(spark, n, m, seed):
    rng = random.Random(seed)
    pairs = sorted({tuple(sorted((f"n{rng.randrange(n)}", f"n{rng.randrange(n)}"))) for _ in range(m)})
    rows = [(u, v, rng.randrange(0, 11) / 10) for u, v in pairs if u != v]
    return rows, spark.createDataFrame(rows, "u string, v string, w double")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def parts(rows, without):
    near = defaultdict(set)
    for u, v, _ in rows:
        near[u].add(v)
        near[v].add(u)
    left, sizes = set(near) - {without}, []
    while left:
        todo, size = [left.pop()], 0
        while todo:
            size += 1
            new = near[todo.pop()] & left
            left -= new
            todo += new
        sizes.append(size)
    return len(sizes), max(sizes, default=0)


def test_resilience_contracts_the_graph_once(spark, monkeypatch):
    rows, df = random_edges(spark, 60, 62, 5)
    given, plain = [], graph.components
    monkeypatch.setattr(graph, "components", lambda edges: (given.append(edges.count()), plain(edges))[1])
    got = {r.id: (r.components_after, r.largest_after) for r in graph.resilience(df, 6).collect()}
    assert len(got) == 6 and got == {x: parts(rows, x) for x in got}
    # the graph without the six nodes, then only the edges at those
    assert len(given) == 2 and given[0] < len(rows)
    gone = spark.createDataFrame([("n1",), ("nowhere",)], "id string")
    assert {r.scenario: (r.components, r.largest) for r in graph.without_each(df, gone).collect()} == {x: parts(rows, x) for x in ("n1", "nowhere")}
    pair = spark.createDataFrame([("a", "b", 1.0)], "u string, v string, w double")
    assert {(r.id, r.components_after, r.largest_after) for r in graph.resilience(pair, 2).collect()} == {("a", 1, 1), ("b", 1, 1)}


def test_best_paths_go_on_from_what_grew(spark):
    rows, df = random_edges(spark, 40, 70, 3)
    for kind, join in (("widest", min), ("likely", lambda x, w: x * max(w, 1e-9))):
        want = {"n1": 1.0}
        for _ in range(40):
            for u, v, w in [*rows, *((v, u, w) for u, v, w in rows)]:
                if u in want:
                    want[v] = max(want.get(v, 0.0), join(want[u], w))
        short = {r.id: r.score for r in graph.best_paths(df, "n1", kind, paths=False).collect()}
        assert short.keys() == want.keys() and all(abs(short[x] - want[x]) < 1e-9 for x in want)
        weight = {(u, v): w for a, b, w in rows for u, v in ((a, b), (b, a))}
        for r in graph.best_paths(df, "n1", kind).collect():
            score = 1.0
            for step in zip(r.path, r.path[1:]):
                score = join(score, weight[step])
            assert abs(score - want[r.id]) < 1e-9 and r.hops == len(r.path) - 1 and len(set(r.path)) == len(r.path)
    over = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 1.0)], "u string, v string, w double")
    assert {r.id: r.score for r in graph.best_paths(over, "a", "likely", paths=False).collect()} == {"a": 1.0, "b": 2.0, "c": 2.0}


def test_egos_go_through_a_round_together(spark):
    rows, df = random_edges(spark, 30, 45, 9)
    spark.sparkContext.setJobGroup("egos", "")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.seed: (r.nodes, r.degree_centrality, r.pagerank) for r in graph.ego_influence(df, graph.nodes(df).select(F.col("id").alias("seed"))).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for ego in {x for u, v, _ in rows for x in (u, v)}:
        near = {ego} | {v if u == ego else u for u, v, _ in rows if ego in (u, v)}
        own = [(u, v, max(w, 1e-9)) for u, v, w in rows if u in near or v in near]
        ids = sorted({x for u, v, _ in own for x in (u, v)})
        out = defaultdict(float)
        for u, _, w in own:
            out[u] += w
        x = dict.fromkeys(ids, 1 / len(ids))
        for _ in range(200):
            loose = sum(x[i] for i in ids if i not in out)
            new = {i: (0.15 + 0.85 * loose) / len(ids) for i in ids}
            for u, v, w in own:
                new[v] += 0.85 * w / out[u] * x[u]
            x = new
        assert got[ego][:2] == (len(ids), round((len(near) - 1) / (len(ids) - 1), 4)) and abs(got[ego][2] - x[ego]) < 1e-4
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("egos")) < 30


def test_chains_are_sealed_once_and_in_order(spark):
    rows = [(i, None if i % 5 == 0 else f"a{i % 3}", "update", "t", i % 4, f"2024-01-01 00:00:{59 - i % 60:02d}") for i in range(100)]
    audit = spark.createDataFrame(rows, "id long, actor_id string, action string, target_table string, target_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        sealed = governance.seal(audit, "actor_id")
        checked = governance.verify_chain(sealed, "actor_id")
        assert "InPandas" not in plan(checked)
        assert {r.actor_id: (r.entries, r.valid) for r in checked.collect()} == {f"a{k}": (sum(i % 5 > 0 and i % 3 == k for i in range(100)), True) for k in range(3)}
        ordered = {}
        for r in sorted(sealed.collect(), key=lambda r: (r.ts, r.id)):
            assert r.prev_hash == ordered.get(r.actor_id, "")
            ordered[r.actor_id] = r.entry_hash
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_visits_meet_by_place_and_time(spark):
    rng = random.Random(1)
    rows = [(f"a{rng.randrange(6)}", f"p{rng.randrange(2)}", rng.randrange(0, 20 * 86400) - 5 * 86400) for _ in range(80)] + [("a1", "p1", 0), ("a2", "p1", 2 * 86400), ("a3", "p1", -2 * 86400)]
    visits = spark.createDataFrame(rows, "actor string, place string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    met = streams.colocation(visits, visits, 2)
    assert "bucket" in plan(met)
    want = sorted((x[0], y[0], x[1], x[2], y[2]) for x in rows for y in rows if x[1] == y[1] and x[0] < y[0] and abs(x[2] - y[2]) <= 2 * 86400)
    assert sorted(tuple(r) for r in met.select("a", "b", "place", F.unix_seconds("ts_a"), F.unix_seconds("ts_b")).collect()) == want


def test_texts_are_read_once_by_ingestion(spark):
    docs = spark.createDataFrame([("d1", "Dr. Ann Lee is the director of Acme Holdings. Nothing else."), ("d2", None)], "id string, text string")
    known = spark.createDataFrame([("P1", "ann lee", "person")], "id string, name string, type string")
    found = text.ingest(docs, "id", "text", known)
    assert all("regexp" not in plan(f) and "rlike" not in plan(f).lower() for f in found.values())
    assert [(r.source_id, r.quote[:11]) for r in found["relationships"].collect()] == [("P1", "Ann Lee is ")]
    assert found["entities"].where("known").count() == 1
