"""Sampled betweenness against the exact one."""

import random

from pyspark.sql import functions as F

from tests.test_engine import brute_betweenness
from veridica.operators import graph


def test_sampled_betweenness_is_within_its_bound(spark):
    rng = random.Random(8)
    pairs = {(f"n{rng.randrange(i)}", f"n{i}") for i in range(1, 200)} | {tuple(sorted((f"n{rng.randrange(200)}", f"n{rng.randrange(200)}"))) for _ in range(700)}
    df = spark.createDataFrame([(u, v, 1.0) for u, v in sorted(pairs) if u != v], "u string, v string, w double").dropDuplicates(["u", "v"])
    exact = graph.betweenness(df)
    rough = graph.sampled_betweenness(df, epsilon=0.5, first=100)
    joined = exact.join(rough.withColumnRenamed("score", "estimate"), "id")
    worst, bound, n = joined.agg(F.max(F.abs(F.col("score") - F.col("estimate")) - F.col("bound")), F.max("bound"), F.count("*")).first()
    assert n == 200 and worst <= 0 < bound <= 0.5
    full = graph.sampled_betweenness(df, epsilon=0.001, first=400).withColumnRenamed("score", "estimate")
    off, bound = exact.join(full, "id").agg(F.max(F.abs(F.col("score") - F.col("estimate"))), F.max("bound")).first()
    assert off < 1e-9 and bound == 0


def test_betweenness_of_a_path(spark):
    df = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)], "u string, v string, w double")
    assert {r.id: round(r.score, 6) for r in graph.betweenness(df).collect()} == {"a": 0, "b": 0.666667, "c": 0.666667, "d": 0}
    assert {r.score for r in graph.sampled_betweenness(df.where("u = 'a'")).collect()} == {0.0}


def test_small_pieces_are_one_block(spark, monkeypatch):
    df = spark.createDataFrame([(f"{k}a", f"{k}b", 1.0) for k in range(40)] + [(f"{k}b", f"{k}c", 1.0) for k in range(40)], "u string, v string, w double")
    blocks, plain = [], graph._dependencies
    monkeypatch.setattr(graph, "_dependencies", lambda *given: (blocks.append(1), plain(*given))[1])
    got = {r.id: round(r.score * 119 * 118, 6) for r in graph.betweenness(df, block=10).collect()}
    assert got == {f"{k}{x}": 2.0 * (x == "b") for k in range(40) for x in "abc"} and len(blocks) == 1


def test_pairs_of_source_and_node_are_no_rows(spark, monkeypatch):
    """Shares of few seeds, small components together and large ones alone, a few seeds at once."""
    rng = random.Random(2)
    pairs = {tuple(sorted(rng.sample(range(k, k + 12), 2))) for k in (0, 20, 40) for _ in range(16)} | {(100, 101), (200, 201), (201, 202)} | {(300 + i, 301 + i) for i in range(40)} | {(300, 310), (305, 333)}
    df = spark.createDataFrame([(f"n{u}", f"n{v}", 1.0) for u, v in sorted(pairs)], "u string, v string, w double")
    want = brute_betweenness([(f"n{u}", f"n{v}", 1.0) for u, v in pairs])
    plans, plain = [], graph.settle
    for small, together, work, state in ((1000, 20_000, 10_000_000, 1_000_000), (5, 2, 1, 30), (30, 10, 1000, 1)):
        for name, value in (("SMALL", small), ("TOGETHER", together), ("WORK", work), ("STATE", state)):
            monkeypatch.setattr(graph, name, value)
        got = {r.id: r.score for r in graph.betweenness(df, block=7).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    monkeypatch.setattr(graph, "settle", lambda d, *more: (plans.append(d.columns), plain(d, *more))[1])
    graph.betweenness(df)
    assert not any({"seed", "id"} <= set(c) for c in plans)
