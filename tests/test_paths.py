"""The k shortest paths against all simple paths."""

import random

import pytest

from veridica.operators import graph


def every_path(edges, source, target):
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    out, open_ = [], [[source]] if source in near else []
    while open_:
        path = open_.pop()
        if path[-1] == target:
            out.append(path)
            continue
        open_ += [[*path, v] for v in near[path[-1]] if v not in path]
    return sorted((len(p) - 1, ">".join(p)) for p in out)


@pytest.mark.parametrize(("n", "m", "k", "seed"), [(9, 14, 6, 1), (7, 6, 40, 3)])
def test_k_shortest_paths(spark, n, m, k, seed):
    rng = random.Random(seed)
    ids = [f"P{i}" for i in [*range(1, n), 11]]  # P1 is a prefix of P11
    pairs = sorted({tuple(sorted(rng.sample(ids, 2))) for _ in range(m)})
    df = spark.createDataFrame([(u, v, 0.5) for u, v in pairs], "u string, v string, w double")
    used = sorted({x for p in pairs for x in p})
    for source, target in ((used[0], used[-1]), (used[1], used[1])):
        want = every_path(pairs, source, target)
        got = [tuple(r) for r in graph.shortest_paths(df, source, target, k).orderBy("hops", "path").collect()]
        assert got == want[:k]
    if want := every_path(pairs, used[0], used[-1]):
        short = want[0][0] + 1
        got = [tuple(r) for r in graph.shortest_paths(df, used[0], used[-1], k, max_length=short).orderBy("hops", "path").collect()]
        assert got == [w for w in want if w[0] <= short][:k]


def test_paths_between_strangers(spark):
    df = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 1.0)], "u string, v string, w double")
    assert graph.shortest_paths(df, "a", "d", 3).count() == 0 and graph.shortest_paths(df, "x", "a", 3).count() == 0 and graph.shortest_paths(df, "x", "x", 3).count() == 0
