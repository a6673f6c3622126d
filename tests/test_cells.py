"""Cells of communities: kinds, clustering and hubs of planted groups."""

from itertools import combinations

from veridica.operators import graph


def test_kinds_and_hubs(spark):
    groups = {
        "hub_and_spoke": [("h2", f"h{i}", 1.0) for i in (0, 1, 3, 4, 5, 6)],
        "clique": [(f"q{a}", f"q{b}", 1.0) for a, b in combinations(range(5), 2)],
        "chain": [("c0", "c1", 1.0), ("c1", "c2", 1.0), ("c2", "c3", 1.0), ("c3", "c4", 1.0)],
        "distributed": [(f"d{i}", f"d{(i + s) % 8}", 1.0) for i in range(8) for s in (1, 2)],
    }
    ids = {kind: sorted({x for u, v, _ in rows for x in (u, v)}) for kind, rows in groups.items()}
    # links between groups, a pair too small for a cell, a node of a group without links inside it
    rows = [e for part in groups.values() for e in part] + [("h0", "q0", 1.0), ("c0", "d0", 1.0), ("p0", "p1", 1.0), ("q1", "far", 1.0)]
    partition = [(x, kind) for kind, part in ids.items() for x in part] + [("p0", "pair"), ("p1", "pair"), ("far", "chain")]
    edges = spark.createDataFrame(rows, "u string, v string, w double")
    got = {r.c: r for r in graph.cells(edges, spark.createDataFrame(partition, "id string, c string")).collect()}
    assert set(got) == set(groups)
    assert {c: r.kind for c, r in got.items()} == {c: c for c in groups}
    assert {c: r.hub for c, r in got.items()} == {"hub_and_spoke": "h2", "clique": None, "chain": None, "distributed": None}
    assert {c: r["size"] for c, r in got.items()} == {"hub_and_spoke": 7, "clique": 5, "chain": 6, "distributed": 8}
    assert got["clique"].clustering == 1 and got["chain"].clustering == 0 and got["distributed"].clustering == 0.5
    assert got["hub_and_spoke"].centralisation == 1 and got["distributed"].centralisation == 0


def test_cells_of_found_communities(spark):
    rows = [(f"{g}{a}", f"{g}{b}", 1.0) for g in "xyz" for a, b in combinations(range(6), 2)] + [("x0", "y0", 0.1), ("y1", "z1", 0.1)]
    edges = spark.createDataFrame(rows, "u string, v string, w double")
    got = graph.cells(edges, graph.communities(edges)).collect()
    assert sorted((r["size"], r.kind, r.density) for r in got) == [(6, "clique", 1.0)] * 3


def test_hierarchy_with_cycles(spark):
    level = lambda rows: {r.id: (r.level, r.reports_to, r.subordinates) for r in graph.hierarchy(spark.createDataFrame(rows, "boss string, report string")).collect()}
    # a long and a short way to z; then z is over b, which closes a cycle
    lines = [("a", "b"), ("b", "c"), ("c", "z"), ("a", "z"), ("a", "a"), ("a", "b")]
    assert level(lines) == {"a": (0, None, 2), "b": (1, "a", 1), "c": (2, "b", 1), "z": (3, "a", 0)}
    assert {k: v[0] for k, v in level([*lines, ("z", "b")]).items()} == {"a": 0, "b": 1, "c": 2, "z": 1}
    # nobody without a boss: the least id is the root
    assert {k: v[0] for k, v in level([("n", "m"), ("m", "o"), ("o", "n")]).items()} == {"m": 0, "o": 1, "n": 2}
    assert level([]) == {}


def test_motifs(spark):
    rows = [("a", "b", 0.5), ("b", "c", 1.0), ("c", "a", 0.25), ("c", "d", 1.0)] + [(x, y, 0.5) for x, y in combinations("wxyz", 2)] + [("z", "w", 0.9)]
    edges = spark.createDataFrame(rows, "u string, v string, w double")
    got = {(tuple(r.members), r["size"], r.kind, r.weight) for r in graph.motifs(edges).collect()}
    assert got == {(("a", "b", "c"), 3, "triangle", 0.5833), (("w", "x", "y", "z"), 4, "clique-4", 0.5667)}
