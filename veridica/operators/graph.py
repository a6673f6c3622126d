"""Graph operators on an edge list (u, v, w), undirected unless said, each pair once.

One-pass measures are joins and group-bys. Triangles start at the end of lower degree, so that a
hub's neighbours never meet in one task; measures of a node's pairs of neighbours (Adamic-Adar,
Burt) pair all neighbours of a hub, which AQE's skew join splits. Iterative measures keep their
state as DataFrames, written to the shared folder each round; only scalars reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridica.operators.frames import dealt, drop, parts, runs, settle

#: Betweenness: nodes under which components go together, and of those at once; steps over links of a task, and parts of a
#: piece's seeds at most; pairs of seed and node that a task holds at once.
SMALL, TOGETHER, WORK, MOST_PARTS, STATE = 1000, 20_000, 10_000_000, 128, 1_000_000


def _held(df: DataFrame) -> DataFrame:
    """settle() for frames that many rounds join: sorted and merged where they lie, never gathered by the driver to be sent to all."""
    return settle(df).hint("merge")


def both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v", "w").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("id")).unionByName(edges.select(F.col("v").alias("id"))).distinct()


def view(rels: DataFrame, ents: DataFrame, types: list[str] | None = None, rel_types: list[str] | None = None, min_confidence: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, undirected edges) of the filtered graph.

    Nodes are the endpoints of the type-filtered edges, fixed before min_confidence filters edges;
    parallel and reciprocal edges collapse to the strongest. Relationships are made once; they and the entities are dealt into
    parts of bounded size, so that the memory of a task does not grow with them.
    """
    kept = rels.where(F.col("type").isin(rel_types)) if rel_types else rels
    kept = settle(kept.select("source_id", "target_id", "confidence_score"))
    ends = kept.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    found = dealt(ents.select("id", "name", "type", "confidence_score"), "id").join(ends, "id", "left_semi")
    if types:
        found = found.where(F.col("type").isin(types))
    ids = found.select("id")
    inside = kept.where(F.col("confidence_score") >= min_confidence).join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    pair = inside.select(F.least("source_id", "target_id").alias("u"), F.greatest("source_id", "target_id").alias("v"), "confidence_score")
    return found, pair.where("u <> v").repartition(parts(kept), "u", "v").groupBy("u", "v").agg(F.max("confidence_score").alias("w"))


def degree(edges: DataFrame) -> DataFrame:
    n = nodes(edges).agg((F.count("*") - 1).alias("rest"))
    return both(edges).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree")).crossJoin(F.broadcast(n)).select("id", "degree", F.round(F.col("degree") / F.col("rest"), 6).alias("score"))


def pagerank(edges: DataFrame, directed: bool = False, alpha: float = 0.85, tol: float = 1e-9, max_rounds: int = 200) -> DataFrame:
    """(id, score), weights max(w, 1e-9), dangling mass spread evenly; stops on the L1 change."""
    links = (edges.select("u", "v", "w") if directed else both(edges)).withColumn("w", F.greatest("w", F.lit(1e-9)))
    out = links.groupBy("u").agg(F.sum("w").alias("total"))
    share = settle(links.join(out, "u").select("u", "v", (F.col("w") / F.col("total")).alias("p")))
    ids = settle(nodes(edges).join(out.select(F.col("u").alias("id"), F.lit(False).alias("dangling")), "id", "left"))
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("score"))
    rank = ids.select("id", F.coalesce("dangling", F.lit(True)).alias("dangling"), F.lit(1.0 / n).alias("score"))
    for _ in range(max_rounds):
        loose = rank.where("dangling").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        flow = share.join(rank.select(F.col("id").alias("u"), "score"), "u").groupBy(F.col("v").alias("id")).agg(F.sum(F.col("p") * F.col("score")).alias("got"))
        new = rank.join(flow, "id", "left").select("id", "dangling", (F.lit((1 - alpha) / n + alpha * loose / n) + alpha * F.coalesce("got", F.lit(0.0))).alias("new"), "score")
        new = settle(new)
        moved = new.agg(F.sum(F.abs(F.col("new") - F.col("score")))).first()[0]
        rank = new.select("id", "dangling", F.col("new").alias("score"))
        if moved < tol:
            break
    return rank.select("id", "score")


def eigenvector(edges: DataFrame, shift: bool = True, tol: float = 1e-6, max_rounds: int = 500, stride: int = 10) -> DataFrame:
    """Weighted power iteration; shift adds the identity, so that bipartite graphs converge too.

    The L1 change of a round is looked at every `stride` rounds, whose joins run as one plan.
    """
    ids = nodes(edges)
    links = both(edges)
    links = settle(links.unionByName(ids.select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(1.0 if shift else 0.0).alias("w"))))

    def step(rank: DataFrame, rounds: int) -> DataFrame:
        for _ in range(rounds):
            rank = links.join(rank.withColumnRenamed("id", "u"), "u").groupBy(F.col("v").alias("id")).agg(F.sum(F.col("w") * F.col("x")).alias("x"))
        rank = settle(rank)
        norm = rank.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0
        return rank.select("id", (F.col("x") / norm).alias("x"))

    rank, done = settle(ids.withColumn("x", F.lit(1.0))), 0
    while done < max_rounds and not rank.isEmpty():
        before = step(rank, min(stride, max_rounds - done) - 1) if min(stride, max_rounds - done) > 1 else rank
        after = step(before, 1)
        done += min(stride, max_rounds - done)
        moved = after.join(before.select("id", F.col("x").alias("old")), "id").agg(F.sum(F.abs(F.col("x") - F.col("old")))).first()[0]
        drop(rank)
        rank = after
        if moved < tol:
            break
    return rank.withColumnRenamed("x", "score")


def _fronts(links: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> list[DataFrame]:
    """The breadth-first levels (seed, id, paths) from many seeds at once, each written; links: u, v, both ways."""
    front = seeds.groupBy("seed").agg(F.max("seed").alias("id")).select("seed", "id", F.lit(1.0).alias("paths"))
    found, seen = [settle(front)], F.lit(True).alias("seen")
    while max_depth is None or len(found) <= max_depth:
        # the links are hashed where they lie, not sent to all: a level would send them through the driver each time
        step = found[-1].join(links.hint("shuffle_hash").withColumnRenamed("u", "id"), "id").select("seed", F.col("v").alias("id"), "paths", F.lit(False).alias("seen"))
        # edges go both ways: what is met again is of the last two levels, whose rows come along as marks
        for level in found[-2:]:
            step = step.unionByName(level.select("seed", "id", F.lit(0.0).alias("paths"), seen))
        front = settle(step.groupBy("seed", "id").agg(F.sum("paths").alias("paths"), F.bool_or("seen").alias("seen")).where("not seen").drop("seen"))
        if not front.take(1):
            break
        found.append(front)
    return found


def levels(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Breadth-first levels from many seeds at once: (seed, id, dist, paths), paths the number of shortest ones."""
    found = _fronts(settle(both(edges).select("u", "v")), seeds, max_depth)
    out = None
    for depth, level in enumerate(found):
        level = level.select("seed", "id", F.lit(depth).alias("dist"), "paths")
        out = level if out is None else out.unionByName(level)
    out = settle(out)
    drop(*found)
    return out


def _numbered(ids: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids with a number `no` each, links u, v both ways between numbers), written: numbers are shorter than ids in every row of a search."""
    ids = settle(ids.withColumn("no", F.monotonically_increasing_id()))
    end = lambda c: ids.select(F.col("id").alias(c), F.col("no").alias(f"{c}_no"))
    return ids, settle(both(edges).select("u", "v").join(end("u"), "u").join(end("v"), "v").select(F.col("u_no").alias("u"), F.col("v_no").alias("v")))


def _pieced(links: DataFrame) -> DataFrame:
    """links with their piece, written: a component, or several small ones together."""
    found = components(links.where("u < v"))
    sizes = settle(found.groupBy("component").agg(F.count("*").alias("n")))
    few = sizes.where(F.col("n") < SMALL).agg(F.sum("n")).first()[0] or 0
    piece = F.when(F.col("n") < SMALL, -1 - F.pmod(F.xxhash64("component"), F.lit(-(-few // TOGETHER) or 1))).otherwise(F.col("component")).alias("piece")
    placed = found.join(sizes, "component").select(F.col("id").alias("u"), piece)
    return settle(links.join(placed, "u").select("u", "v", "piece"))


def _shares(links: DataFrame, seeds: DataFrame, block: int) -> DataFrame:
    """(seed, piece, part), written: the seeds of a piece in parts of at most `block` and of about `WORK` steps over its links, but at most `MOST_PARTS` parts."""
    placed = seeds.join(links.select(F.col("u").alias("seed"), "piece").distinct(), "seed")
    sizes = links.groupBy("piece").agg(F.count("*").alias("m")).join(placed.groupBy("piece").agg(F.count("*").alias("s")), "piece")
    each = F.least(F.lit(block), F.greatest(F.lit(64), F.lit(WORK) / F.col("m")))
    parts = sizes.select("piece", F.least(F.lit(MOST_PARTS), F.ceil(F.col("s") / each)).alias("parts"))
    return settle(placed.join(parts, "piece").select("seed", "piece", F.pmod(F.xxhash64("seed"), "parts").alias("part")))


def _dependencies(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, delta, squares): what the shortest paths from the seeds (_shares()) put on each node, and its square; links: _pieced().

    The links of a piece, two numbers each, go to the tasks that have seeds in it; a task holds those of one piece and searches from
    as many seeds at once as `STATE` allows, level by level, so that no pair of seed and node is a row.
    """
    shares = settle(seeds.select("piece", "part").distinct())
    given = links.join(shares, "piece").select("piece", "part", "u", "v").unionByName(seeds.select("piece", "part", F.col("seed").alias("u"), F.lit(None).cast("bigint").alias("v")))
    tasks = max(seeds.sparkSession.sparkContext.defaultParallelism, 2 * shares.count())
    sums = given.repartition(tasks, "piece", "part").sortWithinPartitions("piece", "part").mapInArrow(_search, "id long, delta double, squares double")
    return settle(sums.groupBy("id").agg(F.sum("delta").alias("delta"), F.sum("squares").alias("squares")))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, delta, squares) of the nodes of each (piece, part), whose rows come together: links (u, v) and seeds (u without v)."""
    for rows in runs(batches, "piece", "part"):
        seed = pc.is_null(rows["v"]).to_numpy()
        u, v = rows["u"].to_numpy(), pc.fill_null(rows["v"], 0).to_numpy()
        ids, ends = np.unique(np.concatenate([u[~seed], v[~seed]]), return_inverse=True)
        start, end = ends[: len(ends) // 2], ends[len(ends) // 2 :]
        order = np.argsort(start, kind="stable")
        delta, squares = _brandes(np.searchsorted(start[order], np.arange(len(ids) + 1)), end[order], np.searchsorted(ids, u[seed]))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(delta), pa.array(squares)], ["id", "delta", "squares"])


def _brandes(first: np.ndarray, near: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the seeds of dependencies and of their squares, by node; the neighbours of node i are near[first[i]:first[i + 1]]."""
    n = len(first) - 1
    degree, sums, squares = np.diff(first), np.zeros(n), np.zeros(n)
    at_once = max(1, STATE // max(n, 1))
    for some in (seeds[i : i + at_once] for i in range(0, len(seeds), at_once)):
        own = np.arange(len(some)) * n + some
        seen, mark = np.zeros(len(some) * n, bool), np.zeros(len(some) * n, np.int64)
        paths, delta = np.zeros(len(some) * n), np.zeros(len(some) * n)
        seen[own], paths[own], front, steps = True, 1.0, own, []
        while len(front):
            node = front % n
            count = degree[node]
            by = np.repeat(np.arange(len(front)), count)
            to = (front - node)[by] + near[np.arange(len(by)) + (first[node] - np.cumsum(count) + count)[by]]
            fresh = ~seen[to]
            by, to = by[fresh], to[fresh]
            np.add.at(paths, to, paths[front[by]])
            seen[to] = True
            steps.append((front, by, to))
            # what is met several times is once in the next front
            mark[to] = np.arange(len(to))
            front = to[mark[to] == np.arange(len(to))]
        for front, by, to in reversed(steps):
            delta[front] = paths[front] * np.bincount(by, (1 + delta[to]) / paths[to], len(front))
        delta[own] = 0.0
        delta = delta.reshape(len(some), n)
        sums += delta.sum(0)
        squares += (delta * delta).sum(0)
    return sums, squares


def betweenness(edges: DataFrame, pivots: int | None = None, block: int = 4096) -> DataFrame:
    """Normalised shortest-path betweenness, exact; with `pivots`, an estimate from so many sources (by hash), scaled up.

    Sources are dealt to tasks by component, at most `block` at a time; small components go together.
    """
    ids, links = _numbered(nodes(edges), edges)
    n = ids.count()
    if n <= 2:
        return ids.select("id", F.lit(0.0).alias("score"))
    seeds = ids.select(F.col("no").alias("seed"))
    if pivots and pivots < n:
        seeds = settle(ids.orderBy(F.xxhash64("id"), "id").limit(pivots).select(F.col("no").alias("seed")))
    links = _pieced(links)
    sums = _dependencies(links, _shares(links, seeds, block))
    scale = (1.0 if not pivots or pivots >= n else n / pivots) / ((n - 1) * (n - 2))
    return settle(ids.join(sums.groupBy(F.col("id").alias("no")).agg(F.sum("delta").alias("b")), "no", "left").select("id", (F.coalesce("b", F.lit(0.0)) * scale).alias("score")))


def sampled_betweenness(edges: DataFrame, epsilon: float = 0.01, failure: float = 0.1, first: int = 256, block: int = 4096) -> DataFrame:
    """(id, score, bound): normalised betweenness from so many sources that every node is within epsilon, but for a chance of `failure`.

    What a source puts on a node, over the other nodes, lies between 0 and 1 and has the node's score as its mean, so that the
    empirical Bernstein inequality bounds the error by the variance seen so far. Sources come in the order of a hash, twice as
    many after each round, until the largest bound is at most epsilon; the chance of failure is shared out over nodes and
    rounds. If the sources run out, the result is exact and the bound 0.
    """
    ids, links = _numbered(nodes(edges), edges)
    n = ids.count()
    if n <= 2:
        return ids.select("id", F.lit(0.0).alias("score"), F.lit(0.0).alias("bound"))
    share = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 40)) / float(1 << 40)
    placed = settle(ids.select(F.col("no").alias("seed"), share.alias("at")))
    links = _pieced(links)
    rounds = max(1, math.ceil(math.log2(max(2.0, n / first))) + 1)
    chance = math.log(3 * n * rounds / failure)
    first = max(first, math.ceil(3.3 * chance / epsilon))  # fewer cannot bring the bound down to epsilon
    sums, taken, low, high = None, 0, 0.0, min(1.0, first / n)
    while True:
        some = placed.where((F.col("at") >= low) & (F.col("at") < high))
        got = _dependencies(links, _shares(links, some.select("seed"), block))
        sums = got if sums is None else settle(sums.unionByName(got).groupBy("id").agg(F.sum("delta").alias("delta"), F.sum("squares").alias("squares")))
        taken = placed.where(F.col("at") < high).count()
        m, to_score = float(max(1, taken)), n / ((n - 1.0) * (n - 2.0))
        mean, power = F.coalesce("delta", F.lit(0.0)) / m, F.coalesce("squares", F.lit(0.0)) / m
        variance = F.greatest(power - mean * mean, F.lit(0.0)) * to_score * to_score
        # a source other than the node puts at most n - 2 on it, so that a summand is at most n / (n - 1)
        bound = F.lit(0.0) if taken >= n else F.sqrt(2 * variance * chance / m) + 3 * chance * n / (n - 1.0) / m
        scored = settle(ids.join(sums.withColumnRenamed("id", "no"), "no", "left").select("id", (mean * to_score).alias("score"), bound.alias("bound")))
        if taken >= n or scored.agg(F.max("bound")).first()[0] <= epsilon:
            return scored
        low, high = high, min(1.0, high * 2)


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component): least id reached.

    Each round contracts every node into the least of itself and its neighbours and goes on with the
    edges that are left; the contractions are composed in the end. A hub or a giant component is
    never one key of a join of raw edges for long, as its edges collapse in the first round.
    """

    def least(pairs: DataFrame) -> DataFrame:
        ends = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        return ends.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("to"))

    now = _held(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
    rounds = []
    while not now.isEmpty():
        if len(rounds) == max_rounds:
            raise RuntimeError("components did not settle")
        rounds.append(now)
        step = least(now)
        moved = now.join(step.select(F.col("id").alias("u"), F.col("to").alias("a")), "u").join(step.select(F.col("id").alias("v"), F.col("to").alias("b")), "v")
        now = _held(moved.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    label = nodes(edges).withColumn("component", F.col("id"))
    for own in rounds:
        label = label.join(least(own).withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    label = _held(label)
    drop(now, *rounds)
    return label


def _low_first(edges: DataFrame) -> DataFrame:
    """Edges directed from lower to higher (degree, id)."""
    deg = both(edges).groupBy(F.col("u").alias("x")).agg(F.count("*").alias("d"))
    joined = edges.select("u", "v").join(deg.select(F.col("x").alias("u"), F.col("d").alias("du")), "u").join(deg.select(F.col("x").alias("v"), F.col("d").alias("dv")), "v")
    up = F.struct("du", "u") < F.struct("dv", "v")
    return joined.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("b"))


def triangles(edges: DataFrame) -> DataFrame:
    """(x, y, z), each triangle once: wedges from the corner of lowest degree, closed by a join."""
    low = _low_first(edges)
    wedge = low.select("a", F.col("b").alias("p")).join(low.select("a", F.col("b").alias("q")), "a").where("p < q")
    closed = wedge.join(edges.select(F.least("u", "v").alias("p"), F.greatest("u", "v").alias("q")), ["p", "q"])
    return closed.select(F.array_sort(F.array("a", "p", "q")).alias("t")).select(F.col("t")[0].alias("x"), F.col("t")[1].alias("y"), F.col("t")[2].alias("z"))


def clustering(edges: DataFrame) -> DataFrame:
    """(id, degree, triangles, clustering)."""
    deg = both(edges).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree"))
    tri = triangles(edges).select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    t = F.coalesce("triangles", F.lit(0))
    return deg.join(tri, "id", "left").select("id", "degree", t.alias("triangles"), F.when(F.col("degree") > 1, F.round(2 * t / (F.col("degree") * (F.col("degree") - 1)), 6)).otherwise(0.0).alias("clustering"))


def adamic_adar(edges: DataFrame, limit: int) -> DataFrame:
    """Unconnected pairs by the sum of 1 / ln(degree) of their common neighbours."""
    links = both(edges).select("u", "v")
    deg = links.groupBy("u").agg(F.count("*").alias("d")).where("d > 1")
    wedge = links.join(deg, "u").select("u", F.col("v").alias("a"), "d").join(links.select("u", F.col("v").alias("b")), "u").where("a < b")
    pairs = wedge.groupBy("a", "b").agg(F.round(F.sum(1 / F.log("d")), 6).alias("score"), F.count("*").alias("common"))
    known = edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    return pairs.join(known, ["a", "b"], "left_anti").orderBy(F.desc("score"), "a", "b").limit(limit)


def holes(edges: DataFrame) -> DataFrame:
    """(id, constraint, effective_size): Burt's measures, weighted."""
    links = both(edges)
    total = links.groupBy("u").agg(F.sum("w").alias("t"), F.max("w").alias("m"))
    p = links.join(total, "u").select("u", "v", F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(0.0).alias("p"), F.when(F.col("m") > 0, F.col("w") / F.col("m")).otherwise(0.0).alias("r"))
    via = p.select("u", F.col("v").alias("x"), F.col("p").alias("p1")).join(p.select(F.col("u").alias("x"), "v", F.col("p").alias("p2")), "x").where("u <> v").groupBy("u", "v").agg(F.sum(F.col("p1") * F.col("p2")).alias("q"))
    constraint = p.join(via, ["u", "v"], "left").groupBy("u").agg(F.sum(F.pow(F.col("p") + F.coalesce("q", F.lit(0.0)), 2)).alias("constraint"))
    redundant = p.select("u", F.col("v").alias("x"), "p").join(p.select(F.col("u").alias("v"), F.col("v").alias("x"), "r"), "x").join(links.select("u", "v"), ["u", "v"], "left_semi").groupBy("u").agg(F.sum(F.col("p") * F.col("r")).alias("red"))
    size = links.groupBy("u").agg(F.count("*").alias("n"))
    return constraint.join(size, "u").join(redundant, "u", "left").select(F.col("u").alias("id"), F.round("constraint", 6).alias("constraint"), F.round(F.col("n") - F.coalesce("red", F.lit(0.0)), 6).alias("effective_size"))


def modularity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """One row: q of the partition (id, c), weighted; 0 where there is no weight."""
    ends = edges.join(partition.select(F.col("id").alias("u"), F.col("c").alias("cu")), "u").join(partition.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v")
    inner = ends.where("cu = cv").groupBy(F.col("cu").alias("c")).agg(F.sum("w").alias("inside"))
    deg = both(edges).groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k")).join(partition, "id").groupBy("c").agg(F.sum("k").alias("tot"))
    m = edges.agg(F.sum("w").alias("m"))
    return deg.join(inner, "c", "left").crossJoin(F.broadcast(m)).agg(F.round(F.coalesce(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.pow(F.col("tot") / (2 * F.col("m")), 2)), F.lit(0.0)), 6).alias("q"))


def _moves(own: DataFrame, links: DataFrame, m: float) -> DataFrame:
    """(id, c, to, gain): the best move of each node that gains modularity. own: id, c, k, its weight; gains are in units of 1 / m."""
    tot = own.groupBy("c").agg(F.sum("k").alias("tot")).withColumnRenamed("c", "to")
    w_in = links.where("u <> v").join(own.select(F.col("id").alias("v"), F.col("c").alias("to")), "v").groupBy(F.col("u").alias("id"), "to").agg(F.sum("w").alias("w_in"))
    stay = own.select("id", F.col("c").alias("to"), F.lit(0.0).alias("w_in"))
    options = w_in.unionByName(stay).groupBy("id", "to").agg(F.sum("w_in").alias("w_in")).join(own, "id").join(tot, "to")
    rest = F.col("tot") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)
    rated = options.select("id", "c", "to", F.round(F.col("w_in") - F.col("k") * rest / (2 * m), 9).alias("g"))
    best = rated.groupBy("id", "c").agg(F.max_by("to", F.struct("g", F.xxhash64("to").alias("h"))).alias("to"), F.max("g").alias("g"), F.max(F.when(F.col("to") == F.col("c"), F.col("g"))).alias("now"))
    return best.where("to <> c and g > now + 1e-9").select("id", "c", "to", (F.col("g") - F.col("now")).alias("gain"))


def _quality(own: DataFrame, links: DataFrame, m: float) -> float:
    inner = links.join(own.select(F.col("id").alias("u"), F.col("c").alias("cu")), "u").join(own.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v").where("cu = cv").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("inner"))
    outer = own.groupBy("c").agg(F.sum("k").alias("tot")).agg(F.sum(F.pow(F.col("tot") / (2 * m), 2)).alias("outer"))
    return inner.crossJoin(outer).select(F.col("inner") / (2 * m) - F.col("outer")).first()[0]


def communities(edges: DataFrame) -> DataFrame:
    """(id, c): Louvain, until no move of a node or of a community gains modularity.

    In a round, half of the nodes (by hash) make their best moves at once. As each was rated without the others, the round counts only if
    modularity, computed anew, has grown; otherwise only those moves are made that are the best ones of both
    communities they touch, whose gains add up exactly. So modularity grows with every round, and the rounds end. Then
    communities become nodes.
    """
    m = edges.agg(F.sum("w")).first()[0] or 0.0
    part = _held(nodes(edges).withColumn("c", F.col("id")))
    if m <= 0:
        return part
    links = _held(both(edges))
    while True:
        own = _held(links.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k")).select("id", F.col("id").alias("c"), "k"))
        quality, turn = _quality(own, links, m), 0
        while True:
            moves = _held(_moves(own, links, m))
            if moves.isEmpty():
                break
            made = lambda some, own=own: _held(own.join(some.select("id", "to"), "id", "left").select("id", F.coalesce("to", "c").alias("c"), "k"))
            new = made(moves.where(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0))
            grown = _quality(new, links, m)
            if grown <= quality + 1e-12:
                drop(new)
                order = F.struct("gain", F.xxhash64("id").alias("h"), "id")
                touched = moves.select("id", "gain", F.explode(F.array("c", "to")).alias("c")).groupBy("c").agg(F.max(order)["id"].alias("id"))
                new = made(moves.join(touched.groupBy("id").agg(F.count("*").alias("n")).where("n = 2"), "id"))
                grown = _quality(new, links, m)
            drop(own, moves)
            own, quality, turn = new, grown, turn + 1
        if not turn:
            return part
        name = own.select("id", "c")
        joined = part.withColumnRenamed("c", "at").join(name.select(F.col("id").alias("at"), "c"), "at").select("id", "c")
        merged = links.join(name.select(F.col("id").alias("u"), F.col("c").alias("cu")), "u").join(name.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w"))
        new_part, new_links = _held(joined), _held(merged)
        drop(part, links, own)
        part, links = new_part, new_links


def cells(edges: DataFrame, partition: DataFrame, min_size: int = 3) -> DataFrame:
    """Per community: size, density, centralisation, mean clustering, kind, and the hub of a hub and its spokes (of the highest degree, the least id)."""
    inside = edges.join(partition.select(F.col("id").alias("u"), "c"), "u").join(partition.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v").where("c = cv").select("u", "v", "w", "c")
    deg = both(inside).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("d"))
    size = partition.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    tri = clustering(inside).select("id", "clustering")
    measured = partition.join(deg, "id", "left").join(tri, "id", "left").withColumn("d", F.coalesce("d", F.lit(0)))
    # the least id of the highest degree, combined before the shuffle
    by_degree = measured.groupBy("c", "d").agg(F.min("id").alias("first"), F.count("*").alias("k"), F.sum(F.coalesce("clustering", F.lit(0.0))).alias("cc"))
    per = by_degree.groupBy("c").agg(F.sum(F.col("d") * F.col("k")).alias("ends"), F.max("d").alias("top"), F.max_by("first", "d").alias("first"), (F.sum("cc") / F.sum("k")).alias("mean_cc"))
    n = F.col("n")
    density = F.col("ends") / (n * (n - 1))
    central = (n * F.col("top") - F.col("ends")) / ((n - 1) * (n - 2))
    kind = F.when(F.col("centralisation") >= 0.6, "hub_and_spoke").when(F.col("density") >= 0.7, "clique").when((F.col("top") <= 2) & (F.col("mean_cc") < 0.1), "chain").otherwise("distributed")
    return per.join(size, "c").withColumn("density", F.round(density, 6)).withColumn("centralisation", F.when(n > 2, F.round(central, 6)).otherwise(0.0)).select("c", F.col("n").alias("size"), "density", "centralisation", F.round("mean_cc", 6).alias("clustering"), kind.alias("kind"), F.when(kind == "hub_and_spoke", F.col("first")).alias("hub"))


def without_each(edges: DataFrame, gone: DataFrame, whole: bool = False) -> DataFrame:
    """(scenario, components, largest): the graph without each node of `gone`, all scenarios in one run; with `whole`, also the whole graph as the null scenario.

    What hangs together without any of `gone` is contracted once, over the whole graph. A scenario then joins those parts again by
    the few edges at `gone` that it leaves; parts that none of them touches are the same in every scenario.
    """
    gone = gone.select("id").distinct()
    key = lambda c: gone.select(F.col("id").alias(c))
    rest = edges.join(F.broadcast(key("u")), "u", "left_anti").join(F.broadcast(key("v")), "v", "left_anti").select("u", "v", "w")
    kept = nodes(edges).join(F.broadcast(gone), "id", "left_anti")
    label = _held(kept.join(components(rest), "id", "left").select("id", F.coalesce("component", "id").alias("c")))
    there = _held(nodes(edges).join(F.broadcast(gone), "id", "left_semi"))
    place = label.unionByName(there.select("id", F.col("id").alias("c")))
    near = both(edges).join(F.broadcast(key("u")), "u", "left_semi")
    touch = _held(near.join(place.select(F.col("id").alias("v"), "c"), "v").select("u", F.col("c").alias("v")).distinct())
    parts = label.groupBy("c").agg(F.count("*").alias("n"))
    met = _held(parts.join(touch.select(F.col("v").alias("c")).distinct(), "c", "left_semi"))
    far = parts.join(met, "c", "left_anti").agg(F.count("*").alias("far"), F.coalesce(F.max("n"), F.lit(0)).alias("far_n"))
    # a scenario is the array of what it removes
    runs = gone.select(F.array("id").alias("s"))
    if whole:
        runs = runs.unionByName(edges.sparkSession.range(1).select(F.slice(F.array(F.lit(None).cast(gone.schema["id"].dataType)), 1, 0).alias("s")))
    runs = F.broadcast(runs)
    in_run = lambda *ends: reduce(lambda x, y: x & y, [~F.array_contains("s", F.col(e)) for e in ends])
    keyed = touch.crossJoin(runs).where(in_run("u", "v")).select(F.struct("s", F.col("u").alias("x")).alias("u"), F.struct("s", F.col("v").alias("x")).alias("v"), F.lit(1.0).alias("w"))
    each = met.unionByName(there.select(F.col("id").alias("c"), F.lit(1).cast("bigint").alias("n"))).crossJoin(runs).where(in_run("c")).select(F.struct("s", F.col("c").alias("x")).alias("id"), "n")
    sizes = each.join(components(keyed), "id", "left").groupBy("id.s", F.coalesce("component", "id").alias("c")).agg(F.sum("n").alias("n"))
    found = sizes.groupBy("s").agg(F.count("*").alias("k"), F.max("n").alias("m"))
    rows = edges.sparkSession.range(1).crossJoin(runs).join(found, "s", "left").crossJoin(F.broadcast(far))
    rows = rows.select(F.get("s", F.lit(0)).alias("scenario"), (F.coalesce("k", F.lit(0)) + F.col("far")).alias("components"), F.greatest(F.coalesce("m", F.lit(0)), "far_n").alias("largest"))
    return rows.where("components > 0")


def resilience(edges: DataFrame, limit: int) -> DataFrame:
    """Removal of each of the `limit` nodes of highest degree: components, largest, fragmentation, drop."""
    deg = both(edges).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree"))
    top = settle(deg.orderBy(F.desc("degree"), "id").limit(limit))
    n = deg.count()
    after = settle(without_each(edges, top, whole=True))
    base = after.where("scenario is null").agg(F.coalesce(F.max("largest"), F.lit(0))).first()[0]
    after = after.where("scenario is not null")
    return after.select(F.col("scenario").alias("id"), F.col("components").alias("components_after"), F.col("largest").alias("largest_after"), F.round(1 - F.col("largest") / (n - 1), 6).alias("fragmentation"), F.round((F.lit(base) - F.col("largest")) / F.lit(base), 6).alias("reachability_drop"))


def tree_blocks(edges: DataFrame) -> DataFrame:
    """(child, up, block): the edges of a breadth-first forest, each with its biconnected component.

    An edge off the forest closes a cycle with the two tree paths to where they meet; the tree edges
    of a cycle belong together. Both ends climb one level at a time, equal pairs of ends going on as
    one; blocks are connected components of tree edges, named by their lower ends.
    """
    pair = _held(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
    roots = components(pair).select(F.col("component").alias("seed")).distinct()
    dist = _held(levels(pair.withColumn("w", F.lit(1.0)), roots).select("id", "dist"))
    ends = pair.join(dist.select(F.col("id").alias("u"), F.col("dist").alias("du")), "u").join(dist.select(F.col("id").alias("v"), F.col("dist").alias("dv")), "v")
    down = ends.where("du <> dv").select(F.when(F.col("du") < F.col("dv"), F.col("u")).otherwise(F.col("v")).alias("up"), F.when(F.col("du") < F.col("dv"), F.col("v")).otherwise(F.col("u")).alias("child"))
    parent = _held(down.groupBy("child").agg(F.min("up").alias("up")).join(dist.withColumnRenamed("id", "child"), "child"))
    tree = parent.select(F.least("child", "up").alias("u"), F.greatest("child", "up").alias("v"))
    x_up = parent.select(F.col("child").alias("x"), F.col("up").alias("x_up"), F.col("dist").alias("x_dist"))
    y_up = parent.select(F.col("child").alias("y"), F.col("up").alias("y_up"), F.col("dist").alias("y_dist"))
    climb = _held(pair.join(tree, ["u", "v"], "left_anti").select(F.col("u").alias("x"), F.col("v").alias("y")))
    same: list[DataFrame] = []
    while not climb.isEmpty():
        # the deeper end climbs, or both if they are level; a root has no parent and no edge of its own
        at = climb.join(x_up, "x", "left").join(y_up, "y", "left").withColumn("xd", F.coalesce("x_dist", F.lit(0))).withColumn("yd", F.coalesce("y_dist", F.lit(0)))
        nx = F.when(F.col("xd") >= F.col("yd"), F.col("x_up")).otherwise(F.col("x"))
        ny = F.when(F.col("yd") >= F.col("xd"), F.col("y_up")).otherwise(F.col("y"))
        at = _held(at.select("x", "y", "xd", "yd", nx.alias("nx"), ny.alias("ny")))
        met = F.col("nx") == F.col("ny")
        joined = F.array_compact(F.array(
            F.when((F.col("xd") >= F.col("yd")) & ~met, F.struct(F.col("x").alias("u"), F.col("nx").alias("v"))),
            F.when((F.col("yd") >= F.col("xd")) & ~met, F.struct(F.col("y").alias("u"), F.col("ny").alias("v"))),
            F.when(met & (F.col("xd") == F.col("yd")), F.struct(F.col("x").alias("u"), F.col("y").alias("v"))),
        ))
        same.append(_held(at.select(F.explode(joined).alias("e")).select("e.u", "e.v").distinct()))
        left = at.where(~met).select(F.least("nx", "ny").alias("x"), F.greatest("nx", "ny").alias("y")).distinct()
        drop(climb)
        climb = _held(left)
        drop(at)
    block = parent.select("child", "up", F.col("child").alias("block"))
    if same:
        pairs = same[0]
        for more in same[1:]:
            pairs = pairs.unionByName(more)
        label = components(pairs)
        block = parent.join(label.withColumnRenamed("id", "child"), "child", "left").select("child", "up", F.coalesce("component", "child").alias("block"))
    return _held(block)


def articulation(edges: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(id): every node (of the candidates) whose removal cuts its component: one in more than one biconnected component."""
    block = tree_blocks(edges)
    cut = block.select(F.explode(F.array("child", "up")).alias("id"), "block").distinct().groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    return cut if candidates is None else cut.join(candidates.select("id"), "id", "left_semi")


def bridges(edges: DataFrame) -> DataFrame:
    """(u, v): every edge that is a biconnected component of its own."""
    block = tree_blocks(edges)
    alone = block.groupBy("block").agg(F.count("*").alias("n"), F.min("child").alias("child"), F.min("up").alias("up")).where("n = 1")
    return alone.select(F.least("child", "up").alias("u"), F.greatest("child", "up").alias("v"))


def cliques(edges: DataFrame, max_size: int | None = None) -> DataFrame:
    """(members, size) of the maximal cliques: level-wise extension by larger ids; maximal when no node extends it.

    With max_size, a clique of more nodes is an error: none is left out in silence.
    """
    adjacent = settle(both(edges).groupBy("u").agg(F.array_sort(F.collect_set("v")).alias("adj")))
    now = adjacent.select(F.array("u").alias("members"), F.col("adj").alias("common"))
    out, size = None, 0
    while True:
        size += 1
        now = settle(now)
        done = now.where(F.size("common") == 0).select("members", F.size("members").alias("size"))
        out = done if out is None else out.unionByName(done)
        grow = now.where(F.size("common") > 0).select("members", "common", F.explode(F.filter("common", lambda x: x > F.element_at("members", -1))).alias("u"))
        now = grow.join(adjacent, "u").select(F.concat("members", F.array("u")).alias("members"), F.array_intersect("common", "adj").alias("common"))
        if not now.take(1):
            return out
        if size == max_size:
            raise RuntimeError(f"a clique has more than {max_size} nodes")


def motifs(edges: DataFrame, max_size: int | None = None) -> DataFrame:
    """(members, size, kind, weight) of the maximal cliques of three nodes or more: triangle or clique-<size>, and the mean weight of their edges."""
    found = settle(cliques(edges, max_size).where("size >= 3"))
    weights = edges.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("w").alias("w"))
    later = F.transform("members", lambda m, i: F.transform(F.slice("members", i + 2, F.size("members")), lambda n: F.struct(m.alias("u"), n.alias("v"))))
    pairs = found.select("members", F.explode(F.flatten(later)).alias("e")).select("members", "e.u", "e.v")
    mean = pairs.join(weights, ["u", "v"]).groupBy("members").agg(F.avg("w").alias("weight"))
    kind = F.when(F.col("size") == 3, F.lit("triangle")).otherwise(F.concat(F.lit("clique-"), "size"))
    return mean.select("members", F.size("members").alias("size"), F.round("weight", 4).alias("weight")).withColumn("kind", kind)


def _steps(command: DataFrame, everyone: DataFrame) -> DataFrame:
    """(id, level): fewest steps from the roots over edges (boss, report), 0 where there is no way."""
    roots = everyone.join(command.select(F.col("report").alias("id")), "id", "left_anti")
    if not roots.take(1):
        roots = everyone.agg(F.min("id").alias("id"))
    front, level = settle(roots.withColumn("level", F.lit(0))), 0
    seen = front
    while front.take(1):
        level += 1
        reached = front.join(command, front["id"] == command["boss"]).select(F.col("report").alias("id")).distinct()
        front = settle(reached.join(seen, "id", "left_anti").withColumn("level", F.lit(level)))
        seen = seen.unionByName(front)
    return everyone.join(seen, "id", "left").select("id", F.coalesce("level", F.lit(0)).alias("level"))


def hierarchy(command: DataFrame) -> DataFrame:
    """(id, level, reports_to, subordinates) over edges (boss, report); level: longest chain from a root.

    With a cycle anywhere, levels are the fewest steps from a root, roots being those without a boss, or the least id where all have one;
    who is reached from no root has level 0. Self-loops are left out.
    """
    command = settle(command.where("boss <> report").distinct())
    everyone = command.select(F.explode(F.array("boss", "report")).alias("id")).distinct()
    left, done, level = command, None, 0
    rest = settle(everyone)
    while True:
        top = settle(rest.join(left.select(F.col("report").alias("id")), "id", "left_anti"))
        if not top.take(1):
            break
        placed = top.withColumn("level", F.lit(level))
        done = placed if done is None else done.unionByName(placed)
        rest = settle(rest.join(top, "id", "left_anti"))
        left = settle(left.join(top.withColumnRenamed("id", "boss"), "boss", "left_anti"))
        level += 1
    if rest.take(1):
        done = _steps(command, everyone)
    elif done is None:
        done = rest.withColumn("level", F.lit(0))
    boss = command.groupBy(F.col("report").alias("id")).agg(F.min("boss").alias("reports_to"))
    subs = command.groupBy(F.col("boss").alias("id")).agg(F.count("*").alias("subordinates"))
    return done.join(boss, "id", "left").join(subs, "id", "left").select("id", "level", "reports_to", F.coalesce("subordinates", F.lit(0)).alias("subordinates"))


def influence(edges: DataFrame, seeds: list[str], trials: int = 200, salt: int = 42) -> DataFrame:
    """Independent cascade: (id, probability). One coin per trial and edge, a hash below the edge's confidence."""
    if trials < 1:
        raise ValueError("trials must be at least 1")
    spark = edges.sparkSession
    runs = spark.range(trials).select(F.col("id").alias("trial"))
    coin = F.pmod(F.xxhash64("trial", F.least("u", "v"), F.greatest("u", "v"), F.lit(salt)), F.lit(1_000_003)) / 1_000_003.0
    live = settle(edges.crossJoin(F.broadcast(runs)).where(coin < F.col("w")).select("trial", "u", "v"))
    live = live.unionByName(live.select("trial", F.col("v").alias("u"), F.col("u").alias("v")))
    front = settle(nodes(edges).where(F.col("id").isin(seeds)).crossJoin(F.broadcast(runs)).select("trial", "id"))
    seen = front
    while front.take(1):
        front = settle(front.withColumnRenamed("id", "u").join(live, ["trial", "u"]).select("trial", F.col("v").alias("id")).distinct().join(seen, ["trial", "id"], "left_anti"))
        seen = seen.unionByName(front)
    return seen.groupBy("id").agg((F.count("*") / F.lit(float(trials))).alias("probability"))


def best_paths(edges: DataFrame, source: str, kind: str, paths: bool = True) -> DataFrame:
    """(id, score, hops and, with `paths`, path) from the source: `widest` (largest bottleneck) or `likely` (largest product), relaxed until still.

    Only nodes whose score grew in a round go on in the next. Without `paths` a row has a fixed size; a walk that meets a node again
    cannot be better, unless weights over 1 make it so in products: then paths are kept, so that none enters a node twice.
    """
    links = settle(both(edges))
    long = kind != "widest" and links.agg(F.coalesce(F.max("w"), F.lit(0.0)) > 1).first()[0]
    path = paths or long
    more = ["path"] if path else []
    now = settle(nodes(edges).where(F.col("id") == source).select("id", F.lit(1.0).alias("score"), F.lit(0).alias("hops"), *([F.array("id").alias("path")] if path else []), F.lit(True).alias("fresh")))
    hops = 0
    while now.where("fresh").take(1):
        hops += 1
        step = now.where("fresh").select(F.col("id").alias("u"), "score", *more).join(links.hint("shuffle_hash"), "u")
        value = F.least("score", "w") if kind == "widest" else F.col("score") * F.greatest("w", F.lit(1e-9))
        if path:
            step = step.where(~F.array_contains("path", F.col("v")))
        reached = step.select(F.col("v").alias("id"), value.alias("score"), *([F.concat("path", F.array("v")).alias("path")] if path else []))
        # what is met in a round has as many hops as rounds went before, so that the first to reach a score has the fewest
        old = now.select("id", F.lit(None).cast("double").alias("got"), F.struct("score", "hops", *more).alias("old"), F.lit(None).cast("array<string>").alias("path"))
        got = reached.select("id", F.col("score").alias("got"), F.lit(None).cast(old.schema["old"].dataType).alias("old"), "path" if path else F.lit(None).cast("array<string>").alias("path"))
        best = old.unionByName(got).groupBy("id").agg(F.max("got").alias("got"), F.max_by("path", "got").alias("way"), F.max("old").alias("old"))
        better = F.col("got").isNotNull() & (F.col("old").isNull() | (F.col("got") > F.col("old.score") + 1e-12))
        pick = lambda new, was: F.when(better, new).otherwise(F.col(f"old.{was}")).alias(was)  # noqa: B023, E731
        new = settle(best.select("id", pick(F.col("got"), "score"), pick(F.lit(hops), "hops"), *([pick(F.col("way"), "path")] if path else []), better.alias("fresh")))
        drop(now)
        now = new
    drop(links)
    return now.select("id", "score", "hops", *(["path"] if paths else []))


def _deviations(links: DataFrame, searches: list[tuple[int, list[str], list[str]]], target: str, limit: int | None) -> dict[int, list[str]]:
    """The shortest path of each search, the least by ids of those; searches without one are left out.

    links: u, v and left, the hops from v to the target. A search (number, root, banned) begins at the end of its root, does not enter
    it again and goes to none of `banned` first. All searches advance together, a job per hop; as edges go both ways, a node met
    again can only be of the last two hops. Paths longer than the limit are not followed.
    """
    spark = links.sparkSession
    plan = F.broadcast(spark.createDataFrame(searches, "no int, root array<string>, banned array<string>"))
    front = _held(plan.select("no", F.element_at("root", -1).alias("id"), F.col("root").alias("path")))
    before, first, found = None, True, {}
    while front.take(1):
        step = front.withColumnRenamed("id", "u").join(links, "u").join(plan, "no").where(~F.array_contains("root", F.col("v")))
        if first:
            step = step.where(~F.array_contains("banned", F.col("v")))
        if limit is not None:
            step = step.where(F.size("path") + F.col("left") <= limit)
        # a separator after every id keeps the order of paths when both go on to the same node
        key = F.concat(F.array_join("path", ">"), F.lit(">"))
        new = step.groupBy("no", F.col("v").alias("id")).agg(F.min_by("path", key).alias("path")).join(front.select("no", "id"), ["no", "id"], "left_anti")
        new = new if before is None else new.join(before.select("no", "id"), ["no", "id"], "left_anti")
        new = _held(new.select("no", "id", F.concat("path", F.array("id")).alias("path")))
        found |= {r.no: r.path for r in new.where(F.col("id") == target).collect()}  # a path a search
        if before is not None:
            drop(before)
        before, front, first = front, new.where(~F.col("no").isin(list(found))), False
    return found


def shortest_paths(edges: DataFrame, source: str, target: str, k: int, max_length: int | None = None) -> DataFrame:
    """The k shortest simple paths by hops, ties in order of their ids.

    Every path after the first leaves an earlier one at some node. A path that is taken splits what is left by where it is
    left, and the shortest of each part is a candidate for the next one. The parts of a path are searched
    together, so that the jobs grow with k times the hops, and nothing is enumerated or searched again. Paths and candidates
    (at most k times the hops of a path) are kept by the driver.
    """
    spark = edges.sparkSession
    left = levels(edges, spark.createDataFrame([(target,)], "seed string")).select(F.col("id").alias("v"), F.col("dist").alias("left"))
    links = settle(both(edges).select("u", "v").join(left, "v"))
    paths: list[list[str]] = []
    if source == target:
        paths = [[source]] if nodes(edges).where(F.col("id") == source).take(1) else []
        candidates: dict[tuple[str, ...], int] = {}
    else:
        candidates = {tuple(p): 0 for p in _deviations(links, [(0, [source], [])], target, max_length).values()}
    order = lambda p: (len(p), ">".join(p))
    while candidates:
        path = min(candidates, key=order)
        leaves = candidates.pop(path)
        paths.append(list(path))
        if len(paths) == k:
            break
        need = k - len(paths)
        limit = sorted(len(p) - 1 for p in candidates)[need - 1] if len(candidates) >= need else max_length
        searches = [(i, list(path[: i + 1]), sorted({p[i + 1] for p in paths if len(p) > i + 1 and p[: i + 1] == list(path[: i + 1])})) for i in range(leaves, len(path) - 1)]
        for i, found in _deviations(links, searches, target, limit).items():
            candidates[tuple(found)] = i
    return spark.createDataFrame([(len(p) - 1, ">".join(p)) for p in paths], "hops int, path string")


def assemble(paths: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """Paths (path_id, path: array of ids) with their edges' weights: length, score by kind, bottleneck.

    score: hops (`shortest`), the weakest edge (`widest`) or the product of the edges (`likely`); a
    path of one node has bottleneck and product 1.
    """
    step = paths.select("path_id", F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path")).alias("b"))).alias("no", "e"))
    pair = step.select("path_id", F.least("e.a", "e.b").alias("u"), F.greatest("e.a", "e.b").alias("v"))
    weighed = pair.join(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w"), ["u", "v"]).groupBy("path_id").agg(F.min("w").alias("bottleneck"), F.product("w").alias("product"))
    joined = paths.join(weighed, "path_id", "left").withColumn("length", F.size("path") - 1)
    one = lambda c: F.coalesce(c, F.lit(1.0))
    score = {"shortest": F.col("length").cast("double"), "widest": one("bottleneck"), "likely": one("product")}[kind]
    return joined.select("path_id", F.array_join("path", ">").alias("path"), "length", F.round(score, 6).alias("score"), F.round(one("bottleneck"), 6).alias("bottleneck"))


def _ego_ranks(alpha: float, tol: float, max_rounds: int):
    """For batches of ego graphs (seed, u, v, w), sorted by seed: (seed, n, degree, x), x the ego's own PageRank; the whole egos of a batch go through a round together."""

    def ranks(pdf):
        import numpy as np
        import pandas as pd

        seed, seeds = pd.factorize(pdf["seed"])
        code, names = pd.factorize(pd.concat([pdf["u"], pdf["v"], pd.Series(seeds)], ignore_index=True))
        m, k = len(pdf), len(names)
        keys, at = np.unique(np.concatenate([seed, seed]) * np.int64(k) + code[: 2 * m], return_inverse=True)
        u, v, own = at[:m], at[m:], keys // k
        n = np.bincount(own, minlength=len(seeds))
        total = np.bincount(u, weights=pdf["w"].to_numpy(), minlength=len(keys))
        p, loose = pdf["w"].to_numpy() / total[u], total == 0
        x = 1.0 / n[own]
        for _ in range(max_rounds):
            spare = np.bincount(own, weights=np.where(loose, x, 0.0), minlength=len(seeds))
            new = ((1 - alpha) + alpha * spare[own]) / n[own] + alpha * np.bincount(v, weights=p * x[u], minlength=len(keys))
            moved = np.bincount(own, weights=np.abs(new - x)).max()
            x = new
            if moved < tol:
                break
        me = code[2 * m :]
        degree = np.bincount(seed, weights=(code[:m] == me[seed]) | (code[m : 2 * m] == me[seed]), minlength=len(seeds))
        return pd.DataFrame({"seed": seeds, "n": n, "degree": degree.astype("int64"), "x": x[np.searchsorted(keys, np.arange(len(seeds)) * np.int64(k) + me)]})

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        held = []
        for pdf in batches:
            last = pdf["seed"].iloc[-1] if len(pdf) else None
            if held and last == held[0]["seed"].iloc[0]:
                held.append(pdf)
                continue
            if len(pdf):
                done = pdf["seed"] != last
                whole = pd.concat([*held, pdf[done]], ignore_index=True)
                held = [pdf[~done]]
                if len(whole):
                    yield ranks(whole)
        if held:
            yield ranks(pd.concat(held, ignore_index=True))

    return run


def ego_influence(edges: DataFrame, egos: DataFrame, alpha: float = 0.85, tol: float = 1e-9, max_rounds: int = 200) -> DataFrame:
    """(seed, nodes, degree_centrality, pagerank) of each ego (seed) within its two-hop graph, all egos in one run.

    The two-hop graph has the edges with an end at the ego or one hop from it. PageRank is directed
    and weighted, dangling mass spread over the ego's graph, until the largest change of an ego's graph is
    below tol. The graphs are made by joins and dealt and sorted by their ego; a task then takes them batch by batch, and
    holds at most a batch and the edges of one ego.
    """
    near = ego(edges, egos, 1).select("seed", F.col("id").alias("x"))
    touched = near.join(edges.select(F.col("u").alias("x"), "u", "v", "w"), "x").unionByName(near.join(edges.select(F.col("v").alias("x"), "u", "v", "w"), "x"))
    own = touched.select("seed", "u", "v", F.greatest("w", F.lit(1e-9)).alias("w")).distinct()
    kind = own.schema["seed"].dataType.simpleString()
    mine = own.repartition("seed").sortWithinPartitions("seed").mapInPandas(_ego_ranks(alpha, tol, max_rounds), f"seed {kind}, n bigint, degree bigint, x double")
    return mine.select("seed", F.col("n").alias("nodes"), F.round(F.col("degree") / (F.col("n") - 1), 4).alias("degree_centrality"), F.round("x", 4).alias("pagerank"))


def ego(edges: DataFrame, egos: DataFrame, depth: int) -> DataFrame:
    """(seed, id, dist) of the nodes within `depth` hops of each ego (seed)."""
    return levels(edges, egos, depth).select("seed", "id", "dist")


def _with_isolates(measured: DataFrame, between: DataFrame, everyone: DataFrame | None) -> DataFrame:
    """measured (id, ...) and the betweenness of every node; nodes without edges have zeros."""
    if everyone is not None:
        measured = everyone.select("id").distinct().join(measured, "id", "left")
    joined = measured.join(between.select("id", F.col("score").alias("btw")), "id", "left")
    return joined.select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in joined.columns if c != "id"])


def roles(edges: DataFrame, between: DataFrame, everyone: DataFrame | None = None) -> DataFrame:
    """(id, role) by thresholds at the 80th percentile of degree and betweenness; everyone (id): nodes without edges too."""
    base = _with_isolates(clustering(edges), between, everyone)
    cut = base.agg(F.percentile("degree", F.lit(0.8)).alias("d80"), F.greatest(F.percentile("btw", F.lit(0.8)), F.lit(1e-9)).alias("b80"))
    scored = base.crossJoin(F.broadcast(cut)).withColumn("hub", F.col("degree") >= F.col("d80")).withColumn("broker", F.col("btw") >= F.col("b80"))
    by_hub = both(edges).join(scored.where("hub").select(F.col("id").alias("v")), "v", "left_semi").select(F.col("u").alias("id")).distinct().withColumn("near_hub", F.lit(True))
    role = F.when(F.col("degree") == 0, "isolate").when(F.col("hub") & F.col("broker"), "leadership").when(F.col("broker"), "broker").when(F.col("hub"), "hub").when((F.col("degree") <= 2) & F.col("near_hub"), "peripheral").when(F.col("clustering") >= 0.6, "core_member").otherwise("associate")
    return scored.join(by_hub, "id", "left").withColumn("near_hub", F.coalesce("near_hub", F.lit(False))).select("id", role.alias("role"), "degree", F.round("btw", 9).alias("betweenness"))


def anomalies(edges: DataFrame, between: DataFrame, z: float = 2.0, everyone: DataFrame | None = None) -> DataFrame:
    """(id, kind, score): degree outliers, nodes without edges (of more than two nodes), low-degree nodes of high betweenness; the strongest per node."""
    base = _with_isolates(both(edges).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("d")), between, everyone).withColumnRenamed("btw", "b")
    stat = base.agg(F.avg("d").alias("mu"), F.stddev_pop("d").alias("sd"), F.percentile("b", F.lit(0.95)).alias("b95"), F.count("*").alias("n"))
    rows = base.crossJoin(F.broadcast(stat))
    hub = rows.where((F.col("sd") > 0) & ((F.col("d") - F.col("mu")) / F.col("sd") >= z)).select("id", F.lit("hub").alias("kind"), ((F.col("d") - F.col("mu")) / F.col("sd")).alias("score"), F.lit(0).alias("o"))
    bridge = rows.where((F.col("b95") > 0) & (F.col("b") >= F.col("b95")) & (F.col("d") <= F.greatest(F.lit(2.0), F.col("mu")))).select("id", F.lit("bridge").alias("kind"), F.col("b").alias("score"), F.lit(2).alias("o"))
    alone = rows.where("d = 0 and n > 2").select("id", F.lit("isolate").alias("kind"), F.lit(1.0).alias("score"), F.lit(1).alias("o"))
    best = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "o"))
    return hub.unionByName(alone).unionByName(bridge).withColumn("r", best).where("r = 1").select("id", "kind", F.round("score", 6).alias("score"))
