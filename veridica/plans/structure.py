"""Registered queries of the iterative graph operators, with recursive SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridica.operators import graph, identity
from veridica.operators.frames import settle
from veridica.plans.catalog import _NORM, _SCREEN, edges, query

def between(fx) -> DataFrame:
    """Exact betweenness of the graph."""
    return graph.betweenness(edges(fx))


def assets(fx) -> DataFrame:
    """All nodes, those without edges too."""
    return fx.ents.where("type = 'asset'").select("id")


@query("""
WITH RECURSIVE o AS MATERIALIZED (SELECT u, sum(greatest(w, 1e-9)) AS t FROM gedges GROUP BY 1), sh AS MATERIALIZED (SELECT g.u, g.v, greatest(w, 1e-9) / t AS p FROM gedges g JOIN o ON o.u = g.u), nn AS MATERIALIZED (SELECT id, o.u IS NULL AS dangling FROM gnodes LEFT JOIN o ON o.u = id), k AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM gnodes),
pr(i, id, x) AS (SELECT 0, id, 1 / n FROM nn, k UNION ALL SELECT r.i, r.id, .15 / n + .85 * l.loose / n + .85 * coalesce(f.got, 0) FROM (SELECT i + 1 AS i, id FROM pr WHERE i < 200) r CROSS JOIN k CROSS JOIN (SELECT coalesce(sum(x), 0) AS loose FROM pr JOIN nn USING (id) WHERE dangling) l LEFT JOIN (SELECT sh.v, sum(p * x) AS got FROM pr JOIN sh ON sh.u = pr.id GROUP BY 1) f ON f.v = r.id)
SELECT id, round(x, 7) AS score FROM pr WHERE i = 200""")
def g_pagerank(fx):
    return graph.pagerank(edges(fx), directed=True).select("id", F.round("score", 7).alias("score"))


@query("""
WITH RECURSIVE gb AS MATERIALIZED (SELECT u, v, w FROM gboth),
ev(i, id, x) AS (SELECT 0, id, CAST(1 AS DOUBLE) FROM gnodes UNION ALL SELECT i, id, y / sqrt(sum(y * y) OVER ()) FROM (SELECT a.i + 1 AS i, a.id, a.x + coalesce(f.got, 0) AS y FROM ev a LEFT JOIN (SELECT gb.u, sum(w * x) AS got FROM ev JOIN gb ON gb.v = ev.id GROUP BY 1) f ON f.u = a.id WHERE a.i < 500)),
ch AS (SELECT b.i, sum(abs(b.x - a.x)) AS moved FROM ev a JOIN ev b ON b.id = a.id AND b.i = a.i + 1 GROUP BY 1), st AS (SELECT coalesce(min(i) FILTER (WHERE moved < 1e-6 AND i % 10 = 0), 500) AS i FROM ch)
SELECT id, round(x, 6) AS score FROM ev JOIN st USING (i)""")
def g_eigenvector(fx):
    return graph.eigenvector(edges(fx)).select("id", F.round("score", 6).alias("score"))


#: Betweenness by levels: shortest paths from every node, then dependencies from the farthest level back.
_BTW = """
WITH RECURSIVE gb AS MATERIALIZED (SELECT u, v FROM gboth), bfs(s, v, d, sig) USING KEY (s, v) AS (SELECT id, id, 0, CAST(1 AS DOUBLE) FROM gnodes UNION SELECT f.s, g.v, f.d + 1, sum(f.sig) FROM bfs f JOIN gb g ON g.u = f.v LEFT JOIN recurring.bfs r ON r.s = f.s AND r.v = g.v WHERE r.v IS NULL GROUP BY f.s, g.v, f.d),
lv AS MATERIALIZED (SELECT s, v, d, sig FROM bfs),
step AS MATERIALIZED (SELECT a.s, a.v, b.v AS w, a.d, a.sig / b.sig AS share FROM lv a JOIN gb ON gb.u = a.v JOIN lv b ON b.s = a.s AND b.v = gb.v AND b.d = a.d + 1),
back(d, s, v, delta) AS (SELECT d, s, v, CAST(0 AS DOUBLE) FROM lv WHERE d = (SELECT max(d) FROM lv)
  UNION ALL SELECT l.d, l.s, l.v, coalesce(x.got, 0) FROM (SELECT max(d) - 1 AS d FROM back) p JOIN lv l ON l.d = p.d LEFT JOIN (SELECT step.s, step.v, sum(share * (1 + delta)) AS got FROM back JOIN step ON step.s = back.s AND step.w = back.v AND step.d = back.d - 1 GROUP BY 1, 2) x ON x.s = l.s AND x.v = l.v WHERE p.d > 0),
btw AS MATERIALIZED (SELECT id, coalesce(b, 0) / ((n - 1) * (n - 2)) AS score FROM gnodes LEFT JOIN (SELECT v AS id, sum(delta) AS b FROM back WHERE v <> s GROUP BY 1) USING (id), (SELECT CAST(count(*) AS DOUBLE) AS n FROM gnodes))"""


@query(_BTW + " SELECT id, round(score, 9) AS score FROM btw")
def g_betweenness(fx):
    return between(fx).select("id", F.round("score", 9).alias("score"))


@query()
def g_betweenness_sampled(fx):
    """Betweenness to within .05 of the exact one, but for a chance of one in ten."""
    return graph.sampled_betweenness(edges(fx), 0.05)


_TRIANGLES = "(SELECT a.u AS x, a.v AS y, b.v AS z FROM gedges a JOIN gedges b ON a.v = b.u JOIN gedges c ON c.u = a.u AND c.v = b.v)"
_CC = f"""cc AS (SELECT g.id, d, CASE WHEN d > 1 THEN round(2 * coalesce(n, 0) / (d * (d - 1)), 6) ELSE 0 END AS cc FROM gdeg g LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT x AS id FROM {_TRIANGLES} UNION ALL SELECT y FROM {_TRIANGLES} UNION ALL SELECT z FROM {_TRIANGLES}) GROUP BY 1) t USING (id)),
nodes0 AS MATERIALIZED (SELECT id, coalesce(d, 0) AS d, coalesce(cc, 0) AS cc, coalesce(score, 0) AS b FROM (SELECT id FROM ents WHERE type = 'asset') LEFT JOIN cc USING (id) LEFT JOIN btw USING (id))"""


@query(f"""{_BTW}, {_CC},
cut AS (SELECT quantile_cont(d, .8) AS d80, greatest(quantile_cont(b, .8), 1e-9) AS b80 FROM nodes0), near_hub AS (SELECT DISTINCT u AS id FROM gboth JOIN nodes0 ON nodes0.id = v, cut WHERE d >= d80)
SELECT id, CASE WHEN d = 0 THEN 'isolate' WHEN d >= d80 AND b >= b80 THEN 'leadership' WHEN b >= b80 THEN 'broker' WHEN d >= d80 THEN 'hub' WHEN d <= 2 AND near_hub.id IS NOT NULL THEN 'peripheral' WHEN cc >= .6 THEN 'core_member' ELSE 'associate' END AS role, d AS degree, round(b, 9) AS betweenness
FROM nodes0 LEFT JOIN near_hub USING (id), cut""")
def g_roles(fx):
    return graph.roles(edges(fx), between(fx), assets(fx))


_ANOMALIES = """st AS (SELECT avg(d) AS mu, stddev_pop(d) AS sd, quantile_cont(b, .95) AS b95, count(*) AS n FROM nodes0),
odd AS (SELECT id, 'hub' AS kind, (d - mu) / sd AS score, 0 AS o FROM nodes0, st WHERE sd > 0 AND (d - mu) / sd >= 2 UNION ALL SELECT id, 'isolate', 1, 1 FROM nodes0, st WHERE d = 0 AND n > 2 UNION ALL SELECT id, 'bridge', b, 2 FROM nodes0, st WHERE b95 > 0 AND b >= b95 AND d <= greatest(2, mu)),
best AS (SELECT id, kind, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, o) AS r FROM odd) WHERE r = 1)"""


@query(f"{_BTW}, {_CC}, {_ANOMALIES} SELECT id, kind, score FROM best")
def g_anomalies(fx):
    return graph.anomalies(edges(fx), between(fx), everyone=assets(fx))


#: A node cuts if, without it, one of its neighbours is not reached from its first neighbour.
_CUTS = "cutn(x, id) AS (SELECT u, min(v) FROM gboth GROUP BY 1 UNION SELECT cutn.x, g.v FROM cutn JOIN gboth g ON g.u = cutn.id AND g.v <> cutn.x), cuts AS (SELECT DISTINCT u AS id FROM gboth LEFT JOIN cutn ON cutn.x = u AND cutn.id = v WHERE cutn.id IS NULL)"


@query(f"WITH RECURSIVE {_CUTS} SELECT id FROM cuts")
def g_articulation(fx):
    return graph.articulation(edges(fx))


@query("""
WITH RECURSIVE gb AS MATERIALIZED (SELECT u, v FROM gboth), walk(a, b, id) AS (SELECT u, v, u FROM gedges UNION SELECT a, b, g.v FROM walk JOIN gb g ON g.u = walk.id WHERE NOT (g.u = a AND g.v = b) AND NOT (g.u = b AND g.v = a))
SELECT least(u, v) AS u, greatest(u, v) AS v FROM gedges WHERE NOT EXISTS (SELECT 1 FROM walk WHERE a = u AND b = v AND id = v)""")
def g_bridges(fx):
    return graph.bridges(edges(fx))


_HOLES = """t AS (SELECT u, sum(w) AS t, max(w) AS m, count(*) AS n FROM gboth GROUP BY 1), p AS (SELECT b.u, b.v, CASE WHEN t > 0 THEN w / t ELSE 0 END AS p, CASE WHEN m > 0 THEN w / m ELSE 0 END AS r FROM gboth b JOIN t USING (u)),
q AS (SELECT a.u, b.v, sum(a.p * b.p) AS q FROM p a JOIN p b ON a.v = b.u WHERE a.u <> b.v GROUP BY 1, 2), c AS (SELECT p.u, sum(pow(p.p + coalesce(q, 0), 2)) AS c FROM p LEFT JOIN q ON q.u = p.u AND q.v = p.v GROUP BY 1),
red AS (SELECT a.u, sum(a.p * b.r) AS red FROM p a JOIN p b ON b.v = a.v JOIN p e ON e.u = a.u AND e.v = b.u GROUP BY 1)"""


@query(f"""{_BTW}, {_CUTS}, {_HOLES}
SELECT btw.id, round(score, 9) AS betweenness, round(c, 6) AS "constraint", round(n - coalesce(red, 0), 6) AS effective_size, cuts.id IS NOT NULL AS articulation FROM btw JOIN c ON c.u = btw.id JOIN t ON t.u = btw.id LEFT JOIN red ON red.u = btw.id LEFT JOIN cuts ON cuts.id = btw.id ORDER BY round(score, 9) DESC, btw.id LIMIT 25""")
def g_brokers(fx):
    kept = edges(fx)
    cuts = graph.articulation(kept).withColumn("articulation", F.lit(True))
    joined = between(fx).select("id", F.round("score", 9).alias("betweenness")).join(graph.holes(kept), "id").join(cuts, "id", "left")
    return joined.withColumn("articulation", F.coalesce("articulation", F.lit(False))).orderBy(F.desc("betweenness"), "id").limit(25)


@query(f"""{_BTW}, {_CC}, {_ANOMALIES}
SELECT DISTINCT entity_id AS id, 'contradiction' AS kind, 'high' AS severity, CAST(1 AS DOUBLE) AS score FROM evidence WHERE verification_status = 'verified' AND stance = 'contradicts'
UNION ALL SELECT id, kind, CASE WHEN kind = 'isolate' THEN 'low' ELSE 'medium' END, score FROM best
UNION ALL SELECT id, 'watchlist', 'high', max(score) FROM {_SCREEN} WHERE score >= .9 GROUP BY 1""")
def alr_feed(fx):
    one = F.lit(1.0).alias("score")
    bad = fx.evidence.where("verification_status = 'verified' and stance = 'contradicts'").select(F.col("entity_id").alias("id")).distinct().select("id", F.lit("contradiction").alias("kind"), F.lit("high").alias("severity"), one)
    odd = graph.anomalies(edges(fx), between(fx), everyone=assets(fx)).select("id", "kind", F.when(F.col("kind") == "isolate", "low").otherwise("medium").alias("severity"), "score")
    hit = identity.screen(fx.ents, fx.watch, 0.9, fx.aliases).groupBy("id").agg(F.max("score").alias("top")).select("id", F.lit("watchlist").alias("kind"), F.lit("high").alias("severity"), F.col("top").alias("score"))
    return bad.unionByName(odd).unionByName(hit)


@query("""
WITH RECURSIVE gb AS MATERIALIZED (SELECT u, v FROM gboth), nodes0 AS MATERIALIZED (SELECT id FROM gnodes), tops AS MATERIALIZED (SELECT id AS x FROM gdeg ORDER BY d DESC, id LIMIT 10),
full0(id, c) AS (SELECT id, id FROM nodes0 UNION SELECT g.v, full0.c FROM full0 JOIN gb g ON g.u = full0.id WHERE full0.c < g.v), base AS (SELECT max(n) AS base FROM (SELECT c, count(*) AS n FROM (SELECT id, min(c) AS c FROM full0 GROUP BY 1) GROUP BY 1)),
wo(x, id, c) AS (SELECT x, id, id FROM tops, nodes0 WHERE id <> x UNION SELECT wo.x, g.v, wo.c FROM wo JOIN gb g ON g.u = wo.id WHERE wo.c < g.v AND g.v <> wo.x),
sz AS (SELECT x, c, count(*) AS n FROM (SELECT x, id, min(c) AS c FROM wo GROUP BY 1, 2) GROUP BY 1, 2)
SELECT x AS id, count(*) AS components_after, max(n) AS largest_after, round(1 - max(n) / ((SELECT count(*) FROM nodes0) - 1), 6) AS fragmentation, round((max(base) - max(n)) / max(base), 6) AS reachability_drop FROM sz, base GROUP BY 1""")
def g_resilience(fx):
    return graph.resilience(edges(fx), 10)


@query("""
WITH RECURSIVE adj AS MATERIALIZED (SELECT u, list(v) AS a FROM gboth GROUP BY 1),
cl(members, common) AS (SELECT [u], a FROM adj UNION ALL SELECT list_append(members, w), list_intersect(common, adj.a) FROM (SELECT members, common, unnest(list_filter(common, lambda x: x > members[-1])) AS w FROM cl) JOIN adj ON adj.u = w)
SELECT array_to_string(members, ',') AS members, len(members) AS size FROM cl WHERE len(common) = 0""")
def g_cliques(fx):
    return graph.cliques(edges(fx)).select(F.array_join("members", ",").alias("members"), F.col("size").cast("bigint").alias("size"))


_CLIQUES = """RECURSIVE adj AS MATERIALIZED (SELECT u, list(v) AS a FROM gboth GROUP BY 1),
cl(members, common) AS (SELECT [u], a FROM adj UNION ALL SELECT list_append(members, w), list_intersect(common, adj.a) FROM (SELECT members, common, unnest(list_filter(common, lambda x: x > members[-1])) AS w FROM cl) JOIN adj ON adj.u = w)"""


@query(f"""
WITH {_CLIQUES}, c AS (SELECT members, len(members) AS size, unnest(members) AS x FROM cl WHERE len(common) = 0 AND len(members) >= 3), p AS (SELECT members, size, x, unnest(members) AS y FROM c)
SELECT array_to_string(members, ',') AS members, size, CASE WHEN size = 3 THEN 'triangle' ELSE 'clique-' || size END AS kind, round(avg(w), 4) AS weight FROM p JOIN gboth ON u = x AND v = y WHERE x < y GROUP BY 1, 2, 3""")
def g_motifs(fx):
    return graph.motifs(edges(fx)).select(F.array_join("members", ",").alias("members"), F.col("size").cast("bigint").alias("size"), "kind", "weight")


@query(f"WITH {_CLIQUES} SELECT len(members) AS size, count(*) AS cliques FROM cl WHERE len(common) = 0 GROUP BY 1")
def g_clique_sizes(fx):
    return graph.cliques(edges(fx)).groupBy(F.col("size").cast("bigint").alias("size")).agg(F.count("*").alias("cliques"))


@query(f"""
WITH RECURSIVE reach(id, c) AS (SELECT id, id FROM gnodes UNION SELECT gboth.v, reach.c FROM reach JOIN gboth ON gboth.u = reach.id WHERE reach.c < gboth.v), part AS MATERIALIZED (SELECT id, min(c) AS c FROM reach GROUP BY 1),
btw AS (SELECT id, CAST(0 AS DOUBLE) AS score FROM gnodes), {_CC},
per AS (SELECT c, count(*) AS n, CAST(sum(d) AS BIGINT) AS ends, max(d) AS top, (array_agg(id ORDER BY d DESC, id))[1] AS first, avg(cc) AS mean_cc FROM part JOIN nodes0 USING (id) GROUP BY 1 HAVING count(*) >= 3),
m AS (SELECT *, round(ends / (n * (n - 1)), 6) AS density, round((n * top - ends) / ((n - 1) * (n - 2)), 6) AS centralisation FROM per)
SELECT c, n AS size, density, centralisation, round(mean_cc, 6) AS clustering, CASE WHEN centralisation >= .6 THEN 'hub_and_spoke' WHEN density >= .7 THEN 'clique' WHEN top <= 2 AND mean_cc < .1 THEN 'chain' ELSE 'distributed' END AS kind, CASE WHEN centralisation >= .6 THEN first END AS hub FROM m""")
def g_cells(fx):
    kept = edges(fx)
    return graph.cells(kept, graph.components(kept).select("id", F.col("component").alias("c")))


@query()
def g_cells_communities(fx):
    """Cells of the communities; the form over components has SQL."""
    kept = edges(fx)
    return graph.cells(kept, settle(graph.communities(kept)))


def hub(fx) -> str:
    """The node of highest degree, the least of them."""
    top = fx.gdeg.orderBy(F.desc("d"), "id").select("id").first()
    return top.id if top else ""


_HUB = "(SELECT id FROM gdeg ORDER BY d DESC, id LIMIT 1)"
_BEST = """
WITH RECURSIVE gb AS MATERIALIZED (SELECT u, v, w FROM gboth), src AS MATERIALIZED {hub},
bp(id, x) USING KEY (id) AS (SELECT id, CAST(1 AS DOUBLE) FROM src UNION SELECT n.v, n.y FROM (SELECT g.v, max({value}) AS y FROM bp JOIN gb g ON g.u = bp.id GROUP BY 1) n LEFT JOIN recurring.bp r ON r.id = n.v WHERE r.id IS NULL OR n.y > r.x + 1e-12)
SELECT id, round(x, 9) AS score FROM bp"""


@query(_BEST.format(hub=_HUB, value="least(x, w)"))
def g_path_strongest(fx):
    return graph.best_paths(edges(fx), hub(fx), "widest", paths=False).select("id", F.round("score", 9).alias("score"))


@query(_BEST.format(hub=_HUB, value="x * greatest(w, 1e-9)"))
def g_path_most_likely(fx):
    return graph.best_paths(edges(fx), hub(fx), "likely", paths=False).select("id", F.round("score", 9).alias("score"))


#: From the node of highest degree to the last of those four hops away: all simple paths of up to six hops, the first five.
_KPATHS = f"""
WITH RECURSIVE gb AS MATERIALIZED (SELECT u, v, w FROM gboth), src AS MATERIALIZED {_HUB},
d(id, n) USING KEY (id) AS (SELECT id, 0 FROM src UNION SELECT DISTINCT g.v, d.n + 1 FROM d JOIN gb g ON g.u = d.id LEFT JOIN recurring.d r ON r.id = g.v WHERE r.id IS NULL), dst AS MATERIALIZED (SELECT max(id) AS id FROM d WHERE n = least(4, (SELECT max(n) FROM d))),
back(id, n) USING KEY (id) AS (SELECT id, 0 FROM dst UNION SELECT DISTINCT g.v, back.n + 1 FROM back JOIN gb g ON g.u = back.id LEFT JOIN recurring.back r ON r.id = g.v WHERE r.id IS NULL),
near AS MATERIALIZED (SELECT id, n FROM back),
walk(path, id, k) AS (SELECT [id], id, 0 FROM src UNION ALL SELECT list_append(path, g.v), g.v, k + 1 FROM walk JOIN gb g ON g.u = walk.id JOIN near ON near.id = g.v WHERE walk.id <> (SELECT id FROM dst) AND NOT list_contains(path, g.v) AND k + 1 + near.n <= 9),
kp AS (SELECT path, k AS hops, array_to_string(path, '>') AS line FROM walk WHERE id = (SELECT id FROM dst) ORDER BY hops, line LIMIT 5)"""


def path_ends(fx, kept: DataFrame) -> tuple[str, str]:
    source = hub(fx)
    dist = graph.levels(kept, fx.spark.createDataFrame([(source,)], "seed string"))
    far = dist.agg(F.max("dist")).first()[0] or 0
    last = dist.where(F.col("dist") == min(4, far)).agg(F.max("id")).first()[0]
    return source, last or ""


@query(_KPATHS + " SELECT hops, line AS path FROM kp")
def g_path_shortest(fx):
    kept = edges(fx)
    return graph.shortest_paths(kept, *path_ends(fx, kept), 5)


@query(_KPATHS + """, e AS (SELECT line, path[i] AS a, path[i + 1] AS b FROM (SELECT line, path, unnest(range(1, len(path))) AS i FROM kp))
SELECT line AS path, max(hops) AS length, round(CAST(product(w) AS DOUBLE), 6) AS score, round(min(w), 6) AS bottleneck FROM kp JOIN e USING (line) JOIN gb ON gb.u = a AND gb.v = b GROUP BY 1""")
def g_path_assemble(fx):
    kept = edges(fx)
    found = graph.shortest_paths(kept, *path_ends(fx, kept), 5)
    return graph.assemble(found.select(F.col("path").alias("path_id"), F.split("path", ">").alias("path")), kept, "likely").drop("path_id")


@query("""
WITH RECURSIVE gb AS MATERIALIZED (SELECT u, v FROM gboth), near AS MATERIALIZED (SELECT id AS seed, id AS x FROM gnodes UNION SELECT u, v FROM gb),
own AS MATERIALIZED (SELECT DISTINCT seed, u, v, greatest(w, 1e-9) AS w FROM near JOIN gedges ON u = x OR v = x), o AS MATERIALIZED (SELECT seed, u, sum(w) AS t FROM own GROUP BY 1, 2), sh AS MATERIALIZED (SELECT seed, own.u, v, w / t AS p FROM own JOIN o USING (seed, u)),
ids AS MATERIALIZED (SELECT i.seed, i.id, count(*) OVER (PARTITION BY i.seed) AS n, o.u IS NULL AS dangling FROM (SELECT seed, u AS id FROM own UNION SELECT seed, v FROM own) i LEFT JOIN o ON o.seed = i.seed AND o.u = i.id),
pr(k, seed, id, x) AS (SELECT 0, seed, id, 1 / n FROM ids UNION ALL SELECT r.k, r.seed, r.id, .15 / r.n + .85 * l.loose / r.n + .85 * coalesce(f.got, 0) FROM (SELECT k + 1 AS k, pr.seed, pr.id, n FROM pr JOIN ids USING (seed, id) WHERE k < 60) r JOIN (SELECT pr.seed, sum(CASE WHEN dangling THEN x ELSE 0 END) AS loose FROM pr JOIN ids USING (seed, id) GROUP BY 1) l ON l.seed = r.seed LEFT JOIN (SELECT sh.seed, sh.v, sum(p * x) AS got FROM pr JOIN sh ON sh.seed = pr.seed AND sh.u = pr.id GROUP BY 1, 2) f ON f.seed = r.seed AND f.v = r.id)
SELECT pr.seed, n AS nodes, round((SELECT d FROM gdeg WHERE gdeg.id = pr.seed) / (n - 1), 4) AS degree_centrality, round(x, 4) AS pagerank FROM pr JOIN ids ON ids.seed = pr.seed AND ids.id = pr.id WHERE k = 60 AND pr.id = pr.seed""")
def g_ego_influence(fx):
    return graph.ego_influence(edges(fx), fx.gnodes.select(F.col("id").alias("seed")))


@query("""
WITH RECURSIVE walk(seed, id, d) AS (SELECT id, id, 0 FROM gnodes UNION SELECT walk.seed, gboth.v, walk.d + 1 FROM walk JOIN gboth ON gboth.u = walk.id WHERE walk.d < 3)
SELECT seed, id, min(d) AS dist FROM walk GROUP BY 1, 2""")
def flt_ego(fx):
    return graph.ego(edges(fx), fx.gnodes.select(F.col("id").alias("seed")), 3)
