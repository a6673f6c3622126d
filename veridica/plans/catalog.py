"""Registered queries of the engine, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridica.functions import text
from veridica.operators import entities as en
from veridica.operators import evidence as ev
from veridica.operators import geo, governance, graph, identity, merging, sweep, vectors
from veridica.operators.frames import settle
from veridica.plans.fixture import Fixture, ctes, load
from veridica.sources import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[Fixture], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(load(spark, sf_dir))
        if sql:
            ORACLE_SQL[key] = ctes(sql)
        return f

    return add


def edges(fx: Fixture) -> DataFrame:
    """The structure operators' graph, written once: it is a self join of line items."""
    return settle(fx.gedges)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = load(spark, sf_dir)
    ranked = graph.pagerank(edges(fx), max_rounds=30).orderBy(F.desc("score"), "id").limit(25)
    scores = ev.confidence(fx.evidence, "entity_id").withColumnRenamed("entity_id", "id").withColumnRenamed("score", "confidence")
    return ranked.join(scores, "id", "left").select("id", F.round("score", 6).alias("pagerank"), "confidence", ev.estimative_label("confidence").alias("estimate"))


# evidence

_CONF = """
SELECT {k}, round(CASE WHEN s + c > 0 THEN s / (s + c) * (1 - exp(-(s + c))) ELSE 0 END, 4) AS score, round(s, 4) AS support_mass, round(c, 4) AS contradict_mass, supports, contradicts, neutral, contradicts > 0 AS is_contradicted, source_count
FROM (SELECT {k}, coalesce(sum(CASE WHEN ok AND stance = 'supports' THEN r END), 0) AS s, coalesce(sum(CASE WHEN ok AND stance = 'contradicts' THEN r END), 0) AS c,
  count(*) FILTER (WHERE ok AND stance = 'supports') AS supports, count(*) FILTER (WHERE ok AND stance = 'contradicts') AS contradicts, count(*) FILTER (WHERE ok AND stance = 'neutral') AS neutral, count(*) AS source_count
  FROM (SELECT *, verification_status = 'verified' AS ok, least(greatest(reliability_score, 0), 1) AS r FROM evidence) GROUP BY {k})"""


@query(_CONF.format(k="relationship_id"))
def agg_confidence_rel(fx):
    return ev.confidence(fx.evidence, "relationship_id")


@query(_CONF.format(k="entity_id"))
def agg_confidence_entity(fx):
    return ev.confidence(fx.evidence, "entity_id")


@query("""
WITH g AS (SELECT source_reliability, info_credibility, count(*) AS n FROM evidence GROUP BY 1, 2)
SELECT source_reliability || info_credibility AS code, n, round(sqrt(CASE source_reliability WHEN 'A' THEN 1 WHEN 'B' THEN .8 WHEN 'C' THEN .6 WHEN 'D' THEN .4 WHEN 'E' THEN .1 WHEN 'F' THEN .5 END * CASE info_credibility WHEN 1 THEN 1 WHEN 2 THEN .8 WHEN 3 THEN .6 WHEN 4 THEN .4 WHEN 5 THEN .1 WHEN 6 THEN .5 END), 4) AS weight
FROM g""")
def agg_admiralty(fx):
    return fx.evidence.groupBy("source_reliability", "info_credibility").agg(F.count("*").alias("n")).select(ev.admiralty_code().alias("code"), "n", ev.admiralty_weight().alias("weight"))


@query(f"""
SELECT entity_id, score, CASE WHEN score < .05 THEN 'almost no chance' WHEN score < .2 THEN 'very unlikely' WHEN score < .45 THEN 'unlikely' WHEN score < .55 THEN 'roughly even chance' WHEN score < .8 THEN 'likely' WHEN score < .95 THEN 'very likely' ELSE 'almost certain' END AS estimate,
       CASE WHEN support_mass + contradict_mass >= 2.5 AND NOT is_contradicted THEN 'high' WHEN support_mass + contradict_mass >= 1 THEN 'moderate' ELSE 'low' END AS analytic_confidence
FROM ({_CONF.format(k="entity_id")})""")
def agg_estimative(fx):
    return ev.confidence(fx.evidence, "entity_id").select("entity_id", "score", ev.estimative_label("score").alias("estimate"), ev.analytic_confidence().alias("analytic_confidence"))


_CELLS = "SELECT analysis_id, hypothesis_id, item_id, arg_max(consistency, rev) AS consistency FROM ach_ratings GROUP BY 1, 2, 3"


@query(_CELLS)
def agg_ach_upsert(fx):
    return ev.latest_ratings(fx.ach_ratings)


@query(f"""
WITH s AS (SELECT analysis_id, hypothesis_id, round(sum(CASE consistency WHEN 'inconsistent' THEN 2 * weight WHEN 'neutral' THEN .5 * weight ELSE 0 END), 4) AS inconsistency,
  count(*) FILTER (WHERE consistency = 'consistent') AS consistent, count(*) FILTER (WHERE consistency = 'inconsistent') AS inconsistent, count(*) FILTER (WHERE consistency = 'neutral') AS neutral, count(*) FILTER (WHERE consistency = 'na') AS na
  FROM ({_CELLS}) JOIN ach_items USING (analysis_id, item_id) GROUP BY 1, 2)
SELECT *, rank = 1 AS most_likely FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY inconsistency, consistent DESC, hypothesis_id) AS rank FROM s)""")
def agg_ach_hypotheses(fx):
    return ev.ach_hypotheses(fx.ach_ratings, fx.ach_items)


@query(f"""
SELECT analysis_id, item_id, ratings, CASE WHEN ratings <= 1 THEN 0 ELSE round(weight * (1 - top / ratings), 4) END AS diagnosticity
FROM (SELECT analysis_id, item_id, CAST(sum(n) AS BIGINT) AS ratings, max(n) AS top FROM (SELECT analysis_id, item_id, consistency, count(*) AS n FROM ({_CELLS}) GROUP BY 1, 2, 3) GROUP BY 1, 2) JOIN ach_items USING (analysis_id, item_id)""")
def agg_ach_diagnosticity(fx):
    return ev.ach_diagnosticity(fx.ach_ratings, fx.ach_items)


@query("SELECT entity_id AS id, count(*) AS n FROM evidence WHERE verification_status = 'verified' AND stance = 'contradicts' GROUP BY 1")
def agg_distinct_evidence_targets(fx):
    return fx.evidence.where("verification_status = 'verified' and stance = 'contradicts'").groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n"))


@query("SELECT quantile_cont(d, .8) AS p80, quantile_cont(d, .95) AS p95 FROM gdeg")
def agg_quantile(fx):
    return fx.gdeg.agg(F.percentile("d", F.lit(0.8)).alias("p80"), F.percentile("d", F.lit(0.95)).alias("p95"))


# entities


@query("""
WITH f AS (SELECT type, classification, CASE WHEN confidence_score < .2 THEN '0.0–0.2' WHEN confidence_score < .4 THEN '0.2–0.4' WHEN confidence_score < .6 THEN '0.4–0.6' WHEN confidence_score < .8 THEN '0.6–0.8' ELSE '0.8–1.0' END AS band,
  CASE WHEN is_ai_generated THEN 'ai_generated' ELSE 'analyst_entered' END AS prov, strftime(created_on, '%Y-%m') AS month FROM ents)
SELECT 'type' AS facet, type AS value, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'classification', classification, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'confidence', band, count(*) FROM f GROUP BY 2
UNION ALL SELECT 'provenance', prov, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'month', month, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM f""")
def agg_facets(fx):
    return en.facets(fx.ents)


INC = "(SELECT source_id AS id, target_id AS other, true AS outgoing, id AS rel_id, type, confidence_score, start_date, end_date FROM rels UNION ALL SELECT target_id, source_id, false, id, type, confidence_score, start_date, end_date FROM rels WHERE source_id <> target_id)"


@query(f"SELECT id, type, count(*) AS n FROM {INC} GROUP BY 1, 2")
def agg_connections_by_type(fx):
    return en.connections_by_type(fx.rels)


@query("SELECT type, count(*) AS n FROM ents GROUP BY 1")
def agg_count(fx):
    return fx.ents.groupBy("type").agg(F.count("*").alias("n"))


@query("""
SELECT c.case_id, title, priority, coalesce(i.n, 0) AS items, coalesce(t.n, 0) AS tasks, coalesce(t.o, 0) AS open_tasks FROM cases c
LEFT JOIN (SELECT case_id, count(*) AS n FROM case_items GROUP BY 1) i USING (case_id) LEFT JOIN (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE status = 'open') AS o FROM tasks GROUP BY 1) t USING (case_id)""")
def agg_case_overview(fx):
    return en.case_overview(fx.cases, fx.case_items, fx.tasks)


@query("SELECT id, name, created_on FROM ents WHERE type = 'person' AND name ILIKE '%1%' AND classification IN ('unclassified', 'official', 'confidential') ORDER BY created_on DESC, id LIMIT 50 OFFSET 10")
def flt_entities(fx):
    """A page of the people with a 1 in their name that a clearance of 2 may see; access is filtered before the limit."""
    return en.list_entities(fx.ents.where(governance.rank() <= 2), "person", "1", 10, 50).select("id", "name", "created_on")


@query("SELECT DISTINCT id, type FROM rels WHERE (source_id = 'S1' OR target_id = 'S1') AND type IN ('OWNS', 'MANAGES')")
def flt_relationships(fx):
    return en.incident(fx.rels).where("id = 'S1' and type in ('OWNS', 'MANAGES')").select(F.col("rel_id").alias("id"), "type").distinct()


@query("SELECT least(source_id, target_id) AS u, greatest(source_id, target_id) AS v, max(confidence_score) AS w FROM rels WHERE type IN ('OWNS', 'ASSOCIATED_WITH') AND confidence_score >= 0.5 AND source_id IN (SELECT id FROM ents) AND target_id IN (SELECT id FROM ents) AND source_id <> target_id GROUP BY 1, 2")
def flt_graph(fx):
    return graph.view(fx.rels, fx.ents, rel_types=["OWNS", "ASSOCIATED_WITH"], min_confidence=0.5)[1]


@query(f"SELECT r.id, rel_id, other, e.name AS other_name, e.type AS other_type, outgoing FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rel_id, outgoing) AS rn FROM {INC}) r JOIN ents e ON e.id = other WHERE rn <= 20")
def flt_neighbors(fx):
    return en.neighbors(fx.rels, fx.ents, 20)


@query("""
WITH c AS (SELECT DATE '1992-01-01' + CAST(45 * i AS INT) AS cutoff FROM range(60) t(i))
SELECT cutoff, count(*) AS visible, count(*) FILTER (WHERE end_date < cutoff) AS ended FROM rels JOIN c ON start_date IS NULL OR start_date <= cutoff GROUP BY 1""")
def flt_as_of(fx):
    cutoffs = fx.spark.range(60).select((F.lit("1992-01-01").cast("date") + (F.col("id") * 45).cast("int")).alias("cutoff"))
    return sweep.as_of(fx.rels, cutoffs)


@query("SELECT id, name FROM watch ORDER BY name, id LIMIT 20 OFFSET 2")
def flt_watchlist(fx):
    return fx.watch.select("id", "name").orderBy("name", "id").offset(2).limit(20)


@query("SELECT analysis_id, item_id, weight FROM ach_items ORDER BY analysis_id DESC, item_id LIMIT 60 OFFSET 5")
def flt_ach(fx):
    """Items of the analyses, newest analysis first, a page of them."""
    return fx.ach_items.select("analysis_id", "item_id", "weight").orderBy(F.desc("analysis_id"), "item_id").offset(5).limit(60)


@query("SELECT task_id, case_id, due FROM tasks WHERE assignee = 3 AND status = 'open'")
def flt_tasks(fx):
    return fx.tasks.where("assignee = 3 and status = 'open'").select("task_id", "case_id", "due")


@query("SELECT id, confidence_score AS score FROM ents WHERE type <> 'event' ORDER BY confidence_score DESC, id LIMIT 100")
def prj_topk(fx):
    return en.top_k(fx.ents.where("type <> 'event'").select("id", F.col("confidence_score").alias("score")), "score", 100)


#: Relationships from both ends, with the far one; self loops are none.
_FAR = """f AS (SELECT i.*, e.name AS title, e.type AS ot FROM (SELECT source_id AS id, target_id AS other, true AS outgoing, id AS rel_id, type, confidence_score, is_ai_generated FROM rels UNION ALL SELECT target_id, source_id, false, id, type, confidence_score, is_ai_generated FROM rels) i JOIN ents e ON e.id = i.other WHERE i.id <> i.other)"""


@query(f"""WITH {_FAR},
l AS (SELECT id, unnest(list_filter(['connections', CASE WHEN ot = 'event' THEN 'events' END, CASE WHEN ot = 'location' THEN 'locations' END, CASE WHEN ot = 'document' THEN 'documents' END, CASE WHEN type = 'PARTNER_OF' THEN 'partners' END,
  CASE WHEN outgoing AND ot IN ('organization', 'company', 'government_agency') AND type IN ('WORKS_FOR', 'MEMBER_OF', 'FOUNDED', 'MANAGES') THEN 'organizations' END, CASE WHEN NOT outgoing AND ot = 'person' AND type IN ('WORKS_FOR', 'MEMBER_OF') THEN 'members' END,
  CASE WHEN ot IN ('organization', 'company', 'government_agency', 'person', 'asset') THEN 'related' END], lambda x: x IS NOT NULL)) AS section, other AS ref, title, rel_id, type AS rel_type, outgoing, confidence_score AS confidence, is_ai_generated FROM f),
own AS (SELECT entity_id AS id, source AS title FROM evidence WHERE entity_id IN (SELECT id FROM ents)),
s AS (SELECT DISTINCT id, title FROM own WHERE title <> '' AND NOT EXISTS (SELECT 1 FROM f WHERE f.id = own.id AND f.title = own.title AND ot = 'document'))
SELECT *, CAST(NULL AS BIGINT) AS n FROM l UNION ALL SELECT id, 'documents', NULL, title, NULL, NULL, NULL, NULL, NULL, NULL FROM s
UNION ALL SELECT id, 'total_connections', NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*) FROM {INC} WHERE id IN (SELECT id FROM ents) GROUP BY 1
UNION ALL SELECT id, 'total_evidence', NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*) FROM own GROUP BY 1
UNION ALL SELECT id, 'total_documents', NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*) FROM (SELECT id FROM f WHERE ot = 'document' UNION ALL SELECT id FROM s) GROUP BY 1""")
def dsh_sections(fx):
    return en.dashboard(fx.rels, fx.ents, fx.evidence)


@query(f"""WITH {_FAR},
g AS (SELECT entity_id AS id, entity_id || '/E' || row_number() OVER (PARTITION BY entity_id ORDER BY relationship_id, source, stance, verification_status) AS evidence_id, relationship_id AS title, source, stance, coalesce(verification_status = 'verified', false) AS verified FROM evidence WHERE entity_id IN (SELECT id FROM ents)),
d AS (SELECT DISTINCT id, other, title FROM f WHERE ot = 'document' AND id IN (SELECT id FROM ents)),
n AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE verified) AS v FROM g GROUP BY 1), o AS (SELECT id, count(DISTINCT s) AS sources FROM (SELECT id, source AS s FROM g WHERE source <> '' UNION ALL SELECT id, title FROM d) GROUP BY 1)
SELECT id, 'entity' AS item, id AS node, CAST(NULL AS VARCHAR) AS target, name AS label, is_ai_generated AS ai_generated, CAST(NULL AS BOOLEAN) AS verified FROM ents UNION ALL SELECT id, 'evidence', evidence_id, NULL, title, NULL, verified FROM g
UNION ALL SELECT DISTINCT id, 'document', 'doc:' || source, NULL, source, NULL, NULL FROM g WHERE source <> '' UNION ALL SELECT id, 'document', other, NULL, title, NULL, NULL FROM d
UNION ALL SELECT id, 'edge', evidence_id, id, stance, NULL, NULL FROM g UNION ALL SELECT id, 'edge', 'doc:' || source, evidence_id, 'source_of', NULL, NULL FROM g WHERE source <> '' UNION ALL SELECT id, 'edge', other, id, 'mentions', NULL, NULL FROM d
UNION ALL SELECT id, 'summary', NULL, NULL, name || ' is ' || CASE WHEN is_ai_generated THEN 'AI-extracted' ELSE 'analyst-entered' END || '; backed by ' || coalesce(n, 0) || ' evidence item(s) (' || coalesce(v, 0) || ' verified) from ' || coalesce(sources, 0) || ' source(s).', NULL, NULL FROM ents LEFT JOIN n USING (id) LEFT JOIN o USING (id)""")
def lin_lineage(fx):
    return en.provenance(fx.ents, fx.rels, fx.evidence.withColumnRenamed("relationship_id", "title"))


@query(f"""
SELECT r.id, string_agg(CASE WHEN outgoing THEN '-> ' ELSE '<- ' END || r.type || ' ' || e.name, chr(10) ORDER BY rn) AS context FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rel_id, outgoing) AS rn FROM {INC}) r JOIN ents e ON e.id = other WHERE rn <= 20 GROUP BY 1""")
def ctx_entity_summary(fx):
    return en.context_lines(fx.rels, fx.ents)


@query("""
SELECT 'added_entities' AS change, id FROM ents WHERE created_on >= DATE '2022-01-01' UNION ALL SELECT 'added_relationships', id FROM rels WHERE created_on >= DATE '2022-01-01'
UNION ALL SELECT 'modified_entities', id FROM ents WHERE updated_on >= DATE '2022-01-01' AND created_on < DATE '2022-01-01' UNION ALL SELECT 'modified_relationships', id FROM rels WHERE updated_on >= DATE '2022-01-01' AND created_on < DATE '2022-01-01'
UNION ALL SELECT 'removed_' || target_table, CAST(id AS VARCHAR) FROM audit WHERE action = 'delete' AND target_table IN ('entities', 'relationships') AND ts >= DATE '2022-01-01'""")
def tim_diff(fx):
    return en.diff(fx.ents, fx.rels, fx.audit, "2022-01-01")


# geo and time


@query("""
SELECT id, coalesce(lat, p.plat) AS lat, coalesce(lon, p.plon) AS lon, CASE WHEN lat IS NOT NULL THEN id ELSE p.place END AS place FROM ents LEFT JOIN
(SELECT r.source_id AS id, arg_min(l.id, (r.created_on, r.id)) AS place, arg_min(l.lat, (r.created_on, r.id)) AS plat, arg_min(l.lon, (r.created_on, r.id)) AS plon FROM rels r JOIN ents l ON l.id = r.target_id AND l.lat IS NOT NULL WHERE r.type = 'LOCATED_IN' GROUP BY 1) p USING (id)
WHERE coalesce(lat, p.plat) IS NOT NULL""")
def geo_map(fx):
    return geo.placements(fx.ents, fx.rels)


_VISITS = """(SELECT source_id AS actor, target_id AS place, start_date AS day FROM rels WHERE type = 'LOCATED_IN' AND source_id IN (SELECT id FROM ents WHERE type IN ('person', 'company', 'asset'))
UNION ALL SELECT a.source_id, l.place, coalesce(e.event_date, a.start_date) FROM rels a JOIN ents e ON e.id = a.target_id AND e.type = 'event' JOIN (SELECT source_id, arg_max(target_id, (created_on, id)) AS place FROM rels WHERE type = 'LOCATED_IN' GROUP BY 1) l ON l.source_id = a.target_id WHERE a.type = 'PARTICIPATED_IN')"""


@query(f"SELECT actor, place, day FROM {_VISITS}")
def geo_visits(fx):
    return geo.visits(fx.ents, fx.rels)


@query("SELECT a.id AS a, b.id AS b, round(2 * 6371 * asin(sqrt(least(1, greatest(0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))), 3) AS km FROM ents a JOIN ents b ON a.lat IS NOT NULL AND b.lat IS NOT NULL AND a.k + 1 = b.k")
def geo_haversine(fx):
    p = fx.ents.where("lat is not null").select("id", "lat", "lon", "k")
    a, b = (p.select(*[F.col(c).alias(f"{c}_{x}") for c in p.columns]) for x in "ab")
    return a.join(b, F.col("k_a") + 1 == F.col("k_b")).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), geo.haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")).alias("km"))


@query("SELECT event_id, CASE WHEN abs(x) <= 90 AND abs(y) <= 180 THEN round(x, 6) END AS lat, CASE WHEN abs(x) <= 90 AND abs(y) <= 180 THEN round(y, 6) END AS lon FROM (SELECT event_id, CAST(event_id % 120 AS DOUBLE) AS x, CAST(user_id % 200 AS DOUBLE) AS y FROM events)")
def geo_coords(fx):
    x, y = (F.col("event_id") % 120).cast("string"), (F.col("user_id") % 200).cast("string")
    props = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("coordinates"), F.concat(F.lit("["), x, F.lit(", "), y, F.lit("]")))).when(F.col("event_id") % 3 == 1, F.create_map(F.lit("lat"), x, F.lit("lng"), y)).otherwise(F.create_map(F.lit("latitude"), x, F.lit("long"), y))
    lat, lon = geo.coords("props")
    return fx.events.select("event_id", props.alias("props")).select("event_id", lat.alias("lat"), lon.alias("lon"))


@query(f"""
WITH v AS MATERIALIZED (SELECT place, actor, day FROM {_VISITS} WHERE place IS NOT NULL), m AS (SELECT place, actor, count(*) AS n FROM v GROUP BY 1, 2),
o AS (SELECT DISTINCT x.place, x.actor AS a, y.actor AS b FROM v x JOIN v y ON x.place = y.place AND x.actor < y.actor AND abs(date_diff('day', x.day, y.day)) <= 2)
SELECT x.actor AS a, y.actor AS b, x.place, x.n * y.n AS meetings, o.a IS NOT NULL AS overlapping, k.a2 IS NOT NULL AS connected, CAST(x.n * y.n * CASE WHEN o.a IS NOT NULL THEN 2 ELSE 1 END AS DOUBLE) AS score FROM m x JOIN m y ON x.place = y.place AND x.actor < y.actor
LEFT JOIN o ON o.place = x.place AND o.a = x.actor AND o.b = y.actor LEFT JOIN (SELECT DISTINCT least(source_id, target_id) AS a2, greatest(source_id, target_id) AS b2 FROM rels) k ON x.actor = a2 AND y.actor = b2""")
def geo_colocation(fx):
    return geo.copresence(fx.ents, fx.rels, 2)


_TITLE = "array_to_string(list_transform(string_split(r.type, '_'), lambda s: upper(s[1]) || lower(s[2:])), ' ') || ' — ' || e.name"
_TIMELINE = f"""(SELECT id, event_date AS day, 'attribute' AS kind, 'Occurred' AS label FROM ents WHERE event_date IS NOT NULL
UNION ALL SELECT r.id, start_date, 'relationship', {_TITLE} FROM {INC} r JOIN ents e ON e.id = other WHERE start_date IS NOT NULL
UNION ALL SELECT r.id, end_date, 'relationship', 'End: ' || {_TITLE} FROM {INC} r JOIN ents e ON e.id = other WHERE end_date IS NOT NULL
UNION ALL SELECT r.id, e.event_date, 'event', 'Event: ' || e.name FROM {INC} r JOIN ents e ON e.id = other WHERE e.event_date IS NOT NULL)"""


@query(f"SELECT id, day, kind, label FROM {_TIMELINE}")
def tim_timeline(fx):
    return geo.timeline(fx.ents, fx.rels)


@query(f"SELECT id, day, kind, label, round(date_diff('day', min(day) OVER (), day) / greatest(date_diff('day', min(day) OVER (), max(day) OVER ()), 1) * 100, 2) AS pct FROM {_TIMELINE} WHERE kind = 'attribute'")
def tim_swimlanes(fx):
    return geo.swimlanes(geo.timeline(fx.ents, fx.rels).where("kind = 'attribute'"))


@query("SELECT id, coalesce(event_date, created_on) AS day FROM ents")
def tim_entity_date(fx):
    return fx.ents.select("id", F.coalesce("event_date", "created_on").alias("day"))


# identity


_JACCARD = "len(list_intersect(string_split({0}, ' '), string_split({1}, ' '))) / len(list_distinct(list_concat(string_split({0}, ' '), string_split({1}, ' '))))"
_SIM = "CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN 1 ELSE round(greatest(len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))), 1 - levenshtein(a, b) / greatest(length(a), length(b))), 4) END"
_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


_WHY = "CASE WHEN a = b THEN 'identical normalized name' WHEN len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))) >= 1 - levenshtein(a, b) / greatest(length(a), length(b)) THEN 'token overlap' ELSE 'string similarity' END"


# all pairs of a block by distance; of one token, or a word and a number, no other name has .85 of the tokens
@query(f"""
WITH e AS (SELECT id, type, {_NORM.format("name")} AS n FROM ents), c AS (SELECT type, substr(n, 1, 3) AS start, n, min(id) AS first, count(*) AS bearers FROM e WHERE n <> '' GROUP BY ALL),
val AS (SELECT type, start, n, n AS v FROM c UNION SELECT type, substr(n, 1, 3), n, {_NORM.format("alias")} FROM e JOIN aliases USING (id) WHERE n <> '' AND {_NORM.format("alias")} <> ''),
sh AS (SELECT type, n, sum(m - 1)::BIGINT AS n_shared, min(CASE WHEN n = lo THEN hi ELSE lo END) AS shared_with FROM (SELECT *, count(*) OVER w AS m, min(n) OVER w AS lo, max(n) OVER w AS hi FROM val WINDOW w AS (PARTITION BY type, start, v)) WHERE m > 1 GROUP BY ALL),
half AS (SELECT type, a, b, {_SIM} AS score, {_WHY} AS reason FROM (SELECT x.type, x.n AS a, y.n AS b FROM c x JOIN c y ON x.type = y.type AND x.start = y.start AND x.n < y.n
  AND CASE WHEN 1 - levenshtein(x.n, y.n) / greatest(length(x.n), length(y.n)) >= .8499 THEN true WHEN NOT contains(x.n, ' ') OR regexp_matches(x.n, '^[a-z]+ [0-9]+$') THEN false ELSE {_JACCARD.format("x.n", "y.n")} >= .8499 END) WHERE {_SIM} >= .85),
li AS (SELECT type, n, count(*) AS n_links, arg_min(struct_pack(other := other, score := score, reason := reason), struct_pack(s := -score, o := other)) AS top FROM (SELECT type, a AS n, b AS other, score, reason FROM half UNION ALL SELECT type, b, a, score, reason FROM half) GROUP BY ALL),
nb AS (SELECT DISTINCT id, other FROM {INC}),
f AS (SELECT c.*, n_shared, shared_with, n_links, top.other AS best, top.score AS score, top.reason AS reason FROM c LEFT JOIN sh USING (type, n) LEFT JOIN li USING (type, n) WHERE n_shared IS NOT NULL OR n_links IS NOT NULL),
co AS (SELECT f.type, f.n, count(*) AS k FROM f JOIN c d ON d.type = f.type AND d.n = f.best JOIN nb x ON x.id = f.first JOIN nb y ON y.id = d.first AND y.other = x.other GROUP BY ALL)
SELECT f.type, f.n, first, bearers, coalesce(n_shared, 0) AS n_shared, shared_with, coalesce(n_links, 0) AS n_links, best, score, reason, CASE WHEN best IS NOT NULL THEN coalesce(k, 0) END AS shared_neighbors FROM f LEFT JOIN co USING (type, n)""")
def er_duplicates(fx):
    return identity.duplicate_names(fx.ents, fx.aliases, fx.rels)


@query(f"SELECT type, n, min(id) AS first, count(*) AS size FROM (SELECT id, type, {_NORM.format('name')} AS n FROM ents) WHERE n <> '' GROUP BY 1, 2 HAVING count(*) > 1")
def er_similarity(fx):
    return identity.shared_names(fx.ents)


#: A merged state as rows; {to} is the entity that an entity of number k becomes.
_MERGED = """
WITH t AS (SELECT id, name, CASE WHEN type = 'asset' AND {merged} THEN 'P' || (k - k % 4) ELSE id END AS kept FROM ents),
p AS (SELECT id, 'classification' AS key, classification AS value FROM ents WHERE k % 3 = 0 UNION ALL SELECT id, 'compartment', compartment FROM ents WHERE compartment IS NOT NULL),
al AS (SELECT kept AS id, alias FROM aliases JOIN t USING (id) UNION SELECT kept, name FROM t WHERE id <> kept)
SELECT 'entity' AS section, id AS key, name AS value FROM t WHERE id = kept
UNION ALL SELECT 'alias', al.id, alias FROM al JOIN t ON t.id = al.id WHERE alias <> name
UNION ALL SELECT 'property', kept, arg_min(p.key || '=' || value, CASE WHEN id = kept THEN '' ELSE id END) FROM p JOIN t USING (id) GROUP BY kept, p.key
UNION ALL SELECT 'relationship', r.id, s.kept || '>' || d.kept FROM rels r JOIN t s ON s.id = r.source_id JOIN t d ON d.id = r.target_id WHERE s.kept <> d.kept OR r.source_id = r.target_id
UNION ALL SELECT 'evidence', kept, count(*)::VARCHAR FROM evidence JOIN t ON t.id = entity_id GROUP BY kept
UNION ALL SELECT 'annotation', annotation_id::VARCHAR, coalesce(kept, entity_id) FROM annotations LEFT JOIN t ON t.id = entity_id"""


def merge_state(fx) -> dict[str, DataFrame]:
    pair = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("key"), value.alias("value")))
    held = F.array_compact(F.array(pair("classification", F.when(F.col("k") % 3 == 0, F.col("classification"))), pair("compartment", F.col("compartment"))))
    return {
        "entities": fx.ents.select("id", "type", "name"),
        "aliases": fx.aliases,
        "properties": fx.ents.select("id", F.explode(held).alias("p")).select("id", "p.*"),
        "relationships": settle(fx.rels.select("id", "source_id", "target_id")),
        "evidence": settle(fx.evidence.select("entity_id").withColumn("evidence_id", F.monotonically_increasing_id())),
        "annotations": fx.annotations.select("annotation_id", "entity_id"),
    }


def merge_pairs(fx) -> DataFrame:
    """Chains of three assets into a fourth, and pairs that are refused."""
    k = F.col("k")
    chains = fx.ents.where("type = 'asset' and k % 4 > 0").select(F.concat(F.lit("P"), F.when(k % 4 == 3, k - 1).otherwise(k - k % 2 - F.when(k % 4 == 2, 2).otherwise(0))).alias("kept"), F.col("id").alias("merged"))
    wrong = fx.ents.where("type = 'person' and k % 50 = 1").select(F.concat(F.lit("P"), "k").alias("kept"), F.col("id").alias("merged"))
    return chains.unionByName(wrong).unionByName(wrong.select("merged", F.concat(F.lit("X"), "merged")).toDF("kept", "merged")).unionByName(wrong.select("merged", "merged").toDF("kept", "merged"))


def merged_rows(state: dict[str, DataFrame]) -> DataFrame:
    line = lambda section, df, key, value: df.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("key"), value.cast("string").alias("value"))
    parts = [
        line("entity", state["entities"], "id", F.col("name")), line("property", state["properties"], "id", F.concat_ws("=", "key", "value")),
        line("alias", state["aliases"].join(state["entities"].select("id", "name"), "id").where("alias <> name"), "id", F.col("alias")),
        line("relationship", state["relationships"], "id", F.concat_ws(">", "source_id", "target_id")),
        line("evidence", state["evidence"].groupBy("entity_id").agg(F.count("*").alias("n")), "entity_id", F.col("n")), line("annotation", state["annotations"], "annotation_id", F.col("entity_id")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(_MERGED.format(merged="true"))
def er_merge(fx):
    return merged_rows(merging.merge(merge_state(fx), merge_pairs(fx))[0])


@query(_MERGED.format(merged="k % 8 >= 4") + """
UNION ALL SELECT 'refused', 'P' || p_partkey, 'undone already' FROM part WHERE p_partkey % 8 IN (1, 2, 3)""")
def er_unmerge(fx):
    """Every other group undone one by one, and what a second undo is told."""
    state, log, _ = merging.merge(merge_state(fx), merge_pairs(fx))
    which = fx.ents.where("type = 'asset' and k % 8 in (1, 2, 3)").select(F.col("id").alias("merged"))
    state, log, _ = merging.undo(state, log, which)
    again = merging.undo(state, log, which)[2]
    return merged_rows(state).unionByName(again.select(F.lit("refused").alias("section"), F.col("merged").alias("key"), F.lit("undone already").alias("value")))


_SCREEN = f"""(SELECT id, type, entry, arg_max(score, p) AS score, arg_max(reason, p) AS reason FROM (
  SELECT id, type, entry, CASE WHEN a = b THEN 3 ELSE 1 END AS p, score, reason FROM (SELECT id, type, {_NORM.format("name")} AS a FROM ents) JOIN (SELECT a, b, entry, {_SIM} AS score, {_WHY} AS reason FROM (SELECT DISTINCT {_NORM.format("name")} AS a FROM ents) CROSS JOIN (SELECT id AS entry, {_NORM.format("name")} AS b FROM watch) WHERE {_SIM} >= .8) USING (a)
  UNION ALL SELECT id, type, entry, 2, .95, 'shared name/alias' FROM (SELECT id, type, {_NORM.format("name")} AS v FROM ents UNION SELECT id, type, {_NORM.format("alias")} FROM ents JOIN aliases USING (id)) JOIN (SELECT id AS entry, {_NORM.format("name")} AS v FROM watch) USING (v) WHERE v <> '') GROUP BY ALL)"""


@query(f"SELECT {_NORM.format('name')} AS name, entry, s.score, s.reason, count(*) AS bearers FROM {_SCREEN} s JOIN ents USING (id) GROUP BY ALL")
def scr_scan(fx):
    hits = identity.screen(fx.ents, fx.watch, aliases=fx.aliases)
    return fx.ents.select("id", identity.normalized(F.col("name")).alias("name")).join(hits, "id").groupBy("name", "entry", "score", "reason").agg(F.count("*").alias("bearers"))


@query(f"""
WITH h AS (SELECT DISTINCT id, 1 AS hit FROM {_SCREEN} WHERE score >= .9),
nb AS (SELECT DISTINCT id, 1 AS near FROM {INC} WHERE other IN (SELECT id FROM h)), dg AS (SELECT id, count(*) AS degree FROM {INC} GROUP BY 1),
bad AS (SELECT DISTINCT entity_id AS id, 1 AS bad FROM evidence WHERE verification_status = 'verified' AND stance = 'contradicts')
SELECT *, CASE WHEN score >= .6 THEN 'high' WHEN score >= .3 THEN 'medium' ELSE 'low' END AS band FROM (
SELECT id, round(.4 * coalesce(hit, 0) + .2 * coalesce(near, 0) + .15 * coalesce(bad, 0) + CAST(.15 AS DOUBLE) * least(1, coalesce(degree, 0) / 10) + .1 * CASE WHEN is_ai_generated AND confidence_score < .5 THEN 1 ELSE 0 END, 4) AS score, coalesce(degree, 0) AS degree, coalesce(hit, 0) AS hit
FROM ents LEFT JOIN h USING (id) LEFT JOIN nb USING (id) LEFT JOIN bad USING (id) LEFT JOIN dg USING (id))""")
def rsk_score(fx):
    hits = identity.screen(fx.ents, fx.watch, 0.9, fx.aliases)
    bad = fx.evidence.where("verification_status = 'verified' and stance = 'contradicts'").select(F.col("entity_id").alias("id"))
    return identity.risk(fx.ents, fx.rels, hits, bad)


@query("""
WITH i AS (SELECT CASE WHEN k % 10 = 0 THEN 'r0' ELSE 'r' || k END AS ref, CASE WHEN k % 2 = 0 THEN upper(name) ELSE name || '*' END AS name, type FROM ents WHERE type = 'company'),
known AS (SELECT lower(name) AS key, type, min(id) AS known_id FROM ents GROUP BY 1, 2), tw AS (SELECT ref FROM i GROUP BY 1 HAVING count(*) > 1),
p AS (SELECT ref, coalesce(known_id, 'new:' || ref) AS id, known_id IS NOT NULL AS matched FROM i LEFT JOIN known ON key = lower(i.name) AND known.type = i.type WHERE ref NOT IN (SELECT ref FROM tw)),
e AS (SELECT 'r' || k AS s, 'r' || (k * 7 % 13) AS t FROM ents WHERE type = 'company'), j AS (SELECT s, t, a.id AS x, b.id AS y FROM e LEFT JOIN p a ON a.ref = s LEFT JOIN p b ON b.ref = t)
SELECT 'matched' AS what, count(*) AS n FROM p WHERE matched UNION ALL SELECT 'created', count(*) FROM p WHERE NOT matched UNION ALL SELECT 'edges', count(*) FROM j WHERE x <> y UNION ALL SELECT 'skipped', count(*) FROM j WHERE NOT coalesce(x <> y, false) UNION ALL SELECT 'repeated', count(*) FROM tw""")
def src_bulk_import(fx):
    companies = fx.ents.where("type = 'company'")
    incoming = companies.selectExpr("CASE WHEN k % 10 = 0 THEN 'r0' ELSE 'r' || k END AS ref", "CASE WHEN k % 2 = 0 THEN upper(name) ELSE name || '*' END AS name", "type")
    got = identity.bulk_import(incoming, companies.selectExpr("'r' || k as source_ref", "'r' || (k * 7 % 13) as target_ref"), fx.ents)
    parts = {"matched": got["entities"].where("matched"), "created": got["entities"].where("not matched"), "edges": got["edges"], "skipped": got["skipped"], "repeated": got["repeated"]}
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k, df in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("SELECT speaker, next, count(*) AS n FROM (SELECT role AS speaker, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM comms) WHERE next IS NOT NULL GROUP BY 1, 2")
def src_comms_conversations(fx):
    return corpus.replies(fx.comms)


@query("SELECT source, target, n, round(amount, 2) AS amount FROM (SELECT trim(from_address) AS source, trim(to_address) AS target, count(*) AS n, sum(amount) AS amount FROM tx WHERE trim(from_address) <> '' AND trim(to_address) <> '' AND from_address <> to_address GROUP BY 1, 2)")
def src_crypto_flow(fx):
    return corpus.flows(fx.tx).groupBy("source", "target").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


@query("SELECT program, count(*) AS entries, count(DISTINCT name) AS names FROM watch GROUP BY 1")
def src_watchlist_load(fx):
    return fx.watch.groupBy("program").agg(F.count("*").alias("entries"), F.count_distinct("name").alias("names"))


@query("SELECT upper(type[1]) || type[2:] AS label, count(*) AS n FROM ents GROUP BY 1")
def snk_projection(fx):
    return fx.ents.groupBy(corpus.label_of("type").alias("label")).agg(F.count("*").alias("n"))


# governance

_RANK = "CASE classification WHEN 'unclassified' THEN 0 WHEN 'official' THEN 1 WHEN 'confidential' THEN 2 WHEN 'secret' THEN 3 ELSE 4 END"


@query(f"SELECT user_id, type, count(*) AS n FROM ents e JOIN users u ON {_RANK} <= u.clearance AND (e.compartment IS NULL OR e.compartment = u.compartment) GROUP BY 1, 2")
def gov_abac(fx):
    return governance.accessible(fx.ents, fx.users).groupBy("user_id", "type").agg(F.count("*").alias("n"))


@query(f"SELECT case_id, e.id, CASE WHEN {_RANK} <= 2 THEN name ELSE '[REDACTED]' END AS name, {_RANK} > 2 AS redacted FROM case_items JOIN ents e ON e.id = item_id")
def gov_sanitized_export(fx):
    return governance.sanitized_export(fx.case_items, fx.ents, fx.rels, 2)[0]


@query("""
WITH p AS (SELECT id FROM ents WHERE created_on < DATE '2021-06-01' AND NOT legal_hold AND is_ai_generated)
SELECT 'purged' AS what, count(*) AS n FROM p UNION ALL SELECT 'relationships', count(*) FROM rels WHERE source_id NOT IN (SELECT id FROM p) AND target_id NOT IN (SELECT id FROM p) UNION ALL SELECT 'evidence', count(*) FROM evidence WHERE entity_id NOT IN (SELECT id FROM p)""")
def gov_retention(fx):
    parts = zip(("purged", "relationships", "evidence"), governance.retention(fx.ents, fx.rels, fx.evidence, "2021-06-01", True), strict=True)
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k, df in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("""
WITH p AS (SELECT actor_id, count(*) AS actions, count(*) FILTER (WHERE action = 'delete') AS deletes, count(*) FILTER (WHERE hour(ts) < 6 OR hour(ts) >= 22) AS off_hours, count(DISTINCT target_id) AS targets FROM audit GROUP BY 1),
s AS (SELECT *, CASE WHEN stddev_pop(actions) OVER () > 0 THEN (actions - avg(actions) OVER ()) / stddev_pop(actions) OVER () ELSE 0 END AS zz FROM p),
f AS (SELECT *, [CASE WHEN zz >= 2 THEN 'volume' END, CASE WHEN deletes >= 5 AND deletes >= .5 * actions THEN 'deletions' END, CASE WHEN off_hours >= .5 * actions AND actions >= 4 THEN 'off_hours' END] AS fl FROM s)
SELECT actor_id, actions, deletes, off_hours, targets, round(zz, 4) AS z, coalesce(array_to_string(list_filter(fl, lambda x: x IS NOT NULL), ','), '') AS flags, CASE WHEN len(list_filter(fl, lambda x: x IS NOT NULL)) >= 2 THEN 'high' WHEN len(list_filter(fl, lambda x: x IS NOT NULL)) = 1 THEN 'medium' ELSE 'low' END AS risk FROM f""")
def agg_insider(fx):
    return governance.insider(fx.audit)


def _chains(fx):
    rows = fx.audit.select("id", "actor_id", "action", "target_table", "target_id", "ts", F.to_date("ts").alias("day"))
    return governance.seal(rows, "actor_id"), rows


@query("""
SELECT actor_id, entries, mismatches, 0 AS forks, 0 AS orphans, coalesce(first - 1, entries) AS checked, broken_at, CASE WHEN mismatches > 0 THEN 'mismatch' END AS reason, mismatches = 0 AS valid
FROM (SELECT actor_id, count(*) AS entries, count(*) FILTER (WHERE id % 97 = 0) AS mismatches, min(n) FILTER (WHERE id % 97 = 0) AS first, arg_min(id, n) FILTER (WHERE id % 97 = 0) AS broken_at FROM (SELECT *, row_number() OVER (PARTITION BY actor_id ORDER BY ts, id) AS n FROM audit) GROUP BY 1)""")
def gov_audit_verify(fx):
    """Sealed chains of which every 97th entry was changed afterwards."""
    sealed = _chains(fx)[0].withColumn("action", F.when(F.col("id") % 97 == 0, "tampered").otherwise(F.col("action")))
    return governance.verify_chain(sealed, "actor_id")


@query("""
WITH RECURSIVE r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY actor_id ORDER BY ts, id) AS n FROM audit),
c(actor_id, n, h) AS (SELECT DISTINCT actor_id, CAST(0 AS BIGINT), '' FROM r UNION ALL SELECT r.actor_id, r.n, sha256('{"action": "' || action || '", "actor_id": "' || r.actor_id || '", "id": "' || id || '", "prev_hash": "' || c.h || '", "target_id": "' || target_id || '", "target_table": "' || target_table || '"}') FROM c JOIN r ON r.actor_id = c.actor_id AND r.n = c.n + 1)
SELECT actor_id, max(n) AS entries, arg_max(h, n) AS head FROM c GROUP BY 1""")
def gov_audit_seal(fx):
    return _chains(fx)[0].groupBy("actor_id").agg(F.count("*").alias("entries"), F.max_by("entry_hash", F.struct("ts", "id")).alias("head"))


# search and text

#: Slot and sign of a hashed word.
HASHED, SIGNED = "CAST('0x' || substr(md5({w}), 1, 8) AS BIGINT) % 256", "CASE WHEN substr(md5({w}), 9, 1) >= '8' THEN 1 ELSE -1 END"


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 5) AS cosine FROM embeddings JOIN q ON vec_id <> query_id)
SELECT * FROM (SELECT query_id, vec_id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def sea_knn(fx):
    return vectors.exact(fx.embeddings, fx.embeddings.where("vec_id % 100 = 0"), 10)


@query()
def sea_knn_lsh(fx):
    return vectors.nearest(fx.embeddings, fx.embeddings.where("vec_id % 100 = 0"), 10)


@query(f"""
WITH s AS (SELECT doc_id, {HASHED.format(w="w")} AS slot, sum({SIGNED.format(w="w")}) AS value FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> '')) AS w FROM documents) GROUP BY 1, 2)
SELECT doc_id, CAST(slot AS INT) AS slot, value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)) AS value FROM s WHERE value <> 0""")
def sea_embed(fx):
    return text.embed(fx.documents, "doc_id", "text")


# graph


@query("SELECT id, d AS degree, round(d / ((SELECT count(*) FROM gnodes) - 1), 6) AS score FROM gdeg")
def g_degree(fx):
    return graph.degree(fx.gedges)


@query()
def g_communities(fx):
    return graph.communities(edges(fx))


@query("""
WITH c AS (SELECT id, CAST(substr(id, 2) AS BIGINT) % 10 AS c FROM gnodes), m AS (SELECT sum(w) AS m FROM gedges),
i AS (SELECT cu.c, sum(w) AS s FROM gedges JOIN c cu ON cu.id = u JOIN c cv ON cv.id = v AND cu.c = cv.c GROUP BY 1), t AS (SELECT c, sum(w) AS t FROM gboth JOIN c ON id = u GROUP BY 1)
SELECT round(sum(coalesce(s, 0) / m - pow(t / (2 * m), 2)), 6) AS q FROM t LEFT JOIN i USING (c), m""")
def g_modularity(fx):
    return graph.modularity(fx.gedges, fx.gnodes.selectExpr("id", "cast(substr(id, 2) as bigint) % 10 as c"))


@query("""
WITH w AS (SELECT a.v AS x, b.v AS y, d FROM gboth a JOIN gboth b ON a.u = b.u AND a.v < b.v JOIN gdeg g ON g.id = a.u WHERE d > 1)
SELECT x AS a, y AS b, round(sum(1 / ln(d)), 6) AS score, count(*) AS common FROM w WHERE NOT EXISTS (SELECT 1 FROM gedges e WHERE e.u = least(x, y) AND e.v = greatest(x, y) OR e.v = least(x, y) AND e.u = greatest(x, y)) GROUP BY 1, 2 ORDER BY score DESC, a, b LIMIT 200""")
def g_adamic_adar(fx):
    return graph.adamic_adar(fx.gedges, 200)


@query("""
WITH t AS (SELECT u, sum(w) AS t, max(w) AS m, count(*) AS n FROM gboth GROUP BY 1), p AS (SELECT b.u, b.v, CASE WHEN t > 0 THEN w / t ELSE 0 END AS p, CASE WHEN m > 0 THEN w / m ELSE 0 END AS r FROM gboth b JOIN t USING (u)),
q AS (SELECT a.u, b.v, sum(a.p * b.p) AS q FROM p a JOIN p b ON a.v = b.u WHERE a.u <> b.v GROUP BY 1, 2), c AS (SELECT p.u, sum(pow(p.p + coalesce(q, 0), 2)) AS c FROM p LEFT JOIN q ON q.u = p.u AND q.v = p.v GROUP BY 1),
red AS (SELECT a.u, sum(a.p * b.r) AS red FROM p a JOIN p b ON b.v = a.v JOIN p e ON e.u = a.u AND e.v = b.u GROUP BY 1)
SELECT c.u AS id, round(c, 6) AS "constraint", round(n - coalesce(red, 0), 6) AS effective_size FROM c JOIN t USING (u) LEFT JOIN red USING (u)""")
def g_constraint(fx):
    return graph.holes(fx.gedges)


ORACLE_SQL["g_effective_size"] = f"SELECT id, effective_size FROM ({ORACLE_SQL['g_constraint']})"


@query()
def g_effective_size(fx):
    return graph.holes(fx.gedges).select("id", "effective_size")


_TRI = "(SELECT a.u AS x, a.v AS y, b.v AS z FROM (SELECT least(u, v) AS u, greatest(u, v) AS v FROM gedges) a JOIN (SELECT least(u, v) AS u, greatest(u, v) AS v FROM gedges) b ON a.v = b.u JOIN (SELECT least(u, v) AS u, greatest(u, v) AS v FROM gedges) c ON c.u = a.u AND c.v = b.v)"


@query(f"SELECT x, y, z FROM {_TRI}")
def g_triangles(fx):
    return graph.triangles(fx.gedges)


@query(f"SELECT g.id, d AS degree, coalesce(n, 0) AS triangles, CASE WHEN d > 1 THEN round(2 * coalesce(n, 0) / (d * (d - 1)), 6) ELSE 0 END AS clustering FROM gdeg g LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT x AS id FROM {_TRI} UNION ALL SELECT y FROM {_TRI} UNION ALL SELECT z FROM {_TRI}) GROUP BY 1) t USING (id)")
def g_clustering(fx):
    return graph.clustering(fx.gedges)


@query("""
WITH RECURSIVE reach(id, c) AS (SELECT id, id FROM gnodes UNION SELECT gboth.v, reach.c FROM reach JOIN gboth ON gboth.u = reach.id WHERE reach.c < gboth.v)
SELECT id, min(c) AS component FROM reach GROUP BY 1""")
def g_components(fx):
    return graph.components(edges(fx))


@query()
def g_influence(fx):
    return graph.influence(edges(fx), ["P1", "P2", "P3"], 100)


@query("""
WITH RECURSIVE e AS (SELECT source_id AS boss, target_id AS report FROM rels WHERE type = 'MANAGES' AND source_id <> target_id), lv(id, level) AS (SELECT boss, 0 FROM e WHERE boss NOT IN (SELECT report FROM e) UNION SELECT e.report, lv.level + 1 FROM lv JOIN e ON e.boss = lv.id)
SELECT l.id, level, b.boss AS reports_to, coalesce(s.n, 0) AS subordinates FROM (SELECT id, max(level) AS level FROM lv GROUP BY 1) l LEFT JOIN (SELECT report, min(boss) AS boss FROM e GROUP BY 1) b ON b.report = l.id LEFT JOIN (SELECT boss, count(*) AS n FROM e GROUP BY 1) s ON s.boss = l.id""")
def g_hierarchy(fx):
    return graph.hierarchy(fx.rels.where("type in ('MANAGES', 'SUPERVISES')").select(F.col("source_id").alias("boss"), F.col("target_id").alias("report")))


@query("""
WITH RECURSIVE e AS (SELECT source_id AS boss, target_id AS report FROM rels WHERE type = 'MANAGES' AND source_id <> target_id UNION SELECT target_id, source_id FROM rels WHERE type = 'MANAGES' AND source_id <> target_id AND CAST(substr(target_id, 2) AS BIGINT) % 4 = 0),
n AS (SELECT boss AS id FROM e UNION SELECT report FROM e), r AS (SELECT id FROM n WHERE id NOT IN (SELECT report FROM e)),
lv(id, level) USING KEY (id) AS (SELECT id, 0 FROM r UNION SELECT t.id, t.level FROM (SELECT e.report AS id, min(lv.level) + 1 AS level FROM lv JOIN e ON e.boss = lv.id GROUP BY 1) t LEFT JOIN recurring.lv old ON old.id = t.id WHERE old.id IS NULL)
SELECT n.id, coalesce(level, 0) AS level, b.boss AS reports_to, coalesce(s.n, 0) AS subordinates FROM n LEFT JOIN lv ON lv.id = n.id LEFT JOIN (SELECT report, min(boss) AS boss FROM e GROUP BY 1) b ON b.report = n.id LEFT JOIN (SELECT boss, count(*) AS n FROM e GROUP BY 1) s ON s.boss = n.id""")
def g_hierarchy_cycles(fx):
    """The suppliers' hierarchy with every fourth supplier also over its own boss, which closes cycles."""
    lines = fx.rels.where("type = 'MANAGES'").select(F.col("source_id").alias("boss"), F.col("target_id").alias("report"))
    again = lines.where(F.substring("report", 2, 20).cast("bigint") % 4 == 0).select(F.col("report").alias("boss"), F.col("boss").alias("report"))
    return graph.hierarchy(lines.unionByName(again))


from veridica.plans import insight, streamed, structure  # noqa: E402, F401  (they register further queries here)
