"""Registered queries over evidence, identity, text and sources, beside those of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridica.functions import ranked, text
from veridica.operators import entities as en
from veridica.operators import evidence as ev
from veridica.operators import geo, graph, identity
from veridica.operators.frames import new_path, settle
from veridica.plans.catalog import _CONF, _NORM, _SCREEN, _SIM, _TIMELINE, _VISITS, HASHED, INC, ORACLE_SQL, SIGNED, edges, query
from veridica.plans.structure import _HUB, hub
from veridica.sources import corpus, tables

# reads


@query("SELECT 'ents' AS source, type AS kind, count(*) AS n, min(id) AS first, max(id) AS last FROM ents GROUP BY 2 UNION ALL SELECT 'rels', type, count(*), min(id), max(id) FROM rels GROUP BY 2 UNION ALL SELECT 'evidence', stance, count(*), min(entity_id), max(entity_id) FROM evidence GROUP BY 2 UNION ALL SELECT 'audit', action, count(*), min(actor_id), max(actor_id) FROM audit GROUP BY 2")
def src_tables(fx):
    parts = (("ents", fx.ents, "type", "id"), ("rels", fx.rels, "type", "id"), ("evidence", fx.evidence, "stance", "entity_id"), ("audit", fx.audit, "action", "actor_id"))
    rows = [df.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last")).select(F.lit(name).alias("source"), "*") for name, df, kind, key in parts]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


#: What the tables do wrong on purpose: every 97th relationship gets a bad end or confidence, every 89th evidence row two targets or none.
_BAD = """bad AS (SELECT id, CASE WHEN n % 4 = 0 THEN target_id ELSE source_id END AS source_id, CASE WHEN n % 4 = 1 THEN target_id || '?' ELSE target_id END AS target_id, CASE WHEN n % 4 = 2 THEN confidence_score + 2 ELSE confidence_score END AS confidence_score FROM (SELECT *, length(id) + length(target_id) AS n FROM rels)),
ebad AS (SELECT CASE WHEN n % 5 > 0 THEN entity_id END AS entity_id, CASE WHEN n % 3 = 0 THEN relationship_id END AS relationship_id FROM (SELECT *, length(relationship_id) AS n FROM evidence))"""


@query(f"""WITH {_BAD}
SELECT 'relationship' AS record, id AS ref, concat_ws(',', CASE WHEN source_id = target_id THEN 'self_loop' END, CASE WHEN NOT EXISTS (SELECT 1 FROM ents WHERE ents.id = source_id) THEN 'unknown_source' END,
  CASE WHEN NOT EXISTS (SELECT 1 FROM ents WHERE ents.id = target_id) THEN 'unknown_target' END, CASE WHEN coalesce(confidence_score BETWEEN 0 AND 1, false) THEN NULL ELSE 'confidence' END) AS problems FROM bad
UNION ALL SELECT 'evidence', concat_ws(' ', entity_id, relationship_id), CASE WHEN (entity_id IS NULL) = (relationship_id IS NULL) THEN 'evidence_target' ELSE '' END FROM ebad""")
def src_edge_integrity(fx):
    """Every relationship and evidence row with what is wrong with it; valid ones have no problems."""
    n = F.length("id") + F.length("target_id")
    rels = fx.rels.select("id", F.when(n % 4 == 0, F.col("target_id")).otherwise(F.col("source_id")).alias("source_id"), F.when(n % 4 == 1, F.concat("target_id", F.lit("?"))).otherwise(F.col("target_id")).alias("target_id"), F.when(n % 4 == 2, F.col("confidence_score") + 2).otherwise(F.col("confidence_score")).alias("confidence_score"))
    k = F.length("relationship_id")
    evidence = fx.evidence.select(F.when(k % 5 > 0, F.col("entity_id")).alias("entity_id"), F.when(k % 3 == 0, F.col("relationship_id")).alias("relationship_id"))
    row = lambda record, ref, df: df.select(F.lit(record).alias("record"), ref.alias("ref"), F.array_join("problems", ",").alias("problems"))
    return row("relationship", F.col("id"), identity.checked_edges(rels, fx.ents)).unionByName(row("evidence", F.concat_ws(" ", "entity_id", "relationship_id"), identity.checked_evidence(evidence)))


@query("""SELECT event_id, list_sort(list_filter(json_keys(props), lambda x: NOT list_contains(CASE event_type WHEN 'purchase' THEN ['amount'] WHEN 'signup' THEN ['country'] ELSE ['k'] END, x))) AS unknown,
CASE WHEN event_type NOT IN ('purchase', 'signup') AND CAST(props->>'k' AS INT) < 50 THEN ['k'] ELSE CAST([] AS VARCHAR[]) END AS out_of_range FROM events""")
def src_validate_props(fx):
    """Unknown keys of a type's schema, and known ones whose value is out of range."""
    allowed = F.when(F.col("event_type") == "purchase", F.array(F.lit("amount"))).when(F.col("event_type") == "signup", F.array(F.lit("country"))).otherwise(F.array(F.lit("k")))
    props = F.from_json("props", "map<string,string>")
    small = ~F.col("event_type").isin("purchase", "signup") & (F.try_element_at(props, F.lit("k")).cast("int") < 50)
    return fx.events.select("event_id", F.array_sort(F.array_except(F.map_keys(props), allowed)).alias("unknown"), F.when(small, F.array(F.lit("k"))).otherwise(F.array().cast("array<string>")).alias("out_of_range"))


@query("SELECT source, stance, created_on, reliability_score FROM evidence WHERE entity_id = 'P7' ORDER BY created_on DESC, source, stance, reliability_score LIMIT 50")
def flt_evidence(fx):
    return fx.evidence.where("entity_id = 'P7'").select("source", "stance", "created_on", "reliability_score").orderBy(F.desc("created_on"), "source", "stance", "reliability_score").limit(50)


@query("SELECT annotation_id, kind, text, created_on FROM annotations WHERE entity_id = 'C1' AND kind IN ('note', 'dissent') ORDER BY created_on DESC, annotation_id LIMIT 50")
def flt_annotations(fx):
    return fx.annotations.where("entity_id = 'C1' and kind in ('note', 'dissent')").select("annotation_id", "kind", "text", "created_on").orderBy(F.desc("created_on"), "annotation_id").limit(50)


@query("SELECT comment_id, body FROM comments WHERE target_type = 'case' AND target_id = 3 ORDER BY created_at, comment_id")
def flt_comments(fx):
    return fx.comments.where("target_type = 'case' and target_id = 3").orderBy("created_at", "comment_id").select("comment_id", "body")


@query("SELECT merge_id, kept_id, merged_id FROM merges WHERE NOT undone ORDER BY created_on DESC, merge_id LIMIT 100")
def flt_merge_log(fx):
    return fx.merges.where("not undone").orderBy(F.desc("created_on"), "merge_id").select("merge_id", "kept_id", "merged_id").limit(100)


@query("SELECT view_id, owner, shared FROM views WHERE (owner = 2 OR shared) AND kind = 'graph'")
def flt_views(fx):
    return fx.views.where("(owner = 2 or shared) and kind = 'graph'").select("view_id", "owner", "shared")


@query("SELECT wanted, e.id, e.type FROM (SELECT DISTINCT upper(name) AS wanted FROM ents WHERE k % 100 = 0) JOIN ents e ON lower(wanted) = lower(e.name)")
def flt_name_lookup(fx):
    """Every hundredth name of any type, in capitals, looked up without case."""
    wanted = fx.ents.where("k % 100 = 0").select(F.upper("name").alias("wanted")).distinct()
    return en.by_name(fx.ents, wanted)


@query("""
SELECT entity_id, round(CASE WHEN s + c > 0 THEN s / (s + c) * (1 - exp(-(s + c))) ELSE 0 END, 4) AS score, verified FROM (SELECT entity_id, coalesce(sum(CASE WHEN st = 'verified' AND stance = 'supports' THEN r END), 0) AS s, coalesce(sum(CASE WHEN st = 'verified' AND stance = 'contradicts' THEN r END), 0) AS c, count(*) FILTER (WHERE st = 'verified') AS verified
FROM (SELECT e.entity_id, stance, least(greatest(reliability_score, 0), 1) AS r, coalesce(d.status, verification_status) AS st FROM evidence e LEFT JOIN (SELECT relationship_id, entity_id, source, arg_max(status, seq) AS status FROM decisions GROUP BY 1, 2, 3) d ON d.relationship_id = e.relationship_id AND d.entity_id = e.entity_id AND d.source = e.source) GROUP BY 1)""")
def gov_verify_evidence(fx):
    """The last decision on evidence takes effect, and the parents' confidence is computed anew."""
    last = fx.decisions.groupBy("relationship_id", "entity_id", "source").agg(F.max_by("status", "seq").alias("status"))
    decided = fx.evidence.join(last, ["relationship_id", "entity_id", "source"], "left").withColumn("verification_status", F.coalesce("status", "verification_status"))
    verified = decided.groupBy("entity_id").agg(F.count_if(F.col("verification_status") == "verified").alias("verified"))
    return ev.confidence(decided, "entity_id").select("entity_id", "score").join(verified, "entity_id")


@query(f"""
WITH v AS (SELECT actor, place, day, lat, lon, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM {_VISITS} v JOIN (SELECT id, lat, lon FROM ents) p ON p.id = v.place WINDOW w AS (PARTITION BY actor ORDER BY day NULLS LAST, place))
SELECT actor, count(*) AS visits, count(DISTINCT place) AS places, CAST(coalesce(round(sum(CAST(CASE WHEN day IS NOT NULL THEN round(2 * 6371 * asin(sqrt(least(1, greatest(0, pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2))))), 3) END AS DECIMAL(18, 3))), 1), 0) AS DOUBLE) AS km FROM v GROUP BY 1""")
def geo_pattern_of_life(fx):
    return geo.pattern_of_life(fx.ents, fx.rels)


@query("SELECT token, id, count(*) AS n FROM (SELECT id, unnest(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda t: t <> '')) AS token FROM (SELECT id, name FROM ents UNION ALL SELECT id, alias FROM aliases)) GROUP BY 1, 2")
def snk_search_index(fx):
    return text.index(fx.ents.select("id", "name").unionByName(fx.aliases.select("id", F.col("alias").alias("name"))), "id", "name")


# identity, risk, investigation


@query(f"SELECT id, type, entry, score, reason FROM {_SCREEN} WHERE score >= .85")
def scr_screen(fx):
    """Every entity with its entries of the watchlist, from .85."""
    return fx.ents.select("id", "type").join(identity.screen(fx.ents, fx.watch, 0.85, fx.aliases), "id")


ORACLE_SQL["rsk_top"] = f"SELECT id, score, band FROM ({ORACLE_SQL['rsk_score']}) ORDER BY score DESC, id LIMIT 50"


@query()
def rsk_top(fx):
    hits = identity.screen(fx.ents, fx.watch, 0.9, fx.aliases)
    bad = fx.evidence.where("verification_status = 'verified' and stance = 'contradicts'").select(F.col("entity_id").alias("id"))
    return en.top_k(identity.risk(fx.ents, fx.rels, hits, bad).select("id", "score", "band"), "score", 50)


@query(f"""
WITH e AS (SELECT id, type, {_NORM.format("name")} AS n FROM ents), dg AS (SELECT id, count(*) AS degree, bool_or(type = 'LOCATED_IN') AS located, bool_or(type IN ('WORKS_FOR', 'MEMBER_OF')) AS affiliated FROM {INC} GROUP BY 1),
hit AS (SELECT id, min(entry) AS entry FROM (SELECT *, max(score) OVER (PARTITION BY id) AS m FROM {_SCREEN} WHERE score >= .85) WHERE score = m GROUP BY 1), dup AS (SELECT type, n, count(*) AS bearers FROM e WHERE n <> '' GROUP BY 1, 2 HAVING count(*) > 1),
ct AS (SELECT entity_id AS id, bool_or(verification_status = 'verified' AND stance = 'contradicts') AS bad FROM evidence GROUP BY 1)
SELECT e.id, 'connectivity' AS kind, 'info' AS severity, coalesce(degree, 0) || ' direct relationships' AS detail FROM e LEFT JOIN dg USING (id)
UNION ALL SELECT id, 'watchlist', 'high', 'matches ' || entry FROM e JOIN hit USING (id)
UNION ALL SELECT id, 'duplicate', 'medium', bearers || ' entities bear this name' FROM e JOIN dup USING (type, n)
UNION ALL SELECT id, 'contradiction', 'high', 'verified evidence contradicts' FROM e JOIN ct USING (id) WHERE bad
UNION ALL SELECT e.id, 'gap', 'info', 'no location' FROM e LEFT JOIN dg USING (id) WHERE type = 'person' AND NOT coalesce(located, false)
UNION ALL SELECT e.id, 'gap', 'info', 'no affiliation' FROM e LEFT JOIN dg USING (id) WHERE type = 'person' AND NOT coalesce(affiliated, false)
UNION ALL SELECT e.id, 'gap', 'info', 'no evidence' FROM e LEFT JOIN ct USING (id) WHERE ct.id IS NULL""")
def inv_findings(fx):
    return identity.findings(fx.ents, fx.rels, fx.evidence, identity.screen(fx.ents, fx.watch, 0.85, fx.aliases))


@query(f"""
WITH c AS ({_CONF.format(k="entity_id")}), dg AS (SELECT id, count(*) AS degree FROM {INC} GROUP BY 1), tl AS (SELECT id, count(*) AS items FROM {_TIMELINE} GROUP BY 1), top AS (SELECT id, string_agg(name, ', ' ORDER BY rn) AS names FROM (SELECT i.id, e.name, row_number() OVER (PARTITION BY i.id ORDER BY rel_id, outgoing) AS rn FROM {INC} i JOIN ents e ON e.id = i.other) WHERE rn <= 5 GROUP BY 1)
SELECT e.id, coalesce(degree, 0) || ' connections; ' || coalesce(source_count, 0) || ' evidence items; ' || coalesce(items, 0) || ' dated items' AS scale,
  coalesce(score, 0) AS confidence, CASE WHEN coalesce(score, 0) < .05 THEN 'almost no chance' WHEN score < .2 THEN 'very unlikely' WHEN score < .45 THEN 'unlikely' WHEN score < .55 THEN 'roughly even chance' WHEN score < .8 THEN 'likely' WHEN score < .95 THEN 'very likely' ELSE 'almost certain' END AS estimate,
  coalesce(is_contradicted, false) AS disputed, names AS key_connections
FROM ents e LEFT JOIN c ON c.entity_id = e.id LEFT JOIN dg ON dg.id = e.id LEFT JOIN tl ON tl.id = e.id LEFT JOIN top ON top.id = e.id WHERE e.type IN ('asset', 'company', 'person')""")
def rpt_key_findings(fx):
    some = fx.ents.where("type in ('asset', 'company', 'person')").select("id")
    conf = ev.confidence(fx.evidence, "entity_id").select(F.col("entity_id").alias("id"), "score", "is_contradicted", "source_count")
    degree = en.incident(fx.rels).groupBy("id").agg(F.count("*").alias("degree"))
    items = geo.timeline(fx.ents, fx.rels).groupBy("id").agg(F.count("*").alias("items"))
    near = en.neighbors(fx.rels, fx.ents, 5)
    top = near.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rel_id", "outgoing", "other_name"))), lambda x: x["other_name"]), ", ").alias("key_connections"))
    rows = some.join(conf, "id", "left").join(degree, "id", "left").join(items, "id", "left").join(top, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    scale = F.concat(zero("degree"), F.lit(" connections; "), zero("source_count"), F.lit(" evidence items; "), zero("items"), F.lit(" dated items"))
    rows = rows.withColumn("confidence", F.coalesce("score", F.lit(0.0)))
    return rows.select("id", scale.alias("scale"), "confidence", ev.estimative_label("confidence").alias("estimate"), F.coalesce("is_contradicted", F.lit(False)).alias("disputed"), "key_connections")


# questions in their parsed form


@query(f"SELECT r.other AS id, e.name, e.type FROM (SELECT DISTINCT other FROM {INC} WHERE id = (SELECT min(id) FROM ents WHERE name ILIKE '%ring%')) r JOIN ents e ON e.id = r.other")
def g_nl_neighbors(fx):
    return en.neighbors_of_name(fx.rels, fx.ents, "ring")


@query("SELECT id, name, type FROM ents WHERE type = 'asset' AND name ILIKE '%ring%' ORDER BY id LIMIT 25")
def g_nl_search(fx):
    return fx.ents.where((F.col("type") == "asset") & F.col("name").ilike("%ring%")).select("id", "name", "type").orderBy("id").limit(25)


@query(f"""
WITH RECURSIVE gb AS MATERIALIZED (SELECT u, v FROM gboth), src AS MATERIALIZED {_HUB}, d(id, n) USING KEY (id) AS (SELECT id, 0 FROM src UNION SELECT DISTINCT g.v, d.n + 1 FROM d JOIN gb g ON g.u = d.id LEFT JOIN recurring.d r ON r.id = g.v WHERE r.id IS NULL),
dst AS MATERIALIZED (SELECT min(id) AS id FROM d WHERE n > 0 AND id IN (SELECT id FROM ents WHERE name ILIKE '%large%')), lim AS (SELECT n FROM d WHERE id = (SELECT id FROM dst)),
back(id, n) USING KEY (id) AS (SELECT id, 0 FROM dst UNION SELECT DISTINCT g.v, back.n + 1 FROM back JOIN gb g ON g.u = back.id LEFT JOIN recurring.back r ON r.id = g.v WHERE r.id IS NULL), near AS MATERIALIZED (SELECT id, n FROM back),
walk(path, id, k) AS (SELECT [id], id, 0 FROM src UNION ALL SELECT list_append(path, g.v), g.v, k + 1 FROM walk JOIN gb g ON g.u = walk.id JOIN near ON near.id = g.v WHERE near.n + k + 1 = (SELECT n FROM lim))
SELECT k AS hops, array_to_string(path, '>') AS path FROM walk WHERE id = (SELECT id FROM dst) ORDER BY path LIMIT 1""")
def g_nl_path(fx):
    """The shortest path from the best connected node to the first node that it reaches with `large` in its name."""
    kept, source = edges(fx), hub(fx)
    reached = graph.levels(kept, fx.spark.createDataFrame([(source,)], "seed string")).where("dist > 0").select("id")
    target = fx.ents.where(F.col("name").ilike("%large%")).join(reached, "id", "left_semi").agg(F.min("id")).first()[0]
    return graph.shortest_paths(kept, source, target or "", 1)


# search and text

_QUERIES = [("steel copper",), ("Large Brass",), ("france",), ("Customer",)]
_VALUES = "(VALUES ('steel copper'), ('Large Brass'), ('france'), ('Customer'))"


#: What stands beside an entity's name in a search: its aliases in order, and its type as the description.
_SEARCHED = """n AS (SELECT id, list_sort(list_distinct(list(alias))) AS al FROM aliases GROUP BY 1), d AS (SELECT id, name, coalesce(al, []) AS al, list_filter(string_split_regex(lower(concat_ws(' ', name, nullif(array_to_string(coalesce(al, []), ' '), ''), type)), '[^a-z0-9]+'), lambda t: t <> '') AS words FROM ents LEFT JOIN n USING (id))"""


def _hashed(key: str, table: str) -> str:
    counts = f"SELECT {key}, {HASHED.format(w='w')} AS slot, sum({SIGNED.format(w='w')}) AS v FROM (SELECT {key}, unnest(words) AS w FROM {table}) GROUP BY 1, 2"
    return f"(SELECT {key}, slot, v, sum(v * v) OVER (PARTITION BY {key}) AS n2 FROM ({counts}))"


@query(f"""
WITH q AS (SELECT DISTINCT trim(query) AS query, list_filter(string_split_regex(lower(query), '[^a-z0-9]+'), lambda t: t <> '') AS words FROM (SELECT * FROM {_VALUES} v(query) UNION ALL SELECT name FROM watch)), {_SEARCHED},
c AS (SELECT query, id, sum(a.v * b.v) / sqrt(any_value(a.n2) * any_value(b.n2)) AS s FROM {_hashed("query", "q")} a JOIN {_hashed("id", "d")} b USING (slot) GROUP BY 1, 2),
p AS (SELECT query, id, name, coalesce(len(list_intersect(q.words, d.words)) / len(list_distinct(q.words)), 0) AS l, list_max(list_transform(list_prepend(name, al), lambda x: 1 - levenshtein(lower(query), lower(x)) / greatest(length(query), length(x)))) AS f, lower(query) = lower(name) AS by_name, list_contains(list_transform(al, lambda x: lower(x)), lower(query)) AS by_alias FROM d CROSS JOIN q),
r AS (SELECT query, id, name, l, f, greatest(0, coalesce(s, 0)) AS s, by_name, by_alias FROM p LEFT JOIN c USING (query, id)),
t AS (SELECT query, id, name, round(CASE WHEN by_name OR by_alias THEN least(1, CAST(.5 AS DOUBLE) * l + CAST(.25 AS DOUBLE) * f + CAST(.25 AS DOUBLE) * s + CAST(.4 AS DOUBLE)) ELSE CAST(.5 AS DOUBLE) * l + CAST(.25 AS DOUBLE) * f + CAST(.25 AS DOUBLE) * s END, 4) AS score,
  CASE WHEN by_alias AND NOT by_name THEN 'alias' WHEN l >= greatest(f, s) THEN 'lexical' WHEN f >= s THEN 'fuzzy' ELSE 'semantic' END AS matched_on FROM r)
SELECT * FROM (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INT) AS rank, id, name, score, matched_on FROM t WHERE score >= .05) WHERE rank <= 20""")
def sea_search(fx):
    """Four phrases and every name of the watchlist, against all entities with their aliases."""
    names = fx.aliases.groupBy("id").agg(F.collect_set("alias").alias("aliases"))
    docs = fx.ents.select("id", "name", F.col("type").alias("description")).join(names, "id", "left")
    return ranked.search(docs, fx.spark.createDataFrame(_QUERIES, "query string").unionByName(fx.watch.select(F.col("name").alias("query"))))


@query(f"""
WITH q AS (SELECT query, unnest(string_split(lower(query), ' ')) AS token FROM (SELECT * FROM {_VALUES} v(query))), n AS (SELECT id, string_agg(alias, ' ') AS alias FROM aliases GROUP BY 1),
f AS (SELECT id, unnest(string_split_regex(lower(name), '[^a-z0-9]+')) AS token, CAST(3 AS DOUBLE) AS w FROM ents UNION ALL SELECT id, unnest(string_split_regex(lower(alias), '[^a-z0-9]+')), 2 FROM n UNION ALL SELECT id, unnest(string_split_regex(lower(type || ' ' || classification), '[^a-z0-9]+')), 1 FROM ents),
s AS (SELECT query, id, sum(w) AS raw FROM (SELECT query, id, token, max(w) AS w FROM f JOIN q USING (token) GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT query, id, round(raw / max(raw) OVER (PARTITION BY query), 4) AS score FROM s""")
def sea_field_boost(fx):
    names = fx.aliases.groupBy("id").agg(F.collect_list("alias").alias("aliases"))
    docs = fx.ents.select("id", "name", F.concat_ws(" ", "type", "classification").alias("description")).join(names, "id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    return text.field_boost(docs, fx.spark.createDataFrame(_QUERIES, "query string"))


@query("SELECT name, score FROM (SELECT DISTINCT name, CASE WHEN starts_with(lower(name), 'a') THEN 1.0::DOUBLE WHEN contains(lower(name), 'a') THEN 0.6::DOUBLE END AS score FROM (SELECT name FROM ents UNION ALL SELECT alias FROM aliases)) WHERE score IS NOT NULL ORDER BY score DESC, length(name), name LIMIT 20")
def sea_suggest(fx):
    return text.suggest(fx.ents.select("name").unionByName(fx.aliases.select(F.col("alias").alias("name"))), "a", 20)


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


@query(f"""
WITH q AS (SELECT question, unnest(list_distinct(list_filter(string_split_regex(lower(question), '[^a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({_STOP})))) AS t FROM (VALUES ('que la maison'), ('other thing and nothing'), ('what does the aire have')) v(question)), z AS (SELECT question, count(*) AS k FROM q GROUP BY 1),
f AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS token FROM documents), s AS (SELECT question, doc_id, count(*) AS n, min(t) AS term FROM f JOIN q ON t = token GROUP BY 1, 2),
r AS (SELECT question, doc_id, term, round(n / k, 4) AS score, row_number() OVER (PARTITION BY question ORDER BY round(n / k, 4) DESC, doc_id) AS rank FROM s JOIN z USING (question))
SELECT question, rank, doc_id, score, substr(text, greatest(instr(lower(text), term) - 40, 1), 160) AS snippet FROM r JOIN documents USING (doc_id) WHERE rank <= 10""")
def rag_retrieve(fx):
    questions = fx.spark.createDataFrame([("que la maison",), ("other thing and nothing",), ("what does the aire have",)], "question string")
    return text.retrieve(fx.documents, questions, 10)


#: The comparison doubles what stands between candidates, since its patterns take the signs around a number along.
@query(r"""
WITH t AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - page_id, url FROM pages),
v AS (SELECT id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), lambda x: lower(x))) AS email, list_distinct(list_transform(regexp_extract_all(text, '(?i)https?://[^\s)>\]"'']+'), lambda x: lower(x))) AS url,
 list_distinct(list_transform(regexp_extract_all(text, '\b0x[a-fA-F0-9]{40}\b'), lambda x: lower(x))) AS eth, list_distinct(list_transform(regexp_extract_all(text, '\b(?:bc1[a-z0-9]{25,90}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b'), lambda x: lower(x))) AS btc,
 list_distinct(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b')) AS ip, list_distinct(list_transform(regexp_extract_all(text, '\b[a-fA-F0-9]{64}\b'), lambda x: lower(x))) AS s256, list_distinct(list_transform(regexp_extract_all(text, '\b[a-fA-F0-9]{40}\b'), lambda x: lower(x))) AS s1,
 list_distinct(list_transform(regexp_extract_all(text, '\b[a-fA-F0-9]{32}\b'), lambda x: lower(x))) AS md5, list_distinct(list_transform(regexp_extract_all(text, '\b(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}\b'), lambda x: lower(x))) AS dom,
 list_distinct(regexp_extract_all(regexp_replace(text, '([^\w.\s()+-])', '\1\1', 'g'), '(?:^|[^\w.])(\+?\d[\d\s().-]{7,}\d)(?:$|[^\w.])', 1)) AS ph FROM t)
SELECT DISTINCT id, kind, value FROM (SELECT id, 'email' AS kind, unnest(email) AS value FROM v UNION ALL SELECT id, 'url', regexp_replace(unnest(url), '[.,);]+$', '') FROM v UNION ALL SELECT id, 'eth_address', unnest(eth) FROM v UNION ALL SELECT id, 'btc_address', unnest(btc) FROM v
UNION ALL SELECT id, 'ipv4', unnest(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: CAST(p AS INT) > 255)) = 0)) FROM v UNION ALL SELECT id, 'sha256', unnest(s256) FROM v UNION ALL SELECT id, 'sha1', unnest(list_filter(s1, lambda x: NOT list_contains(eth, '0x' || x))) FROM v UNION ALL SELECT id, 'md5', unnest(md5) FROM v
UNION ALL SELECT id, 'domain', unnest(list_filter(dom, lambda x: NOT list_contains(list_transform(email, lambda e: string_split(e, '@')[-1]), x) AND len(list_filter(url, lambda u: contains(u, x))) = 0)) FROM v
UNION ALL SELECT id, 'phone', trim(unnest(list_filter(ph, lambda x: length(regexp_replace(x, '\D', '', 'g')) BETWEEN 8 AND 15))) FROM v)""")
def x_selectors(fx):
    """Over the documents' texts and the pages' urls (whose ids are negative here)."""
    rows = fx.documents.select(F.col("doc_id").alias("id"), "text").unionByName(fx.pages.select((-1 - F.col("page_id")).alias("id"), F.col("url").alias("text")))
    return text.selectors(rows, "id", "text")


def claims(fx) -> DataFrame:
    """The documents' texts, and a sentence for each relationship of a person or company."""
    named = fx.rels.where("type in ('OWNS', 'MANAGES')").join(fx.ents.select(F.col("id").alias("source_id"), F.col("name").alias("a")), "source_id").join(fx.ents.select(F.col("id").alias("target_id"), F.initcap("name").alias("b")), "target_id")
    who = F.concat(F.lit("Supplier "), F.regexp_replace("a", r"\D", ""), F.lit(" Holdings"))
    said = named.select(F.col("id"), F.concat(F.lit("Dr. "), F.translate("a", "0123456789#", "abcdefghijX"), F.lit(" is the director of "), who, F.lit(". "), F.translate("a", "0123456789#", "abcdefghijX"), F.lit(" owns "), "b", F.lit(" Industries.")).alias("text"))
    return fx.documents.select(F.concat(F.lit("D"), "doc_id").alias("id"), "text").unionByName(said)


_SAID = r"""(SELECT 'D' || doc_id AS id, text FROM documents UNION ALL SELECT r.id, 'Dr. ' || translate(a.name, '0123456789#', 'abcdefghijX') || ' is the director of Supplier ' || regexp_replace(a.name, '\D', '', 'g') || ' Holdings. ' || translate(a.name, '0123456789#', 'abcdefghijX') || ' owns ' || array_to_string(list_transform(string_split(b.name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' Industries.'
FROM rels r JOIN ents a ON a.id = source_id JOIN ents b ON b.id = target_id WHERE r.type IN ('OWNS', 'MANAGES'))"""


def _sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_CLEAN = "trim(regexp_replace(regexp_replace({}, " + _sql("^[ .,;:'\"]+|[ .,;:'\"]+$") + ", '', 'g'), " + _sql(f"^(?:{text.TITLES})+") + ", ''))"
_ENDS = " UNION ALL ".join(f"SELECT id, no, '{kind}' AS relation, unnest(regexp_extract_all(quote, {_sql(f'({text._NAME}){between}({text._NAME})')}, 1)) AS s, unnest(regexp_extract_all(quote, {_sql(f'({text._NAME}){between}({text._NAME})')}, 2)) AS t, quote FROM se" for between, kind in text.TEMPLATES)


@query(f"""WITH sp AS (SELECT id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x)), lambda x: x <> '') AS q FROM {_SAID}),
se AS (SELECT id, unnest(range(0, len(q))) AS no, unnest(q) AS quote FROM sp), en AS ({_ENDS})
SELECT * FROM (SELECT id, CAST(no AS INT) AS no, relation, {_CLEAN.format("s")} AS source, {_CLEAN.format("t")} AS target, quote, CAST(.5 AS DOUBLE) AS confidence FROM en) WHERE source <> '' AND target <> '' AND lower(source) <> lower(target)""")
def x_extract_graph(fx):
    return text.extract_graph(claims(fx), "id", "text")


@query()
def src_text_ingest(fx):
    parts = text.ingest(claims(fx), "id", "text", fx.ents.select("id", "name", "type"))
    rows = [parts["entities"].select(F.lit("entity").alias("what"), F.col("entity_id").alias("id"), F.col("type").alias("a"), F.col("known").cast("string").alias("b")), parts["relationships"].select(F.lit("relationship").alias("what"), "id", F.col("source_id").alias("a"), F.col("target_id").alias("b")), parts["evidence"].select(F.lit("evidence").alias("what"), "id", F.col("entity_id").alias("a"), F.col("quote").alias("b"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT id, CASE WHEN software = 'Midjourney' THEN .7 ELSE 0 END + CASE WHEN id % 2 = 0 THEN 0 ELSE CAST(.2 AS DOUBLE) END + CASE WHEN id % 5 = 0 THEN 0 ELSE CAST(.1 AS DOUBLE) END AS score, CASE WHEN software = 'Midjourney' THEN 'high' WHEN id % 2 = 1 AND id % 5 > 0 THEN 'medium' ELSE 'low' END AS level FROM (SELECT page_id AS id, CASE WHEN page_id % 7 = 0 THEN 'Midjourney' END AS software FROM pages)".replace("SELECT id, CASE", "SELECT id, round(CASE", 1).replace("END AS score", "END, 3) AS score", 1))
def x_media_flag(fx):
    """A picture of each page: generator, camera and credentials by the page's number."""
    k = F.col("page_id")
    keys = F.concat(F.when(k % 2 == 0, F.array(F.lit("Make"))).otherwise(F.array().cast("array<string>")), F.when(k % 5 == 0, F.array(F.lit("c2pa"))).otherwise(F.array().cast("array<string>")))
    camera, c2pa = text.media_properties(F.map_from_arrays(keys, keys))
    return text.media_flag(fx.pages.select(k.alias("id"), F.when(k % 7 == 0, "Midjourney").alias("software"), camera.alias("camera"), c2pa.alias("c2pa"), F.lit("").alias("text")))


# corpora


@query("""
SELECT page_id AS feed_id, CAST(no AS INT) AS no, 'Item ' || no || ' of ' || page_id AS title, CASE WHEN (page_id + no) % 3 = 0 THEN '' ELSE url END AS summary, CASE WHEN (page_id + no) % 4 = 1 THEN '' ELSE 'http://x/' || page_id || '/' || no END AS link, CASE WHEN (page_id + no) % 5 > 0 THEN 'day ' || no END AS published, false AS rejected
FROM (SELECT page_id, trim(replace(replace(url, '&', ' '), '<', ' ')) AS url FROM pages WHERE page_id % 13 > 0) CROSS JOIN range(0, 3) r(no) UNION ALL SELECT page_id, NULL, NULL, NULL, NULL, NULL, true FROM pages WHERE page_id % 13 = 0""")
def src_feed(fx):
    """Feeds of three items, RSS and Atom in turn, made from the pages; fields are missing, and some feeds end too early."""
    url = F.translate("url", "&<", "  ")
    unless = lambda no, rest, of, text: F.when((F.col("page_id") + no) % of == rest, "").otherwise(text)
    title = lambda no: F.concat(F.lit(f"<title>Item {no} of "), "page_id", F.lit("</title>"))
    body = lambda no, tag: unless(no, 0, 3, F.concat(F.lit(f"<{tag}>"), url, F.lit(f"</{tag}>")))
    day = lambda no, tag: unless(no, 0, 5, F.lit(f"<{tag}> day {no}</{tag}>"))
    item = lambda no: F.concat(F.lit("<item>"), title(no), body(no, "description"), unless(no, 1, 4, F.concat(F.lit("<link>http://x/"), "page_id", F.lit(f"/{no}</link>"))), day(no, "pubDate"), F.lit("</item>"))
    entry = lambda no: F.concat(F.lit("<entry>"), title(no), body(no, "summary" if no else "content"), unless(no, 1, 4, F.concat(F.lit('<link href="http://x/'), "page_id", F.lit(f'/{no}"/>'))), day(no, "updated"), F.lit("</entry>"))
    end = lambda text: F.when(F.col("page_id") % 13 > 0, text).otherwise("")
    rss = F.concat(F.lit("<rss><channel>"), *[item(n) for n in range(3)], end("</channel></rss>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), *[entry(n) for n in range(3)], end("</feed>"))
    return corpus.feed_items(fx.pages.select(F.col("page_id").alias("feed_id"), F.when(F.col("page_id") % 2 == 0, rss).otherwise(atom).alias("xml")))


@query("SELECT conv_id * 1000 + turn AS mail_id, role || conv_id || '@x.org' AS sender, r AS recipient, '' AS recipient_name, 'Turn ' || turn AS subject FROM (SELECT *, unnest(['all@x.org', 'archive@x.org']) AS r FROM comms)")
def src_email(fx):
    """A message for each turn, to all, with a copy to the archive and to its sender."""
    address = F.concat("role", "conv_id", F.lit("@x.org"))
    raw = F.concat(F.lit("From: "), F.upper(address), F.lit("\nTo: all@x.org, "), address, F.lit("\nCc: Archive@x.org\nSubject: Turn "), "turn", F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return corpus.mail_edges(fx.comms.select((F.col("conv_id") * 1000 + F.col("turn")).alias("mail_id"), raw.alias("raw")))


@query("""
SELECT filename, kind, text, length(text)::BIGINT AS char_count, rejected FROM (SELECT c_custkey || CASE c_custkey % 5 WHEN 0 THEN '.csv' WHEN 1 THEN '.JSON' WHEN 2 THEN '.txt' WHEN 3 THEN '.xls' ELSE '.json' END AS filename,
  CASE c_custkey % 5 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' WHEN 2 THEN 'txt' WHEN 4 THEN 'json' END AS kind,
  CASE c_custkey % 5 WHEN 0 THEN c_name || ', inc, ' || c_mktsegment || chr(10) || 'say "' || c_nationkey || '", two' || chr(10) || 'lines' WHEN 1 THEN 'name: ' || c_name || chr(10) || 'segment: ' || c_mktsegment || chr(10) || c_nationkey || chr(10) || 'deep: True' || chr(10) || 'last: None' WHEN 2 THEN c_name || ',  ' || c_mktsegment END AS text,
  CASE c_custkey % 5 WHEN 3 THEN 'unsupported document' WHEN 4 THEN 'unreadable: JSONDecodeError' END AS rejected FROM customer)""")
def src_text_files(fx):
    """A file for each customer: CSV with quotes and empty rows, nested JSON, text, an unknown kind, broken JSON."""
    made = F.element_at(F.array(
        F.concat(F.lit('"'), "c_name", F.lit(', inc" ,'), "c_mktsegment", F.lit('\r\n\n"say ""'), "c_nationkey", F.lit('""","two\nlines"\n')),
        F.concat(F.lit('{"name":"'), "c_name", F.lit('","more":{"segment":"'), "c_mktsegment", F.lit('","list":['), "c_nationkey", F.lit(',[{"deep":true}],[]]},"last":null}')),
        F.concat(F.lit("\n "), "c_name", F.lit(",  "), "c_mktsegment", F.lit(" ")),
        F.lit("x"),
        F.lit('{"name":'),
    ), (F.col("c_custkey") % 5 + 1).cast("int"))
    ending = F.element_at(F.array(*[F.lit(x) for x in (".csv", ".JSON", ".txt", ".xls", ".json")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    return corpus.parse_documents(fx.customer.select(F.concat("c_custkey", ending).alias("filename"), made.alias("content")))


@query("SELECT label, count(*) AS n, min(id) AS first, max(id) AS last FROM (SELECT upper(type[1]) || type[2:] AS label, id FROM ents UNION ALL SELECT type, id FROM rels) GROUP BY 1")
def snk_projection(fx):
    """The exported projection, read back: nodes by label and edges by type."""
    nodes, rels = corpus.exported(fx.ents, fx.rels)
    return nodes.select("label", "id").unionByName(rels.select(F.col("type").alias("label"), "id")).groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


@query("""
WITH n AS (SELECT id, upper(type[1]) || type[2:] AS label, CASE WHEN k % 10 = 0 THEN name || ' II' ELSE name END AS name, CASE WHEN k % 10 = 0 THEN 1 ELSE confidence_score END AS confidence_score FROM ents WHERE k % 13 <> 5),
e AS (SELECT r.id, r.type, r.source_id, r.target_id, CASE WHEN r.is_ai_generated THEN 0 ELSE r.confidence_score END AS confidence_score FROM rels r JOIN n a ON a.id = source_id JOIN n b ON b.id = target_id WHERE NOT (r.type = 'MANAGES' AND r.confidence_score = 1))
SELECT 'node' AS kind, id, label, name, NULL::VARCHAR AS source_id, NULL::VARCHAR AS target_id, confidence_score FROM n UNION ALL SELECT 'edge', id, type, NULL, source_id, target_id, confidence_score FROM e""")
def snk_projection_upsert(fx):
    """The projection after two batches: all that was there at first, then renamed, new and deleted entities, changed and deleted relationships."""
    path = new_path(fx.spark)
    early, late = F.col("k") % 7 != 0, (F.col("k") % 7 == 0) | (F.col("k") % 10 == 0) | (F.col("k") % 13 == 5)
    first = fx.ents.where(early).withColumn("seq", F.lit(1)).withColumn("deleted", F.lit(False))
    again = F.col("k") % 10 == 0
    second = fx.ents.where(late).withColumn("name", F.when(again, F.concat("name", F.lit(" II"))).otherwise(F.col("name"))).withColumn("confidence_score", F.when(again, 1.0).otherwise(F.col("confidence_score")))
    second = second.withColumn("seq", F.lit(2)).withColumn("deleted", F.col("k") % 13 == 5)
    rels = settle(fx.rels.select("id", "type", "source_id", "target_id", "confidence_score", "is_ai_generated"), "zstd")
    said = rels.withColumn("seq", F.lit(1)).withColumn("deleted", F.lit(False))
    tables.project(fx.spark, path, first, said.where("not is_ai_generated"), 0)
    # what had no ends at first is said again
    gone = (F.col("type") == "MANAGES") & (F.col("confidence_score") == 1)
    told = said.withColumn("deleted", gone).withColumn("confidence_score", F.when(F.col("is_ai_generated"), 0.0).otherwise(F.col("confidence_score")))
    tables.project(fx.spark, path, second, told, 1)
    nodes, edges = tables.read(fx.spark, f"{path}/nodes", tables.NODES), tables.read(fx.spark, f"{path}/edges", tables.EDGES)
    none = F.lit(None).cast("string")
    return nodes.select(F.lit("node").alias("kind"), "id", "label", "name", none.alias("source_id"), none.alias("target_id"), "confidence_score").unionByName(edges.select(F.lit("edge").alias("kind"), "id", F.col("type").alias("label"), none.alias("name"), "source_id", "target_id", "confidence_score"))
