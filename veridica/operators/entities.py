"""Reads over entities and relationships: filters, joins, sections, facets, lineage, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridica.operators.frames import dealt, settle

ORGS = ("organization", "company", "government_agency")
AFFILIATION = ("WORKS_FOR", "MEMBER_OF", "FOUNDED", "MANAGES")


def incident(rels: DataFrame, *more: str) -> DataFrame:
    """Each relationship from both of its ends: id, other, outgoing, and more columns; a union, never an OR join."""
    kept = [F.col("id").alias("rel_id"), "type", "confidence_score", "start_date", "end_date", *more]
    out = rels.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), F.lit(True).alias("outgoing"), *kept)
    back = rels.where("source_id <> target_id").select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), F.lit(False).alias("outgoing"), *kept)
    return out.unionByName(back)


def list_entities(ents: DataFrame, type_: str, pattern: str, skip: int, limit: int) -> DataFrame:
    """Newest first; the name pattern matches anywhere, without case."""
    return ents.where((F.col("type") == type_) & F.col("name").ilike(f"%{pattern}%")).orderBy(F.desc("created_on"), "id").offset(skip).limit(limit)


def top_k(df: DataFrame, score: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), "id").limit(k)


def neighbors(rels: DataFrame, ents: DataFrame, limit: int) -> DataFrame:
    """At most `limit` incident edges of every entity, with the far node."""
    far = ents.select(F.col("id").alias("other"), F.col("name").alias("other_name"), F.col("type").alias("other_type"))
    ranked = incident(rels).withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("rel_id", "outgoing")))
    return ranked.where(F.col("rank") <= limit).join(far, "other").select("id", "rel_id", "other", "other_name", "other_type", "outgoing")


def connections_by_type(rels: DataFrame) -> DataFrame:
    return incident(rels).groupBy("id", "type").agg(F.count("*").alias("n"))


def _placed(rels: DataFrame, ents: DataFrame, *more: str) -> DataFrame:
    """incident() with name and type of the far end and the sections that it belongs to."""
    # entities are hashed in parts of bounded size, relationships pass by: those of a hub are not sorted in one task
    far = dealt(ents.select(F.col("id").alias("other"), F.col("name").alias("title"), F.col("type").alias("other_type")), "other")
    joined = incident(rels, *more).join(far.hint("shuffle_hash"), "other")
    kind, rel = F.col("other_type"), F.col("type")
    named: list[tuple[str, Column]] = [
        ("connections", F.lit(True)), ("events", kind == "event"), ("locations", kind == "location"), ("documents", kind == "document"), ("partners", rel == "PARTNER_OF"),
        ("organizations", F.col("outgoing") & kind.isin(*ORGS) & rel.isin(*AFFILIATION)), ("members", ~F.col("outgoing") & (kind == "person") & rel.isin("WORKS_FOR", "MEMBER_OF")),
        ("related", kind.isin(*ORGS, "person", "asset")),
    ]
    return joined.withColumn("sections", F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in named]), lambda x: x.isNotNull()))


def sections(rels: DataFrame, ents: DataFrame) -> DataFrame:
    """Sizes of the dashboard sections of every entity as rows (id, section, n)."""
    return _placed(rels, ents).select("id", F.explode("sections").alias("section")).groupBy("id", "section").agg(F.count("*").alias("n"))


def dashboard(rels: DataFrame, ents: DataFrame, evidence: DataFrame) -> DataFrame:
    """Dashboard sections of every entity as rows (id, section, ref, title, rel_id, rel_type, outgoing, confidence, is_ai_generated, n).

    A row per neighbour and section; self loops are none. Documents also are the sources of the entity's own evidence, each once and
    without a ref, unless a document of that title is listed. The sections total_* have the counts n of all relationships, of evidence and
    of documents.
    """
    rels = settle(rels.select("id", "type", "source_id", "target_id", "confidence_score", "start_date", "end_date", "is_ai_generated"), "zstd")
    listed = _placed(rels.where("source_id <> target_id"), ents, "is_ai_generated").select("id", F.explode("sections").alias("section"), F.col("other").alias("ref"), "title", "rel_id", F.col("type").alias("rel_type"), "outgoing", F.col("confidence_score").alias("confidence"), "is_ai_generated")
    titles = _placed(rels.where("source_id <> target_id"), ents).where("other_type = 'document'").select("id", "title")
    own = dealt(evidence.select(F.col("entity_id").alias("id"), F.col("source").alias("title")), "id").where("id is not null")
    known = own.join(ents.select("id").distinct(), "id", "left_semi")
    sources = known.where("title <> ''").distinct().join(titles, ["id", "title"], "left_anti").select("id", F.lit("documents").alias("section"), "title")
    counted = lambda df, name: df.groupBy("id").agg(F.count("*").alias("n")).select("id", F.lit(name).alias("section"), "n")
    ends = incident(rels).join(dealt(ents.select("id"), "id").hint("shuffle_hash"), "id", "left_semi")
    totals = counted(ends, "total_connections").unionByName(counted(known, "total_evidence")).unionByName(counted(titles.unionByName(sources.select("id", "title")), "total_documents"))
    return listed.unionByName(sources, allowMissingColumns=True).unionByName(totals, allowMissingColumns=True)


def facets(ents: DataFrame) -> DataFrame:
    """Counts by type, classification, confidence band, provenance and month in one pass of grouping sets."""
    s = F.col("confidence_score")
    band = F.when(s < 0.2, "0.0–0.2").when(s < 0.4, "0.2–0.4").when(s < 0.6, "0.4–0.6").when(s < 0.8, "0.6–0.8").otherwise("0.8–1.0")
    cols = {"type": F.col("type"), "classification": F.col("classification"), "confidence": band, "provenance": F.when(F.col("is_ai_generated"), "ai_generated").otherwise("analyst_entered"), "month": F.date_format("created_on", "yyyy-MM")}
    wide = ents.select(*[c.alias(n) for n, c in cols.items()])
    grouped = wide.groupingSets([[F.col(n)] for n in cols] + [[]], *[F.col(n) for n in cols]).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    full = (1 << len(cols)) - 1
    facet, value = F.lit("total"), F.lit("all")
    for i, n in enumerate(cols):
        is_it = F.col("g") == full - (1 << (len(cols) - 1 - i))
        facet, value = F.when(is_it, n).otherwise(facet), F.when(is_it, F.col(n)).otherwise(value)
    return grouped.select(facet.alias("facet"), value.alias("value"), "n")


def case_overview(cases: DataFrame, items: DataFrame, tasks: DataFrame) -> DataFrame:
    counted = cases.join(items.groupBy("case_id").agg(F.count("*").alias("items")), "case_id", "left").join(tasks.groupBy("case_id").agg(F.count("*").alias("tasks"), F.count_if(F.col("status") == "open").alias("open_tasks")), "case_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return counted.select("case_id", "title", "priority", zero("items"), zero("tasks"), zero("open_tasks"))


def lineage(ents: DataFrame, rels: DataFrame, evidence: DataFrame) -> DataFrame:
    """Provenance of every entity: evidence, verified and source counts, mentioning documents."""
    # dealt before it is grouped: few rows of an entity have a source in common, so that grouping each split first would only hold them twice
    given = dealt(evidence.select(F.col("entity_id").alias("id"), "verification_status", "source"), "id")
    own = given.groupBy("id").agg(F.count("*").alias("evidence"), F.count_if(F.col("verification_status") == "verified").alias("verified"), F.count_distinct("source").alias("sources"))
    docs = ents.where("type = 'document'").select(F.col("id").alias("other"))
    mentions = incident(rels).join(docs, "other", "left_semi").groupBy("id").agg(F.count_distinct("other").alias("documents"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = ents.join(own, "id", "left").join(mentions, "id", "left")
    origin = F.when(F.col("is_ai_generated"), "AI-extracted").otherwise("analyst-entered")
    return joined.select("id", origin.alias("origin"), zero("evidence"), zero("verified"), zero("sources"), zero("documents"))


def provenance(ents: DataFrame, rels: DataFrame, evidence: DataFrame) -> DataFrame:
    """Provenance graph of every entity as rows (id, item, node, target, label, ai_generated, verified).

    Nodes are the entity, its evidence, and documents: sources of evidence (`doc:` and the source, each once) and neighbours that are documents.
    An edge leads from node to target, with its relation as label: the stance of evidence towards the entity, source_of from
    a source to evidence, mentions from a document to the entity, one each. The summary is a text. Evidence (evidence_id, entity_id,
    title, source, stance, verification_status) without a known entity has no row; without an evidence_id it is numbered within its entity.
    """
    some = dealt(evidence.select(*[c for c in ("evidence_id", "title", "source", "stance", "verification_status") if c in evidence.columns], F.col("entity_id").alias("id")), "id")
    if "evidence_id" not in some.columns:
        number = F.row_number().over(W.partitionBy("id").orderBy("title", "source", "stance", "verification_status"))
        some = some.withColumn("evidence_id", F.concat("id", F.lit("/E"), number))
    some = some.select("id", "evidence_id", "title", "source", "stance", F.coalesce(F.col("verification_status") == "verified", F.lit(False)).alias("verified"))
    given = settle(some.join(ents.select("id").distinct(), "id", "left_semi"))
    node = lambda df, kind, key, label, *more: df.select("id", F.lit(kind).alias("item"), key.alias("node"), label.alias("label"), *more)
    edge = lambda df, key, target, relation: df.select("id", F.lit("edge").alias("item"), key.alias("node"), target.alias("target"), relation.alias("label"))
    sourced = given.where("source <> ''").withColumn("key", F.concat(F.lit("doc:"), "source"))
    docs = dealt(ents.where("type = 'document'").select(F.col("id").alias("other"), F.col("name").alias("title")), "other")
    near = settle(incident(rels).where("id <> other").select("id", "other").join(docs.hint("shuffle_hash"), "other").distinct().join(ents.select("id").distinct(), "id", "left_semi"))
    backed = given.groupBy("id").agg(F.count("*").alias("n"), F.count_if("verified").alias("v"))
    origins = sourced.select("id", F.col("source").alias("s")).unionByName(near.select("id", F.col("title").alias("s"))).groupBy("id").agg(F.count_distinct("s").alias("sources"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    text = F.concat("name", F.lit(" is "), F.when(F.col("is_ai_generated"), "AI-extracted").otherwise("analyst-entered"), F.lit("; backed by "), zero("n"), F.lit(" evidence item(s) ("), zero("v"), F.lit(" verified) from "), zero("sources"), F.lit(" source(s)."))
    parts = [
        node(ents, "entity", F.col("id"), F.col("name"), F.col("is_ai_generated").alias("ai_generated")),
        node(given, "evidence", F.col("evidence_id"), F.col("title"), "verified"),
        node(sourced.select("id", "key", "source").distinct(), "document", F.col("key"), F.col("source")),
        node(near, "document", F.col("other"), F.col("title")),
        edge(given, F.col("evidence_id"), F.col("id"), F.col("stance")),
        edge(sourced, F.col("key"), F.col("evidence_id"), F.lit("source_of")),
        edge(near, F.col("other"), F.col("id"), F.lit("mentions")),
        ents.join(backed, "id", "left").join(origins, "id", "left").select("id", F.lit("summary").alias("item"), text.alias("label")),
    ]
    columns = {"id": "string", "item": "string", "node": "string", "target": "string", "label": "string", "ai_generated": "boolean", "verified": "boolean"}
    whole = lambda df: df.select(*[c if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()])
    out = whole(parts[0])
    for more in parts[1:]:
        out = out.unionByName(whole(more))
    return out


def context_lines(rels: DataFrame, ents: DataFrame, limit: int = 20) -> DataFrame:
    """One text per entity: its relations with direction, at most `limit` of them, in order of relation."""
    far = ents.select(F.col("id").alias("other"), F.col("name").alias("other_name"))
    line = F.concat(F.when(F.col("outgoing"), "-> ").otherwise("<- "), "type", F.lit(" "), "other_name")
    ranked = incident(rels).withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("rel_id", "outgoing"))).where(F.col("rank") <= limit)
    return ranked.join(far, "other").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


def diff(ents: DataFrame, rels: DataFrame, audit: DataFrame, since: str) -> DataFrame:
    """Rows added, modified or removed since a date."""
    day = F.lit(since).cast("date")
    made = lambda df, kind: df.where(F.col("created_on") >= day).select(F.lit(f"added_{kind}").alias("change"), "id")
    changed = lambda df, kind: df.where((F.col("updated_on") >= day) & (F.col("created_on") < day)).select(F.lit(f"modified_{kind}").alias("change"), "id")
    gone = audit.where((F.col("action") == "delete") & F.col("target_table").isin("entities", "relationships") & (F.col("ts") >= day)).select(F.concat(F.lit("removed_"), "target_table").alias("change"), F.col("id").cast("string").alias("id"))
    return made(ents, "entities").unionByName(made(rels, "relationships")).unionByName(changed(ents, "entities")).unionByName(changed(rels, "relationships")).unionByName(gone)


def by_name(ents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, id, type) of the entities whose name equals a wanted one without case: an equi join, all wanted at once."""
    names = wanted.select("wanted", F.lower("wanted").alias("k"))
    return ents.select("id", "type", F.lower("name").alias("k")).join(names, "k").select("wanted", "id", "type")


def neighbors_of_name(rels: DataFrame, ents: DataFrame, pattern: str) -> DataFrame:
    """(id, name, type) of the entities next to the first one (by id) whose name holds the pattern, without case."""
    base = ents.where(F.col("name").ilike(f"%{pattern}%")).agg(F.min("id").alias("id"))
    near = incident(rels).join(base, "id").select(F.col("other").alias("id")).distinct()
    return ents.select("id", "name", "type").join(near, "id")
