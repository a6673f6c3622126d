"""The evidence graph over the driver's tables.

Each relation is one SELECT in the dialect that Spark SQL and DuckDB share; {name} stands for a
base table or an earlier relation. load() gives DataFrames, ctes() the same relations as a WITH
list for the comparison queries.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations")

RELATIONS = {
    "ents": """
SELECT id, type, name, k, CAST(k % 101 AS DOUBLE) / 100 AS confidence_score, k % 7 = 0 AS is_ai_generated,
       CASE k % 5 WHEN 0 THEN 'unclassified' WHEN 1 THEN 'official' WHEN 2 THEN 'confidential' WHEN 3 THEN 'secret' ELSE 'top_secret' END AS classification,
       CASE k % 3 WHEN 0 THEN 'ALPHA' WHEN 1 THEN 'BRAVO' END AS compartment,
       k % 11 = 0 AS legal_hold, DATE '2020-01-01' + CAST(k % 900 AS INT) AS created_on, DATE '2020-06-01' + CAST(k % 1200 AS INT) AS updated_on, event_date, lat, lon
FROM (SELECT 'C' || c_custkey AS id, 'person' AS type, c_name AS name, c_custkey AS k, CAST(NULL AS DATE) AS event_date, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon FROM {customer}
UNION ALL SELECT 'S' || s_suppkey, 'company', s_name, s_suppkey, NULL, NULL, NULL FROM {supplier}
UNION ALL SELECT 'P' || p_partkey, 'asset', p_name, p_partkey, NULL, NULL, NULL FROM {part}
UNION ALL SELECT 'O' || o_orderkey, 'event', 'Order ' || o_orderkey, o_orderkey, CAST(o_orderdate AS DATE), NULL, NULL FROM {orders}
UNION ALL SELECT 'N' || n_nationkey, 'location', n_name, n_nationkey, NULL, CAST(-60 + 5 * n_nationkey AS DOUBLE), CAST(-150 + 12 * n_nationkey AS DOUBLE) FROM {nation}
UNION ALL SELECT 'R' || r_regionkey, 'location', r_name, r_regionkey, NULL, NULL, NULL FROM {region}
UNION ALL SELECT 'D' || doc_id, 'document', 'Document ' || doc_id, doc_id, NULL, NULL, NULL FROM {documents}) u""",
    "rels": """
SELECT type || ':' || source_id || '>' || target_id AS id, type, source_id, target_id, start_date, start_date + 30 AS end_date, confidence_score, DATE '2021-01-01' + CAST(n % 700 AS INT) AS created_on, DATE '2021-03-01' + CAST(n % 900 AS INT) AS updated_on, n % 9 = 0 AS is_ai_generated
FROM (SELECT 'LOCATED_IN' AS type, 'C' || c_custkey AS source_id, 'N' || c_nationkey AS target_id, CAST(NULL AS DATE) AS start_date, CAST(c_custkey % 10 AS DOUBLE) / 10 AS confidence_score, c_custkey AS n FROM {customer}
UNION ALL SELECT 'LOCATED_IN', 'S' || s_suppkey, 'N' || s_nationkey, NULL, CAST(s_suppkey % 10 AS DOUBLE) / 10, s_suppkey FROM {supplier}
UNION ALL SELECT 'LOCATED_IN', 'N' || n_nationkey, 'R' || n_regionkey, NULL, CAST(1 AS DOUBLE), n_nationkey FROM {nation}
UNION ALL SELECT 'LOCATED_IN', 'O' || o_orderkey, 'N' || (o_orderkey % 25), NULL, CAST(o_orderkey % 10 AS DOUBLE) / 10, o_orderkey FROM {orders}
UNION ALL SELECT 'PARTICIPATED_IN', 'C' || o_custkey, 'O' || o_orderkey, CAST(o_orderdate AS DATE), CAST(o_orderkey % 8 AS DOUBLE) / 8, o_orderkey FROM {orders}
UNION ALL SELECT 'OWNS', 'S' || l_suppkey, 'P' || l_partkey, NULL, round(1 - 8 * max(l_discount), 2), max(l_orderkey) FROM {lineitem} WHERE l_quantity >= 49 GROUP BY l_suppkey, l_partkey
UNION ALL SELECT 'ASSOCIATED_WITH', 'P' || u, 'P' || v, NULL, round(1 - 8 * max(d), 2), max(o) FROM (
  SELECT a.l_partkey AS u, b.l_partkey AS v, greatest(a.l_discount, b.l_discount) AS d, a.l_orderkey AS o
  FROM (SELECT l_orderkey, l_partkey, l_discount FROM {lineitem} WHERE l_quantity >= 45) a JOIN (SELECT l_orderkey, l_partkey, l_discount FROM {lineitem} WHERE l_quantity >= 45) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey) w GROUP BY u, v
UNION ALL SELECT 'MANAGES', 'S' || CAST(floor((s_suppkey - 1) / 3.0) AS BIGINT), 'S' || s_suppkey, NULL, CAST(1 AS DOUBLE), s_suppkey FROM {supplier} WHERE s_suppkey >= 1) r""",
    "evidence": """
SELECT 'OWNS:S' || l_suppkey || '>P' || l_partkey AS relationship_id, 'P' || l_partkey AS entity_id, 'src' || (l_orderkey % 40) AS source,
       CASE l_returnflag WHEN 'N' THEN 'supports' WHEN 'R' THEN 'contradicts' ELSE 'neutral' END AS stance,
       CASE WHEN l_linestatus = 'F' THEN 'verified' ELSE 'unverified' END AS verification_status, 1 - 5 * l_discount AS reliability_score,
       CASE WHEN l_linenumber % 2 = 1 THEN substr('ABCDEFA', l_linenumber, 1) END AS source_reliability,
       CASE WHEN l_linenumber % 3 > 0 THEN CAST(l_quantity AS INT) % 6 + 1 END AS info_credibility, CAST(l_shipdate AS DATE) AS created_on
FROM {lineitem}""",
    "audit": """
SELECT event_id AS id, 'A' || user_id AS actor_id, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'create' ELSE 'update' END AS action,
       CASE WHEN event_id % 2 = 0 THEN 'entities' WHEN event_id % 3 = 0 THEN 'relationships' ELSE 'cases' END AS target_table, user_id % 100 AS target_id, ts FROM {events}""",
    "tx": """
SELECT 'U' || user_id AS from_address, CASE WHEN event_id % 50 = 0 THEN 'U' || user_id WHEN event_id % 41 = 0 THEN ' ' ELSE 'K' || (event_id % 100) END AS to_address, value AS amount, 'tx-' || event_id || '-abcdefghijklmnop' AS tx_hash, ts FROM {events} WHERE event_type = 'purchase'""",
    "watch": """
SELECT 'W' || min(p_partkey) AS id, substr(p_name, 1, length(p_name) - 1) || 'x' AS name, 'SDN' AS program FROM {part} WHERE p_partkey % 17 = 0 GROUP BY p_name
UNION ALL SELECT 'WC' || c_custkey, substr(c_name, 1, length(c_name) - 1) || 'x', 'SDN' FROM {customer} WHERE c_custkey % 97 = 0
UNION ALL SELECT 'WS' || s_suppkey, replace(s_name, '#', ' '), 'SDN' FROM {supplier} WHERE s_suppkey % 19 = 0
UNION ALL SELECT 'WA' || c_custkey, c_mktsegment || ', ' || c_custkey, 'ALIAS' FROM {customer} WHERE c_custkey % 200 = 0""",
    "ach_items": """
SELECT s_nationkey AS analysis_id, s_suppkey AS item_id, CAST(s_suppkey % 3 + 1 AS DOUBLE) AS weight FROM {supplier}""",
    "ach_ratings": """
SELECT s_nationkey AS analysis_id, h AS hypothesis_id, s_suppkey AS item_id, r AS rev, CASE (s_suppkey * 7 + h * 3 + r) % 4 WHEN 0 THEN 'consistent' WHEN 1 THEN 'inconsistent' WHEN 2 THEN 'neutral' ELSE 'na' END AS consistency
FROM {supplier} CROSS JOIN (SELECT 0 AS h UNION ALL SELECT 1 UNION ALL SELECT 2) hs CROSS JOIN (SELECT 0 AS r UNION ALL SELECT 1) rs""",
    "cases": """
SELECT n_nationkey AS case_id, n_name AS title, CASE n_nationkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority, n_regionkey AS owner FROM {nation}""",
    "case_items": """
SELECT c_nationkey AS case_id, 'entity' AS item_type, 'C' || c_custkey AS item_id FROM {customer} UNION ALL SELECT s_nationkey, 'entity', 'S' || s_suppkey FROM {supplier}""",
    "tasks": """
SELECT o_orderkey AS task_id, o_custkey % 25 AS case_id, o_custkey % 7 AS assignee, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'in_progress' END AS status, CAST(o_orderdate AS DATE) AS due FROM {orders}""",
    "users": """
SELECT s_suppkey AS user_id, CAST(s_suppkey % 5 AS INT) AS clearance, CASE WHEN s_suppkey % 2 = 0 THEN 'ALPHA' ELSE 'BRAVO' END AS compartment FROM {supplier} WHERE s_suppkey < 5""",
    "annotations": """
SELECT o_orderkey AS annotation_id, 'C' || o_custkey AS entity_id, CASE o_orderkey % 4 WHEN 0 THEN 'note' WHEN 1 THEN 'assumption' WHEN 2 THEN 'dissent' ELSE 'devils_advocate' END AS kind, o_orderpriority AS text, CAST(o_orderdate AS DATE) AS created_on FROM {orders}""",
    "comments": """
SELECT event_id AS comment_id, 'case' AS target_type, user_id % 25 AS target_id, event_type AS body, ts AS created_at FROM {events}""",
    "views": """
SELECT c_custkey AS view_id, c_custkey % 7 AS owner, c_custkey % 3 = 0 AS shared, CASE WHEN c_custkey % 2 = 0 THEN 'graph' ELSE 'map' END AS kind, c_nationkey AS case_id FROM {customer}""",
    "merges": """
SELECT p_partkey AS merge_id, 'P' || (p_partkey - p_partkey % 2) AS kept_id, 'P' || p_partkey AS merged_id, p_partkey % 5 = 0 AS undone, DATE '2023-01-01' + CAST(p_partkey % 300 AS INT) AS created_on FROM {part} WHERE p_partkey % 2 = 1""",
    # names by which entities go besides their own
    "aliases": """
SELECT 'P' || p_partkey AS id, p_name || ' ' || p_brand AS alias FROM {part} WHERE p_partkey % 4 = 0 UNION ALL SELECT 'C' || c_custkey, c_mktsegment || ' ' || c_custkey FROM {customer} WHERE c_custkey % 4 = 0
UNION ALL SELECT 'C' || c_custkey, c_mktsegment FROM {customer} WHERE c_custkey % 10 = 0""",
    "decisions": """
SELECT e.relationship_id, e.entity_id, e.source, a.id AS seq, CASE WHEN a.action = 'delete' THEN 'rejected' WHEN a.action = 'create' THEN 'unverified' ELSE 'verified' END AS status
FROM (SELECT DISTINCT relationship_id, entity_id, source FROM {evidence}) e JOIN {audit} a ON 'P' || a.target_id = e.entity_id""",
    # the undirected graph of the structure operators
    "gedges": """
SELECT source_id AS u, target_id AS v, confidence_score AS w FROM {rels} WHERE type = 'ASSOCIATED_WITH'""",
    "gnodes": """
SELECT DISTINCT id FROM (SELECT u AS id FROM {gedges} UNION ALL SELECT v FROM {gedges}) x""",
    "gboth": """
SELECT u, v, w FROM {gedges} UNION ALL SELECT v, u, w FROM {gedges}""",
    "gdeg": """
SELECT u AS id, count(*) AS d FROM {gboth} GROUP BY u""",
    "comms": """
SELECT conv_id, turn, role, text FROM {conversations}""",
}


class Fixture(dict):
    """DataFrames by name, made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name in BASE:
            self[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        else:
            used = sorted(set(re.findall(r"\{(\w+)\}", RELATIONS[name])))
            self[name] = self.spark.sql(RELATIONS[name], **{n: self[n] for n in used})
        return self[name]

    __getattr__ = dict.__getitem__


def load(spark: SparkSession, sf_dir: str) -> Fixture:
    return Fixture(spark, sf_dir)


def ctes(query: str) -> str:
    """query (which may begin with its own WITH list, named after `WITH`) with the relations that it uses."""
    need: list[str] = []

    def visit(names: list[str]) -> None:
        for name in names:
            if name in RELATIONS and name not in need:
                visit(re.findall(r"\{(\w+)\}", RELATIONS[name]))
                need.append(name)

    visit(re.findall(r"\w+", query))
    listed = ",\n".join(f"{n} AS ({re.sub(r'[{}]', '', RELATIONS[n]).strip()})" for n in need)
    if not listed:
        return query
    body = query.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {listed},\n{body[14:]}"
    return f"WITH {listed},\n{body[4:]}" if body.upper().startswith("WITH") else f"WITH {listed}\n{body}"
