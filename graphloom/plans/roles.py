"""Inputs of the library's own shapes, derived from the driver's tables in SQL that both engines read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ROLES = {
    # one question for each order
    "examples": """
        SELECT o_orderkey AS example_id, o_orderstatus AS source,
          CASE WHEN o_orderkey % 10 = 0 THEN 'test' WHEN o_orderkey % 10 = 1 THEN 'validation' ELSE 'train' END AS split,
          o_orderpriority AS graph, o_custkey % 50 AS schema_id,
          CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 19 = 0 THEN NULL ELSE concat('which customer placed order ', o_orderkey) END AS question,
          CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE concat('MATCH (o:Order) WHERE o.key = ', o_orderkey, ' RETURN o') END AS cypher,
          o_orderkey % 29 AS n_units, o_orderkey % 31 = 0 AS has_issue, o_orderkey % 7 <> 0 AS complete, o_orderkey AS pos
        FROM {orders}""",
    # one row for each question and schema unit, with a gold label and a prediction
    "selection": """
        SELECT concat(l_orderkey, ':', l_linenumber) AS id, l_orderkey AS example_id, min(l_partkey) % 60 AS unit_id, min(l_suppkey) % 5 AS schema_id,
          CASE WHEN l_linenumber % 2 = 1 THEN 'node' ELSE 'relation' END AS unit_type,
          max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS label, max(l_discount) * 10 AS p_yes,
          CASE WHEN min(l_suppkey) % 11 = 0 THEN 'INVALID' WHEN max(l_discount) >= 0.05 THEN 'YES' ELSE 'NO' END AS predicted,
          l_orderkey * 10 + l_linenumber AS pos
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    # a metric for each query, with a graph and sometimes an error or no value
    "scores": """
        SELECT event_id AS id, event_type AS graph, CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) % 2 END AS metric,
          event_id % 13 = 0 AND event_id % 2 = 0 AS failed, user_id AS seed
        FROM {events}""",
    # a schema graph: nations are nodes, and customers and suppliers draw relations between them
    "nodes": "SELECT n_nationkey AS node_id, n_name AS label, n_regionkey AS schema_id FROM {nation}",
    "relations": """
        SELECT DISTINCT c_nationkey AS source, c_mktsegment AS type, s_nationkey AS target
        FROM (SELECT DISTINCT c_nationkey, c_mktsegment, c_custkey % 10 AS k FROM {customer}) c JOIN (SELECT DISTINCT s_nationkey, s_suppkey % 10 AS k FROM {supplier}) s ON c.k = s.k""",
    # texts whose lengths are to be profiled
    "prompts": "SELECT doc_id AS pos, lang AS split, source AS task, n_chars AS n_tokens, text FROM {documents}",
    "turns": "SELECT conv_id, turn, role, text FROM {conversations}",
    "gold": "SELECT doc_id, quality, toxic FROM {labels}",
    # prediction and reference texts, as lists of lower-cased words
    "pairs": """
        SELECT a.item_id, a.text AS predicted, b.text AS reference FROM {benchmark} a JOIN {benchmark} b ON b.item_id = a.item_id - a.item_id % 2""",
    "vectors": "SELECT vec_id, embedding, label FROM {embeddings}",
    "events_by_user": "SELECT event_id, user_id, event_type, ts, value FROM {events}",
}

TABLES = re.compile(r"\{(\w+)\}")


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A role as a DataFrame over the Parquet tables in sf_dir."""
    names = set(TABLES.findall(ROLES[name]))
    return spark.sql(ROLES[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})


def with_roles(sql: str) -> str:
    """sql with a WITH clause for each role it names as @role."""
    used = [r for r in ROLES if re.search(rf"@{r}\b", sql)]
    body = re.sub(r"@(\w+)", r"\1", sql).strip()
    ctes = ", ".join(f"{r} AS ({TABLES.sub(lambda m: m[1], ROLES[r])})" for r in used)
    if not used:
        return body
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {ctes}, " + re.sub(r"(?i)^with\s+recursive\s+", "", body)
    if re.match(r"(?i)with\b", body):
        return f"WITH {ctes}, " + re.sub(r"(?i)^with\s+", "", body)
    return f"WITH {ctes} {body}"
