"""SQL fragments shared by the checks (DuckDB dialect)."""

WS = r"[\s\x0b\x85\p{Z}]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def tokens(x: str) -> str:
    return rf"greatest(1, len(list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')))::INT"


# Chunk windows of the documents: one every 700 characters, 800 long.
CHUNKS = f"""
chunks AS (
  SELECT version_id, owner_id, source_id, k::INT AS chunk_index, txt AS text, s::INT AS anchor_start, e::INT AS anchor_end
  FROM (
    SELECT doc_id AS version_id, lang AS owner_id, source AS source_id, k, 700 * k AS s, least(700 * k + 800, n) AS e,
           {strip("substring(text, 700 * k + 1, least(800, n - 700 * k)::BIGINT)")} AS txt
    FROM (SELECT *, length(text) AS n FROM documents) d,
         LATERAL (SELECT unnest(range(CASE WHEN n <= 800 THEN 1 ELSE ceil((n - 800) / 700.0)::BIGINT + 1 END)) AS k)
  ) WHERE txt <> ''
)"""

PROPOSALS = """
proposals AS (
  SELECT o_orderkey AS proposal_id, o_custkey AS owner_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'entity' WHEN '2-HIGH' THEN 'claim' WHEN '3-MEDIUM' THEN 'relationship'
      WHEN '4-NOT SPECIFIED' THEN 'entity_resolution' ELSE 'task' END AS proposal_type,
    CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'deferred' END AS status,
    conf AS confidence,
    CASE WHEN conf < 0.6 THEN 'high' WHEN conf >= 0.85 THEN 'low' ELSE 'medium' END AS risk_level,
    o_custkey < o_orderkey AS requires_review, 'Order ' || o_orderkey AS title,
    '{"name":"' || o_orderpriority || '","priority":"' || o_orderpriority || '"}' AS payload,
    o_orderpriority, o_orderdate AS created_at
  FROM (SELECT *, least(floor(o_totalprice / 50) / 10000, 1.0) AS conf FROM orders)
)"""

EVIDENCE = """
evidence AS (
  SELECT l_orderkey AS proposal_id, l_linenumber AS anchor_start, l_partkey AS chunk_id, l_suppkey AS version_id,
    l_orderkey || '-' || l_linenumber || '-' || l_partkey AS evidence_id
  FROM lineitem
)"""

DECISIONS = """
decisions AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS decision_id, l_orderkey AS proposal_id,
    CASE l_returnflag WHEN 'A' THEN 'approve' WHEN 'R' THEN 'reject' ELSE 'edit_and_approve' END AS action,
    '{"part":' || l_partkey || '}' AS edited_payload, l_shipdate AS created_at
  FROM lineitem
)"""

VERSIONS = """
versions AS (
  SELECT o_orderkey AS version_id, o_custkey AS source_id, o_orderdate AS observed_at,
    'file-' || o_orderkey || CASE o_orderpriority WHEN '1-URGENT' THEN '.md' WHEN '2-HIGH' THEN '.pdf' ELSE '.json' END AS external_id,
    CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'failed' ELSE 'completed' END AS extraction_status,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'completed' WHEN '2-HIGH' THEN 'skipped' ELSE 'pending' END AS knowledge_status,
    CASE o_orderpriority WHEN '5-LOW' THEN 'pending' ELSE 'completed' END AS triage_status,
    CASE WHEN o_orderstatus = 'F' THEN 'error in ' || o_orderpriority END AS extraction_error,
    CASE WHEN o_orderpriority = '5-LOW' THEN 0.5 ELSE floor(o_totalprice) / 1000000 END AS relevance,
    o_orderpriority = '1-URGENT' AS flagged
  FROM orders
)"""

CLAIMS = """
claims AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS claim_id, 1 AS owner_id,
    l_orderkey AS subject_entity_id, l_returnflag AS predicate, l_linestatus AS object_value,
    CASE WHEN l_discount > 0.09 THEN 'superseded' ELSE 'active' END AS status, round(1 - l_discount, 2) AS confidence,
    l_partkey AS source_proposal_id, l_shipdate AS created_at
  FROM lineitem
)"""
