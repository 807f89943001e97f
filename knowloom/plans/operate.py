"""Queries for the graph, ontology curation, reports, operations and streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowloom.operators import canonical, graph, ontology, reports
from knowloom.plans import knowledge  # noqa: F401  (registers the SQL shared below)
from knowloom.plans.registry import ORACLES, query
from knowloom.plans.sql import CLAIMS, PROPOSALS, VERSIONS, strip
from knowloom.plans.tables import Tables, joined
from knowloom.sources.sinks import drop_shuffles, work_folder
from knowloom.streaming import jobs

# --- graph -------------------------------------------------------------------------------------
_OUTBOX = """
outbox AS (SELECT event_id, ts, user_id, event_type AS kind, value, props, json_extract_string(props, '$.k') AS k,
  CASE WHEN value > 100 THEN 'processed' ELSE 'pending' END AS status FROM events)"""
_GRAPH = f"""{_OUTBOX},
nodes AS (SELECT DISTINCT user_id::VARCHAR AS node_id, 'entity' AS node_type, 'user ' || user_id AS label, 'person' AS detail FROM outbox WHERE kind = 'signup' AND ok
  UNION ALL SELECT event_id::VARCHAR, 'claim', 'bought', NULL FROM outbox WHERE kind = 'purchase' AND ok),
rel AS (SELECT 'r' || event_id AS edge_id, user_id::VARCHAR AS src, k AS dst, 'WORKS_WITH' AS edge_type FROM outbox WHERE kind = 'view' AND ok
  UNION ALL SELECT sha256('edge|' || user_id || '|HAS_CLAIM|' || event_id), user_id::VARCHAR, event_id::VARCHAR, 'HAS_CLAIM' FROM outbox WHERE kind = 'purchase' AND ok),
edges AS (SELECT * FROM rel WHERE src IN (SELECT node_id FROM nodes WHERE node_type = 'entity')
  AND dst IN (SELECT node_id FROM nodes WHERE node_type = CASE WHEN edge_type = 'HAS_CLAIM' THEN 'claim' ELSE 'entity' END))"""


def _graph(all_rows: bool) -> str:
    return _GRAPH.replace("AND ok", "" if all_rows else "AND status = 'pending'")


def _valid_outbox(t: Tables) -> DataFrame:
    rows = t.outbox()
    return rows.filter(graph.valid_event(F.col("payload"), F.col("event_type")))


@query(f"WITH {_graph(True)} SELECT node_id, node_type, label, detail FROM nodes")
def projected_nodes(t: Tables) -> DataFrame:
    n = graph.project_nodes(_valid_outbox(t))
    return n.select("node_id", "node_type", "label", F.when(F.col("node_type") == "entity", F.col("detail")).alias("detail"))


@query(f"WITH {_graph(True)} SELECT edge_id, src, dst, edge_type FROM edges")
def projected_edges(t: Tables) -> DataFrame:
    events = _valid_outbox(t)
    return graph.project_edges(events, graph.project_nodes(events)).select("edge_id", "src", "dst", "edge_type")


@query(f"""WITH {CLAIMS}, ids AS (SELECT 'c' || c_custkey AS id FROM customer)
SELECT 'entity' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'claim', count(*) FROM claims WHERE status = 'active'
UNION ALL SELECT 'finding', count(*) FROM claims WHERE confidence > 0.97
UNION ALL SELECT 'KNOWS', count(*) FROM orders WHERE 'c' || o_custkey IN (SELECT id FROM ids) AND 'c' || o_orderkey IN (SELECT id FROM ids)
UNION ALL SELECT 'HAS_CLAIM', count(*) FROM claims WHERE status = 'active' AND 'c' || subject_entity_id IN (SELECT id FROM ids)
UNION ALL SELECT 'CONTRADICTS', count(*) FROM claims WHERE status = 'active' AND confidence > 0.97""")
def rebuilt_graph(t: Tables) -> DataFrame:
    c = lambda x: F.concat(F.lit("c"), F.col(x).cast("string"))
    entities = t.raw("customer").select(c("c_custkey").alias("entity_id"), F.lit(1).alias("owner_id"), F.col("c_name").alias("canonical_name"), F.lit("person").alias("entity_type"))
    rel = t.raw("orders").select(F.col("o_orderkey").cast("string").alias("relationship_id"), F.lit(1).alias("owner_id"), c("o_custkey").alias("source_entity_id"),
                                 c("o_orderkey").alias("target_entity_id"), F.lit("knows").alias("relationship_type"), F.lit("active").alias("status"))
    claims = t.claims().withColumn("subject_entity_id", c("subject_entity_id"))
    findings = t.claims().select(
        F.concat(F.lit("f"), F.col("claim_id")).alias("finding_id"), F.lit(1).alias("owner_id"), F.lit("s").alias("summary"),
        F.when(F.col("confidence") > 0.97, "open").otherwise("closed").alias("status"), F.col("claim_id").alias("existing_claim_id"))
    nodes, edges = graph.rebuild(entities, rel, claims, findings)
    return graph.rebuild_counts(nodes, edges)


_EDGES = """
nodes AS (SELECT 'r' || r_regionkey AS node_id, 'entity' AS node_type FROM region UNION ALL SELECT 'n' || n_nationkey, 'entity' FROM nation UNION ALL SELECT 's' || s_suppkey, 'entity' FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'entity' FROM customer UNION ALL SELECT 'o' || o_orderkey, 'claim' FROM orders),
edges AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'IN_REGION' AS edge_type FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'IN_NATION' FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'IN_NATION' FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'HAS_CLAIM' FROM orders),
views AS (SELECT src AS node, dst AS other, src || '>' || dst AS edge_id, edge_type FROM edges UNION ALL SELECT dst, src, src || '>' || dst, edge_type FROM edges)"""


def _entity_roots(t: Tables) -> DataFrame:
    return t.nodes().filter("node_type = 'entity'").select(F.col("node_id").alias("root_id"))


@query(f"""WITH {_EDGES}, ranked AS (SELECT node AS root_id, other, edge_id, edge_type, row_number() OVER (PARTITION BY node ORDER BY edge_id)::INT AS rank, count(*) OVER (PARTITION BY node) > 20 AS truncated
  FROM views WHERE node IN (SELECT node_id FROM nodes WHERE node_type = 'entity')) SELECT * FROM ranked WHERE rank <= 20""")
def neighborhoods(t: Tables) -> DataFrame:
    return graph.neighborhood(t.edges(), _entity_roots(t), 20).select("root_id", "other", "edge_id", "edge_type", "rank", "truncated")


@query(f"""WITH {_EDGES}, e AS (SELECT DISTINCT edge_id, edge_type FROM views WHERE node IN (SELECT node_id FROM nodes WHERE node_type = 'entity'))
SELECT edge_id, edge_type, (SELECT count(*) FROM e) > 100 AS truncated FROM e ORDER BY edge_id LIMIT 100""")
def owner_subgraph(t: Tables) -> DataFrame:
    return graph.owner_subgraph(t.edges(), t.nodes(), 100).select("edge_id", "edge_type", "truncated")


_HOPS = """
h0 AS (SELECT node_id AS root_id, node_id AS node, 0 AS distance FROM nodes WHERE node_type = 'entity'),
h1 AS (SELECT DISTINCT root_id, other AS node FROM h0 JOIN views USING (node)), r1 AS (SELECT root_id, node, min(distance) AS distance FROM (SELECT * FROM h0 UNION ALL SELECT *, 1 FROM h1) GROUP BY 1, 2),
h2 AS (SELECT DISTINCT root_id, other AS node FROM r1 JOIN views USING (node)), r2 AS (SELECT root_id, node, min(distance) AS distance FROM (SELECT * FROM r1 UNION ALL SELECT *, 2 FROM h2) GROUP BY 1, 2),
h3 AS (SELECT DISTINCT root_id, other AS node FROM r2 JOIN views USING (node)), r3 AS (SELECT root_id, node, min(distance)::INT AS distance FROM (SELECT * FROM r2 UNION ALL SELECT *, 3 FROM h3) GROUP BY 1, 2)"""


@query(f"WITH {_EDGES}, {_HOPS} SELECT root_id, distance, count(*) AS nodes, min(node) AS first_node, max(node) AS last_node FROM (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY distance, node) AS rank FROM r3) WHERE rank <= 200 GROUP BY 1, 2")
def expanded_graph(t: Tables) -> DataFrame:
    return graph.rings(t.edges(), _entity_roots(t), depth=3)


@query(f"WITH {_EDGES}, {_HOPS} SELECT root_id, node, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY distance, node)::INT AS rank FROM r2) WHERE rank <= 50")
def bounded_expansion(t: Tables) -> DataFrame:
    return graph.expand(t.edges(), _entity_roots(t), depth=2, limit=50)


@query(f"WITH {_EDGES} SELECT CASE node_type WHEN 'entity' THEN 'entity' ELSE 'claim' END AS node_type, count(*) AS n FROM nodes GROUP BY 1")
def node_views(t: Tables) -> DataFrame:
    return graph.node_view(t.nodes()).groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


# --- ontology ----------------------------------------------------------------------------------
_ONT = """
props_t AS (SELECT p_partkey AS proposal_id, p_brand AS owner_id, lower(p_type) AS entity_type, p_name AS name, p_partkey AS created_at FROM part WHERE p_size <= 40),
groups_t AS (SELECT owner_id, entity_type, name, count(*) AS n, list(proposal_id ORDER BY created_at DESC) AS ids FROM props_t GROUP BY ALL HAVING count(*) >= 3),
unmapped AS (SELECT * FROM groups_t WHERE entity_type <> 'promo')"""


def _typed_proposals(t: Tables) -> DataFrame:
    return t.raw("part").select(
        F.col("p_partkey").alias("proposal_id"), F.col("p_brand").alias("owner_id"), F.col("p_partkey").alias("created_at"), F.lit("entity").alias("proposal_type"),
        F.when(F.col("p_size") <= 40, "pending").otherwise("rejected").alias("status"),
        F.to_json(F.struct(F.lower("p_type").alias("entity_type"), F.col("p_name").alias("name"))).alias("payload"))


def _unmapped(t: Tables) -> DataFrame:
    return ontology.unmapped_entities(_typed_proposals(t), known=("promo",))


@query(f"WITH {_ONT} SELECT owner_id, entity_type, name, n AS occurrence_count, array_to_string(ids[1:3], '|') AS sample_proposal_ids FROM unmapped")
def unmapped_entity_types(t: Tables) -> DataFrame:
    ids = F.transform("sample_proposal_ids", lambda x: x.cast("string"))
    return _unmapped(t).withColumn("sample_proposal_ids", joined(ids))


@query(f"""WITH {PROPOSALS}, g AS (SELECT owner_id, o_orderpriority AS relationship_type, count(*) AS n, list(proposal_id ORDER BY created_at DESC, proposal_id DESC) AS ids FROM proposals
  WHERE status IN ('pending', 'approved') GROUP BY ALL HAVING count(*) >= 3)
SELECT owner_id, relationship_type, n AS occurrence_count, array_to_string(ids[1:3], '|') AS sample_proposal_ids FROM g WHERE relationship_type <> '5-LOW'""")
def unmapped_relationship_types(t: Tables) -> DataFrame:
    p = t.proposals().withColumns({"proposal_type": F.lit("relationship"), "payload": F.regexp_replace("payload", "priority", "relationship_type")})
    ids = F.transform("sample_proposal_ids", lambda x: x.cast("string"))
    return ontology.unmapped_relationships(p, known=("5-LOW",)).withColumn("sample_proposal_ids", joined(ids))


_BEST = f"""{_ONT}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, entity_type ORDER BY n DESC, name) AS b FROM unmapped) WHERE b = 1)"""


@query(f"""WITH {_BEST} SELECT owner_id, 'entity_type' AS kind, 'Új entitástípus: ' || entity_type AS title,
  '{{"id":"' || entity_type || '","label":"' || upper(entity_type[1]) || entity_type[2:] || '","description":"Recurring extracted type for ' || name || '"}}' AS proposed_definition,
  '{{"entity_type":"' || entity_type || '","sample_name":"' || name || '","occurrence_count":' || n || ',"sample_proposal_ids":[' || array_to_string(ids[1:3], ',') || ']}}' AS evidence,
  'A(z) „' || name || '” entitás ' || n || ' alkalommal jelent meg „' || entity_type || '” típusként, de nincs a normatív ontológiában.' AS rationale FROM best""")
def ontology_proposals(t: Tables) -> DataFrame:
    rows = ontology.entity_type_proposals(_unmapped(t))
    return rows.select("owner_id", "kind", "title", "proposed_definition", "evidence", "rationale")


@query(f"""WITH {PROPOSALS}, g AS (SELECT owner_id, o_orderpriority AS kind_id, count(*) AS n, list(proposal_id ORDER BY created_at DESC, proposal_id DESC) AS ids FROM proposals
  WHERE status IN ('pending', 'approved') GROUP BY ALL HAVING count(*) >= 3)
SELECT owner_id, 'Új kapcsolattípus: ' || kind_id AS title, '{{"relationship_type":"' || kind_id || '","occurrence_count":' || n || ',"sample_proposal_ids":[' || array_to_string(ids[1:3], ',') || ']}}' AS evidence,
  'A(z) „' || kind_id || '” kapcsolat ' || n || ' alkalommal szerepelt, de nincs a normatív ontológiában.' AS rationale FROM g WHERE kind_id <> '5-LOW'""")
def relationship_type_proposals(t: Tables) -> DataFrame:
    p = t.proposals().withColumns({"proposal_type": F.lit("relationship"), "payload": F.regexp_replace("payload", "priority", "relationship_type")})
    rows = ontology.relationship_type_proposals(ontology.unmapped_relationships(p, known=("5-LOW",)))
    return rows.select("owner_id", "title", "evidence", "rationale")


@query(f"""WITH {_BEST}, d AS (SELECT *, entity_type = 'economy' AS pending FROM best)
SELECT owner_id, entity_type, CASE WHEN pending THEN 'approved' ELSE 'pending' END AS status, CASE WHEN pending THEN 'fits' END AS decision_rationale FROM d""")
def decided_ontology(t: Tables) -> DataFrame:
    new = ontology.entity_type_proposals(_unmapped(t))
    economy = F.get_json_object("proposed_definition", "$.id") == "economy"
    stored = new.filter(economy)
    both = stored.unionByName(ontology.without_pending(new, stored))
    said = stored.select("ontology_proposal_id", F.lit("approved").alias("status"), F.lit("fits").alias("rationale"), F.lit("2024-01-01").cast("timestamp").alias("decided_at"))
    rows = ontology.decide(both, said)
    return rows.select("owner_id", F.get_json_object("proposed_definition", "$.id").alias("entity_type"), "status", "decision_rationale")


@query("""WITH r AS (SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'supplies' WHEN '2-HIGH' THEN 'buys' ELSE 'knows' END AS ty, lower(c_mktsegment) AS st, 'nation' AS tt FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT id AS relationship_id, ty AS relationship_type, CASE WHEN ty = 'knows' THEN 'unknown type' WHEN ty = 'supplies' AND st NOT IN ('machinery', 'furniture') THEN 'source type not allowed' WHEN ty = 'buys' THEN 'target type not allowed' END AS violation
FROM r WHERE ty = 'knows' OR ty = 'buys' OR (ty = 'supplies' AND st NOT IN ('machinery', 'furniture'))""")
def relationship_violations(t: Tables) -> DataFrame:
    pr = F.col("o_orderpriority")
    nation = t.raw("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rel = t.raw("orders").join(nation, "o_custkey").select(
        F.col("o_orderkey").alias("relationship_id"), F.when(pr == "1-URGENT", "supplies").when(pr == "2-HIGH", "buys").otherwise("knows").alias("relationship_type"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source_entity_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("target_entity_id"))
    e = t.raw("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("entity_id"), F.lower("c_mktsegment").alias("entity_type")).unionByName(
        t.raw("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("entity_id"), F.lit("nation").alias("entity_type")))
    segments = ("automobile", "building", "furniture", "household", "machinery")
    rules = ontology.ontology_relations(t.spark, (("supplies", ("machinery", "furniture"), ("nation",)), ("buys", segments, ("region",))))
    return ontology.relationship_violations(rel, e, rules).select("relationship_id", "relationship_type", "violation")


# --- reports -----------------------------------------------------------------------------------
_TYPES = "CASE c_mktsegment WHEN 'MACHINERY' THEN 'project' WHEN 'HOUSEHOLD' THEN 'person' WHEN 'BUILDING' THEN 'repository' ELSE 'technology' END"
_REPORT = f"""
ent AS (SELECT c_custkey AS entity_id, c_nationkey AS owner_id, {_TYPES} AS entity_type, c_name AS canonical_name FROM customer),
clm AS (SELECT o_orderkey AS claim_id, c_nationkey AS owner_id, CASE WHEN o_totalprice > 250000 THEN o_custkey END AS subject_entity_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'has_decision' WHEN '2-HIGH' THEN 'has_task' WHEN '3-MEDIUM' THEN 'has_event' ELSE 'mentions' END AS predicate,
  'order ' || o_orderkey AS object_value, CASE WHEN o_orderstatus = 'P' THEN 'superseded' ELSE 'active' END AS status, o_orderdate AS created_at FROM orders JOIN customer ON c_custkey = o_custkey),
fnd AS (SELECT o_orderkey AS finding_id, c_nationkey AS owner_id, 'conflict ' || o_orderkey AS summary, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS status, o_orderdate AS created_at
  FROM orders JOIN customer ON c_custkey = o_custkey),
etop AS (SELECT *, row_number() OVER (PARTITION BY owner_id, entity_type ORDER BY canonical_name, entity_id) AS rn FROM ent),
ctop AS (SELECT *, row_number() OVER (PARTITION BY owner_id, predicate ORDER BY created_at DESC, claim_id DESC) AS rn FROM clm WHERE status = 'active' AND predicate <> 'mentions')"""


def _report_tables(t: Tables) -> dict[str, DataFrame]:
    seg, pr, st = F.col("c_mktsegment"), F.col("o_orderpriority"), F.col("o_orderstatus")
    c = t.raw("customer")
    o = t.raw("orders").join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("owner_id")), "o_custkey")
    kind = F.when(seg == "MACHINERY", "project").when(seg == "HOUSEHOLD", "person").when(seg == "BUILDING", "repository").otherwise("technology")
    predicate = F.when(pr == "1-URGENT", "has_decision").when(pr == "2-HIGH", "has_task").when(pr == "3-MEDIUM", "has_event").otherwise("mentions")
    return {
        "entities": c.select(F.col("c_custkey").alias("entity_id"), F.col("c_nationkey").alias("owner_id"), kind.alias("entity_type"), F.col("c_name").alias("canonical_name")),
        "claims": o.select(F.col("o_orderkey").alias("claim_id"), "owner_id", F.when(F.col("o_totalprice") > 250000, F.col("o_custkey")).alias("subject_entity_id"),
                           predicate.alias("predicate"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("object_value"),
                           F.when(st == "P", "superseded").otherwise("active").alias("status"), F.col("o_orderdate").alias("created_at")),
        "findings": o.select(F.col("o_orderkey").alias("finding_id"), "owner_id", F.concat(F.lit("conflict "), F.col("o_orderkey").cast("string")).alias("summary"),
                             F.when(st == "O", "open").otherwise("closed").alias("status"), F.col("o_orderdate").alias("created_at")),
        "provenance": t.raw("lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("proposal_id"), F.col("l_suppkey").alias("chunk_id")),
        "sources": t.raw("supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_nationkey").alias("owner_id"), F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("enabled")),
        "proposals": o.select("owner_id", F.when(st == "O", "pending").otherwise("approved").alias("status")),
        "runs": t.raw("lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_shipdate").alias("completed_at")),
    }


def _list(source: str, value: str, cond: str, limit: int) -> str:
    return f"coalesce((SELECT string_agg({value}, '|' ORDER BY rn) FROM {source} x WHERE x.owner_id = o.owner_id AND {cond} AND rn <= {limit}), '')"


@query(f"""WITH {_REPORT}, {_OUTBOX}, o AS (SELECT owner_id FROM ent UNION SELECT owner_id FROM clm UNION SELECT s_nationkey FROM supplier),
d AS (SELECT owner_id, {_list('etop', 'canonical_name', "entity_type = 'project'", 20)} AS projects, {_list('etop', 'canonical_name', "entity_type = 'person'", 20)} AS people,
  {_list('ctop', 'object_value', "predicate = 'has_task'", 20)} AS tasks, {_list('ctop', 'object_value', "predicate = 'has_decision'", 20)} AS decisions,
  (SELECT count(*) FROM ent x WHERE x.owner_id = o.owner_id AND entity_type = 'project') AS np, (SELECT count(*) FROM ent x WHERE x.owner_id = o.owner_id AND entity_type = 'repository') AS nr,
  (SELECT count(*) FROM ctop x WHERE x.owner_id = o.owner_id AND predicate = 'has_task') AS nt,
  (SELECT count(*) FROM fnd x WHERE x.owner_id = o.owner_id AND status = 'open') AS open_contradictions, (SELECT count(*) FROM fnd x WHERE x.owner_id = o.owner_id AND status = 'open') AS pending_proposals,
  (SELECT count(*) FROM supplier WHERE s_nationkey = o.owner_id) AS sources_total, (SELECT count(*) FROM outbox WHERE status = 'pending') AS pending_outbox_events,
  (SELECT strftime(max(l_shipdate), '%Y-%m-%d') FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = o.owner_id) AS last_sync FROM o)
SELECT owner_id, projects, people, tasks, decisions, open_contradictions, pending_proposals, sources_total, pending_outbox_events, last_sync,
  np || ' projects, ' || nr || ' repositories, ' || nt || ' open tasks, ' || open_contradictions || ' contradictions' AS summary FROM d""")
def project_dashboards(t: Tables) -> DataFrame:
    r = _report_tables(t)
    d = reports.dashboard(r["entities"], r["claims"], r["sources"], r["findings"], t.outbox(), r["proposals"], r["runs"])
    return d.select("owner_id", *[joined(c).alias(c) for c in ("projects", "people", "tasks", "decisions")], "open_contradictions", "pending_proposals",
                    "sources_total", "pending_outbox_events", F.date_format("last_sync_at", "yyyy-MM-dd").alias("last_sync"), "summary")


_CITES = """cites AS (SELECT owner_id, string_agg(ref, '|' ORDER BY ref) AS citations, count(*) AS n FROM (SELECT DISTINCT c.owner_id, unnest(['proposal:' || l_partkey, 'chunk:' || l_suppkey]) AS ref
  FROM ctop c JOIN lineitem ON l_orderkey = c.claim_id WHERE rn <= 50) GROUP BY 1)"""
_PERIOD = _REPORT.replace("predicate <> 'mentions')", "predicate <> 'mentions' AND created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '1998-06-30')")


@query(f"""WITH {_PERIOD}, {_CITES}, o AS (SELECT DISTINCT owner_id FROM ent)
SELECT owner_id, 'Project status report from 1996-01-01 to 1998-06-30' AS title, {_list('ctop', 'object_value', "predicate = 'has_task'", 50)} AS tasks, {_list('ctop', 'object_value', "predicate = 'has_event'", 50)} AS events,
  {_list('etop', 'canonical_name', "entity_type = 'technology'", 30)} AS technologies, coalesce(citations, '') AS citations,
  (SELECT count(*) FROM ctop x WHERE x.owner_id = o.owner_id AND predicate = 'has_decision') || ' decisions, ' || (SELECT count(*) FROM ctop x WHERE x.owner_id = o.owner_id AND predicate = 'has_task') || ' tasks, '
  || (SELECT count(*) FROM ctop x WHERE x.owner_id = o.owner_id AND predicate = 'has_event') || ' events in the selected period.' AS summary FROM o LEFT JOIN cites USING (owner_id)""")
def status_reports(t: Tables) -> DataFrame:
    import datetime as dt

    r = _report_tables(t)
    s = reports.status_report(r["entities"], r["claims"], r["provenance"], dt.datetime(1996, 1, 1), dt.datetime(1998, 6, 30))
    return s.select("owner_id", "title", *[joined(c).alias(c) for c in ("tasks", "events", "technologies", "citations")], "summary")


def _sec(title: str, items: str) -> str:
    return f"'## {title}' || chr(10) || chr(10) || coalesce({items}, '{reports.NOTHING}') || chr(10)"


_PROJECT = """p AS (SELECT entity_id, owner_id, canonical_name AS name FROM ent WHERE entity_type = 'project'),
pc AS (SELECT p.entity_id, c.*, row_number() OVER (PARTITION BY p.entity_id, c.predicate ORDER BY created_at DESC, claim_id DESC) AS place
  FROM p JOIN clm c ON c.owner_id = p.owner_id AND (subject_entity_id IS NULL OR subject_entity_id = p.entity_id) WHERE status = 'active' AND predicate <> 'mentions'),
cites AS (SELECT entity_id, string_agg(ref, '|' ORDER BY ref) AS citations, count(*) AS n FROM (SELECT DISTINCT entity_id, unnest(['proposal:' || l_partkey, 'chunk:' || l_suppkey]) AS ref
  FROM pc JOIN lineitem ON l_orderkey = pc.claim_id WHERE place <= 50) GROUP BY 1)"""


@query(f"""WITH {_REPORT}, {_PROJECT},
sc AS (SELECT entity_id, predicate, count(*) AS n, string_agg('- ' || object_value, chr(10) ORDER BY place) FILTER (place <= 50) AS lines FROM pc GROUP BY 1, 2),
rk AS (SELECT owner_id, count(*) AS n, string_agg('- ' || summary, chr(10) ORDER BY rn) FILTER (rn <= 20) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, finding_id DESC) AS rn FROM fnd WHERE status = 'open') GROUP BY 1),
te AS (SELECT owner_id, '- Technológiák: ' || string_agg(canonical_name, ', ' ORDER BY rn) AS line FROM etop WHERE entity_type = 'technology' AND rn <= 30 GROUP BY 1),
x AS (SELECT p.*, coalesce(d.n, 0) AS nd, d.lines AS dl, coalesce(k.n, 0) AS nk, k.lines AS kl, coalesce(e.n, 0) AS ne, e.lines AS el, coalesce(rk.n, 0) AS nr, rk.lines AS rl, te.line, citations
  FROM p LEFT JOIN sc d ON d.entity_id = p.entity_id AND d.predicate = 'has_decision' LEFT JOIN sc k ON k.entity_id = p.entity_id AND k.predicate = 'has_task' LEFT JOIN sc e ON e.entity_id = p.entity_id AND e.predicate = 'has_event'
  LEFT JOIN rk ON rk.owner_id = p.owner_id LEFT JOIN te ON te.owner_id = p.owner_id LEFT JOIN cites ON cites.entity_id = p.entity_id)
SELECT entity_id AS project_id, '# Projektjelentés: ' || name || chr(10) || chr(10) || '**Időszak:** teljes időszak' || chr(10) || chr(10) || '## Összefoglaló' || chr(10) || chr(10)
  || 'A(z) „' || name || '” projekthez ' || nd || ' döntés, ' || nk || ' feladat, ' || ne || ' esemény és ' || nr || ' kockázat tartozik a kiválasztott időszakban.' || chr(10) || chr(10)
  || {_sec("Változások", "nullif(concat_ws(chr(10), el, line), '')")} || {_sec("Kockázatok", "rl")} || {_sec("Döntések", "dl")} || {_sec("Nyitott feladatok", "kl")}
  || coalesce('## Hivatkozások' || chr(10) || chr(10) || '- ' || replace(citations, '|', chr(10) || '- ') || chr(10), '') AS markdown FROM x""")
def project_reports(t: Tables) -> DataFrame:
    return _rendered(t).select("project_id", "markdown")


def _rendered(t: Tables) -> DataFrame:
    r = _report_tables(t)
    projects = r["entities"].filter("entity_type = 'project'")
    return reports.render_reports(reports.project_subgraphs(projects, r["entities"], r["claims"], r["provenance"], r["findings"]))


@query(f"""WITH {_REPORT}, {_PROJECT}
SELECT c.c_custkey AS project_id, CASE WHEN e.entity_id IS NULL THEN 'failed' ELSE 'completed' END AS status, CASE WHEN e.entity_id IS NULL THEN 'Project not found' END AS error_summary,
  CASE WHEN e.entity_id IS NOT NULL THEN coalesce(n, 0) END AS citation_count FROM customer c LEFT JOIN ent e ON e.entity_id = c.c_custkey AND e.entity_type = 'project' LEFT JOIN cites ON cites.entity_id = e.entity_id""")
def report_ledger(t: Tables) -> DataFrame:
    asked = t.raw("customer").select(F.col("c_nationkey").alias("owner_id"), F.col("c_custkey").alias("project_id"))
    return reports.report_ledger(asked, _rendered(t)).select("project_id", "status", "error_summary", F.col("citation_count").cast("bigint").alias("citation_count"))


@query(f"""WITH {VERSIONS}, c AS (SELECT l_suppkey AS source_id, count(*) AS content_chunks FROM lineitem GROUP BY 1),
e AS (SELECT source_id, string_agg(external_id || '=' || extraction_error, '|' ORDER BY rn) AS errors FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY observed_at DESC, version_id DESC) AS rn FROM versions WHERE extraction_status = 'failed') WHERE rn <= 5 GROUP BY 1),
s AS (SELECT source_id, string_agg(external_id || '=low', '|' ORDER BY rn) AS samples, round(max(relevance), 6) AS top_relevance FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY observed_at DESC, version_id DESC) AS rn FROM versions WHERE triage_status = 'completed') WHERE rn <= 5 GROUP BY 1)
SELECT v.source_id, count(*) FILTER (extraction_status = 'pending') AS extraction_pending, count(*) FILTER (extraction_status = 'failed') AS extraction_failed, count(*) FILTER (knowledge_status = 'skipped') AS knowledge_skipped,
  count(*) FILTER (triage_status = 'completed') AS triage_completed, max(coalesce(content_chunks, 0)) AS content_chunks, max(coalesce(errors, '')) AS errors, max(coalesce(samples, '')) AS samples, max(top_relevance) AS top_relevance
FROM versions v LEFT JOIN c USING (source_id) LEFT JOIN e USING (source_id) LEFT JOIN s USING (source_id) GROUP BY 1""")
def source_statistics(t: Tables) -> DataFrame:
    r = reports.source_stats(t.versions(), t.version_chunks())
    pair = lambda a, b: joined(F.transform(a, lambda x: F.concat(x["external_id"], F.lit("="), x[b])))
    return r.select("source_id", "extraction_pending", "extraction_failed", "knowledge_skipped", "triage_completed", "content_chunks",
                    F.coalesce(pair("recent_errors", "error"), F.lit("")).alias("errors"), F.coalesce(pair("recent_triage", "sensitivity"), F.lit("")).alias("samples"),
                    F.round(F.array_max(F.transform("recent_triage", lambda x: x["relevance"])), 6).alias("top_relevance"))


@query(f"""WITH {VERSIONS} SELECT count(*) FILTER (extraction_status = 'pending') AS extraction_pending, count(*) FILTER (extraction_status = 'failed') AS extraction_failed, count(*) FILTER (knowledge_status = 'pending') AS knowledge_pending,
  count(*) FILTER (triage_status = 'pending' AND extraction_status = 'pending') AS triage_pending, count(*) FILTER (knowledge_status = 'pending' AND extraction_status = 'completed') AS knowledge_ready FROM versions""")
def queue_depths(t: Tables) -> DataFrame:
    return reports.pipeline_snapshot(t.versions())


@query(f"WITH {_OUTBOX} SELECT count(*) FILTER (status = 'pending') AS pending_outbox_events, 0::BIGINT AS failed_outbox_events, count(*) FILTER (status = 'processed') AS processed_outbox_events FROM outbox")
def outbox_counts(t: Tables) -> DataFrame:
    return reports.outbox_counts(t.outbox())


_DRIFT = "old_m AS (SELECT DISTINCT l_orderkey AS version_id FROM lineitem WHERE l_returnflag = 'R')"


@query(f"WITH {VERSIONS}, {_DRIFT} SELECT version_id FROM versions WHERE NOT flagged AND version_id IN (SELECT version_id FROM old_m)")
def drifted_versions(t: Tables) -> DataFrame:
    return reports.drifted_versions(t.versions(), t.version_chunks(), "current-model").select("version_id")


@query(f"""WITH {VERSIONS}, {_DRIFT} SELECT CASE WHEN flagged OR version_id IN (SELECT version_id FROM old_m) THEN '{{"embedding_model_mismatch":true}}' ELSE '{{}}' END AS maintenance_flags, count(*) AS n FROM versions GROUP BY 1""")
def flagged_versions(t: Tables) -> DataFrame:
    rows = reports.flag_drifted(t.versions(), t.version_chunks(), "current-model")
    return rows.groupBy("maintenance_flags").agg(F.count(F.lit(1)).alias("n"))


_STATUS = f"""{VERSIONS}, {_DRIFT}, {_OUTBOX}, {CLAIMS},
s AS (SELECT (SELECT count(*) FROM outbox WHERE status = 'pending') AS po, (SELECT count(*) FROM versions WHERE extraction_status = 'pending') AS ep, (SELECT count(*) FROM versions WHERE extraction_status = 'failed') AS ef,
  (SELECT count(*) FROM versions WHERE knowledge_status = 'pending') AS kp, (SELECT count(*) FROM versions WHERE NOT flagged AND version_id IN (SELECT version_id FROM old_m)) AS em,
  (SELECT count(*) FROM part) AS canonical_entities, (SELECT count(*) FROM claims WHERE status = 'active') AS canonical_claims)"""


@query(f"""WITH {_STATUS} SELECT po AS pending_outbox_events, em AS embedding_model_mismatch_versions, canonical_entities, canonical_claims, po > 100 AS projection_rebuild_recommended, true AS maintenance_recommended,
  'Outbox várakozó: ' || po || ' · Feldolgozás várakozó: ' || ep || ' · Tudás várakozó: ' || kp || ' · Feldolgozási hiba: ' || ef || ' · Embedding eltérés: ' || em AS status_summary FROM s""")
def operations_status(t: Tables) -> DataFrame:
    return _status(t).select("pending_outbox_events", "embedding_model_mismatch_versions", "canonical_entities", "canonical_claims",
                             "projection_rebuild_recommended", "maintenance_recommended", "status_summary")


def _status(t: Tables) -> DataFrame:
    return reports.operations_status(t.versions(), t.version_chunks(), t.outbox(), t.entities(), t.claims(), "current-model")


@query(f"WITH {_STATUS} SELECT ep > 0 OR kp > 0 AS pipeline_recovery_enqueued, em AS embedding_mismatch_flagged FROM s")
def recovery_decision(t: Tables) -> DataFrame:
    return reports.recovery_decision(_status(t))


# --- streaming ---------------------------------------------------------------------------------
def _stream(t: Tables, table: str) -> DataFrame:
    """The table as a file stream, whether it is one file or a folder of files; the braces make Spark resolve either as a pattern."""
    return jobs.read_files(t.spark, f"{t.dir}/{{{table}.parquet}}", t.raw(table).schema)


class _Streamed(Tables):
    """The same views over file streams."""

    def raw(self, name: str) -> DataFrame:
        return _stream(Tables(self.spark, self.dir), name)


@query(f"""WITH {_graph(False)} SELECT 'node' AS kind, node_id AS id, node_type AS a, label AS b FROM nodes UNION ALL SELECT 'edge', edge_id, src, dst FROM edges
UNION ALL SELECT 'dead letter', event_id::VARCHAR, 'failed', '1' FROM outbox WHERE kind = 'error' AND status = 'pending'
UNION ALL SELECT 'processed', event_id::VARCHAR, 'processed', '' FROM outbox WHERE kind <> 'error' AND status = 'pending'""")
def streamed_outbox(t: Tables) -> DataFrame:
    """Outbox rows in three batches, each of as many files as keep the cores at work: edges often come before their ends."""
    out = work_folder(t.spark, "outbox")
    files = -(-t.spark.sparkContext.defaultParallelism // 3)
    t.outbox().repartition(3 * files, F.xxhash64("event_id")).write.option("compression", "zstd").parquet(f"{out}/arriving")
    events = jobs.read_files(t.spark, f"{out}/arriving", t.outbox().schema, max_files=files)
    jobs.project_outbox(events, out, f"{out}/checkpoint").awaitTermination()
    nodes, edges = jobs.read_projection(events, out)
    dead, done = t.spark.read.parquet(f"{out}/dead_letters"), t.spark.read.parquet(f"{out}/projected")
    return (
        nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), F.col("node_type").alias("a"), F.col("label").alias("b"))
        .union(edges.select(F.lit("edge"), "edge_id", "src", "dst"))
        .union(dead.select(F.lit("dead letter"), "event_id", "status", F.col("retry_count").cast("string")))
        .union(done.select(F.lit("processed"), "event_id", "status", F.lit("")))
    )


def _track(t: Tables, out: str) -> None:
    jobs.track_changes(_stream(t, "events"), "user_id", F.col("event_type"), "event_id", out, f"{out}/checkpoint").awaitTermination()


@query("""SELECT user_id::VARCHAR AS object_id, event_type AS content_hash, event_id AS seq FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
WHERE before IS DISTINCT FROM event_type""")
def streamed_changes(t: Tables) -> DataFrame:
    out = work_folder(t.spark, "changes")
    _track(t, out)
    return jobs.read_changes(t.spark, out)


@query("""SELECT user_id::VARCHAR AS object_id, arg_max(event_type, event_id) AS content_hash FROM events GROUP BY 1""")
def streamed_snapshot(t: Tables) -> DataFrame:
    out = work_folder(t.spark, "snapshot")
    _track(t, out)
    return jobs.read_latest(t.spark, out).select("object_id", "content_hash")


@query(r"""SELECT 'chunk' AS kind, sum(CASE WHEN n <= 800 THEN 1 ELSE ceil((n - 800) / 700.0)::BIGINT + 1 END)::BIGINT AS n FROM (SELECT length(text) AS n FROM conversations)
UNION ALL SELECT 'high risk', count(*) FROM conversations WHERE role = 'system'""")
def streamed_ingest(t: Tables) -> DataFrame:
    out = work_folder(t.spark, "ingest")
    docs = _stream(t, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("version_id"), F.lit(1).alias("owner_id"),
        F.col("conv_id").alias("source_id"), F.when(F.col("role") == "system", ".env").otherwise("note.txt").alias("external_id"),
        F.lit("text/plain").alias("mime_type"), F.lit(None).cast("string").alias("configuration"), "text", F.col("turn").alias("created_at"))
    jobs.ingest_documents(docs, out, f"{out}/checkpoint").awaitTermination()
    count = lambda df, k: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n")
    read = t.spark.read.parquet
    return count(read(f"{out}/chunks"), "chunk").unionByName(count(read(f"{out}/triage").filter("review_risk = 'high'"), "high risk"))


@query(ORACLES["contradictions"])
def streamed_contradictions(t: Tables) -> DataFrame:
    """The claims dealt by hash into four batches, each of as many files as keep the cores at work: the rows of the batch operator."""
    out = work_folder(t.spark, "claims")
    files = -(-t.spark.sparkContext.defaultParallelism // 4)
    t.claims().repartition(4 * files, "claim_id").write.option("compression", "zstd").parquet(f"{out}/arriving")
    drop_shuffles(t.spark)
    stream = jobs.read_files(t.spark, f"{out}/arriving", t.claims().schema, max_files=files)
    jobs.find_contradictions(stream, out, f"{out}/checkpoint").awaitTermination()
    rows = canonical.with_finding_text(jobs.read_contradictions(stream, out))
    return rows.select("conflicting_claim_id", "existing_claim_id", "predicate", "conflicting_value", "differing_claims", "summary")


_CLAIM_PARTS = [
    ("claim", "'mentions'", "CASE WHEN len(names) >= 2 THEN [names[2]] ELSE [] END", "names[1]"), ("task", "'has_task'", "tasks", "NULL"),
    ("decision", "'has_decision'", "decisions", "NULL"), ("event", "'has_event'", "events", "NULL")]
_STATED = " UNION ALL ".join(
    f"SELECT version_id, owner_id, {predicate} AS predicate, {values}[i + 1] AS v, {subject} AS lead, len(tech) AS n_tech, "
    f"sha256('claim|' || sha256('proposal|' || version_id || '|{kind}|' || i)) AS claim_id FROM (SELECT *, unnest(range(0, len({values}))) AS i FROM n)"
    for kind, predicate, values, subject in _CLAIM_PARTS)
_STREAMED = f"""{knowledge._FACTS}, n AS (SELECT *, list_concat(tech, persons) AS names FROM g),
named AS (SELECT DISTINCT owner_id, 'technology' AS t, unnest(tech) AS name FROM n UNION SELECT DISTINCT owner_id, 'person', unnest(persons) FROM n),
ent AS (SELECT sha256('entity|' || owner_id || '|' || t || '|' || name) AS id, t, name FROM named),
claims AS (SELECT *, CASE WHEN lead IS NOT NULL THEN sha256('entity|' || owner_id || '|' || CASE WHEN n_tech > 0 THEN 'technology' ELSE 'person' END || '|' || lead) END AS subject,
  lower({strip("v")}) AS value_key FROM ({_STATED})),
vals AS (SELECT owner_id, coalesce(subject, '') AS s, predicate, value_key, min((version_id, claim_id)) AS f FROM claims GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY owner_id, s, predicate ORDER BY f) AS place FROM vals),
finds AS (SELECT c.claim_id, struct_extract_at(p.f, 2) AS existing FROM claims c JOIN placed p ON p.owner_id = c.owner_id AND p.s = coalesce(c.subject, '') AND p.predicate = c.predicate AND p.value_key <> c.value_key
  AND p.place = (SELECT min(place) FROM placed q WHERE q.owner_id = c.owner_id AND q.s = coalesce(c.subject, '') AND q.predicate = c.predicate AND q.value_key <> c.value_key AND q.place <= 2)
  WHERE p.f < (c.version_id, c.claim_id)),
rel AS (SELECT sha256('relationship|' || sha256('proposal|' || version_id || '|relationship|0')) AS id,
  sha256('entity|' || owner_id || '|' || CASE WHEN len(tech) > 0 THEN 'technology' ELSE 'person' END || '|' || names[1]) AS src,
  sha256('entity|' || owner_id || '|' || CASE WHEN len(tech) > 1 THEN 'technology' ELSE 'person' END || '|' || names[2]) AS dst FROM n WHERE len(names) >= 2),
fnd AS (SELECT sha256('finding|' || existing || '|' || claim_id) AS id, existing, claim_id FROM finds)
SELECT 'entity' AS kind, id, t AS a, name AS b FROM ent UNION ALL SELECT 'claim', claim_id, predicate, v FROM claims UNION ALL SELECT 'finding', id, existing, claim_id FROM fnd
UNION ALL SELECT 'node', id, 'entity', '' FROM ent UNION ALL SELECT 'node', claim_id, 'claim', '' FROM claims UNION ALL SELECT 'node', id, 'finding', '' FROM fnd
UNION ALL SELECT 'edge', id, src, dst FROM rel UNION ALL SELECT 'edge', sha256('edge|' || subject || '|HAS_CLAIM|' || claim_id), subject, claim_id FROM claims WHERE subject IS NOT NULL
UNION ALL SELECT 'edge', sha256('edge|' || id || '|CONTRADICTS|' || existing), id, existing FROM fnd"""


@query(f"WITH {_STREAMED}")
def streamed_knowledge(t: Tables) -> DataFrame:
    """Documents in two files, one a batch: the entities, claims, findings, nodes and edges of all of them together."""
    out = work_folder(t.spark, "knowledge")
    docs = t.documents().select(
        "version_id", "owner_id", "source_id", F.lit("note.txt").alias("external_id"), F.lit("text/plain").alias("mime_type"),
        F.lit(None).cast("string").alias("configuration"), "text", F.col("version_id").alias("created_at"))
    # Small row groups, so that all cores share a batch of one file.
    docs.repartition(2, F.xxhash64("version_id")).write.options(compression="zstd", **{"parquet.block.size": 8 << 20}).parquet(f"{out}/arriving")
    drop_shuffles(t.spark)
    stream = jobs.read_files(t.spark, f"{out}/arriving", docs.schema, max_files=1)
    jobs.ingest_documents(
        stream, out, f"{out}/checkpoint", knowledge.PATTERNS, lambda p: p.filter("confidence >= 0.6"), multi_valued=()).awaitTermination()
    got = jobs.read_knowledge(jobs.knowledge_tables(t.spark, out, docs.schema["owner_id"].dataType, docs.schema["created_at"].dataType))
    return (
        got["entities"].select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), F.col("entity_type").alias("a"), F.col("canonical_name").alias("b"))
        .union(got["claims"].select(F.lit("claim"), "claim_id", "predicate", "object_value"))
        .union(got["findings"].select(F.lit("finding"), "finding_id", "existing_claim_id", "conflicting_claim_id"))
        .union(got["nodes"].select(F.lit("node"), "node_id", "node_type", F.lit("")))
        .union(got["edges"].select(F.lit("edge"), "edge_id", "src", "dst"))
    )
