"""Table schemas (Spark DDL) and enumerations of the knowledge model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCES = (
    "source_id STRING, type STRING, name STRING, owner_id STRING, configuration STRING, enabled BOOLEAN, "
    "default_project_id STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
)
SYNC_RUNS = (
    "run_id STRING, source_id STRING, mode STRING, status STRING, idempotency_key STRING, "
    "objects_discovered INT, objects_processed INT, objects_failed INT, error_summary STRING, "
    "started_at TIMESTAMP, completed_at TIMESTAMP, created_at TIMESTAMP"
)
DISCOVERED = "external_id STRING, object_type STRING, content_hash STRING, mime_type STRING, content_ref STRING"
SOURCE_OBJECTS = "object_id STRING, source_id STRING, external_id STRING, object_type STRING, created_at TIMESTAMP"
VERSIONS = (
    "version_id STRING, object_id STRING, source_id STRING, owner_id STRING, external_id STRING, "
    "content_hash STRING, mime_type STRING, content_ref STRING, observed_at TIMESTAMP, "
    "extraction_status STRING, knowledge_status STRING, triage_status STRING, triage_metadata STRING, "
    "maintenance_flags STRING, extraction_error STRING, pipeline_version STRING"
)
CHUNKS = (
    "chunk_id STRING, version_id STRING, source_id STRING, owner_id STRING, chunk_index INT, text STRING, "
    "token_count INT, embedding_model STRING, embedding_dimension INT, embedding ARRAY<DOUBLE>, "
    "content_hash STRING, anchor_start INT, anchor_end INT"
)
PROPOSALS = (
    "proposal_id STRING, owner_id STRING, run_id STRING, proposal_type STRING, status STRING, "
    "risk_level STRING, confidence DOUBLE, title STRING, payload STRING, original_payload STRING, "
    "project_id STRING, source_id STRING, requires_review BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP"
)
EVIDENCE = (
    "evidence_id STRING, proposal_id STRING, version_id STRING, chunk_id STRING, anchor_start INT, "
    "anchor_end INT, excerpt STRING"
)
DECISIONS = (
    "decision_id STRING, proposal_id STRING, actor_id STRING, action STRING, rationale STRING, "
    "edited_payload STRING, created_at TIMESTAMP"
)
ENTITY_INDEX = (
    "index_id STRING, owner_id STRING, entity_type STRING, canonical_name STRING, aliases ARRAY<STRING>, "
    "status STRING, source_proposal_id STRING, canonical_entity_id STRING"
)
ENTITIES = (
    "entity_id STRING, owner_id STRING, entity_type STRING, canonical_name STRING, aliases ARRAY<STRING>, "
    "description STRING, status STRING, source_proposal_id STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
)
CLAIMS = (
    "claim_id STRING, owner_id STRING, subject_entity_id STRING, predicate STRING, object_value STRING, "
    "status STRING, confidence DOUBLE, source_proposal_id STRING, created_at TIMESTAMP"
)
PROVENANCE = (
    "provenance_id STRING, claim_id STRING, version_id STRING, chunk_id STRING, proposal_id STRING, "
    "run_id STRING, confidence DOUBLE, created_at TIMESTAMP"
)
RELATIONSHIPS = (
    "relationship_id STRING, owner_id STRING, source_entity_id STRING, target_entity_id STRING, "
    "relationship_type STRING, status STRING, source_proposal_id STRING, created_at TIMESTAMP"
)
FINDINGS = (
    "finding_id STRING, owner_id STRING, existing_claim_id STRING, conflicting_claim_id STRING, "
    "status STRING, summary STRING, evidence STRING, created_at TIMESTAMP"
)
ONTOLOGY_PROPOSALS = (
    "ontology_proposal_id STRING, owner_id STRING, kind STRING, status STRING, title STRING, "
    "rationale STRING, proposed_definition STRING, evidence STRING, ontology_version STRING, "
    "decision_rationale STRING, decided_at TIMESTAMP"
)
OUTBOX = (
    "event_id STRING, aggregate_type STRING, aggregate_id STRING, event_type STRING, payload STRING, "
    "status STRING, retry_count INT, created_at TIMESTAMP"
)
AUDIT = (
    "audit_id STRING, actor_id STRING, action STRING, object_type STRING, object_id STRING, "
    "correlation_id STRING, metadata STRING, created_at TIMESTAMP"
)
QUESTIONS = "query_id STRING, owner_id STRING, question STRING"

_ENTITY = (
    "STRUCT<local_id:STRING,name:STRING,entity_type:STRING,aliases:ARRAY<STRING>,description:STRING,"
    "confidence:DOUBLE,chunk_id:STRING,anchor_start:INT,anchor_end:INT>"
)
_CLAIM = (
    "STRUCT<local_id:STRING,subject_local_id:STRING,predicate:STRING,value:STRING,confidence:DOUBLE,"
    "chunk_id:STRING>"
)
_RELATION = (
    "STRUCT<local_id:STRING,source_local_id:STRING,target_local_id:STRING,relationship_type:STRING,"
    "confidence:DOUBLE,chunk_id:STRING>"
)
_TASK = "STRUCT<local_id:STRING,title:STRING,status:STRING,confidence:DOUBLE,chunk_id:STRING>"
_EVENT = "STRUCT<local_id:STRING,title:STRING,event_type:STRING,confidence:DOUBLE,chunk_id:STRING>"
EXTRACTION = (
    f"version_id STRING, schema_version STRING, entities ARRAY<{_ENTITY}>, claims ARRAY<{_CLAIM}>, "
    f"relationships ARRAY<{_RELATION}>, tasks ARRAY<{_TASK}>, decisions ARRAY<{_TASK}>, "
    f"events ARRAY<{_EVENT}>, warnings ARRAY<STRING>"
)

# Enumerations stored as text.
ENUMS: dict[str, tuple[str, ...]] = {
    "entity_type": ("project", "person", "organization", "document", "repository", "technology",
                    "concept", "system_component", "external_system"),
    "proposal_type": ("entity", "claim", "relationship", "task", "decision", "event",
                      "entity_resolution", "merge"),
    "proposal_status": ("pending", "approved", "rejected", "deferred", "merged"),
    "risk_level": ("low", "medium", "high"),
    "claim_status": ("proposed", "approved", "active", "superseded", "rejected", "retracted"),
    "extraction_status": ("pending", "completed", "failed", "skipped"),
    "sync_mode": ("full", "incremental"),
    "outbox_status": ("pending", "processed", "failed"),
    "retrieval_signal": ("keyword", "semantic", "graph", "canonical"),
}


def check_enum(c: Column, name: str) -> Column:
    return F.coalesce(c.isin(*ENUMS[name]), F.lit(False))


def check_confidence(c: Column) -> Column:
    return F.coalesce(c.between(0.0, 1.0), F.lit(False))
