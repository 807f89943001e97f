"""Ontology curation: recurring types outside the ontology become proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knowloom.functions import jsonx
from knowloom.functions.hashing import stable_id
from knowloom.functions.skew import top_k

MIN_OCCURRENCES = 3
# The core ontology.
VERSION = "0.1.0"
ENTITY_TYPES = ("entity",)
RELATION_TYPES = (("relates_to", ("entity",), ("entity",)),)


def ontology_relations(spark: SparkSession, relations=RELATION_TYPES) -> DataFrame:
    return spark.createDataFrame(
        [(r, list(s), list(t)) for r, s, t in relations],
        "relationship_type string, source_types array<string>, target_types array<string>",
    )


def _recurring(rows: DataFrame, keys: list[str], min_occurrences: int, cap: int | None) -> DataFrame:
    """Groups with enough occurrences, most frequent first, with their three newest proposal ids."""
    scope = ["owner_id", *keys]
    counts = rows.groupBy(*scope).agg(F.count(F.lit(1)).alias("occurrence_count")).filter(
        F.col("occurrence_count") >= min_occurrences
    )
    if cap is not None:
        counts = top_k(counts, ["owner_id"], [F.desc("occurrence_count"), *[F.col(k) for k in keys]], cap).drop("rank")
    newest = top_k(rows, scope, [F.desc("created_at"), F.desc("proposal_id")], 3)
    samples = newest.groupBy(*scope).agg(F.sort_array(F.collect_list(F.struct("rank", "proposal_id"))).alias("_s"))
    return counts.join(samples, scope).withColumn(
        "sample_proposal_ids", F.transform("_s", lambda x: x["proposal_id"])
    ).drop("_s")


def unmapped_entities(
    proposals: DataFrame, known: tuple[str, ...] = ENTITY_TYPES, min_occurrences: int = MIN_OCCURRENCES,
    cap: int | None = None,
) -> DataFrame:
    """Recurring (type, name) pairs of entity proposals whose type is not in the ontology.

    ``cap`` is a page size per owner, most frequent first.
    """
    p = F.col("payload")
    rows = proposals.filter(
        F.col("proposal_type").isin("entity", "entity_resolution") & F.col("status").isin("pending", "approved")
        & jsonx.has_key(p, "entity_type") & jsonx.has_key(p, "name")
    ).select("owner_id", "proposal_id", "created_at", jsonx.field(p, "entity_type").alias("entity_type"),
             jsonx.field(p, "name").alias("name"))
    rows = rows.filter(F.coalesce("entity_type", F.lit("")) != "").filter(~F.col("entity_type").isin(*known))
    return _recurring(rows, ["entity_type", "name"], min_occurrences, cap)


def unmapped_relationships(
    proposals: DataFrame, known: tuple[str, ...] = tuple(r[0] for r in RELATION_TYPES),
    min_occurrences: int = MIN_OCCURRENCES, cap: int | None = None,
) -> DataFrame:
    p = F.col("payload")
    rows = proposals.filter(
        (F.col("proposal_type") == "relationship") & F.col("status").isin("pending", "approved")
        & jsonx.has_key(p, "relationship_type")
    ).select("owner_id", "proposal_id", "created_at", jsonx.field(p, "relationship_type").alias("relationship_type"))
    rows = rows.filter(F.coalesce("relationship_type", F.lit("")) != "").filter(~F.col("relationship_type").isin(*known))
    return _recurring(rows, ["relationship_type"], min_occurrences, cap)


def best_examples(candidates: DataFrame) -> DataFrame:
    """Most frequent name per (owner, entity type)."""
    return top_k(candidates, ["owner_id", "entity_type"], [F.desc("occurrence_count"), F.col("name")], 1).drop("rank")


def _label(type_id: Column) -> Column:
    return F.initcap(F.regexp_replace(type_id, "_", " "))


def entity_type_proposals(candidates: DataFrame, min_occurrences: int = MIN_OCCURRENCES) -> DataFrame:
    c = best_examples(candidates).filter(F.col("occurrence_count") >= min_occurrences)
    n = F.col("occurrence_count").cast("string")
    definition = F.struct(
        F.col("entity_type").alias("id"), _label(F.col("entity_type")).alias("label"),
        F.concat(F.lit("Recurring extracted type for "), F.col("name")).alias("description"),
    )
    evidence = F.struct("entity_type", F.col("name").alias("sample_name"), "occurrence_count", "sample_proposal_ids")
    rationale = F.concat(
        F.lit("A(z) „"), F.col("name"), F.lit("” entitás "), n, F.lit(" alkalommal jelent meg „"),
        F.col("entity_type"), F.lit("” típusként, de nincs a normatív ontológiában."),
    )
    return _proposals(c, "entity_type", F.col("entity_type"), F.lit("Új entitástípus: "), rationale, definition, evidence)


def relationship_type_proposals(candidates: DataFrame, min_occurrences: int = MIN_OCCURRENCES) -> DataFrame:
    c = candidates.filter(F.col("occurrence_count") >= min_occurrences)
    kind = F.col("relationship_type")
    definition = F.struct(
        kind.alias("id"), _label(kind).alias("label"), F.array(F.lit("entity")).alias("source_types"),
        F.array(F.lit("entity")).alias("target_types"),
    )
    evidence = F.struct("relationship_type", "occurrence_count", "sample_proposal_ids")
    rationale = F.concat(
        F.lit("A(z) „"), kind, F.lit("” kapcsolat "), F.col("occurrence_count").cast("string"),
        F.lit(" alkalommal szerepelt, de nincs a normatív ontológiában."),
    )
    return _proposals(c, "relationship_type", kind, F.lit("Új kapcsolattípus: "), rationale, definition, evidence)


def _proposals(c: DataFrame, kind: str, target: Column, title: Column, rationale: Column, definition: Column,
               evidence: Column) -> DataFrame:
    return c.select(
        stable_id("ontology", F.col("owner_id"), kind, target).alias("ontology_proposal_id"), "owner_id",
        F.lit(kind).alias("kind"), F.lit("pending").alias("status"), F.concat(title, target).alias("title"),
        rationale.alias("rationale"), F.to_json(definition).alias("proposed_definition"),
        F.to_json(evidence).alias("evidence"), F.lit(VERSION).alias("ontology_version"),
        F.lit(None).cast("string").alias("decision_rationale"), F.lit(None).cast("timestamp").alias("decided_at"),
    )


def without_pending(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Proposals whose (owner, kind, definition id) is not pending already."""
    target = jsonx.field(F.col("proposed_definition"), "id")
    waiting = stored.filter(F.col("status") == "pending").select("owner_id", "kind", target.alias("_target")).distinct()
    fresh = new.withColumn("_target", target).dropDuplicates(["owner_id", "kind", "_target"])
    return fresh.join(waiting, ["owner_id", "kind", "_target"], "left_anti").drop("_target")


def decide(stored: DataFrame, decisions: DataFrame) -> DataFrame:
    """``decisions(ontology_proposal_id, status, rationale, decided_at)``; only pending proposals change."""
    row = F.struct("status", "rationale", "decided_at")
    first = decisions.groupBy("ontology_proposal_id").agg(F.min_by(row, "decided_at").alias("_d"))
    joined = stored.join(first, "ontology_proposal_id", "left")
    takes = (F.col("status") == "pending") & F.col("_d").isNotNull()
    return joined.withColumns(
        {
            "decision_rationale": F.when(takes, F.col("_d.rationale")).otherwise(F.col("decision_rationale")),
            "decided_at": F.when(takes, F.col("_d.decided_at")).otherwise(F.col("decided_at")),
            "status": F.when(takes, F.col("_d.status")).otherwise(F.col("status")),
        }
    ).drop("_d")


def relationship_violations(relationships: DataFrame, entities: DataFrame, ontology: DataFrame) -> DataFrame:
    """Relationships of unknown type, or whose end types the ontology does not allow."""
    e = entities.select("entity_id", "entity_type")
    src = e.select(F.col("entity_id").alias("source_entity_id"), F.col("entity_type").alias("source_type"))
    dst = e.select(F.col("entity_id").alias("target_entity_id"), F.col("entity_type").alias("target_type"))
    typed = relationships.join(src, "source_entity_id").join(dst, "target_entity_id")
    rule = ontology.select(F.col("relationship_type").alias("_t"), "source_types", "target_types")
    checked = typed.join(rule, F.lower("relationship_type") == F.col("_t"), "left")
    problem = (
        F.when(F.col("_t").isNull(), "unknown type")
        .when(~F.array_contains("source_types", F.col("source_type")), "source type not allowed")
        .when(~F.array_contains("target_types", F.col("target_type")), "target type not allowed")
    )
    return checked.withColumn("violation", problem).filter("violation is not null").drop(
        "_t", "source_types", "target_types"
    )
