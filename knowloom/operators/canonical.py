"""Approved proposals -> canonical entities, claims, relationships, findings and outbox events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowloom.functions import jsonx, text
from knowloom.functions.hashing import stable_id
from knowloom.functions.skew import attach_rows, hot_join, top_k
from knowloom.operators.resolution import gather_names, merged_aliases
from knowloom.sources.sinks import cut_lineage, newest_per_key, upsert

ENTITY_KEY = ["owner_id", "entity_type", "canonical_name"]
CLAIM_TYPES = ("claim", "task", "decision", "event")
# Predicates that may hold several values at a time.
MULTI_VALUED = ("has_task", "has_decision", "has_event", "mentions")
ENTITY_COLUMNS = ("entity_id", *ENTITY_KEY, "aliases", "description", "status", "source_proposal_id",
                  "created_at", "updated_at")


def approved(proposals: DataFrame) -> DataFrame:
    return proposals.filter(F.col("status") == "approved")


def route(proposals: DataFrame) -> dict[str, DataFrame]:
    """Approved proposals by branch. Each branch is a filter that reaches the scan."""
    p, kind = approved(proposals), F.col("proposal_type")
    return {
        "entity": p.filter(kind.isin("entity", "entity_resolution")),
        "merge": p.filter(kind == "merge"),
        "relationship": p.filter(kind == "relationship"),
        "claim": p.filter(kind.isin(*CLAIM_TYPES)),
    }


def _named(entity_proposals: DataFrame) -> DataFrame:
    p = F.col("payload")
    return entity_proposals.select(
        "proposal_id", "owner_id", "created_at",
        F.coalesce(jsonx.field(p, "entity_type"), F.lit("concept")).alias("entity_type"),
        F.coalesce(jsonx.field(p, "name"), F.col("title")).alias("canonical_name"),
        jsonx.string_array(p, "aliases").alias("aliases"),
        F.nullif(jsonx.field(p, "description"), F.lit("")).alias("description"),
        jsonx.field(p, "resolved_entity_id").alias("resolved_entity_id"),
    )


def entity_rows(entity_proposals: DataFrame) -> DataFrame:
    """The entity of each (owner, type, name) as its last proposal states it."""
    last = newest_per_key(_named(entity_proposals), ENTITY_KEY, [F.col("created_at"), F.col("proposal_id")])
    return last.select(
        stable_id("entity", *[F.col(c) for c in ENTITY_KEY]).alias("entity_id"), *ENTITY_KEY, "aliases",
        "description", F.lit("active").alias("status"), F.col("proposal_id").alias("source_proposal_id"),
        "created_at", F.col("created_at").alias("updated_at"),
    )


def upsert_entities(entities: DataFrame, entity_proposals: DataFrame) -> DataFrame:
    """Last proposal per (owner, type, name) overwrites the stored row; id and created_at stay."""
    return upsert(entities, entity_rows(entity_proposals), ENTITY_KEY, keep=("entity_id", "created_at"))


def link_aliases(entities: DataFrame, entity_proposals: DataFrame) -> DataFrame:
    """Names of proposals resolved to a known entity become its aliases, in proposal order."""
    named = _named(entity_proposals).filter("resolved_entity_id is not null")
    spelled = named.select(
        F.col("resolved_entity_id").alias("entity_id"), "created_at", "proposal_id",
        F.posexplode(F.concat(F.array("canonical_name"), "aliases")).alias("i", "alias"),
    ).withColumn("seq", F.struct("created_at", "proposal_id", "i"))
    new = gather_names(spelled, "entity_id")
    last = named.groupBy(F.col("resolved_entity_id").alias("entity_id")).agg(
        F.max(F.struct("created_at", "proposal_id")).alias("_last")
    )
    joined = entities.join(new.join(last, "entity_id"), "entity_id", "left")
    return joined.withColumns(
        {
            "aliases": F.when(F.col("names").isNull(), F.col("aliases")).otherwise(
                merged_aliases(F.col("aliases"), F.col("names"))
            ),
            "source_proposal_id": F.coalesce("_last.proposal_id", "source_proposal_id"),
            "updated_at": F.coalesce("_last.created_at", "updated_at"),
        }
    ).select(*entities.columns)


def materialize_entities(entities: DataFrame, entity_proposals: DataFrame) -> DataFrame:
    """Proposals resolved to an existing entity add aliases, all others upsert their own key."""
    known = entities.select(F.col("entity_id").alias("resolved_entity_id"))
    with_ref = entity_proposals.withColumn("resolved_entity_id", jsonx.field(F.col("payload"), "resolved_entity_id"))
    linked = with_ref.join(known, "resolved_entity_id", "left_semi").drop("resolved_entity_id")
    fresh = with_ref.join(known, "resolved_entity_id", "left_anti").drop("resolved_entity_id")
    return upsert_entities(link_aliases(entities, linked), fresh)


def merge_targets(merges: DataFrame) -> DataFrame:
    """``merges(source, target, created_at, merge_id)`` -> final target of every source.

    The first merge of a source counts. Chains collapse by pointer jumping, which doubles the reach
    per round, so log2 of the number of merges bounds the rounds; each round is checkpointed. Sources on
    or behind a cycle have no target and are dropped.
    """
    first = merges.filter("source <> target").groupBy("source").agg(
        F.min_by("target", F.struct("created_at", "merge_id")).alias("target")
    )
    step = cut_lineage(first)
    for _ in range(step.count().bit_length()):
        nxt = step.select(F.col("source").alias("target"), F.col("target").alias("_t2"))
        jumped = cut_lineage(
            step.join(nxt, "target", "left").select("source", F.coalesce("_t2", "target").alias("target"),
                                                    F.col("_t2").isNotNull().alias("moved"))
        )
        step = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            break
    return step.join(first.select(F.col("source").alias("target")), "target", "left_anti").select("source", "target")


def merge_map(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """(source, target) of the merges that count: pairs of one owner and entity type, chains followed to their end."""
    e = entities.select("entity_id", "owner_id", "entity_type", "canonical_name", "aliases")
    s = e.select(*[F.col(c).alias(f"s_{c}") for c in e.columns])
    t = e.select(*[F.col(c).alias(f"t_{c}") for c in e.columns])
    valid = (
        merges.join(s, F.col("source") == F.col("s_entity_id"))
        .join(t, F.col("target") == F.col("t_entity_id"))
        .filter((F.col("s_owner_id") == F.col("t_owner_id")) & (F.col("s_entity_type") == F.col("t_entity_type")))
    )
    return merge_targets(valid.select("source", "target", "created_at", "merge_id"))


def apply_merges(entities: DataFrame, merges: DataFrame, final: DataFrame | None = None) -> DataFrame:
    """Targets collect the names of everything merged into them; sources get status ``merged``.

    Claims and relationships follow by :func:`repoint_claims` and :func:`repoint_relationships` with the same ``final``
    map (:func:`merge_map`), references of later proposals by ``resolve_refs(..., merged=final)``.
    """
    final = merge_map(entities, merges) if final is None else final
    s = entities.select(*[F.col(c).alias(f"s_{c}") for c in ("entity_id", "canonical_name", "aliases")])
    moved = final.join(s, F.col("source") == F.col("s_entity_id")).select(
        F.col("target").alias("entity_id"), "source",
        F.posexplode(F.concat(F.array("s_canonical_name"), "s_aliases")).alias("i", "alias"),
    ).withColumn("seq", F.struct("source", "i"))
    gathered = gather_names(moved, "entity_id")
    gone = final.select(F.col("source").alias("entity_id"), F.lit(True).alias("_gone"))
    out = entities.join(gathered, "entity_id", "left").join(gone, "entity_id", "left")
    return out.withColumns(
        {
            "aliases": F.when(F.col("names").isNull(), F.col("aliases")).otherwise(
                merged_aliases(F.col("aliases"), F.col("names"))
            ),
            "status": F.when(F.col("_gone"), "merged").otherwise(F.col("status")),
        }
    ).select(*entities.columns)


def follow_merges(rows: DataFrame, columns: tuple[str, ...], final: DataFrame) -> DataFrame:
    """Entity ids in ``columns`` become the ids that their entities were merged into."""
    out = rows
    for c in columns:
        step = final.select(F.col("source").alias(c), F.col("target").alias("_into"))
        out = hot_join(out, step, [c], "left").withColumn(c, F.coalesce("_into", c)).drop("_into")
    return out.select(*rows.columns)


def repoint_claims(claims: DataFrame, final: DataFrame) -> DataFrame:
    """Claims about a merged entity become claims about its target; their topics and findings follow from there."""
    return follow_merges(claims, ("subject_entity_id",), final)


def repoint_relationships(relationships: DataFrame, final: DataFrame) -> DataFrame:
    """Relationships of merged entities move to the targets.

    One between two entities that are now the same gets status ``merged``. Of active ones that now say the same, the one
    with the smallest id stays, the others are ``superseded``.
    """
    ends = ("source_entity_id", "target_entity_id")
    was_loop = F.col("source_entity_id").eqNullSafe(F.col("target_entity_id"))
    moved = follow_merges(relationships.withColumn("_loop", was_loop), ends, final)
    collapsed = was_loop & ~F.col("_loop") & (F.col("status") == "active")
    moved = moved.withColumn("status", F.when(collapsed, "merged").otherwise(F.col("status"))).drop("_loop")
    same = ["owner_id", *ends, "relationship_type"]
    first = moved.filter("status = 'active'").groupBy(*same).agg(F.min("relationship_id").alias("_first"))
    kept = hot_join(moved, first, same, "left")
    again = (F.col("status") == "active") & (F.col("relationship_id") != F.col("_first"))
    return kept.withColumn("status", F.when(again, "superseded").otherwise(F.col("status"))).select(*relationships.columns)


def referenced_keys(rows: DataFrame, ref: str, entity_proposals: DataFrame, id_type) -> DataFrame:
    """Adds the key (entity_type, canonical_name) that column ``ref`` of ``rows(owner_id, run_id, ...)`` means, and ``_linked``.

    A reference is the local id of an entity proposal of the same run, else the name of a concept. A proposal that
    was linked carries the entity's id in ``resolved_entity_id`` (column or payload).
    """
    linked = jsonx.field(F.col("payload"), "resolved_entity_id")
    if "resolved_entity_id" in entity_proposals.columns:
        linked = F.coalesce(F.col("resolved_entity_id").cast("string"), linked)
    named = _named(entity_proposals)
    local = entity_proposals.select(
        "proposal_id", F.col("run_id"), jsonx.field(F.col("payload"), "local_id").alias("_ref"), linked.cast(id_type).alias("_linked")
    ).join(named.select("proposal_id", "entity_type", F.col("canonical_name").alias("_name")), "proposal_id")
    local = local.groupBy("run_id", "_ref").agg(F.min(F.struct("entity_type", "_name")).alias("_l"), F.min("_linked").alias("_linked"))
    return rows.withColumn("_ref", F.col(ref)).join(local, ["run_id", "_ref"], "left").withColumns(
        {
            "entity_type": F.coalesce("_l.entity_type", F.lit("concept")),
            "canonical_name": F.coalesce("_l._name", "_ref"),
        }
    ).drop("_ref", "_l")


def resolve_refs(
    rows: DataFrame, ref: str, entity_proposals: DataFrame, entities: DataFrame, merged: DataFrame | None = None
) -> DataFrame:
    """Adds ``entity_id`` for the reference in column ``ref``; the id of a linked proposal goes before a lookup by name.

    With ``merged`` (:func:`merge_map`) a reference to a merged entity means its target.
    """
    keyed = referenced_keys(rows, ref, entity_proposals, entities.schema["entity_id"].dataType)
    ids = entities.select("owner_id", "entity_type", "canonical_name", "entity_id")
    found = hot_join(keyed, ids, ENTITY_KEY, "left").withColumn("entity_id", F.coalesce("_linked", "entity_id"))
    found = found.drop("_linked", "entity_type", "canonical_name")
    return found if merged is None else follow_merges(found, ("entity_id",), merged)


def referenced_ids(rows: DataFrame, ref: str, entity_proposals: DataFrame) -> DataFrame:
    """Adds ``entity_id``, the id that the referenced entity has or will have: ids follow from keys alone. Null without a reference."""
    keyed = referenced_keys(rows, ref, entity_proposals, "string")
    key = stable_id("entity", *[F.col(c) for c in ENTITY_KEY])
    return keyed.withColumn("entity_id", F.coalesce("_linked", F.when(F.col(ref).isNotNull(), key))).drop("_linked", "entity_type", "canonical_name")


def relationship_rows(relationship_proposals: DataFrame) -> DataFrame:
    """Type and end references of relationship proposals."""
    p = F.col("payload")
    return relationship_proposals.select(
        "proposal_id", "owner_id", "run_id", "created_at",
        jsonx.field(p, "source_local_id").alias("_source"), jsonx.field(p, "target_local_id").alias("_target"),
        F.coalesce(jsonx.field(p, "relationship_type"), F.lit("RELATES_TO")).alias("relationship_type"),
    )


def _relationships(both: DataFrame) -> DataFrame:
    return both.select(
        stable_id("relationship", F.col("proposal_id")).alias("relationship_id"), "owner_id", "source_entity_id",
        "target_entity_id", "relationship_type", F.lit("active").alias("status"),
        F.col("proposal_id").alias("source_proposal_id"), "created_at",
    )


def referenced_relationships(relationship_proposals: DataFrame, entity_proposals: DataFrame) -> DataFrame:
    """Relationships by the ids of their ends, whether these entities exist yet or not."""
    src = referenced_ids(relationship_rows(relationship_proposals), "_source", entity_proposals).withColumnRenamed("entity_id", "source_entity_id")
    both = referenced_ids(src.filter("source_entity_id is not null"), "_target", entity_proposals)
    return _relationships(both.withColumnRenamed("entity_id", "target_entity_id").filter("target_entity_id is not null"))


def materialize_relationships(
    relationship_proposals: DataFrame, entity_proposals: DataFrame, entities: DataFrame, merged: DataFrame | None = None
) -> DataFrame:
    """Relationships whose two ends are known entities."""
    rows = relationship_rows(relationship_proposals)
    src = resolve_refs(rows, "_source", entity_proposals, entities, merged).withColumnRenamed("entity_id", "source_entity_id")
    both = resolve_refs(src.filter("source_entity_id is not null"), "_target", entity_proposals, entities, merged)
    return _relationships(both.withColumnRenamed("entity_id", "target_entity_id").filter("target_entity_id is not null"))


def claim_rows(claim_proposals: DataFrame) -> DataFrame:
    """Predicate, value and subject reference of claim, task, decision and event proposals."""
    p, kind = F.col("payload"), F.col("proposal_type")
    predicate = (
        F.when(kind == "task", "has_task").when(kind == "decision", "has_decision").when(kind == "event", "has_event")
        .otherwise(F.coalesce(jsonx.field(p, "predicate"), F.lit("claims")))
    )
    value = F.coalesce(F.when(kind == "claim", jsonx.field(p, "value")).otherwise(jsonx.field(p, "title")), F.col("title"))
    return claim_proposals.select(
        stable_id("claim", F.col("proposal_id")).alias("claim_id"), "owner_id", "run_id",
        jsonx.field(p, "subject_local_id").alias("subject_ref"), predicate.alias("predicate"),
        value.alias("object_value"), F.lit("active").alias("status"), "confidence",
        F.col("proposal_id").alias("source_proposal_id"), "created_at",
    )


def materialize_claims(
    claim_proposals: DataFrame, entity_proposals: DataFrame, entities: DataFrame, merged: DataFrame | None = None
) -> DataFrame:
    rows = claim_rows(claim_proposals)
    out = resolve_refs(rows, "subject_ref", entity_proposals, entities, merged)
    return out.withColumnRenamed("entity_id", "subject_entity_id").drop("subject_ref")


def claim_provenance(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """One provenance row per claim and evidence span."""
    c = claims.select("claim_id", F.col("source_proposal_id").alias("proposal_id"), "run_id", "confidence", "created_at")
    joined = evidence.select("evidence_id", "proposal_id", "version_id", "chunk_id").join(c, "proposal_id")
    return joined.select(
        stable_id("provenance", F.col("claim_id"), F.col("evidence_id")).alias("provenance_id"), "claim_id",
        "version_id", "chunk_id", "proposal_id", "run_id", "confidence", "created_at",
    )


TOPIC = ["owner_id", "subject_entity_id", "predicate"]


def _comparable(claims: DataFrame, multi_valued: tuple[str, ...]) -> DataFrame:
    """Active claims with a value; a claim without one states nothing that could differ."""
    active = claims.filter(
        (F.col("status") == "active") & F.col("object_value").isNotNull() & ~F.col("predicate").isin(*multi_valued)
    )
    return active.withColumn("value_key", F.lower(text.strip(F.col("object_value"))))


def claim_values(claims: DataFrame, multi_valued: tuple[str, ...] = MULTI_VALUED) -> DataFrame:
    """Distinct values per (owner, subject, predicate) with claim count and first claim.

    All conflicting pairs are the pairs of claims under different values of one topic; this table holds
    them in linear space. The aggregation combines map-side, so a hot topic shuffles its values only.
    """
    first = F.min(F.struct("created_at", "claim_id", "object_value"))
    return (
        _comparable(claims, multi_valued)
        .groupBy(*TOPIC, "value_key")
        .agg(F.count(F.lit(1)).alias("claims"), first.alias("_f"))
        .select(*TOPIC, "value_key", "claims", F.col("_f.created_at").alias("first_at"),
                F.col("_f.claim_id").alias("first_claim_id"), F.col("_f.object_value").alias("first_value"))
    )


def contradiction_topics(values: DataFrame, min_values: int = 2) -> DataFrame:
    """Topics with their totals and their two earliest values (``v2`` is null for a single value).

    The rank limit of two runs before the shuffle, so a topic of many values sends two rows per
    partition.
    """
    opener = F.struct(F.col("first_at"), F.col("first_claim_id"), F.col("first_value"), F.col("value_key"))
    totals = values.groupBy(*TOPIC).agg(
        F.count(F.lit(1)).alias("topic_values"), F.sum("claims").alias("topic_claims")
    ).filter(F.col("topic_values") >= min_values)
    firsts = top_k(values, TOPIC, [F.col("first_at"), F.col("first_claim_id")], 2, "place").groupBy(*TOPIC).agg(
        F.min(opener).alias("v1"), F.when(F.count(F.lit(1)) > 1, F.max(opener)).alias("v2")
    )
    return hot_join(totals, firsts, TOPIC)


def _value_facts(asked: DataFrame, topics: DataFrame) -> DataFrame:
    """``asked(topic, value_key, same_claims, same_values)`` -> the earliest stored claim that differs
    and how many stored claims and values differ."""
    prior = F.when(F.col("value_key") == F.col("v1.value_key"), F.col("v2")).otherwise(F.col("v1"))
    return hot_join(asked, topics, TOPIC).select(
        *TOPIC, "value_key", prior.alias("_p"),
        (F.col("topic_claims") - F.col("same_claims")).alias("differing_claims"),
        (F.col("topic_values") - F.col("same_values")).alias("differing_values"),
    ).filter("_p is not null")


def _findings(rows: DataFrame) -> DataFrame:
    return rows.select(
        stable_id("finding", F.col("_p.first_claim_id"), F.col("claim_id")).alias("finding_id"), *TOPIC,
        F.col("_p.first_claim_id").alias("existing_claim_id"), F.col("claim_id").alias("conflicting_claim_id"),
        F.col("_p.first_value").alias("existing_value"), F.col("object_value").alias("conflicting_value"),
        "differing_claims", "differing_values", F.lit("open").alias("status"), "created_at", "source_proposal_id",
    )


def detect_contradictions(claims: DataFrame, multi_valued: tuple[str, ...] = MULTI_VALUED) -> DataFrame:
    """A finding for every claim that contradicts an earlier one on the same topic.

    It names the earliest contradicting claim and counts all claims of the topic that differ. Work and
    output are linear in the claims; :func:`claim_values` lists the members behind each count. All
    facts about a value are gathered on the aggregated values, so claims are joined once.
    """
    return findings_of(claims, claim_values(claims, multi_valued), multi_valued)


def merged_values(parts: DataFrame) -> DataFrame:
    """Value tables of several batches as one: counts add up, the earliest claim stays."""
    first = F.min(F.struct("first_at", "first_claim_id", "first_value"))
    return (
        parts.groupBy(*TOPIC, "value_key").agg(F.sum("claims").alias("claims"), first.alias("_f"))
        .select(*TOPIC, "value_key", "claims", "_f.*")
    )


def met_values(before: DataFrame, new: DataFrame) -> DataFrame:
    """:func:`merged_values` of stored value tables and a batch's one, with the stored part beside (``_claims``, ``_f``, null for new values)."""
    both = before.withColumn("_old", F.lit(True)).unionByName(new.withColumn("_old", F.lit(False)))
    first = F.struct("first_at", "first_claim_id", "first_value")
    return (
        both.groupBy(*TOPIC, "value_key")
        .agg(F.sum("claims").alias("claims"), F.min(first).alias("_first"), F.sum(F.when(F.col("_old"), F.col("claims"))).alias("_claims"), F.min(F.when(F.col("_old"), first)).alias("_f"))
        .select(*TOPIC, "value_key", "claims", "_first.*", "_claims", "_f")
    )


def values_before(met: DataFrame) -> DataFrame:
    """The stored part of :func:`met_values` as a value table."""
    return met.filter("_claims is not null").select(*TOPIC, "value_key", F.col("_claims").alias("claims"), "_f.*")


def moved_topics(before: DataFrame, after: DataFrame) -> DataFrame:
    """Topics known ``before`` whose two earliest values changed: only there can findings of stored claims change.

    With claims in order of time this happens once per topic, when its second value comes. A topic that still has a
    single value has no finding, whichever of its claims is the first.
    """
    old = contradiction_topics(before, 1).select(*TOPIC, F.col("v1").alias("_o1"), F.col("v2").alias("_o2"))
    both = hot_join(contradiction_topics(after, 2), old, TOPIC)
    return both.filter(~F.col("v1").eqNullSafe(F.col("_o1")) | ~F.col("v2").eqNullSafe(F.col("_o2"))).select(*TOPIC)


def findings_of(
    claims: DataFrame, values: DataFrame, multi_valued: tuple[str, ...] = MULTI_VALUED
) -> DataFrame:
    """Findings of ``claims`` against all claims behind the value table ``values``, which include them."""
    own = values.select(*TOPIC, "value_key", F.col("claims").alias("same_claims"), F.lit(1).alias("same_values"))
    facts = _value_facts(own, contradiction_topics(values))
    earlier = F.struct(F.col("_p.first_at"), F.col("_p.first_claim_id")) < F.struct("created_at", "claim_id")
    return _findings(hot_join(_comparable(claims, multi_valued), facts, [*TOPIC, "value_key"]).filter(earlier))


def refreshed_counts(findings: DataFrame, values: DataFrame) -> DataFrame:
    """Findings with the counts that hold now: both follow from the value table alone."""
    totals = values.groupBy(*TOPIC).agg(F.sum("claims").alias("_claims"), F.count(F.lit(1)).alias("_values"))
    same = values.select(*TOPIC, "value_key", F.col("claims").alias("_same"))
    rows = findings.withColumn("value_key", F.lower(text.strip(F.col("conflicting_value"))))
    return hot_join(hot_join(rows, totals, TOPIC), same, [*TOPIC, "value_key"]).withColumns(
        {"differing_claims": F.col("_claims") - F.col("_same"), "differing_values": F.col("_values") - 1}
    ).select(*findings.columns)


def compare_new_claims(
    new: DataFrame, existing: DataFrame, multi_valued: tuple[str, ...] = MULTI_VALUED
) -> DataFrame:
    """A batch of new claims against the stored ones: one finding per new claim that contradicts any.

    The earliest contradicting claim is named, all differing stored claims are counted.
    """
    values = claim_values(existing, multi_valued)
    rows = _comparable(new, multi_valued)
    same = values.select(*TOPIC, "value_key", F.col("claims").alias("_same"), F.lit(1).alias("_known"))
    asked = hot_join(rows.select(*TOPIC, "value_key").distinct(), same, [*TOPIC, "value_key"], "left").select(
        *TOPIC, "value_key", F.coalesce("_same", F.lit(0)).alias("same_claims"),
        F.coalesce("_known", F.lit(0)).alias("same_values"),
    )
    facts = _value_facts(asked, contradiction_topics(values, 1))
    return _findings(hot_join(rows, facts, [*TOPIC, "value_key"]))


def with_finding_text(findings: DataFrame) -> DataFrame:
    """Adds ``summary`` and the ``evidence`` JSON."""
    summary = F.format_string(
        "Potential contradiction on '%s': '%s' vs '%s'", "predicate", "existing_value", "conflicting_value"
    )
    evidence = F.to_json(
        F.struct(
            "predicate", "existing_value", "conflicting_value", "existing_claim_id",
            F.col("subject_entity_id"), F.col("conflicting_claim_id"),
            F.col("source_proposal_id").alias("conflicting_proposal_id"),
        )
    )
    return findings.withColumns({"summary": summary, "evidence": evidence})


def contradiction_view(findings: DataFrame) -> DataFrame:
    """Evidence JSON of stored findings as columns; empty strings become null."""
    names = ("predicate", "existing_value", "conflicting_value", "subject_entity_id")
    return findings.select(
        "finding_id", "existing_claim_id", "conflicting_claim_id", "status", "summary",
        *[F.nullif(jsonx.field(F.col("evidence"), n), F.lit("")).alias(n) for n in names],
    )


def _event(df: DataFrame, aggregate: str, event_type: str, id_col: str, payload: Column) -> DataFrame:
    return df.select(
        stable_id("event", event_type, F.col(id_col)).alias("event_id"), F.lit(aggregate).alias("aggregate_type"),
        F.col(id_col).cast("string").alias("aggregate_id"), F.lit(event_type).alias("event_type"),
        F.to_json(payload).alias("payload"), F.lit("pending").alias("status"), F.lit(0).alias("retry_count"),
        F.col("created_at"),
    )


def outbox_events(
    entities: DataFrame | None = None,
    relationships: DataFrame | None = None,
    claims: DataFrame | None = None,
    findings: DataFrame | None = None,
    linked: DataFrame | None = None,
    merged: DataFrame | None = None,
) -> DataFrame:
    """Pending outbox rows for changed tables: one projection per event type.

    ``linked(entity_id, owner_id, alias, source_proposal_id, created_at)``;
    ``merged(target_entity_id, source_entity_id, owner_id, created_at)``.
    """
    parts = []
    if entities is not None:
        parts.append(_event(entities, "entity", "entity.materialized", "entity_id",
                            F.struct("entity_id", "owner_id", "entity_type", "canonical_name", "aliases")))
    if relationships is not None:
        parts.append(_event(relationships, "relationship", "relationship.materialized", "relationship_id",
                            F.struct("relationship_id", "owner_id", "source_entity_id", "target_entity_id",
                                     "relationship_type")))
    if claims is not None:
        parts.append(_event(claims, "claim", "claim.materialized", "claim_id",
                            F.struct("claim_id", "owner_id", "subject_entity_id", "predicate", "object_value",
                                     "status", "confidence")))
    if findings is not None:
        parts.append(_event(findings, "contradiction", "contradiction.detected", "finding_id",
                            F.struct("finding_id", "owner_id", "existing_claim_id", "conflicting_claim_id",
                                     "summary", "evidence")))
    if linked is not None:
        parts.append(_event(linked, "entity", "entity.alias_added", "entity_id",
                            F.struct("entity_id", "owner_id", "alias", "source_proposal_id")))
    if merged is not None:
        parts.append(_event(merged, "entity", "entity.merged", "target_entity_id",
                            F.struct("target_entity_id", "source_entity_id", "owner_id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def claims_with_provenance(claims: DataFrame, provenance: DataFrame, key: str = "claim_id") -> DataFrame:
    """One row per claim and provenance row (struct ``provenance``, null without any).

    ``key`` is what a provenance row belongs to. Rows that all claims of a proposal share are given once, by the proposal's
    id, and need not be repeated for each claim beforehand.
    """
    return attach_rows(claims, provenance, key, "provenance")


def entities_by_type(entities: DataFrame, limit: int = 20, types: tuple[str, ...] | None = None) -> DataFrame:
    """First ``limit`` names per owner and type."""
    if types is not None:
        entities = entities.filter(F.col("entity_type").isin(*types))
    return top_k(entities, ["owner_id", "entity_type"], [F.col("canonical_name"), F.col("entity_id")], limit)


def active_in(claims: DataFrame, since=None, until=None) -> DataFrame:
    """Active claims of an optional period, both ends included."""
    out = claims.filter(F.col("status") == "active")
    if since is not None:
        out = out.filter(F.col("created_at") >= F.lit(since))
    if until is not None:
        out = out.filter(F.col("created_at") <= F.lit(until))
    return out


def claims_by_predicate(
    claims: DataFrame, limit: int = 20, predicates: tuple[str, ...] | None = None, since=None, until=None
) -> DataFrame:
    """Newest active claims per owner and predicate inside an optional period."""
    out = active_in(claims, since, until)
    if predicates is not None:
        out = out.filter(F.col("predicate").isin(*predicates))
    return top_k(out, ["owner_id", "predicate"], [F.desc("created_at"), F.desc("claim_id")], limit)


def canonical_counts(entities: DataFrame, claims: DataFrame, findings: DataFrame) -> DataFrame:
    """Entities of any status, active claims and open contradictions per owner."""
    parts = [
        entities.groupBy("owner_id").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("entities")),
        claims.groupBy("owner_id").agg(F.count_if(F.col("status") == "active").alias("n")).withColumn("what", F.lit("claims")),
        findings.groupBy("owner_id").agg(F.count_if(F.col("status") == "open").alias("n")).withColumn("what", F.lit("contradictions")),
    ]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    names = ["entities", "claims", "contradictions"]
    return union.groupBy("owner_id").pivot("what", names).agg(F.sum("n")).na.fill(0, names)


def list_rows(
    table: DataFrame, id_col: str, limit: int = 50, status: str | None = None, cursor=None, newest_first: bool = False
) -> DataFrame:
    """One page per owner of entities, claims or findings.

    ``cursor`` is the last row of the page before: its id, or with ``newest_first`` its (created_at, id).
    """
    if status is not None:
        table = table.filter(F.col("status") == status)
    if cursor is not None and newest_first:
        at, last = cursor
        at = F.lit(at).cast(table.schema["created_at"].dataType)
        table = table.filter((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col(id_col) < F.lit(last))))
    elif cursor is not None:
        table = table.filter(F.col(id_col) > F.lit(cursor))
    order = [F.desc("created_at"), F.desc(id_col)] if newest_first else [F.col(id_col)]
    return top_k(table, ["owner_id"], order, limit)


def provenance_trace(
    claims: DataFrame, provenance: DataFrame, evidence: DataFrame, chunks: DataFrame, versions: DataFrame,
    objects: DataFrame,
) -> DataFrame:
    """claim -> proposal -> evidence span -> chunk -> version -> object and source, one row per span.

    A span belongs to the provenance of its own version and chunk; claims without provenance keep a row of nulls.
    """
    out = claims.select("claim_id", F.col("source_proposal_id").alias("proposal_id"))
    p = provenance.select("claim_id", "version_id", "chunk_id").distinct()
    e = evidence.select("proposal_id", "version_id", "chunk_id", "evidence_id", "excerpt")
    out = out.join(p, "claim_id", "left").join(e, ["proposal_id", "version_id", "chunk_id"], "left")
    out = out.join(chunks.select("chunk_id", "chunk_index"), "chunk_id", "left")
    out = out.join(versions.select("version_id", "object_id"), "version_id", "left")
    return out.join(objects.select("object_id", "source_id", "external_id"), "object_id", "left")


def provenance_coverage(claims: DataFrame, provenance: DataFrame) -> DataFrame:
    """Share of claims with at least one provenance row, per owner."""
    has = provenance.select("claim_id").distinct().withColumn("_has", F.lit(1))
    return claims.join(has, "claim_id", "left").groupBy("owner_id").agg(
        F.count(F.lit(1)).alias("claims"), F.count("_has").alias("covered"),
        (F.count("_has") / F.count(F.lit(1))).alias("coverage"),
    )
