"""Dashboards, status and project reports, processing statistics and operations status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowloom.functions import jsonx
from knowloom.functions.layout import once
from knowloom.functions.skew import hot_join, is_small, small_side, top_k
from knowloom.operators.canonical import active_in, claims_by_predicate, entities_by_type
from knowloom.sources.sinks import materialize

PROJECT_PREDICATES = (("decisions", "has_decision"), ("tasks", "has_task"), ("events", "has_event"))
DASHBOARD_TYPES = (("projects", "project"), ("people", "person"), ("repositories", "repository"),
                   ("technologies", "technology"))
STRINGS = "array<string>"
#: Owners whose lists (some 20 kB each) are broadcast to their projects.
BROADCAST_OWNERS = 1000

# Report texts.
NOTHING = "_Nincs rögzített tétel._"
WHOLE_PERIOD = "teljes időszak"


def _list_per(value: str, when: Column | None = None) -> Column:
    """Values in rank order; rows are top-k bounded before."""
    item = F.struct("rank", value) if when is None else F.when(when, F.struct("rank", value))
    return F.transform(F.sort_array(F.collect_list(item)), lambda x: x[value])


def _or_empty(*names: str) -> dict[str, Column]:
    return {n: F.coalesce(n, F.array().cast(STRINGS)) for n in names}


def dashboard(
    entities: DataFrame, claims: DataFrame, sources: DataFrame, findings: DataFrame, outbox: DataFrame,
    proposals: DataFrame, runs: DataFrame, limit: int = 20, source_limit: int = 50,
) -> DataFrame:
    """One row per owner: short entity and claim lists, source coverage and health counts.

    Every list is cut per owner before rows are gathered; the counts are over all rows.
    """
    e = entities_by_type(entities, limit, tuple(t for _, t in DASHBOARD_TYPES)).groupBy("owner_id").agg(
        *[_list_per("canonical_name", F.col("entity_type") == t).alias(n) for n, t in DASHBOARD_TYPES]
    )
    c = claims_by_predicate(claims, limit, tuple(p for _, p in PROJECT_PREDICATES)).groupBy("owner_id").agg(
        *[_list_per("object_value", F.col("predicate") == p).alias(n) for n, p in PROJECT_PREDICATES]
    )
    s = top_k(sources, ["owner_id"], [F.col("source_id")], source_limit).groupBy("owner_id").agg(
        _list_per("name").alias("source_names")
    )
    totals = sources.groupBy("owner_id").agg(
        F.count(F.lit(1)).alias("sources_total"), F.count_if("enabled").alias("sources_enabled")
    )
    e_counts = entities.groupBy("owner_id").agg(
        *[F.count_if(F.col("entity_type") == t).alias(f"{n}_total") for n, t in DASHBOARD_TYPES]
    )
    c_counts = _claim_counts(claims.filter(F.col("status") == "active"))
    last_sync = hot_join(runs, sources.select("source_id", "owner_id").hint("merge"), ["source_id"]).groupBy("owner_id").agg(
        F.max("completed_at").alias("last_sync_at")
    )
    conflicts = findings.groupBy("owner_id").agg(F.count_if(F.col("status") == "open").alias("open_contradictions"))
    waiting = proposals.groupBy("owner_id").agg(F.count_if(F.col("status") == "pending").alias("pending_proposals"))
    queued = outbox.agg(F.count_if(F.col("status") == "pending").alias("n")).scalar()
    out = e_counts
    for part in (c_counts, totals, e, c, s, last_sync, conflicts, waiting):
        out = out.join(part, "owner_id", "full_outer")
    out = out.filter("owner_id is not null")
    lists = [n for n, _ in (*DASHBOARD_TYPES, *PROJECT_PREDICATES)] + ["source_names"]
    counts = ["sources_total", "sources_enabled", "open_contradictions", "pending_proposals",
              *[f"{n}_total" for n, _ in (*DASHBOARD_TYPES, *PROJECT_PREDICATES)]]
    out = out.withColumns(_or_empty(*lists)).na.fill(0, counts).withColumn("pending_outbox_events", queued)
    return out.withColumn(
        "summary",
        F.format_string(
            "%d projects, %d repositories, %d open tasks, %d contradictions",
            "projects_total", "repositories_total", "tasks_total", "open_contradictions",
        ),
    )


def _claim_counts(claims: DataFrame, key: str = "owner_id") -> DataFrame:
    """Claims per owner (or project) and kind, as ``<kind>_total``."""
    return claims.groupBy(key).agg(
        *[F.count_if(F.col("predicate") == p).alias(f"{n}_total") for n, p in PROJECT_PREDICATES]
    )


def _claim_refs(provenance: DataFrame) -> DataFrame:
    """Proposal and chunk references, one per row: (claim_id, ref)."""
    kinds = [F.concat(F.lit(f"{kind}:"), F.col(f"{kind}_id").cast("string")) for kind in ("proposal", "chunk")]
    return provenance.select("claim_id", F.explode(F.array_compact(F.array(*kinds))).alias("ref"))


def _citations(claims: DataFrame, provenance: DataFrame) -> DataFrame:
    """Sorted distinct proposal and chunk references of the listed claims, per owner."""
    refs = hot_join(_claim_refs(provenance), claims.select("claim_id", "owner_id"), ["claim_id"])
    return refs.select("owner_id", "ref").distinct().groupBy("owner_id").agg(
        F.sort_array(F.collect_list("ref")).alias("citations")
    )


def status_report(
    entities: DataFrame, claims: DataFrame, provenance: DataFrame, since=None, until=None,
    limit: int = 50, technologies: int = 30,
) -> DataFrame:
    """Per owner: newest decisions, tasks and events of the period, technologies, citations, summary.

    ``*_total`` and the summary count all claims of the period; lists show the newest ``limit``.
    """
    listed = claims_by_predicate(claims, limit, tuple(p for _, p in PROJECT_PREDICATES), since, until)
    totals = _claim_counts(active_in(claims, since, until))
    c = listed.groupBy("owner_id").agg(
        *[_list_per("object_value", F.col("predicate") == p).alias(n) for n, p in PROJECT_PREDICATES]
    )
    t = entities_by_type(entities, technologies, ("technology",)).groupBy("owner_id").agg(
        _list_per("canonical_name").alias("technologies")
    )
    out = c.join(t, "owner_id", "full_outer").join(_citations(listed, provenance), "owner_id", "left")
    out = out.join(totals, "owner_id", "left").na.fill(0, [f"{n}_total" for n, _ in PROJECT_PREDICATES])
    out = out.withColumns(_or_empty("decisions", "tasks", "events", "technologies", "citations"))
    period = ""
    if since is not None:
        period += f" from {str(since)[:10]}"
    if until is not None:
        period += f" to {str(until)[:10]}"
    summary = F.format_string(
        "%d decisions, %d tasks, %d events in the selected period.", "decisions_total", "tasks_total", "events_total"
    )
    return out.withColumn("title", F.lit(f"Project status report{period}")).withColumn("summary", summary)


def project_subgraphs(
    projects: DataFrame, entities: DataFrame, claims: DataFrame, provenance: DataFrame, findings: DataFrame,
    since=None, until=None, limit: int = 50, technologies: int = 30, risks: int = 20,
) -> DataFrame:
    """One row per project: claims of the project or without subject, risks, technologies, citations.

    Lists hold the newest ``limit`` claims per project and predicate and citations are those of the listed
    claims; ``*_total`` counts all claims and open findings. What an owner's projects share is put together once
    per owner, claims without subject with their references too, and meets each project's own list inside the
    project's row: no claim is repeated per project and no row of a report is shuffled.
    """
    predicates = tuple(p for _, p in PROJECT_PREDICATES)
    active = active_in(claims, since, until).filter(F.col("predicate").isin(*predicates))
    named = projects.select("owner_id", F.col("entity_id").alias("project_id"), F.col("canonical_name").alias("project_name"))
    newest = [F.desc("created_at"), F.desc("claim_id")]
    fields = ["owner_id", "predicate", "claim_id", "created_at", "object_value"]
    own = hot_join(
        active.select(*fields, F.col("subject_entity_id").alias("project_id")).filter("project_id is not null"),
        named.select("owner_id", "project_id"), ["owner_id", "project_id"],
    )
    common = active.filter("subject_entity_id is null").select(*fields)
    own_top = materialize(top_k(own, ["project_id", "predicate"], newest, limit).drop("rank"), "report-claims")
    common_top = materialize(top_k(common, ["owner_id", "predicate"], newest, limit).drop("rank"), "report-shared")
    # Only provenance of claims that may be listed is opened, once per claim and not per project.
    ids = own_top.select("claim_id").union(common_top.select("claim_id")).distinct()
    known = provenance.join(small_side(ids, is_small(ids)), "claim_id", "left_semi")
    per_claim = materialize(_claim_refs(known).groupBy("claim_id").agg(F.collect_set("ref").alias("refs")), "report-refs")

    def gathered(top: DataFrame, key: str, name: str) -> DataFrame:
        item = F.struct("created_at", "claim_id", "predicate", "object_value", F.coalesce("refs", F.array().cast(STRINGS)).alias("refs"))
        return hot_join(top, per_claim, ["claim_id"], "left").groupBy(key).agg(F.collect_list(item).alias(name))

    totals = [f"{n}_total" for n, _ in PROJECT_PREDICATES]
    open_findings = findings.filter(F.col("status") == "open")
    of_owners = (
        gathered(common_top, "owner_id", "_shared"),
        _claim_counts(common).withColumnsRenamed({t: f"_{t}" for t in totals}),
        entities_by_type(entities, technologies, ("technology",)).groupBy("owner_id").agg(
            _list_per("canonical_name").alias("technologies")),
        top_k(open_findings, ["owner_id"], [F.desc("created_at"), F.desc("finding_id")], risks).groupBy("owner_id").agg(
            _list_per("summary").alias("risks")),
        open_findings.groupBy("owner_id").agg(F.count(F.lit(1)).alias("risks_total")),
    )
    owners = projects.select("owner_id").distinct()
    for part in of_owners:
        owners = hot_join(owners, part, ["owner_id"], "left")
    owners = materialize(owners, "report-owners")
    out = named
    for part in (gathered(own_top, "project_id", "_own"), _claim_counts(own, "project_id")):
        out = out.join(part, "project_id", "left")
    out = hot_join(out, small_side(owners, is_small(owners, BROADCAST_OWNERS)), ["owner_id"], "left")
    out = out.na.fill(0, [*totals, *[f"_{t}" for t in totals], "risks_total"])
    every = F.concat(*[F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("_own", "_shared")])

    def listed(predicate: str) -> Column:
        return F.slice(F.sort_array(F.filter(every, lambda x: x["predicate"] == predicate), asc=False), 1, limit)

    out = once(out, **{f"_{n}": listed(p) for n, p in PROJECT_PREDICATES})
    lists = [n for n, _ in PROJECT_PREDICATES]
    refs = F.flatten(F.transform(F.concat(*[F.col(f"_{n}") for n in lists]), lambda x: x["refs"]))
    out = once(out, citations=F.sort_array(F.array_distinct(refs)), **{n: F.transform(f"_{n}", lambda x: x["object_value"]) for n in lists})
    return out.select(
        "owner_id", "project_id", "project_name", *lists,
        *[v.alias(n) for n, v in _or_empty("technologies", "risks").items()], "citations",
        *[(F.col(t) + F.col(f"_{t}")).alias(t) for t in totals], "risks_total",
    )


def period_label(since=None, until=None) -> str:
    a, b = (str(x)[:10] if x is not None else None for x in (since, until))
    if a and b:
        return f"{a} – {b}"
    if a:
        return f"{a} óta"
    return f"{b}-ig" if b else WHOLE_PERIOD


def _section(title: str, items: Column) -> Column:
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.concat(
        F.lit(f"## {title}\n\n"), F.when(F.size(items) == 0, F.lit(NOTHING)).otherwise(lines), F.lit("\n")
    )


def render_reports(subgraphs: DataFrame, since=None, until=None) -> DataFrame:
    """Summary line and Markdown per project; sections without items say so."""
    name = F.col("project_name")
    summary = F.concat(
        F.lit("A(z) „"), name, F.lit("” projekthez "), F.col("decisions_total").cast("string"), F.lit(" döntés, "),
        F.col("tasks_total").cast("string"), F.lit(" feladat, "), F.col("events_total").cast("string"), F.lit(" esemény és "),
        F.col("risks_total").cast("string"), F.lit(" kockázat tartozik a kiválasztott időszakban."),
    )
    technologies = F.when(
        F.size("technologies") > 0,
        F.array(F.concat(F.lit("Technológiák: "), F.array_join("technologies", ", "))),
    ).otherwise(F.array().cast(STRINGS))
    cited = F.when(
        F.size("citations") > 0,
        F.concat(
            F.lit("## Hivatkozások\n\n"),
            F.array_join(F.transform("citations", lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n"),
        ),
    ).otherwise("")
    markdown = F.concat(
        F.lit("# "), F.col("title"), F.lit(f"\n\n**Időszak:** {period_label(since, until)}\n\n## Összefoglaló\n\n"),
        F.col("summary"), F.lit("\n\n"),
        _section("Változások", F.concat("events", technologies)), _section("Kockázatok", F.col("risks")),
        _section("Döntések", F.col("decisions")), _section("Nyitott feladatok", F.col("tasks")), cited,
    )
    titled = subgraphs.withColumn("title", F.concat(F.lit("Projektjelentés: "), name)).withColumn("summary", summary)
    return titled.withColumn("markdown", markdown)


def report_ledger(requests: DataFrame, reports: DataFrame) -> DataFrame:
    """``requests(owner_id, project_id)`` -> completed with counts, or failed when the project is unknown."""
    r = reports.select("owner_id", "project_id", "title", "markdown", F.col("markdown").isNotNull().alias("_done"),
                       F.size("citations").alias("citation_count"), F.size("risks").alias("risk_count"))
    joined = requests.join(r, ["owner_id", "project_id"], "left")
    # Who asks for the status alone does not move the texts.
    done = F.coalesce("_done", F.lit(False))
    return joined.withColumn("status", F.when(done, "completed").otherwise("failed")).withColumn(
        "error_summary", F.when(~done, F.lit("Project not found"))
    ).drop("_done")


STATUSES = ("pending", "completed", "failed", "skipped")


def source_stats(versions: DataFrame, chunks: DataFrame, samples: int = 5) -> DataFrame:
    """Per source: status counts in one aggregation, chunk count, latest errors and triage samples.

    ``versions`` carries source_id and external_id (see ``changes.version_context``).
    """
    counts = versions.groupBy("source_id").agg(
        *[F.count_if(F.col("extraction_status") == s).alias(f"extraction_{s}") for s in STATUSES],
        *[F.count_if(F.col("knowledge_status") == s).alias(f"knowledge_{s}") for s in STATUSES],
        *[F.count_if(F.col("triage_status") == s).alias(f"triage_{s}") for s in ("pending", "completed")],
    )
    n = chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("content_chunks"))
    newest = [F.desc("observed_at"), F.desc("version_id")]
    failed = versions.filter((F.col("extraction_status") == "failed") & F.col("extraction_error").isNotNull())
    errors = top_k(failed, ["source_id"], newest, samples).groupBy("source_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "external_id", F.col("extraction_error").alias("error")))).alias("recent_errors")
    )
    m = F.col("triage_metadata")
    triaged = versions.filter((F.col("triage_status") == "completed") & (m != "{}"))
    sample = F.struct(
        "rank", "external_id",
        F.coalesce(jsonx.field(m, "sensitivity"), F.lit("low")).alias("sensitivity"),
        F.coalesce(jsonx.field(m, "relevance").try_cast("double"), F.lit(0.5)).alias("relevance"),
        F.coalesce(jsonx.field(m, "review_risk"), F.lit("medium")).alias("review_risk"),
        F.coalesce(jsonx.field(m, "extractor_hint"), F.lit("structured")).alias("extractor_hint"),
    )
    triage = top_k(triaged, ["source_id"], newest, samples).groupBy("source_id").agg(
        F.sort_array(F.collect_list(sample)).alias("recent_triage")
    )
    out = counts
    for part in (n, errors, triage):
        out = out.join(part, "source_id", "left")
    return out.na.fill(0, ["content_chunks"])


def _mismatched(chunks: DataFrame, current_model: str) -> DataFrame:
    return chunks.filter(F.col("embedding_model").isNotNull() & (F.col("embedding_model") != current_model)).select(
        "version_id"
    ).distinct()


def _flagged() -> Column:
    return F.coalesce(
        jsonx.field(F.col("maintenance_flags"), "embedding_model_mismatch") == "true", F.lit(False)
    )


def drifted_versions(versions: DataFrame, chunks: DataFrame, current_model: str) -> DataFrame:
    """Versions with chunks of another embedding model that are not flagged yet."""
    return versions.filter(~_flagged()).join(_mismatched(chunks, current_model), "version_id", "left_semi")


def flag_drifted(versions: DataFrame, chunks: DataFrame, current_model: str) -> DataFrame:
    """Version snapshot with the mismatch flag merged into ``maintenance_flags`` of drifted versions."""
    hit = _mismatched(chunks, current_model).withColumn("_hit", F.lit(True))
    joined = versions.join(hit, "version_id", "left")
    merged = jsonx.merge(F.col("maintenance_flags"), F.lit('{"embedding_model_mismatch":true}'))
    return joined.withColumn(
        "maintenance_flags",
        F.when(F.coalesce("_hit", F.lit(False)) & ~_flagged(), merged).otherwise(F.col("maintenance_flags")),
    ).drop("_hit")


def pipeline_snapshot(versions: DataFrame) -> DataFrame:
    """One row of queue depths from a single pass."""
    ex, kn, tr = F.col("extraction_status"), F.col("knowledge_status"), F.col("triage_status")
    return versions.agg(
        F.count_if(ex == "pending").alias("extraction_pending"),
        F.count_if(ex == "failed").alias("extraction_failed"),
        F.count_if(kn == "pending").alias("knowledge_pending"),
        F.count_if((tr == "pending") & (ex == "pending")).alias("triage_pending"),
        F.count_if((kn == "pending") & (ex == "completed")).alias("knowledge_ready"),
    )


def outbox_counts(outbox: DataFrame) -> DataFrame:
    return outbox.agg(
        *[F.count_if(F.col("status") == s).alias(f"{s}_outbox_events") for s in ("pending", "failed", "processed")]
    )


def operations_status(
    versions: DataFrame, chunks: DataFrame, outbox: DataFrame, entities: DataFrame, claims: DataFrame, current_model: str
) -> DataFrame:
    """One row with queue depths, canonical counts, recommendations and the summary text.

    The single-row aggregates are scalar subqueries, not joins.
    """
    events = outbox_counts(outbox)
    drift = drifted_versions(versions, chunks, current_model).agg(F.count(F.lit(1)))
    out = pipeline_snapshot(versions).withColumns(
        {
            "_o": events.select(F.struct(*events.columns)).scalar(),
            "canonical_entities": entities.agg(F.count(F.lit(1))).scalar(),
            "canonical_claims": claims.agg(F.count_if(F.col("status") == "active")).scalar(),
            "embedding_model_mismatch_versions": drift.scalar(),
        }
    )
    out = out.select("*", "_o.*").drop("_o")
    waiting = (F.col("extraction_pending") > 0) | (F.col("knowledge_pending") > 0) | (F.col("triage_pending") > 0)
    failed = F.col("failed_outbox_events") > 0
    summary = F.concat_ws(
        " · ",
        F.format_string("Outbox várakozó: %d", "pending_outbox_events"),
        F.format_string("Feldolgozás várakozó: %d", "extraction_pending"),
        F.format_string("Tudás várakozó: %d", "knowledge_pending"),
        F.when(F.col("extraction_failed") > 0, F.format_string("Feldolgozási hiba: %d", "extraction_failed")),
        F.when(F.col("embedding_model_mismatch_versions") > 0,
               F.format_string("Embedding eltérés: %d", "embedding_model_mismatch_versions")),
    )
    return out.withColumns(
        {
            "projection_rebuild_recommended": failed | (F.col("pending_outbox_events") > 100),
            "maintenance_recommended": waiting | failed | (F.col("extraction_failed") > 0)
            | (F.col("embedding_model_mismatch_versions") > 0),
            "stalled": waiting,
            "status_summary": summary,
        }
    )


def recovery_decision(status: DataFrame) -> DataFrame:
    """What a recovery run does: re-queue stalled stages, flag drifted versions."""
    return status.select(
        F.col("stalled").alias("pipeline_recovery_enqueued"),
        F.col("embedding_model_mismatch_versions").alias("embedding_mismatch_flagged"),
    )
