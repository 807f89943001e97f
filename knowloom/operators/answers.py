"""Cited answers from ranked citations: extractive text, citation checks, conflicts, scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowloom.functions.text import is_blank, strip

# Answer texts.
NO_EVIDENCE = (
    "Insufficient evidence to answer this question. "
    "Try syncing sources and approving knowledge proposals first."
)
INVALID_IDS = "Eltávolított érvénytelen hivatkozás-azonosítók: "
UNSUPPORTED = "Nem támasztható állítás elvetve (nincs érvényes forrás): "
CONFLICT_HEAD = "Ellentmondó bizonyíték a(z) '"
CONFLICT_TAIL = "' predikátumra: "
MIN_CONFIDENCE = 0.3

STRINGS = "array<string>"


def _ranked(citations: DataFrame) -> DataFrame:
    """Citations of a question in rank order; the list is bounded by the retrieval limit."""
    item = F.struct("rank", "citation_id", "excerpt", "score", "signal")
    return citations.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("c"))


def extractive_answers(questions: DataFrame, citations: DataFrame) -> DataFrame:
    """Answer per question: top-5 excerpts as bullets, top-3 as claims, best score as confidence.

    Questions without citations get the fixed no-evidence answer.
    """
    joined = questions.select("query_id", "question").join(_ranked(citations), "query_id", "left")
    c = F.col("c")
    bullets = F.array_join(
        F.transform(F.slice(c, 1, 5), lambda x: F.concat(F.lit("- "), F.left(x["excerpt"], F.lit(300)))), "\n\n"
    )
    text = F.concat(
        F.lit("Based on "), F.size(c).cast("string"), F.lit(" retrieved evidence item(s):\n\n"), bullets,
        F.lit("\n\nThis is a heuristic summary for: "), F.col("question"),
    )
    best = F.array_max(F.transform(c, lambda x: x["score"]))
    confidence = F.when(best > 1.0, F.lit(1.0)).otherwise(best)
    claims = F.transform(
        F.slice(c, 1, 3),
        lambda x: F.struct(
            F.left(x["excerpt"], F.lit(200)).alias("text"), F.least(x["score"], F.lit(1.0)).alias("confidence"),
            F.array(x["citation_id"]).alias("citation_ids"),
        ),
    )
    empty = F.array().cast("array<struct<text:string,confidence:double,citation_ids:array<string>>>")
    return joined.select(
        "query_id", "question",
        F.when(c.isNull(), NO_EVIDENCE).otherwise(text).alias("answer"),
        F.coalesce(confidence, F.lit(0.0)).alias("confidence"),
        F.coalesce(confidence < MIN_CONFIDENCE, F.lit(True)).alias("insufficient_evidence"),
        F.coalesce(claims, empty).alias("claims"),
        F.coalesce(F.size(c), F.lit(0)).alias("citation_count"),
    )


def context_package(citations: DataFrame) -> DataFrame:
    """citation id -> excerpt (600 characters) per question."""
    ranked = _ranked(citations)
    entries = F.transform("c", lambda x: F.struct(x["citation_id"], F.left(x["excerpt"], F.lit(600))))
    return ranked.select(
        "query_id", F.map_from_entries(entries).alias("context"),
        F.transform("c", lambda x: x["citation_id"]).alias("allowed_ids"),
    )


def validate_citations(answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """Claims keep only citation ids of ``allowed(query_id, allowed_ids)``; claims left bare are dropped.

    Adds ``warnings`` in claim order.
    """
    joined = answers.join(allowed.select("query_id", "allowed_ids"), "query_id", "left").withColumn(
        "allowed_ids", F.coalesce("allowed_ids", F.array().cast(STRINGS))
    )

    def kept(x: Column) -> Column:
        return F.filter(x["citation_ids"], lambda i: F.array_contains(F.col("allowed_ids"), i))

    def removed(x: Column) -> Column:
        return F.filter(x["citation_ids"], lambda i: ~F.array_contains(F.col("allowed_ids"), i))

    warnings = F.array_compact(
        F.flatten(
            F.transform(
                "claims",
                lambda x: F.array(
                    F.when(F.size(removed(x)) > 0, F.concat(F.lit(INVALID_IDS), F.array_join(removed(x), ", "))),
                    F.when((F.size(kept(x)) == 0) & ~is_blank(x["text"]),
                           F.concat(F.lit(UNSUPPORTED), F.left(x["text"], F.lit(80)))),
                ),
            )
        )
    )
    cleaned = F.transform(
        F.filter("claims", lambda x: F.size(kept(x)) > 0), lambda x: x.withField("citation_ids", kept(x))
    )
    return joined.withColumn("warnings", warnings).withColumn("claims", cleaned).drop("allowed_ids")


def evidence_conflicts(citations: DataFrame) -> DataFrame:
    """One message per question and predicate whose canonical citations state different values."""
    canonical = citations.filter((F.col("signal") == "canonical") & F.contains("excerpt", F.lit(": ")))
    at = F.instr("excerpt", ": ")
    split = canonical.select(
        "query_id",
        F.lower(strip(F.substring("excerpt", F.lit(1), at - 1))).alias("predicate"),
        strip(F.substring("excerpt", at + 2, F.length("excerpt"))).alias("value"),
    ).distinct()
    grouped = split.groupBy("query_id", "predicate").agg(F.sort_array(F.collect_list("value")).alias("values"))
    message = F.concat(
        F.lit(CONFLICT_HEAD), F.col("predicate"), F.lit(CONFLICT_TAIL), F.array_join("values", " vs ")
    )
    return grouped.filter(F.size("values") > 1).select("query_id", "predicate", message.alias("conflict"))


def with_conflicts(answers: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Adds the ordered distinct ``conflicts`` of the question."""
    notes = conflicts.groupBy("query_id").agg(F.sort_array(F.collect_set("conflict")).alias("conflicts"))
    return answers.join(notes, "query_id", "left").withColumn(
        "conflicts", F.coalesce("conflicts", F.array().cast(STRINGS))
    )


def answer(questions: DataFrame, citations: DataFrame) -> DataFrame:
    """Extractive answers, checked against their own citations, with conflicts and distinct warnings."""
    draft = extractive_answers(questions, citations)
    checked = validate_citations(draft, context_package(citations))
    return with_conflicts(checked, evidence_conflicts(citations)).withColumn("warnings", F.array_distinct("warnings"))


def score_golden(answers: DataFrame, golden: DataFrame) -> DataFrame:
    """``golden(query_id, expected_signals, min_citations)`` -> hit, citation check and signal coverage."""
    joined = golden.join(answers.select("query_id", "answer", "citation_count"), "query_id", "left")
    low = F.lower(F.coalesce("answer", F.lit("")))
    found = F.filter("expected_signals", lambda s: F.contains(low, F.lower(s)))
    return joined.select(
        "query_id", F.size(found).alias("signals_found"), F.size("expected_signals").alias("signals_expected"),
        (F.size(found) > 0).alias("any_signal"),
        (F.coalesce("citation_count", F.lit(0)) >= F.col("min_citations")).alias("enough_citations"),
    )
