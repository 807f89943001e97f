"""From questions to cited answers: chunk search, entity neighbourhoods and claims rank together and end in one answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowloom.functions.skew import hot_join
from knowloom.operators import answers, graph, retrieval, search_index
from knowloom.sources.sinks import materialize


@dataclass(frozen=True)
class QuestionPlan:
    """Results of :func:`run`, one row per question unless said otherwise."""

    citations: DataFrame  #: ranked, up to ``limit`` per question
    steps: DataFrame  #: three per question, with result counts
    related: DataFrame
    answers: DataFrame
    audit: DataFrame


def entity_neighborhoods(matched: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    """(query_id, node_id, label, node_type): matched entities and the nodes at the other ends of up to ``limit`` of their edges.

    ``matched(query_id, entity_id)``. Every entity is looked up once, whatever number of questions match it.
    """
    roots = matched.select(F.col("entity_id").alias("root_id")).distinct()
    near = graph.neighborhood(edges, roots, limit).select("root_id", F.col("other").alias("node_id"))
    near = near.union(roots.select("root_id", F.col("root_id").alias("node_id"))).distinct()
    asked = matched.select("query_id", F.col("entity_id").alias("root_id")).distinct()
    seen = hot_join(near, asked, ["root_id"]).select("query_id", "node_id").distinct()
    return hot_join(seen, graph.node_view(nodes), ["node_id"]).select("query_id", "node_id", "label", "node_type")


def run(spark: SparkSession, index: str, entities: DataFrame, claims: DataFrame, nodes: DataFrame, edges: DataFrame, questions: DataFrame,
        mode: str = "hybrid", limit: int = 20, entity_limit: int = 5, edge_limit: int = 50) -> QuestionPlan:
    """Answer ``questions(query_id, owner_id, question, vector)`` from a stored index, entities, their graph and claims.

    The corpus is not read: chunk search opens only postings of asked terms (and the vectors, for semantic modes). Hits
    of the three steps are written once and feed ranking, plan steps, related entities, answers and the audit row alike.
    Questions that nothing matches end in the fixed answer without evidence.
    """
    # Vectors may be costly: they are made once, by all cores, and every step reads them.
    questions = materialize(questions.repartition(max(8, spark.sparkContext.defaultParallelism)), "plan-questions")
    hits = materialize(search_index.search(spark, index, questions, mode, limit), "plan-hits")
    matched = materialize(retrieval.entity_search(entities, questions, entity_limit), "plan-entities")
    found = materialize(retrieval.claim_search(claims, questions, limit), "plan-claims")
    near = entity_neighborhoods(matched, nodes, edges, edge_limit)
    parts = [
        retrieval.chunk_citations(hits, search_index.indexed_chunks(spark, index)), retrieval.graph_citations(near), retrieval.claim_citations(found)]
    citations = materialize(retrieval.rank_citations(parts, limit), "plan-citations")
    steps = retrieval.plan_steps(questions, hits, matched, found, mode)
    return QuestionPlan(
        citations, steps, retrieval.related_entities(matched, found), answers.answer(questions, citations),
        retrieval.retrieval_audit(questions, citations, steps, mode))
