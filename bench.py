"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from knowloom.plans import catalog  # noqa: E402
from knowloom.session import local_session  # noqa: E402

HEADLINE = (
    "chunk_documents", "hash_embeddings", "triage_pages", "stored_versions", "new_objects", "sync_summaries",
    "extraction_results", "built_proposals", "entity_matches", "decided_proposals", "upserted_entities",
    "materialized_claims", "contradictions", "hot_topic_contradictions", "keyword_search", "semantic_search",
    "hybrid_search", "cited_answers", "projected_edges", "expanded_graph", "project_dashboards", "project_reports",
    "source_statistics", "operations_status", "streamed_changes", "indexed_keyword_search", "planned_answers", "dictionary_names",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    seconds: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
