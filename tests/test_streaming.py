import glob
import json
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from knowloom.operators import canonical, extraction, graph, metrics, triage
from knowloom.sources.sinks import materialize, work_folder, work_tables
from knowloom.streaming import jobs, state


def _drop(df, folder, i):
    df.coalesce(1).write.mode("append").parquet(f"{folder}/part{i}")


def test_outbox_batches_and_restart(spark, tmp_path):
    schema = "event_id string, event_type string, payload string, status string, retry_count int, created_at int"

    def ev(i, kind, **p):
        return (str(i), kind, json.dumps(p), "pending", 0, i)

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = [ev(1, "relationship.materialized", relationship_id="r", owner_id="o", source_entity_id="a", target_entity_id="b"), ev(2, "entity.materialized", entity_id="a", owner_id="o", entity_type="t", canonical_name="A")]
    second = [ev(3, "entity.materialized", entity_id="b", owner_id="o", entity_type="t", canonical_name="B"), ev(4, "claim.materialized", claim_id="x"), ev(5, "entity.alias_added", entity_id="a")]
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/p{i}")
        stream = jobs.read_files(spark, f"{src}/*", schema, max_files=1)
        jobs.project_outbox(stream, out, str(tmp_path / "cp")).awaitTermination()
    nodes, edges = jobs.read_projection(stream, out)
    assert {r["node_id"] for r in nodes.collect()} == {"a", "b"} and edges.count() == 1
    assert {r["status"] for r in spark.read.parquet(f"{out}/projected").collect()} == {"processed"}
    dead = spark.read.parquet(f"{out}/dead_letters").collect()
    assert [(r["event_id"], r["status"], r["retry_count"]) for r in dead] == [("4", "failed", 1)]


def test_changes_keep_state_across_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    for i, rows in enumerate(([("o", "A", 1), ("o", "A", 2), ("p", "A", 1)], [("o", "A", 3), ("o", "B", 4), ("p", "A", 2), ("o", "A", 5)])):
        spark.createDataFrame(rows, "id string, h string, seq int").coalesce(1).write.parquet(f"{src}/p{i}")
        stream = jobs.read_files(spark, f"{src}/*", "id string, h string, seq int", max_files=1)
        jobs.track_changes(stream, "id", F.col("h"), "seq", str(tmp_path), str(tmp_path / "cp")).awaitTermination()
    log = jobs.read_changes(spark, str(tmp_path))
    assert sorted((r["object_id"], r["content_hash"], r["seq"]) for r in log.collect()) == [("o", "A", 1), ("o", "A", 5), ("o", "B", 4), ("p", "A", 1)]
    assert {r["object_id"]: r["content_hash"] for r in jobs.read_latest(spark, str(tmp_path)).collect()} == {"o": "A", "p": "A"}


CLAIM = "claim_id string, owner_id string, subject_entity_id string, predicate string, object_value string, status string, created_at int, source_proposal_id string"
CLAIMS = [("1", "o", "s", "p", "A", "active", 1, "x"), ("2", "o", "s", "p", "B", "active", 2, "x"), ("3", "o", "s", "p", "a", "active", 3, "x"),
          ("4", "o", None, "p", "A", "active", 4, "x"), ("5", "o", None, "p", "\tB\n", "active", 5, "x"), ("6", "o", "s", "p", "c", "active", 6, "x"),
          ("7", "o", "s", "p", None, "active", 7, "x"), ("8", "o", "s", "p", "c", "superseded", 0, "x"), ("9", "o", "t", "p", "b ", "active", 2, "x"),
          ("10", "o", "t", "p", "B", "active", 1, "x")]


@pytest.mark.parametrize("packing", [[[0], [1], [2], [3, 4], [5, 6, 7, 8, 9]], [list(range(10))], [[9, 6, 5], [4, 2], [8, 7], [3, 1], [0]]])
def test_contradictions_do_not_depend_on_batches(spark, tmp_path, packing):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, picked in enumerate(packing):
        spark.createDataFrame([CLAIMS[k] for k in picked], CLAIM).coalesce(1).write.parquet(f"{src}/p{i}")
        stream = jobs.read_files(spark, f"{src}/*", CLAIM, max_files=1)
        jobs.find_contradictions(stream, out, str(tmp_path / "cp"), buckets=3).awaitTermination()
    names = ("existing_claim_id", "conflicting_claim_id", "differing_claims", "differing_values")
    found = sorted(tuple(r[n] for n in names) for r in jobs.read_contradictions(stream, out, buckets=3).collect())
    whole = canonical.detect_contradictions(spark.read.parquet(f"{src}/*"))
    assert found == sorted(tuple(r[n] for n in names) for r in whole.collect())
    assert {f[:2] for f in found} == {("1", "2"), ("2", "3"), ("4", "5"), ("1", "6")}


def test_topics_of_a_single_value_open_no_stored_claims(spark):
    columns = "claim_id string, owner_id string, subject_entity_id string, predicate string, object_value string, status string, created_at int, source_proposal_id string"
    values = lambda rows: canonical.claim_values(spark.createDataFrame(rows, columns))
    one, two = ("2", "o", "s", "p", "A", "active", 2, "x"), ("3", "o", "t", "p", "A", "active", 2, "x")
    earlier, other = ("1", "o", "s", "p", "a", "active", 1, "x"), ("4", "o", "t", "p", "B", "active", 1, "x")
    moved = canonical.moved_topics(values([one, two]), values([one, two, earlier, other]))
    assert [r["subject_entity_id"] for r in moved.collect()] == ["t"]


EVENT = "event_id string, event_type string, payload string, status string, retry_count int, created_at int"


def _outbox():
    """Entities, relationships and claims in an order where ends come late and edges change their ends."""
    def ev(i, kind, **p):
        return (f"{i:03d}", kind, json.dumps(p), "pending", 0, i)

    rows = [ev(i, "relationship.materialized", relationship_id=f"r{i % 12}", owner_id="o", source_entity_id=f"e{i % 5}", target_entity_id=f"e{i % 7}") for i in range(30)]
    rows += [ev(30 + i, "claim.materialized", claim_id=f"c{i}", owner_id="o", subject_entity_id=f"e{i % 9}", predicate="p", object_value="v") for i in range(20)]
    rows += [ev(50 + i, "entity.materialized", entity_id=f"e{i % 6}", owner_id="o", entity_type="t", canonical_name=f"E{i}") for i in range(9)]
    return rows


@pytest.mark.parametrize("packing", [1, 5])
def test_incremental_projection_equals_rebuild(spark, tmp_path, packing):
    rows = _outbox()
    random.Random(packing).shuffle(rows)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(packing):
        spark.createDataFrame(rows[i::packing], EVENT).coalesce(1).write.parquet(f"{src}/p{i:02d}")
    stream = jobs.read_files(spark, f"{src}/*", EVENT, max_files=1)
    jobs.project_outbox(stream, out, str(tmp_path / "cp"), buckets=3).awaitTermination()
    nodes, edges = jobs.read_projection(stream, out, buckets=3)
    events = spark.createDataFrame(rows, EVENT)
    want_nodes = graph.project_nodes(events)
    want_edges = graph.project_edges(events, want_nodes)
    assert sorted(map(tuple, nodes.select(*want_nodes.columns).collect())) == sorted(map(tuple, want_nodes.collect()))
    assert sorted(map(tuple, edges.select(*want_edges.columns).collect())) == sorted(map(tuple, want_edges.collect()))


DOC = "version_id string, owner_id string, source_id string, external_id string, mime_type string, configuration string, text string, created_at int"
TEXTS = ["Anna Smith uses Python.\nTODO: write tests", "Anna Smith uses Redis and Docker\ndecision: go", "# Project Loom\nBob Jones\nTASK ship it", "nothing here",
         "Redis then Python", "# Project Loom\nRedis", "Bob Jones met Anna Smith\nmeeting today"]


def _whole(spark, docs, approve):
    """The same knowledge by the batch operators; claims and relationships about entities nobody approved are left out."""
    rows = triage.with_triage(docs)
    facts = extraction.validate(extraction.extract_facts(rows)).join(rows.select("version_id", "owner_id", "source_id", "sensitivity", "review_risk"), "version_id")
    built = extraction.build_proposals(facts).join(rows.select("version_id", "created_at"), "version_id")
    sure = approve(built).select("proposal_id")
    routes = canonical.route(built.join(sure, "proposal_id", "left_semi").withColumn("status", F.lit("approved")))
    every = built.filter("proposal_type = 'entity'")
    rows = canonical.entity_rows(routes["entity"])
    claims = canonical.materialize_claims(routes["claim"], every, rows)
    claims = canonical.claim_rows(routes["claim"]).select("claim_id", "subject_ref").join(claims, "claim_id").filter("subject_ref is null or subject_entity_id is not null").drop("subject_ref")
    relations = canonical.materialize_relationships(routes["relationship"], every, rows)
    findings = canonical.with_finding_text(canonical.detect_contradictions(claims, ()))
    nodes, edges = graph.rebuild(rows, relations, claims, findings)
    return {"entities": rows, "claims": claims, "findings": findings, "nodes": nodes, "edges": edges}


@pytest.mark.parametrize("packing, least", [([[4, 1], [6, 2, 0], [3, 5]], 0.6), ([[6, 0, 1], [2, 5, 4, 3]], 0.7)])
def test_staged_stream_equals_batch_also_after_a_failure(spark, tmp_path, monkeypatch, packing, least):
    docs = [(f"v{i}", "o", "s", "a.md", "text/plain", None, t, i) for i, t in enumerate(TEXTS)]
    approve = lambda p: p.filter((F.col("confidence") >= least) | F.col("proposal_type").isin("claim", "relationship"))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, picked in enumerate(packing):
        spark.createDataFrame([docs[k] for k in picked], DOC).coalesce(1).write.parquet(f"{src}/p{i}")

    def start():
        stream = jobs.read_files(spark, f"{src}/*", DOC, max_files=1)
        return jobs.ingest_documents(stream, out, str(tmp_path / "cp"), approve=approve, multi_valued=(), buckets=2)

    compare, calls = jobs.compare_claims, []

    def fails_once(tables, *args):
        calls.append(tables.epoch)
        if len(calls) == len(packing):
            raise RuntimeError("executor lost between two stages")
        return compare(tables, *args)

    monkeypatch.setattr(jobs, "compare_claims", fails_once)
    with pytest.raises(Exception, match="between two stages"):
        start().awaitTermination()
    start().awaitTermination()
    got = jobs.read_knowledge(jobs.knowledge_tables(spark, out, StringType(), IntegerType(), buckets=2))
    want = _whole(spark, spark.createDataFrame(docs, DOC), approve)
    names = {"entities": ("entity_id", "entity_type", "canonical_name", "source_proposal_id"), "claims": ("claim_id", "subject_entity_id", "predicate", "object_value"),
             "findings": ("finding_id", "differing_claims", "differing_values"), "nodes": ("node_id", "node_type", "label"), "edges": ("edge_id", "src", "dst", "edge_type")}
    for table, columns in names.items():
        rows = [sorted(map(repr, x[table].select(*columns).collect())) for x in (got, want)]
        assert rows[0] == rows[1] and rows[0], table


def test_change_log_of_a_hot_object_and_nulls(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("hot", "A" if i % 5 else "B", i) for i in range(5000)] + [("n", None, 1), ("n", "A", 2), ("n", None, 3), ("n", None, 4)]
    for i in range(2):
        spark.createDataFrame(rows[i * 2500:(i + 1) * 2500] if i == 0 else rows[2500:], "id string, h string, seq int").coalesce(1).write.parquet(f"{src}/p{i}")
    stream = jobs.read_files(spark, f"{src}/*", "id string, h string, seq int", max_files=1)
    jobs.track_changes(stream, "id", F.col("h"), "seq", str(tmp_path), str(tmp_path / "cp"), buckets=2).awaitTermination()
    got = jobs.read_changes(spark, str(tmp_path)).collect()
    assert sum(r["object_id"] == "hot" for r in got) == 2000
    assert sorted(r["seq"] for r in got if r["object_id"] == "n") == [1, 2, 3]


def test_work_tables_leave_with_their_batch(spark, tmp_path):
    """Only state and output stay, so the disk a stream takes does not grow with the steps of its batches."""
    written = lambda: set(glob.glob(work_folder(spark, "stream-").rsplit("/", 1)[0].removeprefix("file:") + "/stream-*"))
    with work_tables(spark):
        inner = materialize(spark.range(3).toDF("x"), "stream-seen")
        assert inner.count() == 3 and any("stream-seen" in w for w in written())
    assert not any("stream-seen" in w for w in written())
    before, rows = written(), _outbox()
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_files(spark, str(tmp_path / "in"), EVENT)
    jobs.project_outbox(stream, str(tmp_path / "out"), str(tmp_path / "cp"), buckets=2).awaitTermination()
    assert written() == before
    assert jobs.read_projection(stream, str(tmp_path / "out"), buckets=2)[0].count() == 26


LEDGER_ROW = "version_id string, status string, proposals_created long, requires_review_count long, error_summary string"


def test_run_metrics_come_from_the_writing_pass(spark, tmp_path):
    rows = [("a", "completed", 3, 1, None), ("b", "failed", 0, 0, "broken"), ("c", "skipped", 0, 0, None), ("d", "failed", 0, 0, "worse")]
    row = metrics.write_measured(spark.createDataFrame(rows, LEDGER_ROW), str(tmp_path / "run"), "r1").first()
    assert (row["status"], row["versions"], row["completed"], row["failed"], row["skipped"], row["proposals_created"], row["requires_review_count"]) == ("partial", 4, 1, 2, 1, 3, 1)
    assert row["first_error"] == "b: broken" and row["latency_ms"] > 0 and spark.read.parquet(str(tmp_path / "run")).count() == 4
    empty = metrics.write_measured(spark.createDataFrame([], LEDGER_ROW), str(tmp_path / "none"), "r2").first()
    assert (empty["status"], empty["versions"], empty["first_error"]) == ("completed", 0, None)


def test_stream_listener_writes_a_ledger_row_per_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    for i, status in enumerate(("completed", "failed")):
        spark.createDataFrame([(f"v{i}", status, 1, 0, "e")] * (i + 1), LEDGER_ROW).coalesce(1).write.parquet(f"{src}/p{i}")
    listener = metrics.LedgerListener()
    spark.streams.addListener(listener)
    try:
        stream = metrics.measured_stream(jobs.read_files(spark, f"{src}/*", LEDGER_ROW, max_files=1))
        stream.writeStream.queryName("ledger").format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        for _ in range(100):
            if len(listener.rows) == 2:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    got = {(r["run_id"], r["status"], r["versions"]) for r in listener.ledger(spark).collect()}
    assert got == {("ledger/0", "completed", 1), ("ledger/1", "failed", 2)} or got == {("ledger/0", "failed", 2), ("ledger/1", "completed", 1)}


def test_streamed_outbox_writes_and_reads_a_batch_by_all_cores(spark, tmp_path, monkeypatch):
    from knowloom.plans import catalog, operate

    monkeypatch.setattr(operate, "work_folder", lambda session, name: f"{tmp_path}/{name}")
    catalog.QUERIES["streamed_outbox"](spark, "/root/testdata/sf0.001")
    files = list((tmp_path / "outbox" / "arriving").glob("*.parquet"))
    assert len(files) >= spark.sparkContext.defaultParallelism
    assert len(list((tmp_path / "outbox" / "graph" / "manifest").glob("batch=*"))) == 3


def test_a_batch_stores_its_own_nodes_only(spark, tmp_path):
    def ev(i, kind, **p):
        return (f"{i:03d}", kind, json.dumps(p), "pending", 0, i)

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    name = lambda k, n: {"entity_id": f"e{k}", "owner_id": "o", "entity_type": "t", "canonical_name": n}
    # The second batch restates e0 later and e1 earlier than the first one did.
    batches = [[ev(10 + k, "entity.materialized", **name(k, "old")) for k in range(6)], [ev(30, "entity.materialized", **name(0, "new")), ev(5, "entity.materialized", **name(1, "late")), ev(31, "entity.materialized", **name(9, "new"))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{src}/p{i}")
    stream = jobs.read_files(spark, f"{src}/*", EVENT, max_files=1)
    jobs.project_outbox(stream, out, str(tmp_path / "cp"), buckets=1).awaitTermination()
    for i, n in enumerate((6, 2)):
        assert spark.read.parquet(f"{out}/graph/nodes/batch={i}").count() == n
    nodes = {r["node_id"]: r["label"] for r in jobs.read_projection(stream, out, buckets=1)[0].collect()}
    assert nodes == {"e0": "new", "e1": "old", "e2": "old", "e3": "old", "e4": "old", "e5": "old", "e9": "new"}


def test_streamed_contradictions_reads_a_batch_by_all_cores(spark, tmp_path, monkeypatch):
    from knowloom.plans import catalog, operate

    monkeypatch.setattr(operate, "work_folder", lambda session, name: f"{tmp_path}/{name}")
    catalog.QUERIES["streamed_contradictions"](spark, "/root/testdata/sf0.001")
    assert len(list((tmp_path / "claims" / "arriving").glob("*.parquet"))) >= spark.sparkContext.defaultParallelism
    assert len(list((tmp_path / "claims" / "topics" / "manifest").glob("batch=*"))) == 4


def test_versions_of_many_batches_become_one_piece(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "PIECES", 3)
    schema = StructType().add("k", StringType()).add("v", IntegerType())
    tables, want = state.Tables(spark, str(tmp_path / "t"), {"rows": ("k",)}, {"rows": schema}, 2, {"rows": ("k",)}), {}
    for epoch in range(8):
        now = tables.at(epoch)
        rows = [(f"k{(epoch + j) % 5}", epoch) for j in range(2)] + [(None, epoch)]
        now.add_versions("rows", spark.createDataFrame(rows, schema), spark.createDataFrame([*rows, ("k4", 0)], schema))
        now.commit()
        want = {k: v for k, v in want.items() if k != "k4"} | dict(rows)
        latest = tables.latest()
        assert sorted(map(repr, latest.live("rows").select("k", "v").toLocalIterator())) == sorted(map(repr, spark.createDataFrame(list(want.items()), schema).collect()))
        assert max(map(len, latest.pieces.values())) <= 4
