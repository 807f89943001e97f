import base64
import fnmatch
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from knowloom.functions.hashing import fingerprint
from knowloom.operators import changes, chunking, triage
from knowloom.sources import content, discovery, folder, landed, sinks, snapshots


def test_folder_scan(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "a" / "node_modules" / "deep").mkdir(parents=True)
    (root / "readme.md").write_text("hello plain text")
    (root / "a" / "x y.TXT").write_text("text")
    (root / "a" / "skip.bin").write_text("no")
    (root / "a" / "node_modules" / "deep" / "n.md").write_text("no")
    rows = {r["external_id"]: r for r in folder.scan_folder(spark, [str(root)]).collect()}
    assert set(rows) == {"readme.md", "a/x y.TXT"}
    assert rows["readme.md"]["content_hash"] == hashlib.sha256(b"hello plain text").hexdigest()
    assert rows["readme.md"]["mime_type"] == "text/markdown" and rows["a/x y.TXT"]["mime_type"] == "text/plain"
    two = folder.scan_folder(spark, [str(root), str(root / "a")], exclude_globs=("*node_modules*",))
    assert {r["external_id"] for r in two.select("external_id").collect()} == {"0/readme.md", "0/a/x y.TXT", "1/x y.TXT"}


@pytest.mark.parametrize("tasks", [1, 3, 64])
def test_folder_listing_source(spark, tmp_path, tasks):
    root = tmp_path / "docs"
    (root / "a" / "node_modules" / "deep").mkdir(parents=True)
    (root / "a" / "empty").mkdir()
    (root / "readme.md").write_text("hello plain text")
    (root / "a" / "x y.TXT").write_text("text" * 500_000)
    (root / "a" / "skip.bin").write_text("no")
    (root / "a" / "link.md").symlink_to(root / "readme.md")
    (root / "a" / "node_modules" / "n.md").write_text("no")
    locked = root / "a" / "node_modules" / "deep"
    (locked / "n.md").write_text("no")
    locked.chmod(0)
    (root / "a" / "node_modules").chmod(0)
    try:
        rows = {r["external_id"]: r for r in discovery.list_folders(spark, [str(root)], tasks=tasks).collect()}
    finally:
        (root / "a" / "node_modules").chmod(0o755)
        locked.chmod(0o755)
    assert set(rows) == {"readme.md", "a/x y.TXT"}
    assert rows["readme.md"]["content_hash"] == hashlib.sha256(b"hello plain text").hexdigest() and rows["readme.md"]["size"] == 16
    assert rows["readme.md"]["mime_type"] == "text/markdown" and rows["a/x y.TXT"]["mime_type"] == "text/plain"
    two = discovery.list_folders(spark, [str(root), str(root / "a")], excludes=("*node_modules*",), tasks=tasks)
    assert {r["external_id"] for r in two.collect()} == {"0/readme.md", "0/a/x y.TXT", "1/x y.TXT"}


def test_folder_walk_enters_no_excluded_folder(tmp_path, monkeypatch):
    (tmp_path / "a" / "node_modules" / "deep").mkdir(parents=True)
    (tmp_path / "a" / "node_modules" / "deep" / "n.md").write_text("no")
    (tmp_path / "a" / "y.md").write_text("yes")
    entered, opened = [], []
    scandir, digest = os.scandir, discovery._digest
    monkeypatch.setattr(discovery.os, "scandir", lambda p: entered.append(p) or scandir(p))
    monkeypatch.setattr(discovery, "_digest", lambda p: opened.append(p) or digest(p))
    walker = discovery._Walker({"roots": json.dumps([str(tmp_path)]), "tasks": "2"})
    rows = [r for part in walker.folders() for batch in walker.read(part) for r in batch.to_pylist()]
    assert [r["external_id"] for r in rows] == ["a/y.md"] and len(opened) == 1
    assert not [p for p in entered if "node_modules" in p]


def test_sync_run(spark):
    objects = spark.createDataFrame([("s", "known", "file", "o-known"), ("s", "gone", "file", "o-gone"), ("t", "other", "file", "o-t")], "source_id string, external_id string, object_type string, object_id string")
    versions = spark.createDataFrame([("o-known", "v1", "A", "1", 1), ("o-known", "v1", "B", "2", 2)], "object_id string, pipeline_version string, content_hash string, version_id string, observed_at int")
    schema = "run_id string, source_id string, external_id string, object_type string, content_hash string, version_id string, observed_at int, seq int, error string"
    listing = [("r", "s", "known", "file", "A", "3", 3, 0, None), ("r", "s", "new", "file", "C", "4", 3, 1, None), ("r", "s", "new", "file", "C", "5", 3, 2, None), ("r", "s", "bad", "file", None, "6", 3, 3, "unreadable")]
    for incremental in (True, False):
        out = changes.sync(objects, versions, spark.createDataFrame(listing, schema), incremental=incremental)
        # An older content that comes back is stored already.
        assert [(r["content_hash"], r["version_id"]) for r in out["created"].collect()] == [("C", "4")]
        assert {r["external_id"] for r in out["removed"].collect()} == {"gone"}
        assert {r["external_id"] for r in out["objects"].collect()} == {"known", "gone", "other", "new"} and out["versions"].count() == 3
        s = out["summary"].first()
        assert (s["status"], s["objects_discovered"], s["objects_processed"], s["objects_failed"], s["error_summary"]) == ("partial", 4, 3, 1, "bad: unreadable")
        assert out["audit"].first()["action"] == "sync_completed"


def test_globs_match_fnmatch(spark):
    globs = ["*.md", "a/?.txt", "**/tmp/**", "x[0-9].md", "x[!0-9].md", "a.b"]
    paths = ["r.md", "a/b.txt", "a/bb.txt", "q/tmp/z", "tmp/z", "x1.md", "xa.md", "a.b", "aXb"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for g in globs:
        got = {r["p"] for r in df.filter(folder.matches_any_glob(F.col("p"), (g,))).collect()}
        assert got == {p for p in paths if fnmatch.fnmatchcase(p, g)}, g


def test_mail_walks_nested_parts(spark):
    def data(s):
        return base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")

    message = {
        "id": "m1", "historyId": "7",
        "payload": {
            "mimeType": "multipart/mixed", "headers": [{"name": "Subject", "value": "old"}, {"name": "Subject", "value": "Hi"}, {"name": "From", "value": "a@b"}],
            "parts": [
                {"mimeType": "text/plain", "body": {"data": data("first")}},
                {"mimeType": "multipart/alternative", "parts": [{"mimeType": "text/plain", "body": {"data": data("né?>~")}}, {"mimeType": "image/png", "body": {"data": data("png")}}]},
            ],
        },
    }
    bare = {"id": "m2", "payload": {"mimeType": "text/plain", "headers": []}}
    df = spark.createDataFrame([(json.dumps(message),), (json.dumps(bare),)], "value string")
    rows = {r["external_id"]: r for r in landed.mail_objects(df).collect()}
    body = base64.b64decode(rows["m1"]["content_ref"].removeprefix("inline:")).decode()
    assert body == "Subject: Hi\nFrom: a@b\n\nné?>~\nfirst"
    assert rows["m1"]["content_hash"] == hashlib.sha256(b"m1|7").hexdigest()
    assert base64.b64decode(rows["m2"]["content_ref"].removeprefix("inline:")).decode() == "Subject: (no subject)\nFrom:"


def test_mail_reads_any_depth_and_survives_broken_parts(spark):
    part = {"mimeType": "text/plain", "body": {"data": base64.urlsafe_b64encode(b"deep").decode()}}
    for _ in range(40):
        part = {"mimeType": "multipart/mixed", "parts": [part]}
    broken = {"mimeType": "multipart/mixed", "parts": [{"mimeType": "text/plain", "body": {"data": "A"}}, {"mimeType": "text/html", "body": {"data": "b2s="}}, None, {"mimeType": None, "body": 3}]}
    rows = [(json.dumps({"id": str(i), "payload": p}),) for i, p in enumerate((part, broken, None))]
    got = {r["external_id"]: base64.b64decode(r["content_ref"].removeprefix("inline:")).decode() for r in landed.mail_objects(spark.createDataFrame(rows, "value string")).collect()}
    assert got["0"].endswith("deep") and got["1"].endswith("\n\nok") and got["2"] == "Subject: (no subject)\nFrom:"


def test_calendar_horizon(spark):
    def event(i, **start):
        return ("cal", json.dumps({"id": i, "etag": "e", "summary": "S", "start": start, "location": "L"}))

    df = spark.createDataFrame([event("in", date="2024-01-10"), event("out", date="2020-01-01"), event("t", dateTime="2024-01-02T10:00:00Z")], "calendar_id string, value string")
    rows = landed.calendar_objects(df, now=F.lit("2024-01-05").cast("timestamp"), past_days=30, future_days=30).collect()
    assert {r["external_id"] for r in rows} == {"cal:in", "cal:t"}
    text = base64.b64decode(rows[0]["content_ref"].removeprefix("inline:")).decode()
    assert text.startswith("Event: S\nWhen: 2024-01-") and text.endswith("Location: L")


def test_content_and_parsers(spark, tmp_path):
    f = tmp_path / "n.md"
    f.write_bytes(b"# T\xff\n")
    rows = [("1", "a.txt", "text/plain", "inline:" + base64.b64encode(b"hi").decode()), ("2", "b.md", None, str(f)), ("3", "c.pdf", None, "inline:aGk="),
            ("4", "email:x.pdf", None, "inline:" + base64.b64encode(b" \n").decode()), ("5", "gone.txt", None, "/no/such/file")]
    v = spark.createDataFrame(rows, "version_id string, external_id string, mime_type string, content_ref string")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    parsed = content.parse_documents(content.load_content(v, files))
    got = {r["version_id"]: r for r in parsed.collect()}
    assert got["1"]["text"] == "hi" and got["2"]["text"] == "# T�\n" and got["2"]["parser_type"] == "markdown"
    status = {r["version_id"]: r["extraction_status"] for r in chunking.processing_outcomes(parsed).collect()}
    assert status == {"1": "completed", "2": "completed", "3": "failed", "4": "skipped", "5": "failed"}


def test_fingerprint_counts_null_as_empty(spark):
    row = spark.range(1).select(fingerprint("a", F.lit(None), "c").alias("f")).first()
    assert row["f"] == hashlib.sha256(b"a||c").hexdigest()


def test_triage_cases(spark):
    rows = [("docs/readme.md", "text/markdown", '{"project":"P"}'), ("config/.env.production", None, None), ("x/key.pem", None, None), ("d.pdf", None, None), ("noext", "text/html", None)]
    df = spark.createDataFrame(rows, "external_id string, mime_type string, configuration string")
    got = {r["external_id"]: r for r in triage.with_triage(df).collect()}
    md = got["docs/readme.md"]
    assert (md["extractor_hint"], md["relevance"], md["sensitivity"], md["review_risk"], md["project_hint"]) == ("markdown", 0.92, "low", "low", "P")
    assert got["config/.env.production"]["sensitivity"] == "high" and got["x/key.pem"]["review_risk"] == "high"
    assert got["d.pdf"]["relevance"] == 0.7 and got["noext"]["extractor_hint"] == "text"


def test_version_context_neither_copies_nor_broadcasts_sources(spark):
    """Sources may be as many as versions: a copy per salt, small by its estimate, would be gathered by the driver."""
    versions = spark.range(50).selectExpr("id version_id", "id object_id")
    objects = spark.range(50).selectExpr("id object_id", "id % 7 source_id", "cast(id as string) external_id")
    sources = spark.range(7).selectExpr("id source_id", "id + 100 owner_id", "'{}' configuration")
    out = changes.version_context(versions, objects, sources)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate" not in plan, plan
    assert sorted((r["version_id"], r["owner_id"]) for r in out.collect()) == [(i, 100 + i % 7) for i in range(50)]


def test_reruns_converge(spark):
    old = spark.createDataFrame([("s", "a", "file")], "source_id string, external_id string, object_type string")
    listed = spark.createDataFrame([("s", "a", "file"), ("s", "b", "file"), ("s", "b", "file")], "source_id string, external_id string, object_type string")
    new = changes.new_objects(old, listed)
    assert [r["external_id"] for r in new.collect()] == ["b"]
    both = old.unionByName(new.drop("object_id"))
    assert changes.new_objects(both, listed).count() == 0


def test_reverted_content_adds_no_version(spark):
    schema = "object_id string, pipeline_version string, content_hash string, version_id int, observed_at int"
    stored = spark.createDataFrame([("o", "v1", "A", 1, 1), ("o", "v1", "B", 2, 2)], schema)
    listed = spark.createDataFrame([("o", "v1", "A", 3, 3), ("o", "v1", "C", 4, 3), ("n", "v1", "A", 5, 3)], schema)
    assert {r["version_id"] for r in changes.changed_versions(stored, listed).collect()} == {4, 5}


def test_upsert_and_snapshots(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, name string, created int")
    new = spark.createDataFrame([(2, "B", 99), (3, "c", 30)], "id int, name string, created int")
    out = sinks.upsert(old, new, ["id"], keep=("created",))
    assert sorted(map(tuple, out.collect())) == [(1, "a", 10), (2, "B", 20), (3, "c", 30)]
    path = str(tmp_path / "t")
    sinks.write_snapshot(out, path)
    sinks.append_table(new, path)
    assert spark.read.parquet(path).count() == 5


def test_bucketed_upsert_moves_changes_only(spark, tmp_path):
    old = spark.createDataFrame([(i, f"n{i}", 1) for i in range(200)], "id long, name string, seen int")
    first = snapshots.write(old, str(tmp_path / "1"), ("id",), 4)
    new = spark.createDataFrame([(5, "five", 2), (500, "new", 2), (7, None, 2)], "id long, name string, seen int")
    second = snapshots.upserted(first, new, str(tmp_path / "2"), keep=("seen",))
    rows = {r["id"]: (r["name"], r["seen"]) for r in second.read(spark).collect()}
    assert len(rows) == 201 and rows[5] == ("five", 1) and rows[500] == ("new", 2) and rows[7] == (None, 1) and rows[6] == ("n6", 1)
    assert first.read(spark).count() == 200
    merged = sinks.upsert(first.read(spark), new.repartition(4, "id"), ["id"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1, plan
