import json
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from knowloom import schemas
from knowloom.functions import text
from knowloom.operators import canonical, dictionary, embedding, extraction, graph, ontology, reports, resolution, review

SAMPLE = """# Demo Project

Text for the smoke run.

## Stack

It uses PostgreSQL, FastAPI, Redis and redis again.

## Work

TODO: Ship the phase
TODO: Check the rebuild

decision: use an outbox
release: Phase 6 done

Alice Engineer leads.
"""


def test_extraction_sample(spark):
    df = spark.createDataFrame([("v", SAMPLE, "c0"), ("blank", "nothing here", "c1")], "version_id string, text string, chunk_id string")
    rows = {r["version_id"]: r for r in extraction.validate(extraction.extract_facts(df)).collect()}
    r = rows["v"]
    assert [(e["local_id"], e["name"], e["entity_type"]) for e in r["entities"]] == [
        ("ent-0", "Demo Project", "project"), ("ent-1", "Stack", "concept"), ("ent-2", "Work", "concept"),
        ("ent-tech-3", "PostgreSQL", "technology"), ("ent-tech-4", "FastAPI", "technology"), ("ent-tech-5", "Redis", "technology"),
        ("ent-person-6", "Demo Project", "person"), ("ent-person-7", "Alice Engineer", "person")]
    for e in r["entities"]:
        assert e["name"] in SAMPLE[e["anchor_start"]:e["anchor_end"]]
    assert [t["title"] for t in r["tasks"]] == ["Ship the phase", "Check the rebuild"]
    assert [d["title"] for d in r["decisions"]] == ["use an outbox"]
    assert [e["title"] for e in r["events"]] == ["Phase 6 done"]
    assert r["claims"][0]["value"] == "Stack" and r["relationships"][0]["target_local_id"] == "ent-1"
    assert r["is_valid"] and rows["blank"]["warnings"] == ["heuristic_extractor_found_no_signals"]


def _result(spark, **over):
    base = {"version_id": "v", "schema_version": extraction.SCHEMA_VERSION, "entities": [], "claims": [], "relationships": [], "tasks": [], "decisions": [], "events": [], "warnings": []}
    return spark.createDataFrame([base | over], schemas.EXTRACTION)


def _e(local_id):
    return {"local_id": local_id, "name": "N", "entity_type": "concept", "aliases": [], "description": None, "confidence": 0.9, "chunk_id": None, "anchor_start": 0, "anchor_end": 1}


def test_validation_negatives(spark):
    claim = {"local_id": "c", "subject_local_id": "gone", "predicate": "p", "value": "v", "confidence": 0.5, "chunk_id": None}
    rel = {"local_id": "r", "source_local_id": "a", "target_local_id": "gone", "relationship_type": "X", "confidence": 0.5, "chunk_id": None}
    errors = lambda **k: extraction.validate(_result(spark, **k)).first()["errors"]
    assert errors(entities=[_e("dup"), _e("dup")]) == ["duplicate local_id: dup"]
    assert "schema_version" in errors(schema_version="9.9.9")[0]
    assert errors(entities=[_e(" ")]) == ["entities: missing local_id"]
    assert errors(entities=[_e("a")], claims=[claim], relationships=[rel]) == ["claim c references unknown subject gone", "relationship r references unknown target gone"]
    assert extraction.build_proposals(_result(spark, entities=[_e("dup"), _e("dup")])).count() == 0


def test_proposal_rules(spark):
    p = extraction.build_proposals(_result(spark, entities=[_e("a")])).first()
    assert (p["risk_level"], p["requires_review"], p["proposal_type"]) == ("low", False, "entity")
    assert json.loads(p["payload"])["name"] == "N"
    row = spark.range(1).select(
        extraction.requires_review(F.lit("low"), F.lit("merge"), F.lit(0.99)).alias("m"), extraction.requires_review(F.lit("medium"), F.lit("task"), F.lit(0.7)).alias("t"),
        extraction.entity_risk(F.lit("person"), F.lit(0.9)).alias("r")).first()
    assert (row["m"], row["t"], row["r"]) == (True, True, "medium")


def _similarity(a, b):
    a, b = (re.sub(r"\s+", " ", x.strip().lower()) for x in (a, b))
    if a == b:
        return 1.0
    if a in b or b in a:
        return min(len(a), len(b)) / max(len(a), len(b))
    x, y = set(a.split()), set(b.split())
    return len(x & y) / max(len(x), len(y)) if x and y else 0.0


def _brute(names, index, limit=5):
    out = set()
    for owner, kind, name in set(names):
        scored = []
        for i, o, k, canon, aliases in index:
            if (o, k) == (owner, kind):
                own = _similarity(name, canon)
                best = max([own, *(_similarity(name, a) for a in aliases)])
                if best > 0.4:
                    scored.append((-best, canon, i))
        for rank, (s, canon, i) in enumerate(sorted(scored)[:limit], 1):
            out.add((owner, kind, name, i, rank, round(-s, 9)))
    return out


@pytest.mark.parametrize("seed,words,tokens,count", [(1, 6, (1, 3), 90), (2, 12, (2, 6), 80), (3, 10, (6, 13), 60), (4, 3, (1, 4), 150)])
def test_candidates_equal_brute_force(spark, seed, words, tokens, count):
    rng = random.Random(seed)
    vocab = ["hub"] + ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) for _ in range(words)]

    def name():
        return " ".join(rng.choice(vocab) if rng.random() < 0.7 else "hub" for _ in range(rng.randint(*tokens)))

    index, seen = [], set()
    while len(index) < count:
        n = name() + ("" if rng.random() < 0.6 else f" {len(index)}")
        if n not in seen:
            seen.add(n)
            index.append((f"i{len(index):03d}", "o", "t", n, [name()] if rng.random() < 0.3 else []))
    names = [("o", "t", name()) for _ in range(60)] + [("o", "t", index[0][3].upper()), ("o", "t", "hub"), ("x", "t", "hub")]
    idx = spark.createDataFrame(index, "index_id string, owner_id string, entity_type string, canonical_name string, aliases array<string>")
    asked = spark.createDataFrame(names, "owner_id string, entity_type string, name string")
    got = {(r["owner_id"], r["entity_type"], r["name"], r["index_id"], r["rank"], round(r["score"], 9)) for r in resolution.find_matches(asked, idx).collect()}
    assert got == _brute(names, index)


def test_long_names_by_containment(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (60, 127, 128, 129, 200, 300)]
    index = [(f"i{k}", "o", "t", b, []) for k, b in enumerate(base)]
    names = [("o", "t", b[3:int(len(b) * 0.8)]) for b in base] + [("o", "t", "zz" + b + "yy") for b in base]
    idx = spark.createDataFrame(index, "index_id string, owner_id string, entity_type string, canonical_name string, aliases array<string>")
    asked = spark.createDataFrame(names, "owner_id string, entity_type string, name string")
    got = {(r["owner_id"], r["entity_type"], r["name"], r["index_id"], r["rank"], round(r["score"], 9)) for r in resolution.find_matches(asked, idx).collect()}
    assert got == _brute(names, index)


def test_resolution_actions(spark):
    def action(*scores):
        arr = F.array(*[F.struct(F.lit(float(s)).alias("score")) for s in scores]) if scores else F.array().cast("array<struct<score:double>>")
        return spark.range(1).select(resolution.resolution_action(arr).alias("a")).first()["a"]

    assert [action(), action(0.71), action(0.95), action(0.9, 0.88), action(0.95, 0.7)] == ["new", "new", "link", "ambiguous", "link"]


def test_merge_chains_and_cycles(spark):
    ids = ["a", "b", "c", "d", "x", "y", "z", "other"]
    rows = [(i, "o", "other" if i == "other" else "t", i.upper(), [i + "1"], "active") for i in ids]
    e = spark.createDataFrame(rows, "entity_id string, owner_id string, entity_type string, canonical_name string, aliases array<string>, status string")
    merges = [("a", "b", 1), ("b", "c", 2), ("c", "d", 3), ("x", "y", 4), ("y", "x", 5), ("z", "other", 6), ("a", "x", 7)]
    m = spark.createDataFrame([(*r, r[2]) for r in merges], "source string, target string, created_at int, merge_id int")
    got = {r["entity_id"]: (r["status"], r["aliases"]) for r in canonical.apply_merges(e, m).collect()}
    assert got["d"] == ("active", ["d1", "A", "a1", "B", "b1", "C", "c1"][0:1] + ["A", "a1", "B", "b1", "C", "c1"])
    assert [got[i][0] for i in "abc"] == ["merged"] * 3
    assert [got[i][0] for i in "xyz"] == ["active"] * 3


CLAIMS = "claim_id string, owner_id string, subject_entity_id string, predicate string, object_value string, status string, created_at int, source_proposal_id string"


def test_contradictions(spark):
    rows = [("1", "o", "s", "uses", "MySQL", "active", 1, "p"), ("2", "o", "s", "uses", "PostgreSQL", "active", 2, "p"), ("3", "o", "s", "uses", " postgresql ", "active", 3, "p"),
            ("4", "o", None, "uses", "A", "active", 1, "p"), ("5", "o", None, "uses", "B", "active", 2, "p"), ("6", "o", "s", "has_task", "A", "active", 1, "p"),
            ("7", "o", "s", "has_task", "B", "active", 2, "p"), ("8", "o2", "s", "uses", "Oracle", "active", 3, "p"), ("9", "o", "s", "uses", "X", "retracted", 4, "p"), ("a", "o", "s", "uses", "mysql", "active", 9, "p")]
    c = spark.createDataFrame(rows, CLAIMS)
    found = canonical.with_finding_text(canonical.detect_contradictions(c)).collect()
    assert {(r["existing_claim_id"], r["conflicting_claim_id"], r["differing_claims"]) for r in found} == {("1", "2", 2), ("1", "3", 2), ("2", "a", 2), ("4", "5", 1)}
    one = next(r for r in found if r["conflicting_claim_id"] == "2")
    assert one["summary"] == "Potential contradiction on 'uses': 'MySQL' vs 'PostgreSQL'"
    assert json.loads(one["evidence"])["existing_value"] == "MySQL"
    new = spark.createDataFrame([("n1", "o", "s", "uses", "MYSQL", "active", 20, "q"), ("n2", "o", "s", "uses", "Redis", "active", 20, "q"), ("n3", "o", "s", "likes", "x", "active", 20, "q")], CLAIMS)
    got = {(r["conflicting_claim_id"], r["existing_claim_id"], r["differing_claims"], r["differing_values"]) for r in canonical.compare_new_claims(new, c).collect()}
    assert got == {("n1", "2", 2, 1), ("n2", "1", 4, 2)}
    assert {r["conflicting_claim_id"] for r in canonical.detect_contradictions(c, multi_valued=()).collect()} >= {"7"}


def test_decisions_once_and_idempotent(spark):
    p = spark.createDataFrame([(1, "pending", "{}", None, 0), (2, "approved", "{}", None, 0), (3, "pending", "{}", None, 0)], "proposal_id int, status string, payload string, original_payload string, updated_at int")
    d = spark.createDataFrame([("d1", 1, "edit_and_approve", '{"a":1}', 2), ("d0", 1, "reject", None, 3), ("d2", 2, "reject", None, 1), ("d3", 3, "unknown", None, 1)],
                              "decision_id string, proposal_id int, action string, edited_payload string, created_at int")
    once = review.apply_decisions(p, d)
    got = {r["proposal_id"]: (r["status"], r["payload"], r["original_payload"]) for r in once.collect()}
    assert got == {1: ("approved", '{"a":1}', "{}"), 2: ("approved", "{}", None), 3: ("pending", "{}", None)}
    assert sorted(map(tuple, review.apply_decisions(once, d).collect())) == sorted(map(tuple, once.collect()))


def test_auto_approval_order(spark):
    rows = [(i, "o", "pending", 0.9, "relationship" if i < 3 else "task", i == 4) for i in range(6)]
    p = spark.createDataFrame(rows, "proposal_id int, owner_id string, status string, confidence double, proposal_type string, requires_review boolean")
    assert {r[0] for r in review.auto_approvable(p).select("proposal_id").collect()} == {3, 4, 5}
    assert {r[0] for r in review.auto_approvable(p, limit=2).select("proposal_id").collect()} == {3, 4}
    assert {r[0] for r in review.auto_approvable(p, limit=None, respect_review=True).select("proposal_id").collect()} == {3, 5}


def test_keyset_pages_skip_nothing(spark):
    p = spark.createDataFrame([(i, "o") for i in range(7)], "proposal_id int, owner_id string")
    first = [r[0] for r in review.proposal_queue(p, limit=3).select("proposal_id").collect()]
    second = [r[0] for r in review.proposal_queue(p, limit=3, cursor=first[-1]).select("proposal_id").collect()]
    assert (first, second) == ([0, 1, 2], [3, 4, 5])


def test_graph_edges_need_ends_and_types(spark):
    def ev(i, kind, **payload):
        return (str(i), kind, json.dumps(payload), i)

    events = spark.createDataFrame([
        ev(1, "entity.materialized", entity_id="e1", owner_id="o", entity_type="t", canonical_name="Old"), ev(2, "entity.materialized", entity_id="e1", owner_id="o", entity_type="t", canonical_name="New"),
        ev(3, "entity.materialized", entity_id="e2", owner_id="o", entity_type="t", canonical_name="E2"), ev(4, "relationship.materialized", relationship_id="r1", owner_id="o", source_entity_id="e1", target_entity_id="e2", relationship_type="part-of x"),
        ev(5, "relationship.materialized", relationship_id="r2", owner_id="o", source_entity_id="e1", target_entity_id="gone", relationship_type="x"), ev(6, "claim.materialized", claim_id="c1", owner_id="o", subject_entity_id="e1", predicate="p", object_value="v"),
        ev(7, "contradiction.detected", finding_id="f1", owner_id="o", existing_claim_id="c1", summary="s"), ev(8, "entity.merged", target_entity_id="e1")], "event_id string, event_type string, payload string, created_at int")
    nodes = graph.project_nodes(events)
    assert {(r["node_id"], r["label"]) for r in nodes.collect()} == {("e1", "New"), ("e2", "E2"), ("c1", "p"), ("f1", "s")}
    assert {(r["src"], r["edge_type"], r["dst"]) for r in graph.project_edges(events, nodes).collect()} == {("e1", "PART_OF_X", "e2"), ("e1", "HAS_CLAIM", "c1"), ("f1", "CONTRADICTS", "c1")}
    assert events.filter(~graph.valid_event(F.col("payload"), F.col("event_type"))).count() == 0


def test_expand_depth(spark):
    edges = spark.createDataFrame([(f"e{i}", str(i), str(i + 1), "X", "o") for i in range(6)] + [("loop", "0", "0", "X", "o")], "edge_id string, src string, dst string, edge_type string, owner_id string")
    roots = spark.createDataFrame([("0",), ("3",)], "root_id string")
    got = {(r["root_id"], r["node"]): r["distance"] for r in graph.expand(edges, roots, 3).collect()}
    assert {n for r, n in got if r == "0"} == {"0", "1", "2", "3"} and got[("3", "6")] == 3 and got[("3", "0")] == 3
    with pytest.raises(ValueError):
        graph.expand(edges, roots, 4)
    rng = random.Random(3)
    pairs = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(150)} | {(0, k) for k in range(30)})
    mesh = spark.createDataFrame([(f"{a}-{b}", f"{a:02}", f"{b:02}", "X", "o") for a, b in pairs], edges.schema)
    around = {f"{n:02}": {f"{x:02}" for p in pairs if n in p for x in p} for n in range(40)}
    for limit in (1, 7, 200):
        got = graph.expand(mesh, mesh.selectExpr("src root_id"), 3, limit).collect()
        found = {}
        for r in sorted(got, key=lambda r: r["rank"]):
            found.setdefault(r["root_id"], []).append((r["distance"], r["node"]))
        for root, nodes in found.items():
            reached = {root: 0}
            for hop in (1, 2, 3):
                for n in [n for n, d in reached.items() if d == hop - 1]:
                    for x in around[n]:
                        reached.setdefault(x, hop)
            assert nodes == sorted((d, n) for n, d in reached.items())[:limit]
    near = graph.neighborhood(edges, roots, 1).collect()
    assert {(r["root_id"], r["truncated"]) for r in near} == {("0", True), ("3", True)}


def test_ontology_proposal(spark):
    rows = [(i, "o", "entity", "pending", i, json.dumps({"entity_type": "project", "name": "Alpha"})) for i in range(3)]
    p = spark.createDataFrame(rows, "proposal_id int, owner_id string, proposal_type string, status string, created_at int, payload string")
    new = ontology.entity_type_proposals(ontology.unmapped_entities(p))
    row = new.first()
    assert new.count() == 1 and json.loads(row["proposed_definition"])["id"] == "project"
    assert json.loads(row["evidence"])["sample_proposal_ids"] == [2, 1, 0]
    assert ontology.without_pending(new, new).count() == 0


def test_evidence_has_one_shape_at_every_size(spark):
    p = spark.createDataFrame([("hot", 1), ("cold", 2), ("none", 3), (None, 4)], "proposal_id string, n int")
    e = spark.createDataFrame([("hot", f"e{i}") for i in range(1500)] + [("cold", "x"), ("cold", "y"), ("lost", "z")], "proposal_id string, evidence_id string")
    rows = [(r["proposal_id"], r["n"], r["evidence"] and r["evidence"]["evidence_id"]) for r in review.with_evidence(p, e).collect()]
    assert sorted(rows, key=str) == sorted([("hot", 1, f"e{i}") for i in range(1500)] + [("cold", 2, "x"), ("cold", 2, "y"), ("none", 3, None), (None, 4, None)], key=str)


def test_auto_approval_and_ontology_reach_rows_beyond_any_page(spark):
    rows = [(i, "o", "pending", 0.9, "relationship" if i < 300 else "task", False) for i in range(310)]
    p = spark.createDataFrame(rows, "proposal_id int, owner_id string, status string, confidence double, proposal_type string, requires_review boolean")
    assert review.auto_approvable(p).count() == 10
    assert review.proposal_queue(p, limit=250).count() == 250
    rows = [(i, "o", "entity", "pending", f'{{"entity_type":"{"technology" if i < 900 else "gadget"}","name":"n{i // 3}"}}', i) for i in range(903)]
    p = spark.createDataFrame(rows, "proposal_id int, owner_id string, proposal_type string, status string, payload string, created_at int")
    assert {r["entity_type"] for r in ontology.unmapped_entities(p, known=("technology",)).collect()} == {"gadget"}


def test_newest_first_pages_continue(spark):
    df = spark.createDataFrame([("o", "a", 1), ("o", "b", 2), ("o", "c", 3), ("o", "d", 2)], "owner_id string, claim_id string, created_at int")
    pages, cursor = [], None
    for _ in range(3):
        page = sorted(canonical.list_rows(df, "claim_id", 2, cursor=cursor, newest_first=True).collect(), key=lambda r: r["rank"])
        pages.append([r["claim_id"] for r in page])
        cursor = (page[-1]["created_at"], page[-1]["claim_id"]) if page else cursor
    assert pages == [["c", "d"], ["b", "a"], []]


def test_linked_entities_keep_their_facts(spark):
    payload = '{"local_id":"e1","name":"Postgres","entity_type":"technology"}'
    proposals = spark.createDataFrame(
        [(1, "o", "r", payload, "entity", "Postgres", 1, 99)], "proposal_id long, owner_id string, run_id string, payload string, "
        "proposal_type string, title string, created_at int, resolved_entity_id long")
    entities = spark.createDataFrame([(99, "o", "technology", "PostgreSQL")], "entity_id long, owner_id string, entity_type string, canonical_name string")
    rows = spark.createDataFrame([("o", "r", "e1"), ("o", "r", "other")], "owner_id string, run_id string, ref string")
    assert {r["ref"]: r["entity_id"] for r in canonical.resolve_refs(rows, "ref", proposals, entities).collect()} == {"e1": 99, "other": None}


def test_reports_count_all_claims_and_scope_before_the_cut(spark):
    claim = "claim_id int, owner_id int, subject_entity_id int, predicate string, object_value string, status string, created_at int"
    rows = [(i, 1, 2, "has_task", f"t{i}", "active", 100 + i) for i in range(60)] + [(900, 1, 1, "has_task", "old", "active", 1), (901, 1, None, "has_task", "all", "active", 2)]
    claims = spark.createDataFrame(rows, claim)
    entities = spark.createDataFrame([(1, 1, "project", "P1"), (2, 1, "project", "P2")], "entity_id int, owner_id int, entity_type string, canonical_name string")
    provenance = spark.createDataFrame([(900, 7, None), (901, 8, 9), (0, 5, 5)], "claim_id int, proposal_id int, chunk_id int")
    findings = spark.createDataFrame([(i, 1 if i < 30 else 3, f"f{i}", "open", i) for i in range(31)], "finding_id int, owner_id int, summary string, status string, created_at int")
    got = {r["project_name"]: r for r in reports.project_subgraphs(entities, entities, claims, provenance, findings).collect()}
    assert got["P1"]["tasks"] == ["all", "old"] and got["P1"]["tasks_total"] == 2 and got["P1"]["citations"] == ["chunk:9", "proposal:7", "proposal:8"]
    assert len(got["P2"]["tasks"]) == 50 and got["P2"]["tasks_total"] == 61 and got["P2"]["risks_total"] == 30 and len(got["P2"]["risks"]) == 20
    assert reports.status_report(entities, claims, provenance).first()["summary"].startswith("0 decisions, 62 tasks")
    sources = spark.createDataFrame([(i, 1, f"s{i}", i % 2 == 0) for i in range(60)], "source_id int, owner_id int, name string, enabled boolean")
    none = findings.filter("false")
    d = {r["owner_id"]: r for r in reports.dashboard(entities, claims, sources, findings, none, none, none.selectExpr("finding_id source_id", "created_at completed_at")).collect()}
    assert d[1]["sources_total"] == 60 and d[1]["sources_enabled"] == 30 and len(d[1]["source_names"]) == 50 and "62 open tasks" in d[1]["summary"]
    assert d[3]["open_contradictions"] == 1


def test_long_cue_lines_are_kept_whole(spark):
    line = "x" * 5000
    facts = extraction.extract_facts(spark.createDataFrame([("v", f"TODO: {line}")], "version_id string, text string"))
    p = extraction.build_proposals(facts).filter("proposal_type = 'task'").first()
    assert len(p["title"]) == 200 and line in p["payload"] and p["excerpt"] == line


def test_dictionary_join_equals_expression(spark):
    texts = ["Python, python and POSTGRESQL; Next.js with nextjs, Next-js, next.js!", "xPython Python3 Python", "", None, "FastAPI" * 3, "GitHub GitHub redis\nRedis Neo4j docker-compose", "ünîcode Celery\u00a0LangGraph é Docker"]
    docs = spark.createDataFrame(list(enumerate(texts)), "version_id long, text string")
    names = spark.createDataFrame([(n,) for n in extraction.TECHNOLOGIES], "name string")
    got = dictionary.dictionary_entities(docs, names)
    want = docs.filter("text is not null").select("version_id", F.posexplode(extraction.technology_entities(F.col("text"))).alias("i", "e"))
    assert sorted((r["version_id"], r["i"], r["name"], r["start"], r["end"]) for r in got.collect()) == sorted(
        (r["version_id"], r["i"], r["e"]["name"], r["e"]["start"], r["e"]["end"]) for r in want.collect())


def test_dictionary_of_many_overlapping_names(spark):
    rng = random.Random(2)
    names = {" ".join(rng.choices(["red", "blue", "big", "new", "old"] + [f"n{i}" for i in range(3000)], k=rng.randint(1, 4))) for _ in range(60_000)}
    names |= {"red", "red blue", "red blue big", "blue big new old", "big", "C++", "  ", "e-mail"}
    said = "Red blue big new old. red  blue BIG c++ x E-MAIL e mail " + " ".join(rng.choices(["red", "blue", "big", "n5", "n6"], k=400))
    docs = spark.createDataFrame([(1, said), (2, "big"), (3, "nothing here")], "version_id long, text string")
    got = dictionary.dictionary_entities(docs, spark.createDataFrame([(n,) for n in names], "name string"))
    low = sorted({re.sub(r"^\W+|\W+$", "", n.lower()) for n in names} - {""}, key=lambda n: (-len(n), n))
    expression = re.compile(r"\b(?:" + "|".join(map(re.escape, low)) + r")\b", re.I)
    want = []
    for d, t in ((1, said), (2, "big"), (3, "nothing here")):
        firsts = {}
        for m in expression.finditer(t):
            firsts.setdefault(m.group().lower(), m)
        want += [(d, m.group(), m.start(), m.end()) for m in firsts.values()]
    assert sorted((r["version_id"], r["name"], r["start"], r["end"]) for r in got.collect()) == sorted(want)
    assert dictionary.dictionary_entities(docs, spark.createDataFrame([], "name string")).count() == 0


def test_guarded_embedder_gives_up_row_by_row(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("down")
        return [[1.0, 0.0] for _ in texts]

    chunks = spark.createDataFrame([(i, "bad" if i % 10 == 3 else None if i == 5 else f"t{i}") for i in range(40)], "i int, text string").coalesce(1)
    rows = embedding.embed(chunks, 2, embedding.guarded(model), "model").collect()
    assert {r["i"] for r in rows if r["embedding_model"] != "model"} == {3, 5, 13, 23, 33}
    # Five failures in a row: the task stops asking, and its later rows are hashed.
    down = spark.createDataFrame([(i, "bad" if i < 8 else f"t{i}") for i in range(40)], "i int, text string").coalesce(1)
    rows = embedding.embed(down, 2, embedding.guarded(model), "model").collect()
    assert {r["embedding_model"] for r in rows} == {embedding.HASH_MODEL}


def test_fuzzy_matches_of_every_length_equal_brute_force(spark):
    rng = random.Random(5)
    words = ["al", "be", "ga", "delta", "eps", "zet", "eta", "theta"]
    base = [" ".join(rng.choices(words, k=k)) for k in (1, 1, 2, 3, 5, 9, 20, 60, 300)] + ["a", "ab", "x" * 2000]
    names = base + [b[rng.randint(0, len(b) // 4):][: max(1, int(len(b) * rng.uniform(0.4, 1)))].strip() or "q" for b in base for _ in range(3)]
    index = spark.createDataFrame([("o", "t", i, n, []) for i, n in enumerate(sorted(set(names[::2])))], "owner_id string, entity_type string, index_id int, canonical_name string, aliases array<string>")
    asked = spark.createDataFrame([("o", "t", n) for n in sorted(set(names))], "owner_id string, entity_type string, name string")
    got = resolution.find_matches(asked, index)
    a, b = F.col("q"), text.normalize_name(F.col("canonical_name"))
    pairs = asked.withColumn("q", text.normalize_name(F.col("name"))).crossJoin(index.select("index_id", "canonical_name"))
    scored = pairs.withColumn("score", text.normalized_similarity(a, b)).filter("score > 0.4")
    want = scored.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "canonical_name", "index_id"))).filter("rank <= 5")
    columns = ["name", "index_id", "rank"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_merges_move_claims_relationships_and_later_references(spark):
    entities = spark.createDataFrame([(i, "o", "t", n, [], "active") for i, n in (("a", "A"), ("b", "B"), ("c", "C"), ("d", "D"))],
                                     "entity_id string, owner_id string, entity_type string, canonical_name string, aliases array<string>, status string")
    final = canonical.merge_map(entities, spark.createDataFrame([("c", "b", 1, "1"), ("b", "a", 2, "2")], "source string, target string, created_at int, merge_id string"))
    claims = spark.createDataFrame([("1", "c"), ("2", "a"), ("3", None), ("4", "gone")], "claim_id string, subject_entity_id string")
    assert {r["claim_id"]: r["subject_entity_id"] for r in canonical.repoint_claims(claims, final).collect()} == {"1": "a", "2": "a", "3": None, "4": "gone"}
    rows = [("1", "o", "c", "d", "R", "active"), ("2", "o", "a", "d", "R", "active"), ("3", "o", "b", "c", "R", "active"), ("4", "o", "d", "d", "R", "active"), ("0", "o", "b", "d", "R", "deleted"), ("5", "o", "a", "d", "S", "active")]
    relations = spark.createDataFrame(rows, "relationship_id string, owner_id string, source_entity_id string, target_entity_id string, relationship_type string, status string")
    got = {r["relationship_id"]: (r["source_entity_id"], r["target_entity_id"], r["status"]) for r in canonical.repoint_relationships(relations, final).collect()}
    assert got == {"0": ("a", "d", "deleted"), "1": ("a", "d", "active"), "2": ("a", "d", "superseded"), "3": ("a", "a", "merged"), "4": ("d", "d", "active"), "5": ("a", "d", "active")}
    proposals = spark.createDataFrame([("p", "o", "r", 1, "C", json.dumps({"local_id": "x", "entity_type": "t", "name": "C"}))], "proposal_id string, owner_id string, run_id string, created_at int, title string, payload string")
    refs = spark.createDataFrame([("o", "r", "x")], "owner_id string, run_id string, ref string")
    assert canonical.resolve_refs(refs, "ref", proposals, entities).first()["entity_id"] == "c"
    assert canonical.resolve_refs(refs, "ref", proposals, entities, final).first()["entity_id"] == "a"


def test_dictionary_places_do_not_meet_the_texts_again(spark):
    """One join for the word that begins a name, one for the name: a frequent name copies no text."""
    text = "Äpfel, Redis!\U0001F600 redis  cluster;Redis Cluster redis cluster." + " der" * 500
    docs = spark.createDataFrame([("v", text), ("v", "der"), ("w", None), ("x", "")], "version_id string, text string")
    names = spark.createDataFrame([("Redis Cluster",), ("der",), ("äpfel",), ("redis",)], "name string")
    found = dictionary.dictionary_mentions(docs, names)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
    got = sorted((r["name"], r["spelled"], r["start"], r["end"]) for r in found.collect())
    want = [("der", "der", m.start(), m.end()) for t in (text, "der") for m in re.finditer(r"\bder\b", t)]
    for name in ("redis", "äpfel", "redis cluster"):
        want += [(name, m.group(), m.start(), m.end()) for m in re.finditer(rf"(?i)\b{name}\b", text)]
    assert got == sorted(want)


def test_provenance_that_claims_share_is_given_once_per_proposal(spark):
    claims = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", None)], "claim_id string, proposal_id long")
    shared = spark.createDataFrame([(1, 7, "x"), (1, 7, "y"), (3, 8, "z")], "proposal_id long, chunk_id long, evidence_id string")
    out = canonical.claims_with_provenance(claims, shared, "proposal_id")
    got = sorted((r["claim_id"], r["proposal_id"] or 0, r["provenance"] and tuple(r["provenance"])) for r in out.collect())
    assert got == [("a", 1, (7, "x")), ("a", 1, (7, "y")), ("b", 1, (7, "x")), ("b", 1, (7, "y")), ("c", 2, None), ("d", 0, None)]


def test_expansion_repeats_no_hop_and_sums_up_rings(spark, monkeypatch):
    pairs = [(i, (7 * i + 3) % 40) for i in range(40)] + [(0, i) for i in range(1, 30)]
    edges = spark.createDataFrame([(f"e{i}", "R", f"n{a:02}", f"n{b:02}") for i, (a, b) in enumerate(pairs)], "edge_id string, edge_type string, src string, dst string")
    roots = edges.select("src").distinct().withColumnRenamed("src", "root_id")
    monkeypatch.setattr(graph, "TASK_NODES", 40)  # more partitions than the session's
    out = graph.expand(edges, roots, 3, 15)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
    near = {}
    for a, b in pairs:
        near.setdefault(f"n{a:02}", set()).add(f"n{b:02}")
        near.setdefault(f"n{b:02}", set()).add(f"n{a:02}")
    want = []
    for root in sorted(near):
        got = [(0, root)]
        for hop in (1, 2, 3):
            new = {x for d, node in got if d == hop - 1 for x in near[node]} - {node for _, node in got}
            got += [(hop, x) for x in sorted(new)]
        want += [(root, node, d, i + 1) for i, (d, node) in enumerate(got[:15])]
    rows = sorted((r["root_id"], r["node"], r["distance"], r["rank"]) for r in out.collect())
    assert rows == sorted(want)
    rings = {(root, d): [n for r, n, e, _ in rows if (r, e) == (root, d)] for root, _, d, _ in rows}
    assert {(r["root_id"], r["distance"]): (r["nodes"], r["first_node"], r["last_node"]) for r in graph.rings(edges, roots, 3, 15).collect()} == {
        k: (len(v), min(v), max(v)) for k, v in rings.items()}
