import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from knowloom.operators import answers, approximate, question_plan, retrieval, search_index

CHUNKS = [("o1", "c1", "The graph database stores entities and claims"), ("o1", "c2", "graph graph graph of claims"), ("o2", "c3", "a graph with claims of another owner"), ("o1", "c4", "claims only")]


@pytest.fixture
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "owner_id string, chunk_id string, text string")


@pytest.fixture
def questions(spark):
    return spark.createDataFrame([("q1", "o1", "the Graph claims"), ("q2", "o2", "graph claims"), ("q3", "o1", "missing graph"), ("q4", "o1", "of the")], "query_id string, owner_id string, question string")


def test_keyword_needs_all_terms_and_stays_with_owner(chunks, questions, monkeypatch):
    def hits():
        return {(r["query_id"], r["chunk_id"]): r["score"] for r in retrieval.keyword_search(chunks, questions).collect()}

    found = hits()
    assert set(found) == {("q1", "c1"), ("q1", "c2"), ("q2", "c3")}
    assert found[("q1", "c2")] > found[("q1", "c1")] and all(0 <= s < 1 for s in found.values())
    monkeypatch.setattr(retrieval, "QUESTION_BOUND", 0)
    monkeypatch.setattr(retrieval, "TERM_BOUND", 0)
    assert hits() == found


@pytest.mark.parametrize("block", [4096, 2])
def test_semantic_equals_numpy(spark, block):
    rng = np.random.default_rng(1)
    vecs, owners = rng.normal(size=(40, 6)), ["o1" if i % 3 else "o2" for i in range(40)]
    chunks = spark.createDataFrame([(owners[i], i, [float(x) for x in vecs[i]]) for i in range(40)] + [("o1", 99, None)], "owner_id string, chunk_id int, embedding array<double>")
    qs = rng.normal(size=(7, 6))
    asked = spark.createDataFrame([(f"q{i}", "o1" if i % 2 else "o2", [float(x) for x in qs[i]]) for i in range(7)], "query_id string, owner_id string, vector array<double>")
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in retrieval.semantic_search(chunks, asked, 5, block).collect()}
    for q in range(7):
        owner = "o1" if q % 2 else "o2"
        scores = sorted((-round(float(vecs[i] @ qs[q] / np.linalg.norm(vecs[i]) / np.linalg.norm(qs[q])), 6), i) for i in range(40) if owners[i] == owner)[:5]
        for rank, (s, i) in enumerate(scores, 1):
            assert got[(f"q{q}", rank)] == (i, -s)


def test_no_questions(spark, chunks, questions):
    e = chunks.withColumn("embedding", F.array(F.lit(1.0)))
    assert retrieval.semantic_search(e, questions.filter("false").withColumn("vector", F.array(F.lit(1.0)))).count() == 0
    assert retrieval.keyword_search(chunks, questions.filter("false")).count() == 0


def test_hybrid_prefers_keyword_on_ties(spark):
    hit = "query_id string, chunk_id string, score double, match_type string"
    k = spark.createDataFrame([("q", "a", 0.5, "keyword"), ("q", "b", 0.2, "keyword")], hit)
    s = spark.createDataFrame([("q", "a", 0.5, "semantic"), ("q", "b", 0.9, "semantic"), ("q", "c", 0.1, "semantic")], hit)
    rows = retrieval.merge_hits(k, s, 2).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"], r["signal"], r["match_type"]) for r in rows] == [("b", 0.9, "semantic", "hybrid"), ("a", 0.5, "keyword", "hybrid")]


def test_substring_search_is_literal(spark):
    e = spark.createDataFrame([("o", "1", "100% Alpha", ["Beta_x"]), ("o", "2", "Alphabet", []), ("p", "3", "Alpha", []), ("o", "4", "1000 alpha", None)], "owner_id string, entity_id string, canonical_name string, aliases array<string>")
    q = spark.createDataFrame([("q1", "o", "ALPHA"), ("q2", "o", "0% a"), ("q3", "o", "ta_X"), ("q4", "o", "%")], "query_id string, owner_id string, question string")
    got = {(r["query_id"], r["entity_id"]) for r in retrieval.entity_search(e, q).collect()}
    assert got == {("q1", "1"), ("q1", "2"), ("q1", "4"), ("q2", "1"), ("q3", "1"), ("q4", "1")}


def _citations(spark, rows):
    return spark.createDataFrame(rows, "query_id string, rank int, citation_id string, excerpt string, score double, signal string")


def test_answers(spark):
    q = spark.createDataFrame([("q", "What?"), ("none", "Else?")], "query_id string, question string")
    c = _citations(spark, [("q", 1, "claim-1", "uses_technology: MySQL", 0.9, "canonical"), ("q", 2, "claim-2", "uses_technology: PostgreSQL", 0.8, "canonical"), ("q", 3, "chunk-1", "a: b", 0.1, "keyword"), ("q", 4, "claim-3", "other: x: y", 0.1, "canonical")])
    got = {r["query_id"]: r for r in answers.answer(q, c).collect()}
    a = got["q"]
    assert a["answer"].startswith("Based on 4 retrieved evidence item(s):\n\n- uses_technology: MySQL\n\n- ") and a["confidence"] == 0.9
    assert len(a["claims"]) == 3 and a["warnings"] == [] and len(a["conflicts"]) == 1
    assert "MySQL vs PostgreSQL" in a["conflicts"][0]
    assert got["none"]["answer"] == answers.NO_EVIDENCE and got["none"]["insufficient_evidence"] and got["none"]["confidence"] == 0.0


def test_citation_guard(spark):
    schema = "query_id string, claims array<struct<text:string,confidence:double,citation_ids:array<string>>>"
    drafts = spark.createDataFrame([("q", [("ok", 1.0, ["chunk-real", "chunk-invented"]), ("gone", 1.0, ["missing-id"]), (" ", 1.0, ["missing-id"])])], schema)
    allowed = spark.createDataFrame([("q", ["chunk-real"])], "query_id string, allowed_ids array<string>")
    r = answers.validate_citations(drafts, allowed).first()
    assert [(x["text"], x["citation_ids"]) for x in r["claims"]] == [("ok", ["chunk-real"])]
    assert r["warnings"] == [answers.INVALID_IDS + "chunk-invented", answers.INVALID_IDS + "missing-id", answers.UNSUPPORTED + "gone", answers.INVALID_IDS + "missing-id"]


def test_golden_scores(spark):
    a = spark.createDataFrame([("g", "Uses PostgreSQL here", 1)], "query_id string, answer string, citation_count int")
    g = spark.createDataFrame([("g", ["technology", "postgresql"], 1), ("h", ["task"], 0)], "query_id string, expected_signals array<string>, min_citations int")
    got = {r["query_id"]: (r["signals_found"], r["any_signal"], r["enough_citations"]) for r in answers.score_golden(a, g).collect()}
    assert got == {"g": (1, True, True), "h": (0, False, True)}


def test_embedder_falls_back_per_row(spark, chunks):
    from knowloom.operators import embedding

    def broken(text):
        return F.when(F.contains(text, F.lit("only")), F.lit(None)).otherwise(F.array(*[F.lit(0.5)] * 4)).cast("array<double>")

    rows = {r["chunk_id"]: r for r in embedding.embed(chunks, 4, broken, "mine").collect()}
    assert rows["c1"]["embedding_model"] == "mine" and rows["c1"]["embedding"] == [0.5] * 4
    plain = {r["chunk_id"]: r["embedding"] for r in embedding.embed(chunks, 4).collect()}
    assert rows["c4"]["embedding_model"] == embedding.HASH_MODEL and rows["c4"]["embedding"] == plain["c4"]


def test_semantic_search_with_two_models(spark):
    chunks = spark.createDataFrame(
        [(1, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0, 0.0, 0.0]), (1, "c", [0.6, 0.8]), (1, "d", [0.0, 0.6, 0.8, 0.0]), (1, "e", [None, 1.0])],
        "owner_id int, chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [0.0, 1.0, 0.0, 0.0])], "query_id int, owner_id int, vector array<double>")
    got = {(r["query_id"], r["chunk_id"]): round(r["score"], 6) for r in retrieval.semantic_search(chunks, asked).collect()}
    assert got == {(1, "a"): 1.0, (1, "c"): 0.6, (2, "b"): 1.0, (2, "d"): 0.6}


CHUNK = "owner_id string, chunk_id string, text string"


def _corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    return [(rng.choice("ab"), f"{rng.random():.12f}", " ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(40)], k=rng.randint(0, 30)))) for _ in range(n)] + [
        ("a", f"same{i:03d}", "w39 w38 w37") for i in range(60)] + [("b", "null", None), (None, "nobody", "w1 w2"), ("a", "empty", "")]


@pytest.mark.parametrize("block, limit, probes", [(4096, 5, 8), (16, 5, 1), (16, 3, 2), (7, 100, 3)])
def test_stored_index_equals_exhaustive_search(spark, tmp_path, monkeypatch, block, limit, probes):
    monkeypatch.setattr(search_index, "BLOCK", block)
    rows = _corpus(block, 400)
    chunks = spark.createDataFrame(rows, CHUNK).repartition(3)
    asked = [(f"q{i}", o, q) for i, (o, q) in enumerate([("a", "w0"), ("a", "w39 w38"), ("a", "w0 w1 w2"), ("b", "w5 the w0"), ("b", "w39"), ("a", "nowhere"), ("b", "the of"), ("b", "w1 w1"), ("c", "w1"), ("a", "w37 w39 w38")])]
    questions = spark.createDataFrame(asked, "query_id string, owner_id string, question string")
    folder = str(tmp_path / "index")
    search_index.write_index(chunks, folder)
    got = search_index.keyword_search(spark, folder, questions, limit, probes=probes)
    want = retrieval.keyword_search(chunks, questions, limit)
    columns = ["query_id", "rank", "chunk_id", "score"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    # Beyond the broadcast bound the same rows come from shuffle joins.
    monkeypatch.setattr(search_index, "TERM_BOUND", 1)
    got = search_index.keyword_search(spark, folder, questions, limit, probes=probes)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_index_skips_blocks_and_takes_an_empty_corpus(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "BLOCK", 8)
    opened = []
    score = search_index._score
    monkeypatch.setattr(search_index, "_score", lambda limit: opened.append(limit) or score(limit))
    rows = [("a", f"{i:04d}", "rare common" if i < 4 else "common " + "filler " * 20) for i in range(400)]
    chunks = spark.createDataFrame(rows, CHUNK).coalesce(1)
    search_index.write_index(chunks, str(tmp_path / "i"))
    asked = spark.createDataFrame([("q", "a", "common")], "query_id string, owner_id string, question string")
    got = search_index.keyword_search(spark, str(tmp_path / "i"), asked, 4, probes=1).collect()
    # The short chunks of the first block have the best scores; the bounds of the other blocks stay below them.
    assert sorted(r["chunk_id"] for r in got) == ["0000", "0001", "0002", "0003"] and len(opened) == 1
    search_index.write_index(chunks.limit(0), str(tmp_path / "none"))
    assert search_index.keyword_search(spark, str(tmp_path / "none"), asked).count() == 0


def test_question_plan_joins_all_signals(spark, tmp_path):
    chunks = spark.createDataFrame([("o", "c1", "Python runs the loom", [1.0, 0.0]), ("o", "c2", "nothing", [0.0, 1.0])], CHUNK + ", embedding array<double>")
    search_index.write_index(chunks, str(tmp_path / "i"))
    entities = spark.createDataFrame([("e1", "o", "Python", ["Py"])], "entity_id string, owner_id string, canonical_name string, aliases array<string>")
    claims = spark.createDataFrame([("k1", "o", "e1", "uses", "python 3", 0.4, "active"), ("k2", "o", "e1", "uses", "python 2", 0.3, "active")],
                                   "claim_id string, owner_id string, subject_entity_id string, predicate string, object_value string, confidence double, status string")
    nodes = spark.createDataFrame([("e1", "entity", "Python"), ("e2", "entity", "Loom"), ("k1", "claim", "uses")], "node_id string, node_type string, label string")
    edges = spark.createDataFrame([("x", "T", "e1", "e2"), ("y", "HAS_CLAIM", "e1", "k1")], "edge_id string, edge_type string, src string, dst string")
    asked = spark.createDataFrame([("q1", "o", "python", [1.0, 0.1]), ("q2", "o", "unheard of", None)], "query_id string, owner_id string, question string, vector array<double>")
    plan = question_plan.run(spark, str(tmp_path / "i"), entities, claims, nodes, edges, asked)
    steps = {(r["query_id"], r["signal"]): r["result_count"] for r in plan.steps.collect()}
    assert steps == {("q1", "keyword"): 2, ("q1", "graph"): 1, ("q1", "canonical"): 2, ("q2", "keyword"): 0, ("q2", "graph"): 0, ("q2", "canonical"): 0}
    cited = {r["citation_id"]: r["excerpt"] for r in plan.citations.collect()}
    assert set(cited) == {"chunk-c1", "chunk-c2", "graph-e1", "graph-e2", "claim-k1", "claim-k2"} and cited["graph-e2"] == "Graph entity: Loom"
    answers_ = {r["query_id"]: r for r in plan.answers.collect()}
    assert answers_["q2"]["answer"] == answers.NO_EVIDENCE and answers_["q2"]["confidence"] == 0.0 and answers_["q2"]["insufficient_evidence"]
    assert not answers_["q1"]["insufficient_evidence"] and answers_["q1"]["conflicts"] == ["Ellentmondó bizonyíték a(z) 'uses' predikátumra: python 2 vs python 3"]
    assert {r["object_id"] for r in plan.audit.collect()} == {"q1", "q2"} and plan.related.first()["related_entity_ids"] == ["e1"]


def test_approximate_search_recall_and_blocks(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 24))
    vectors = [(centres[i % 30] + 0.6 * rng.standard_normal(24)).tolist() for i in range(6000)]
    rows = [("o" if i % 2 else "p", i, v) for i, v in enumerate(vectors)] + [("o", 7000 + i, vectors[1]) for i in range(50)] + [("o", 8000, None), ("o", 8001, [1.0, 2.0]), ("o", 8002, [None] * 24)]
    chunks = spark.createDataFrame(rows, "owner_id string, chunk_id long, embedding array<double>").repartition(4)
    asked = spark.createDataFrame([(f"q{i}", "o", vectors[i]) for i in range(1, 400, 4)] + [("other", "o", [2.0, 1.0]), ("none", "o", None)], "query_id string, owner_id string, vector array<double>")
    exact = retrieval.semantic_search(chunks, asked)
    for blocks in ({}, {"query_block": 10, "chunk_block": 40}):
        found = approximate.approximate_search(chunks, asked, **blocks).cache()
        recalls = approximate.recall(found, exact)
        assert recalls.agg({"recall": "avg"}).first()[0] >= 0.9 and recalls.count() == exact.select("query_id").distinct().count()
    columns = ["query_id", "chunk_id", "score", "rank"]
    whole = approximate.approximate_search(chunks, asked, share=1.0)
    assert sorted(map(tuple, whole.select(*columns).collect())) == sorted(map(tuple, exact.select(*columns).collect()))


def test_substring_search_of_long_values(spark):
    long = "".join(random.Random(1).choices("abc é", k=100_000))
    claims = spark.createDataFrame([("k1", "o", None, "p", long, 0.5, "active"), ("k2", "o", None, "p", "漢字 and é", 0.4, "active"), ("k3", "o", None, "p", None, 0.4, "active"), ("k4", "x", None, "p", long, 0.4, "active")],
                                   "claim_id string, owner_id string, subject_entity_id string, predicate string, object_value string, confidence double, status string")
    questions = [("head", long[:300]), ("tail", long[-9:].upper()), ("letter", "É"), ("two", "漢字"), ("whole", long), ("percent", "%"), ("empty", ""), ("gone", long[:40] + "#"), ("p", "P")]
    asked = spark.createDataFrame([(q, "o", x) for q, x in questions], "query_id string, owner_id string, question string")
    texts = {"k1": ["p", long], "k2": ["p", "漢字 and é"], "k3": ["p"]}
    want = {(q, k) for q, x in questions if x for k, ts in texts.items() if any(x.lower() in t.lower() for t in ts)}
    assert {(r["query_id"], r["claim_id"]) for r in retrieval.claim_search(claims, asked).collect()} == want


def test_question_plan_makes_each_question_vector_once(spark, tmp_path):
    chunks = spark.createDataFrame([("o", "c1", "Python runs the loom", [1.0, 0.0])], CHUNK + ", embedding array<double>")
    search_index.write_index(chunks, str(tmp_path / "i"))
    entities = spark.createDataFrame([("e1", "o", "Python", ["Py"])], "entity_id string, owner_id string, canonical_name string, aliases array<string>")
    claims = spark.createDataFrame([], "claim_id string, owner_id string, subject_entity_id string, predicate string, object_value string, confidence double, status string")
    nodes = spark.createDataFrame([("e1", "entity", "Python")], "node_id string, node_type string, label string")
    edges = spark.createDataFrame([], "edge_id string, edge_type string, src string, dst string")
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def vector(text):
        made.add(1)
        return [1.0, 0.0]

    asked = spark.createDataFrame([(f"q{i}", "o", f"python {i}") for i in range(20)], "query_id string, owner_id string, question string").withColumn("vector", vector("question"))
    plan = question_plan.run(spark, str(tmp_path / "i"), entities, claims, nodes, edges, asked)
    assert plan.answers.count() == 20 and made.value == 20


def test_keyword_search_tokenises_its_chunks_once(spark):
    chunks = spark.createDataFrame([("o", "a", "redis cluster redis"), ("o", "b", "redis"), ("p", "c", None)], "owner_id string, chunk_id string, text string")
    asked = spark.createDataFrame([("q", "o", "Redis"), ("r", "o", "cluster redis"), ("s", "p", "redis")], "query_id string, owner_id string, question string")
    found = retrieval.keyword_search(chunks, asked)
    assert "lower(text" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["query_id"], r["chunk_id"]) for r in found.collect()) == [("q", "a"), ("q", "b"), ("r", "a")]


def test_rows_of_equal_texts_are_searched_once(spark, monkeypatch):
    seen = {}

    def kept(df, name, write=retrieval.materialize):
        seen[name] = write(df, name)
        return seen[name]

    monkeypatch.setattr(retrieval, "materialize", kept)
    rows = [(i, "a" if i % 2 else "b", ["Blue Ring", "RING"] if i % 3 else ["green bolt", None]) for i in range(600)]
    table = spark.createDataFrame(rows, "id int, owner_id string, names array<string>")
    asked = spark.createDataFrame([("q1", "a", "ring"), ("q2", "b", "n bo"), ("q3", "a", "nothing"), ("q4", "a", "blue ring"), ("q5", None, "ring")], "query_id string, owner_id string, question string")
    got = retrieval.substring_matches(table.union(spark.createDataFrame([(900, None, ["ring"])], table.schema)), F.col("names"), asked)
    want = {(q, i) for q, o, w in asked.collect() for i, p, names in rows if o == p and any(w in n.lower() for n in names if n)}
    assert got.columns == ["query_id", "id", "owner_id", "names"]
    assert sorted((r["query_id"], r["id"]) for r in got.collect()) == sorted(want)
    assert seen["search-units"].count() == 4
