import math
import random
import re

import pytest
from pyspark.sql import functions as F

from knowloom.functions import jsonx, text
from knowloom.functions.vectors import hash_embedding, hash_embedding_sql
from knowloom.operators import chunking

ALPHABET = ["a", "b", "Z", " ", " ", "\n", "\n\n", "é", "😀", "# ", "\n## ", "word ", "\t"]


def random_text(rng, pieces):
    return "".join(rng.choice(ALPHABET) for _ in range(pieces))


def windows(text_, size, overlap):
    """Independent statement of the rule: cut points first, then trimmed pieces."""
    if not text_.strip():
        return []
    out, at = [], 0
    while True:
        stop = at + size
        if stop >= len(text_):
            stop = len(text_)
        else:
            cut = text_[at:stop].rfind("\n\n")
            stop = at + cut if cut > size // 2 else stop
        if text_[at:stop].strip():
            out.append((text_[at:stop].strip(), at, stop))
        if stop == len(text_):
            return out
        at = max(stop - overlap, at + 1)


def got(rows):
    return {r["id"]: [(s["text"], s["start"], s["end"]) for s in r["s"]] for r in rows}


def test_chunks_equal_brute_force(spark):
    rng = random.Random(7)
    texts = [random_text(rng, rng.randint(0, 900)) for _ in range(120)] + ["", " \n ", "x" * 800, "y" * 801]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    found = got(df.select("id", chunking.segments(F.col("t"), size=100, overlap=10).alias("s")).collect())
    assert found == {i: windows(t, 100, 10) for i, t in enumerate(texts)}
    plain = [t.replace("\n\n", "\n") for t in texts]
    plain = [re.sub("\n+", "\n", t) for t in plain]
    df = spark.createDataFrame(list(enumerate(plain)), "id int, t string")
    fixed = got(df.select("id", chunking.fixed_segments(F.col("t"), 100, 10).alias("s")).collect())
    assert fixed == {i: windows(t, 100, 10) for i, t in enumerate(plain)}


def test_markdown_sections(spark):
    rng = random.Random(3)
    texts = [random_text(rng, rng.randint(1, 400)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    found = got(df.select("id", chunking.segments(F.col("t"), F.lit(True), 100, 10).alias("s")).collect())
    for i, t in enumerate(texts):
        heads = [m.start() for m in re.finditer(r"^#{1,3}\s", t, re.M)]
        edges = sorted({0, *heads, len(t)})
        want = [(x, lo + a, lo + b) for lo, hi in zip(edges, edges[1:]) for x, a, b in windows(t[lo:hi], 100, 10)]
        assert found[i] == want


def test_paragraph_example(spark):
    body = "Paragraph one.\n\n" + "word " * 200
    df = spark.createDataFrame([(1, body)], "version_id int, text string")
    rows = chunking.chunk_documents(df, size=100, overlap=10).orderBy("chunk_index").collect()
    assert len(rows) >= 2 and all(r["text"] for r in rows)
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))


def test_names_and_tokens(spark):
    pairs = [("PostgreSQL", "postgresql", 1.0), ("Graph Index", "Large Graph Index", 11 / 17), ("a b c", "b c d", 2 / 3),
             ("x", "y", 0.0), ("", "", 1.0), ("  A   b ", "a b", 1.0)]
    df = spark.createDataFrame(pairs, "l string, r string, want double")
    for r in df.select("want", text.name_similarity(F.col("l"), F.col("r")).alias("s")).collect():
        assert math.isclose(r["s"], r["want"])
    row = spark.range(1).select(
        text.token_count(F.lit("hello world")).alias("two"), text.token_count(F.lit("  ")).alias("one"),
        text.dedupe_names(F.array(F.lit("PostgreSQL"), F.lit("postgresql"), F.lit(" "), F.lit("Postgres "))).alias("names"),
        text.query_tokens(F.lit("What is the Graph?")).alias("q"),
    ).first()
    assert (row["two"], row["one"]) == (2, 1)
    assert row["names"] == ["PostgreSQL", "Postgres"]
    assert row["q"] == ["what", "the", "graph"]


def test_spans_match_python(spark):
    rng = random.Random(5)
    words = ["Anna Bell", "é", " ", "Bob Fox", "x", "\n", "Kim Éa", "Joe Ray", "😀"]
    texts = ["".join(rng.choice(words) for _ in range(30)) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    pattern = r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"
    for r in df.select("t", text.find_spans(F.col("t"), "(?U)" + pattern).alias("s")).collect():
        want = [(m.group(0), m.start(), m.end()) for m in re.finditer(pattern, r["t"])]
        assert [(s["match"], s["start"], s["end"]) for s in r["s"]] == want


def test_json_merge_keeps_types(spark):
    row = spark.range(1).select(
        jsonx.merge(F.lit('{"a":1,"b":{"c":2}}'), F.lit('{"b":"x","d":true}')).alias("m"),
        jsonx.merge(F.lit(None).cast("string"), F.lit('{"d":true}')).alias("n"),
        jsonx.has_key(F.lit('{"a":null}'), "a").alias("k"), jsonx.has_key(F.lit('{"a":null}'), "b").alias("no"),
    ).first()
    assert row["m"] == '{"a":1,"b":"x","d":true}' and row["n"] == '{"d":true}'
    assert row["k"] and not row["no"]


@pytest.mark.parametrize("dimension", [8, 20, 64])
def test_hash_embedding_forms_agree(spark, dimension):
    df = spark.createDataFrame([("hello",), ("",), ("árvíz 😀",), (None,)], "t string")
    rows = df.select(hash_embedding(dimension)(F.col("t")).alias("a"), hash_embedding_sql(F.col("t"), dimension).alias("b"), "t").collect()
    for r in rows:
        if r["t"] is None:
            assert r["a"] is None
            continue
        assert len(r["a"]) == dimension and math.isclose(sum(x * x for x in r["a"]), 1.0)
        assert all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(r["a"], r["b"], strict=True))


def test_spans_and_totals_of_many_matches(spark):
    many = spark.createDataFrame([("Ab Cd, " * 20000,), ("",), (None,)], "t string").select(text.find_spans(F.col("t"), "Ab Cd").alias("s"))
    sizes = [(len(r["s"]), r["s"][-1]["start"], r["s"][-1]["end"]) if r["s"] else r["s"] for r in many.collect()]
    assert sizes == [(20000, 139993, 139998), [], None] or sizes == [(20000, 139993, 139998), [], []]
    for n in (0, 1, 2, 3, 10, 101):
        got = spark.range(1).select(text.running_totals(F.expr(f"slice(sequence(1, 200), 1, {n})")).alias("x")).first()["x"]
        assert got == [i * (i + 1) // 2 for i in range(1, n + 1)]


def test_first_positions(spark):
    keys = spark.createDataFrame([(["b", "a", "b", None, "a", None, "c"],), ([],)], "k array<string>")
    assert [r["x"] for r in keys.select(text.first_positions(F.col("k")).alias("x")).collect()] == [[0, 1, 3, 6], []]


def test_hash_embedding_sends_digests_to_python(spark):
    texts = spark.createDataFrame([(1, ""), (2, "été"), (3, None), (4, "long " * 5000)], "id int, t string")
    rows = texts.select("id", hash_embedding(32)(F.col("t")).alias("a"), hash_embedding_sql(F.col("t"), 32).alias("b"))
    for r in rows.collect():
        assert r["a"] is None if r["id"] == 3 else max(abs(x - y) for x, y in zip(r["a"], r["b"], strict=True)) < 1e-12
    plan = rows.select("a")._jdf.queryExecution().optimizedPlan().toString()
    assert "embed(unhex(sha2(" in plan


def test_terms_look_stop_words_up_in_a_set(spark):
    """Words are not compared with each stop word in turn; without stop words all stay."""
    from knowloom.operators.retrieval import terms

    df = spark.createDataFrame([("The Ärger, of a the REDIS_9  x!",), ("",), (None,)], "t string")
    out = df.select(terms(F.col("t")).alias("some"), terms(F.col("t"), ()).alias("all"))
    assert "array_contains" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["some"], r["all"]) for r in out.collect()] == [
        (["ärger", "redis_9", "x"], ["the", "ärger", "of", "a", "the", "redis_9", "x"]), ([], []), (None, None)]
