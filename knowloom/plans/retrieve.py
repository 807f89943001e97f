"""Queries for retrieval and cited answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowloom.functions.layout import spread
from knowloom.functions.text import query_tokens
from knowloom.functions.vectors import hash_embedding, hash_embedding_sql
from knowloom.operators import answers, approximate, chunking, question_plan, retrieval, search_index
from knowloom.plans.registry import query
from knowloom.plans.sql import CHUNKS
from knowloom.plans.tables import Tables, joined
from knowloom.sources.sinks import materialize, work_folder

_STOP = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)


def _terms(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}]+'), lambda w: w <> '' AND w NOT IN ({_STOP}))"


_BENCHMARK_ASK = f"""ask AS (SELECT lang || '-' || item_id AS query_id, lang AS owner_id, text AS question, list_distinct({_terms("text")}) AS terms FROM benchmark, (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL))"""


def _keyword_sql(ask: str) -> str:
    return f"""{CHUNKS},
tok AS (SELECT sha256('chunk|' || version_id || '|' || chunk_index) AS chunk_id, owner_id, text, {_terms("text")} AS tokens FROM chunks),
corpus AS (SELECT owner_id, count(*) AS n, avg(len(tokens)) AS avg_len FROM tok GROUP BY 1),
{ask},
df AS (SELECT owner_id, term, count(*) AS df FROM (SELECT owner_id, unnest(list_distinct(tokens)) AS term FROM tok) WHERE term IN (SELECT unnest(terms) FROM ask) GROUP BY 1, 2),
met AS (SELECT query_id, chunk_id, a.owner_id, tokens, unnest(terms) AS term FROM ask a JOIN tok t ON t.owner_id = a.owner_id AND len(terms) > 0 AND list_has_all(tokens, terms)),
part_s AS (SELECT query_id, chunk_id, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, len(list_filter(tokens, lambda x: x = m.term)) AS tf, len(tokens) / avg_len AS rel
  FROM met m JOIN df USING (owner_id, term) JOIN corpus USING (owner_id)),
raw_s AS (SELECT query_id, chunk_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * rel))) AS s FROM part_s GROUP BY 1, 2),
keyword AS (SELECT query_id, chunk_id, round(s / (s + 1), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s / (s + 1), 6) DESC, chunk_id)::INT AS rank FROM raw_s)"""


_KEYWORD = _keyword_sql(_BENCHMARK_ASK)


def _chunks(t: Tables) -> DataFrame:
    return chunking.chunk_documents(t.documents())


def _index(t: Tables, chunks: DataFrame) -> str:
    folder = work_folder(t.spark, "index")
    search_index.write_index(chunks, folder)
    return folder


@query(f"WITH {_KEYWORD} SELECT query_id, chunk_id, score, rank FROM keyword WHERE rank <= 20")
def keyword_search(t: Tables) -> DataFrame:
    return retrieval.keyword_search(_chunks(t), t.questions()).drop("match_type")


@query(f"WITH {_KEYWORD} SELECT query_id, chunk_id, score, rank FROM keyword WHERE rank <= 20")
def indexed_keyword_search(t: Tables) -> DataFrame:
    """The corpus is tokenised once into a stored index; questions open the postings of their own terms."""
    return search_index.keyword_search(t.spark, _index(t, _chunks(t)), t.questions()).drop("match_type")


_WORD_ASK = f"""ask AS (SELECT DISTINCT lang || '/' || w AS query_id, lang AS owner_id, w AS question, list_distinct({_terms("w")}) AS terms FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark), (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL))"""


@query(f"WITH {_keyword_sql(_WORD_ASK)} SELECT query_id, chunk_id, score, rank FROM keyword WHERE rank <= 10")
def indexed_word_search(t: Tables) -> DataFrame:
    """Every word of the benchmark as a question: most blocks of frequent words cannot enter the list and stay closed."""
    words = t.questions().select("owner_id", F.explode(F.split("question", " ")).alias("question")).distinct()
    asked = words.select(F.concat_ws("/", "owner_id", "question").alias("query_id"), "owner_id", "question")
    return search_index.keyword_search(t.spark, _index(t, _chunks(t)), asked, 10, probes=1).drop("match_type")


@query("""WITH c AS (SELECT label, i, avg(x::DOUBLE) AS a FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
q AS (SELECT label AS query_id, list(a ORDER BY i) AS vec FROM c GROUP BY 1),
s AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(vec, embedding::DOUBLE[]), 6) AS score FROM q, embeddings)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s) WHERE rank <= 20""")
def semantic_search(t: Tables) -> DataFrame:
    """One question per label: its mean vector."""
    chunks, asked = _vectors(t)
    return retrieval.semantic_search(chunks, asked).drop("match_type")


@query("""WITH c AS (SELECT label, i, avg(x::DOUBLE) AS a FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
q AS (SELECT label AS query_id, list(a ORDER BY i) AS vec FROM c GROUP BY 1),
s AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(vec, embedding::DOUBLE[]), 6) AS score FROM q, embeddings WHERE label = query_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s) WHERE rank <= 10""")
def owned_semantic_search(t: Tables) -> DataFrame:
    """Every label owns its vectors and searches only them; uses the block grid for large question tables."""
    chunks, asked = _vectors(t)
    chunks = chunks.drop("owner_id").withColumnRenamed("label", "owner_id")
    asked = asked.withColumn("owner_id", F.col("query_id"))
    return retrieval.semantic_search(chunks, asked, limit=10, query_block=4).drop("match_type")


@query()
def approximate_search(t: Tables) -> DataFrame:
    """Every twentieth vector as a question, without the blocks of the exact search; tests measure its recall against that."""
    e = t.raw("embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit(1).alias("owner_id"), "embedding")
    asked = e.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "owner_id", F.col("embedding").alias("vector"))
    return approximate.approximate_search(e, asked).drop("match_type")


def _vectors(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = t.raw("embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("a"))
    vec = mean.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "a"))).alias("v"))
    asked = vec.select(F.col("label").alias("query_id"), F.lit(1).alias("owner_id"), F.transform("v", lambda x: x["a"]).alias("vector"))
    return e.select(F.col("vec_id").alias("chunk_id"), F.lit(1).alias("owner_id"), "label", "embedding"), asked


def _words(x: str) -> str:
    nibble = f"(strpos('0123456789abcdef', substring(sha256({x}), i * 8 + j + 1, 1)) - 1) * pow(16, 7 - j)"
    return f"list_transform(range(8), lambda i: list_sum(list_transform(range(8), lambda j: {nibble})) / 4294967296.0 * 2 - 1)"


_MERGED = f"""
vt AS (SELECT chunk_id, owner_id, {_words("text")} AS v FROM tok), vq AS (SELECT query_id, owner_id, {_words("question")} AS v FROM ask),
sem_s AS (SELECT query_id, chunk_id, round(list_cosine_similarity(q.v, t.v), 6) AS score FROM vq q JOIN vt t USING (owner_id)),
semantic AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sem_s),
both_s AS (SELECT query_id, chunk_id, score, 1 AS k FROM keyword WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, score, 0 FROM semantic WHERE rank <= 20),
merged AS (SELECT query_id, chunk_id, max((score, k)) AS b FROM both_s GROUP BY 1, 2),
hybrid AS (SELECT query_id, chunk_id, struct_extract_at(b, 1) AS score, CASE WHEN struct_extract_at(b, 2) = 1 THEN 'keyword' ELSE 'semantic' END AS signal,
  row_number() OVER (PARTITION BY query_id ORDER BY struct_extract_at(b, 1) DESC, chunk_id)::INT AS rank FROM merged)"""
_HYBRID = f"{_KEYWORD},{_MERGED}"


@query(f"WITH {_HYBRID} SELECT query_id, chunk_id, score, signal, rank FROM hybrid WHERE rank <= 20")
def hybrid_search(t: Tables) -> DataFrame:
    index = _index(t, _embedded(_chunks(t)))
    return search_index.search(t.spark, index, _with_vectors(t.questions()), "hybrid", 20).drop("match_type")


def _embedded(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("embedding", hash_embedding(8)(F.col("text")))


def _with_vectors(questions: DataFrame) -> DataFrame:
    return questions.withColumn("vector", hash_embedding_sql(F.col("question"), 8))


@query(r"""SELECT lang || '-' || item_id AS query_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+'), lambda w: length(w) > 2), '|') AS tokens FROM benchmark, (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)""")
def question_tokens(t: Tables) -> DataFrame:
    return t.questions().select("query_id", joined(query_tokens(F.col("question"))).alias("tokens"))


# --- parts as knowledge: every word of a brand's part names is a question ---------------------------
_PART_ASK = """
ask AS (SELECT DISTINCT p_brand || '/' || w AS query_id, p_brand AS owner_id, w AS question FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part))"""
_PART_HITS = """ent AS (SELECT 'p' || p_partkey AS entity_id, p_brand AS owner_id, p_name AS canonical_name, lower(p_type) || ' ' || p_name AS alias FROM part),
eh AS (SELECT query_id, entity_id, canonical_name, row_number() OVER (PARTITION BY query_id ORDER BY canonical_name, entity_id)::INT AS rank
  FROM ask JOIN ent USING (owner_id) WHERE contains(lower(canonical_name), question) OR contains(lower(alias), question)),
cl AS (SELECT p_partkey AS claim_id, p_brand AS owner_id, 'p' || p_partkey AS subject_entity_id, p_type AS predicate, p_name AS object_value, round(p_size / 50.0, 2) AS confidence FROM part WHERE p_retailprice < 1500),
ch AS (SELECT query_id, claim_id, subject_entity_id, predicate, object_value, confidence, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, claim_id)::INT AS rank
  FROM ask JOIN cl USING (owner_id) WHERE contains(lower(predicate), question) OR contains(lower(object_value), question)),
eh5 AS (SELECT * FROM eh WHERE rank <= 5), ch10 AS (SELECT * FROM ch WHERE rank <= 10)"""
_PARTS = f"{_PART_ASK},\n{_PART_HITS}"


def _part_questions(t: Tables) -> DataFrame:
    words = t.raw("part").select(F.col("p_brand").alias("owner_id"), F.explode(F.split("p_name", " ")).alias("question")).distinct()
    return words.select(F.concat_ws("/", "owner_id", "question").alias("query_id"), "owner_id", "question")


def _part_claims(t: Tables) -> DataFrame:
    return spread(t.raw("part")).select(
        F.col("p_partkey").alias("claim_id"), F.col("p_brand").alias("owner_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("subject_entity_id"),
        F.col("p_type").alias("predicate"), F.col("p_name").alias("object_value"), F.round(F.col("p_size") / 50, 2).alias("confidence"),
        F.when(F.col("p_retailprice") < 1500, "active").otherwise("retracted").alias("status"))


def _entity_hits(t: Tables) -> DataFrame:
    return retrieval.entity_search(t.entities(), _part_questions(t))


def _claim_hits(t: Tables) -> DataFrame:
    return retrieval.claim_search(_part_claims(t), _part_questions(t), 10)


@query(f"WITH {_PARTS} SELECT * FROM eh5")
def entity_search(t: Tables) -> DataFrame:
    return _entity_hits(t)


@query(f"WITH {_PARTS} SELECT query_id, claim_id, predicate, object_value, confidence, rank FROM ch10")
def claim_search(t: Tables) -> DataFrame:
    return _claim_hits(t).drop("subject_entity_id")


@query("""WITH r AS (SELECT s_suppkey AS relationship_id, lower('IN_NATION') AS a, lower(s_name) AS b, lower(n_name) AS c FROM supplier JOIN nation ON n_nationkey = s_nationkey),
q AS (SELECT n_nationkey AS query_id, lower(n_name) AS question FROM nation)
SELECT * FROM (SELECT query_id, relationship_id, row_number() OVER (PARTITION BY query_id ORDER BY relationship_id)::INT AS rank FROM q JOIN r ON contains(a, question) OR contains(b, question) OR contains(c, question)) WHERE rank <= 20""")
def relationship_search(t: Tables) -> DataFrame:
    rel = t.raw("supplier").select(F.col("s_suppkey").alias("relationship_id"), F.lit(1).alias("owner_id"), F.lit("IN_NATION").alias("relationship_type"),
                                   F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source_entity_id"),
                                   F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("target_entity_id"))
    names = t.nodes().select(F.col("node_id").alias("entity_id"), F.col("label").alias("canonical_name"))
    asked = t.raw("nation").select(F.col("n_nationkey").alias("query_id"), F.lit(1).alias("owner_id"), F.col("n_name").alias("question"))
    return retrieval.relationship_search(rel, names, asked).select("query_id", "relationship_id", "rank")


_CITED = f"""{_PARTS},
cit AS (SELECT query_id, 'graph-' || entity_id AS citation_id, 'Graph entity: ' || canonical_name AS excerpt, 0.5 AS score, 'graph' AS signal FROM eh5
  UNION ALL SELECT query_id, 'claim-' || claim_id, predicate || ': ' || object_value, confidence, 'canonical' FROM ch10),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, citation_id)::INT AS rank FROM cit),
top AS (SELECT * FROM ranked WHERE rank <= 12)"""


def _citations(t: Tables) -> DataFrame:
    nodes = _entity_hits(t).select("query_id", F.col("entity_id").alias("node_id"), F.col("canonical_name").alias("label"), F.lit("entity").alias("node_type"))
    parts = [retrieval.graph_citations(nodes), retrieval.claim_citations(_claim_hits(t))]
    return materialize(retrieval.rank_citations(parts, 12), "citations")  # read several times by answers and audits


@query(f"WITH {_CITED} SELECT query_id, citation_id, excerpt, score, signal, rank FROM top")
def ranked_citations(t: Tables) -> DataFrame:
    return _citations(t)


@query(f"""WITH {_KEYWORD} SELECT k.query_id, 'chunk-' || k.chunk_id AS citation_id, left(t.text, 500) AS excerpt, k.score, 'keyword' AS signal FROM keyword k JOIN tok t USING (chunk_id) WHERE rank <= 20""")
def chunk_citations(t: Tables) -> DataFrame:
    chunks = _chunks(t)
    return retrieval.chunk_citations(retrieval.keyword_search(chunks, t.questions()), chunks)


_STEPS = """steps AS (SELECT query_id, 0 AS step, 'keyword' AS signal, 'hybrid chunk search' AS description, 0 AS n FROM ask
UNION ALL SELECT query_id, 1, 'graph', 'entity neighborhood expansion', (SELECT count(*) FROM eh5 WHERE eh5.query_id = ask.query_id) FROM ask
UNION ALL SELECT query_id, 2, 'canonical', 'canonical claim lookup', (SELECT count(*) FROM ch10 WHERE ch10.query_id = ask.query_id) FROM ask)"""


def _steps(t: Tables) -> DataFrame:
    claims = _claim_hits(t)
    return retrieval.plan_steps(_part_questions(t), claims.filter("false"), _entity_hits(t), claims)


@query(f"WITH {_PARTS}, {_STEPS} SELECT query_id, step, signal, description, n AS result_count FROM steps")
def retrieval_plans(t: Tables) -> DataFrame:
    return _steps(t)


@query(f"""WITH {_PARTS}, u AS (SELECT query_id, 0 AS part, rank, entity_id AS id FROM eh5 UNION ALL SELECT query_id, 1, rank, subject_entity_id FROM ch10),
f AS (SELECT query_id, id, min((part, rank)) AS o FROM u GROUP BY 1, 2) SELECT query_id, string_agg(id, '|' ORDER BY o) AS related FROM f GROUP BY 1""")
def related_entities(t: Tables) -> DataFrame:
    rows = retrieval.related_entities(_entity_hits(t), _claim_hits(t))
    return rows.select("query_id", joined("related_entity_ids").alias("related"))


@query(f"""WITH {_CITED}, {_STEPS}, c AS (SELECT query_id, '["' || string_agg(citation_id, '","' ORDER BY rank) || '"]' AS ids FROM top GROUP BY 1),
p AS (SELECT query_id, '[' || string_agg('{{"step":' || step || ',"signal":"' || signal || '","description":"' || description || '","result_count":' || n || '}}', ',' ORDER BY step) || ']' AS plan FROM steps GROUP BY 1)
SELECT query_id AS object_id, owner_id AS actor_id, '{{"question":"' || question || '","mode":"hybrid","citation_ids":' || coalesce(ids, '[]') || ',"plan":' || plan || '}}' AS metadata FROM ask LEFT JOIN c USING (query_id) JOIN p USING (query_id)""")
def retrieval_audit(t: Tables) -> DataFrame:
    rows = retrieval.retrieval_audit(_part_questions(t), _citations(t), _steps(t))
    return rows.select("object_id", "actor_id", "metadata")


_EVIDENCE = """
agg AS (SELECT query_id, count(*) AS n, string_agg('- ' || left(excerpt, 300), chr(10) || chr(10) ORDER BY rank) FILTER (rank <= 5) AS bullets, max(score) AS best FROM top GROUP BY 1),
conf AS (SELECT query_id, lower(trim(split_part(excerpt, ': ', 1))) AS predicate, trim(substring(excerpt, strpos(excerpt, ': ') + 2)) AS v FROM top WHERE signal = 'canonical'),
conflicts AS (SELECT query_id, predicate, 'Ellentmondó bizonyíték a(z) ''' || predicate || ''' predikátumra: ' || string_agg(DISTINCT v, ' vs ' ORDER BY v) AS conflict FROM conf GROUP BY 1, 2 HAVING count(DISTINCT v) > 1),
notes AS (SELECT query_id, string_agg(conflict, '|' ORDER BY conflict) AS conflicts FROM conflicts GROUP BY 1)"""
_ANSWERS = f"{_CITED},{_EVIDENCE}"


@query(f"""WITH {_ANSWERS} SELECT a.query_id, CASE WHEN n IS NULL THEN '{answers.NO_EVIDENCE}' ELSE 'Based on ' || n || ' retrieved evidence item(s):' || chr(10) || chr(10) || bullets || chr(10) || chr(10) || 'This is a heuristic summary for: ' || question END AS answer,
  coalesce(CASE WHEN best > 1.0 THEN 1.0 ELSE best END, 0.0) AS confidence, coalesce(best < 0.3, true) AS insufficient_evidence, coalesce(least(n, 3), 0)::INT AS claims, '' AS warnings, coalesce(conflicts, '') AS conflicts
FROM ask a LEFT JOIN agg USING (query_id) LEFT JOIN notes USING (query_id)""")
def cited_answers(t: Tables) -> DataFrame:
    a = answers.answer(_part_questions(t), _citations(t))
    return a.select("query_id", "answer", "confidence", "insufficient_evidence", F.size("claims").alias("claims"), joined("warnings").alias("warnings"), joined("conflicts").alias("conflicts"))


@query(f"WITH {_ANSWERS} SELECT query_id, predicate, conflict FROM conflicts")
def evidence_conflicts(t: Tables) -> DataFrame:
    return answers.evidence_conflicts(_citations(t))


@query(f"WITH {_CITED} SELECT query_id, string_agg(citation_id, '|' ORDER BY rank) AS allowed_ids, sum(length(excerpt))::BIGINT AS characters FROM top GROUP BY 1")
def context_packages(t: Tables) -> DataFrame:
    c = answers.context_package(_citations(t))
    total = F.aggregate(F.map_values("context"), F.lit(0).cast("bigint"), lambda s, x: s + F.length(x))
    return c.select("query_id", joined("allowed_ids").alias("allowed_ids"), total.alias("characters"))


@query(f"""WITH allowed AS (SELECT l_orderkey AS k, list(DISTINCT l_partkey) AS ids FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
c AS (SELECT l_orderkey AS k, l_linenumber AS i, l_partkey, l_suppkey, 'line ' || l_linenumber AS text FROM lineitem),
j AS (SELECT c.k, i, l_partkey, l_suppkey, text, coalesce(list_contains(ids, l_partkey), false) AS ok1, coalesce(list_contains(ids, l_suppkey), false) AS ok2 FROM c LEFT JOIN allowed USING (k)),
w AS (SELECT *, CASE WHEN ok1 AND ok2 THEN NULL ELSE '{answers.INVALID_IDS}' || concat_ws(', ', CASE WHEN NOT ok1 THEN l_partkey END, CASE WHEN NOT ok2 THEN l_suppkey END) END AS w1,
  CASE WHEN NOT ok1 AND NOT ok2 THEN '{answers.UNSUPPORTED}' || text END AS w2 FROM j)
SELECT k AS query_id, count(*) FILTER (ok1 OR ok2) AS claims, coalesce(string_agg(concat_ws('|', w1, w2), '|' ORDER BY i, l_partkey, l_suppkey) FILTER (w1 IS NOT NULL), '') AS warnings FROM w GROUP BY 1""")
def checked_citations(t: Tables) -> DataFrame:
    li = t.raw("lineitem")
    claim = F.struct(F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    drafts = li.groupBy(F.col("l_orderkey").alias("query_id")).agg(F.sort_array(F.collect_list(claim)).alias("c")).select(
        "query_id", F.transform("c", lambda x: F.struct(F.concat(F.lit("line "), x["i"].cast("string")).alias("text"), F.lit(1.0).alias("confidence"),
                                                       F.array(x["a"].cast("string"), x["b"].cast("string")).alias("citation_ids"))).alias("claims"))
    allowed = li.filter("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.collect_set(F.col("l_partkey").cast("string")).alias("allowed_ids"))
    rows = answers.validate_citations(drafts, allowed)
    return rows.select("query_id", F.size("claims").cast("bigint").alias("claims"), joined("warnings").alias("warnings"))


@query(f"""WITH {_ANSWERS} SELECT query_id, 2 AS signals_expected, (CASE WHEN n IS NOT NULL AND contains(lower(bullets || question), question) THEN 1 ELSE 0 END
  + CASE WHEN n IS NOT NULL AND contains(lower(bullets), 'graph entity') THEN 1 ELSE 0 END)::INT AS signals_found, coalesce(n, 0) >= 3 AS enough_citations FROM ask LEFT JOIN agg USING (query_id)""")
def golden_scores(t: Tables) -> DataFrame:
    golden = _part_questions(t).select("query_id", F.array(F.col("question"), F.lit("Graph Entity")).alias("expected_signals"), F.lit(3).alias("min_citations"))
    rows = answers.score_golden(answers.answer(_part_questions(t), _citations(t)), golden)
    return rows.select("query_id", "signals_expected", "signals_found", "enough_citations")


# --- catalogues of parts: one question set meets their text, their entities, the suppliers around them and their claims -----------
_CATALOGUE = f"""documents AS (SELECT p_brand || '-' || p_size % 5 AS doc_id, p_brand AS lang, 'catalogue' AS source,
  string_agg(p_name || ', ' || lower(p_type), '. ' ORDER BY p_partkey) AS text FROM part GROUP BY 1, 2),
said AS (SELECT DISTINCT p_brand AS owner_id, unnest(string_split(p_name, ' ')) AS question FROM part
  UNION SELECT DISTINCT p_brand, p_name FROM part UNION SELECT DISTINCT p_brand, 'nobody wrote about this' FROM part)"""
_CATALOGUE_ASK = f"""ask AS (SELECT owner_id || '/' || question AS query_id, owner_id, question, list_distinct({_terms("question")}) AS terms FROM said)"""
_PLAN = f"""{_CATALOGUE}, {_keyword_sql(_CATALOGUE_ASK)}, {_MERGED},
{_PART_HITS},
node AS (SELECT entity_id AS id, canonical_name AS label, 'entity' AS kind FROM ent UNION ALL SELECT 's' || s_suppkey, s_name, 'entity' FROM supplier
  UNION ALL SELECT 'c' || claim_id, predicate, 'claim' FROM cl),
edge AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION ALL SELECT subject_entity_id, 'c' || claim_id FROM cl),
seen AS (SELECT DISTINCT query_id, other FROM eh5 JOIN (SELECT src, dst AS other, row_number() OVER (PARTITION BY src ORDER BY src || '>' || dst) AS k FROM edge) ON src = entity_id AND k <= 6
  UNION SELECT query_id, entity_id FROM eh5),
cit AS (SELECT query_id, 'chunk-' || chunk_id AS citation_id, left(text, 500) AS excerpt, h.score, 'keyword' AS signal FROM hybrid h JOIN tok t USING (chunk_id) WHERE h.rank <= 10
  UNION ALL SELECT query_id, 'graph-' || other, 'Graph entity: ' || label, 0.5, 'graph' FROM seen JOIN node ON id = other AND kind = 'entity'
  UNION ALL SELECT query_id, 'claim-' || claim_id, predicate || ': ' || object_value, confidence, 'canonical' FROM ch10),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, citation_id)::INT AS rank FROM cit),
top AS (SELECT * FROM ranked WHERE rank <= 10),
steps AS (SELECT query_id, 0 AS step, 'keyword' AS signal, 'hybrid chunk search' AS description, (SELECT count(*) FROM hybrid h WHERE h.rank <= 10 AND h.query_id = ask.query_id) AS n FROM ask
  UNION ALL SELECT query_id, 1, 'graph', 'entity neighborhood expansion', (SELECT count(*) FROM eh5 WHERE eh5.query_id = ask.query_id) FROM ask
  UNION ALL SELECT query_id, 2, 'canonical', 'canonical claim lookup', (SELECT count(*) FROM ch10 WHERE ch10.query_id = ask.query_id) FROM ask)"""


def _plan(t: Tables) -> question_plan.QuestionPlan:
    part = t.raw("part")
    line = F.concat("p_name", F.lit(", "), F.lower("p_type"))
    texts = part.groupBy(F.concat_ws("-", "p_brand", F.col("p_size") % 5).alias("version_id"), F.col("p_brand").alias("owner_id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda x: x["line"]), ". ").alias("text"))
    index = _index(t, _embedded(chunking.chunk_documents(texts.withColumn("source_id", F.lit("catalogue")))))
    said = _part_questions(t).select("owner_id", "question").union(part.select("p_brand", "p_name")).union(part.select("p_brand", F.lit("nobody wrote about this"))).distinct()
    asked = _with_vectors(said.select(F.concat_ws("/", "owner_id", "question").alias("query_id"), "owner_id", "question"))
    claims = _part_claims(t)

    def c(prefix: str, key: str) -> Column:
        return F.concat(F.lit(prefix), F.col(key).cast("string"))

    nodes = t.entities().select(F.col("entity_id").alias("node_id"), F.lit("entity").alias("node_type"), F.col("canonical_name").alias("label"))
    nodes = nodes.unionByName(t.nodes().filter("node_id like 's%'")).unionByName(
        claims.filter("status = 'active'").select(c("c", "claim_id").alias("node_id"), F.lit("claim").alias("node_type"), F.col("predicate").alias("label")))
    ends = t.raw("lineitem").select(c("p", "l_partkey").alias("src"), c("s", "l_suppkey").alias("dst")).distinct().union(
        claims.filter("status = 'active'").select("subject_entity_id", c("c", "claim_id")))
    edges = ends.select(F.concat_ws(">", "src", "dst").alias("edge_id"), F.lit("NEAR").alias("edge_type"), "src", "dst")
    return question_plan.run(t.spark, index, t.entities(), claims, nodes, edges, asked, limit=10, edge_limit=6)


@query(f"WITH {_PLAN} SELECT query_id, citation_id, excerpt, score, signal, rank FROM top")
def planned_citations(t: Tables) -> DataFrame:
    """Chunks, neighbourhoods and claims of one question set, ranked together."""
    return _plan(t).citations


@query(f"WITH {_PLAN} SELECT query_id, step, signal, description, n AS result_count FROM steps")
def planned_steps(t: Tables) -> DataFrame:
    return _plan(t).steps


_PLAN_ANSWERS = f"{_PLAN},{_EVIDENCE}"


@query(f"""WITH {_PLAN_ANSWERS} SELECT a.query_id, CASE WHEN n IS NULL THEN '{answers.NO_EVIDENCE}' ELSE 'Based on ' || n || ' retrieved evidence item(s):' || chr(10) || chr(10) || bullets || chr(10) || chr(10) || 'This is a heuristic summary for: ' || question END AS answer,
  coalesce(CASE WHEN best > 1.0 THEN 1.0 ELSE best END, 0.0) AS confidence, coalesce(best < 0.3, true) AS insufficient_evidence, coalesce(least(n, 3), 0)::INT AS claims, '' AS warnings, coalesce(conflicts, '') AS conflicts
FROM ask a LEFT JOIN agg USING (query_id) LEFT JOIN notes USING (query_id)""")
def planned_answers(t: Tables) -> DataFrame:
    a = _plan(t).answers
    return a.select("query_id", "answer", "confidence", "insufficient_evidence", F.size("claims").alias("claims"), joined("warnings").alias("warnings"), joined("conflicts").alias("conflicts"))


@query(f"""WITH {_PLAN}, u AS (SELECT query_id, 0 AS part, rank, entity_id AS id FROM eh5 UNION ALL SELECT query_id, 1, rank, subject_entity_id FROM ch10),
f AS (SELECT query_id, id, min((part, rank)) AS o FROM u GROUP BY 1, 2), r AS (SELECT query_id, string_agg(id, '|' ORDER BY o) AS related FROM f GROUP BY 1),
c AS (SELECT query_id, '["' || string_agg(citation_id, '","' ORDER BY rank) || '"]' AS ids FROM top GROUP BY 1),
p AS (SELECT query_id, '[' || string_agg('{{"step":' || step || ',"signal":"' || signal || '","description":"' || description || '","result_count":' || n || '}}', ',' ORDER BY step) || ']' AS plan FROM steps GROUP BY 1)
SELECT query_id AS object_id, owner_id AS actor_id, coalesce(related, '') AS related, '{{"question":"' || question || '","mode":"hybrid","citation_ids":' || coalesce(ids, '[]') || ',"plan":' || plan || '}}' AS metadata
FROM ask LEFT JOIN c USING (query_id) LEFT JOIN r USING (query_id) JOIN p USING (query_id)""")
def planned_audit(t: Tables) -> DataFrame:
    plan = _plan(t)
    related = plan.related.select(F.col("query_id").alias("object_id"), joined("related_entity_ids").alias("related"))
    rows = plan.audit.join(related, "object_id", "left")
    return rows.select("object_id", "actor_id", F.coalesce("related", F.lit("")).alias("related"), "metadata")
