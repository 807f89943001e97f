"""Batch retrieval: all questions of a table are answered by one plan.

Keyword, semantic and hybrid chunk search, entity and claim search, and the ranked citation list.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from knowloom.functions.hashing import stable_id
from knowloom.functions.layout import once
from knowloom.functions.skew import SALTS, hot_join, is_small, small_side, top_k
from knowloom.functions.text import bind
from knowloom.sources.sinks import materialize

# Common English words that carry no search meaning.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "if", "in",
    "into", "is", "it", "its", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then",
    "there", "these", "they", "this", "to", "was", "were", "what", "which", "will", "with",
)
K1, B = 1.2, 0.75
SCORE_DIGITS = 6
QUERY_BLOCK = 4096
QUESTION_BOUND = 20_000
CHUNK_BLOCK = 20000
TERM_BOUND = 200_000
GRAM = 8


def terms(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-cased words without stop words, in text order with repeats."""
    words = F.split(F.lower(text), r"(?U)\W+")
    # A set, not an array: each word is looked up once instead of being compared with every stop word.
    return F.filter(words, lambda w: (w != "") & ~w.isin(*stop_words))


def term_statistics(tokens: DataFrame, vocabulary: DataFrame, small: bool = False) -> DataFrame:
    """Per owner and queried term: chunks with the term and mean chunk length, in one pass.

    The empty term stands for the whole corpus. Other terms are dropped before the shuffle.
    """
    listed = F.array_append(F.array_distinct("tokens"), F.lit(""))
    rows = tokens.select("owner_id", F.size("tokens").alias("length"), F.explode(listed).alias("term"))
    asked = vocabulary.unionByName(vocabulary.select("owner_id", F.lit("").alias("term")).distinct())
    kept = rows.join(small_side(asked, small), ["owner_id", "term"], "left_semi")
    return kept.groupBy("owner_id", "term").agg(
        F.count(F.lit(1)).alias("chunks"), F.avg("length").alias("avg_len")
    )


def keyword_search(
    chunks: DataFrame, questions: DataFrame, limit: int = 20, stop_words: tuple[str, ...] = STOP_WORDS
) -> DataFrame:
    """Chunks of the question's owner that contain every question term, best BM25 first.

    Candidates come from the rarest term only; the other terms are tested inside the row. Questions
    with the same terms are searched once. Score is s / (1 + s), so it lies in [0, 1). With a checked
    number of question terms the question side is broadcast and chunk rows are only scanned, not
    shuffled. Beyond it only (term, chunk id) rows meet the questions and token arrays move once per chunk.
    """
    asked = questions.select(
        "query_id", "owner_id", F.array_sort(F.array_distinct(terms(F.col("question"), stop_words))).alias("q_terms")
    ).filter(F.size("q_terms") > 0)
    small = is_small(asked.select(F.explode("q_terms")), TERM_BOUND)
    # Cutting and tokenising the texts is most of the work: it is done once for the counts and the postings.
    stored = materialize(chunks.select("owner_id", "chunk_id", terms(F.col("text"), stop_words).alias("_stored")), "search-tokens")
    # Taken out of the columns once per chunk, not once per term.
    tokens = once(stored, tokens=F.transform("_stored", lambda x: x)).drop("_stored")
    distinct = asked.select("owner_id", "q_terms").distinct().withColumn("q_key", F.xxhash64("owner_id", "q_terms"))
    per_term = distinct.select("owner_id", "q_key", F.size("q_terms").alias("wanted"), F.explode("q_terms").alias("term"))
    stats = term_statistics(tokens, per_term.select("owner_id", "term").distinct(), small)
    corpus = stats.filter("term = ''").select("owner_id", F.col("chunks").alias("n"), "avg_len")
    frequency = stats.filter("term <> ''").select("owner_id", "term", F.col("chunks").alias("df"))
    # One array entry per question term: a group is as long as its question.
    drivers = (
        per_term.join(frequency, ["owner_id", "term"]).join(corpus, "owner_id")
        .withColumn("idf", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        .groupBy("owner_id", "q_key", "avg_len", "wanted")
        .agg(
            F.min(F.struct("df", "term")).alias("rarest"),
            F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("weights"),
        )
        .filter(F.size("weights") == F.col("wanted"))
        .select("owner_id", F.col("rarest.term").alias("term"), "q_key", "weights", "avg_len")
    )
    postings = tokens.select("owner_id", "chunk_id", "tokens", F.explode(F.array_distinct("tokens")).alias("term"))
    if small:
        met = postings.join(F.broadcast(drivers), ["owner_id", "term"])
    else:
        asked_terms = drivers.select("owner_id", "term").distinct()
        listed = postings.drop("tokens").join(asked_terms, ["owner_id", "term"], "left_semi")
        met = hot_join(listed, drivers, ["owner_id", "term"], salts=SALTS).join(tokens.select("chunk_id", "tokens"), "chunk_id")
    met = met.filter(F.size(F.array_except(F.transform("weights", lambda w: w["term"]), F.col("tokens"))) == 0)

    def weight(w: Column) -> Column:
        tf = F.size(F.filter("tokens", lambda t: t == w["term"])).cast("double")
        norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.size("tokens") / F.col("avg_len"))
        return w["idf"] * tf * (K1 + 1) / (tf + norm)

    raw = F.aggregate(F.transform("weights", weight), F.lit(0.0), lambda a, x: a + x)
    scored = once(met.select("q_key", "chunk_id", "weights", "tokens", "avg_len"), raw=raw).select(
        "q_key", "chunk_id", F.round(F.col("raw") / (F.col("raw") + 1), SCORE_DIGITS).alias("score")
    )
    best = top_k(scored, ["q_key"], [F.desc("score"), F.col("chunk_id")], limit)
    keyed = asked.select("query_id", F.xxhash64("owner_id", "q_terms").alias("q_key"))
    return keyed.join(best, "q_key").select("query_id", "chunk_id", "score", "rank", F.lit("keyword").alias("match_type"))


def _unit_rows(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _local_top(ids, vectors, owners, block, k, held):
    """Merge one batch into ``held`` (query position -> best ids and scores)."""
    v = _unit_rows(vectors)
    for owner, positions in block["by_owner"].items():
        mine = owners == owner
        if not mine.any():
            continue
        scores = np.round(v[mine] @ block["matrix"][positions].T, SCORE_DIGITS)
        own_ids = ids[mine]
        for j, pos in enumerate(positions):
            column = scores[:, j]
            if len(column) > k:
                cut = np.partition(column, len(column) - k)[len(column) - k]
                keep = column >= cut
            else:
                keep = np.ones(len(column), dtype=bool)
            old = held.get(pos)
            new_ids, new_scores = own_ids[keep], column[keep]
            if old is not None:
                new_ids = np.concatenate([old[0], new_ids])
                new_scores = np.concatenate([old[1], new_scores])
            held[pos] = _best(new_ids, new_scores, k)


def _block(query_ids, owners, vectors) -> dict:
    owners = np.asarray(owners, dtype=object)
    matrix = _unit_rows(np.asarray(vectors, dtype="float64"))
    return {
        "ids": np.asarray(query_ids, dtype=object),
        "matrix": matrix,
        "by_owner": {o: np.flatnonzero(owners == o) for o in set(owners.tolist())},
    }


def semantic_search(
    chunks: DataFrame, questions: DataFrame, limit: int = 20, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """Exact cosine top-``limit`` per question over the owner's embedded chunks.

    ``chunks(owner_id, chunk_id, embedding)``, ``questions(query_id, owner_id, vector)``. Chunk vectors
    never move: each partition multiplies its Arrow batches with the query matrix and keeps ``limit``
    rows per question; only those are shuffled. The query matrix is sent to the tasks while it has at
    most ``query_block`` rows; larger question tables run as a block grid with the same result.
    """
    rows = chunks.filter("embedding is not null").select("owner_id", "chunk_id", "embedding")
    asked = questions.filter("vector is not null").select("query_id", "owner_id", "vector")
    schema = {f.name: f.dataType.simpleString() for f in [*chunks.schema.fields, *questions.schema.fields]}
    out_schema = f"query_id {schema['query_id']}, chunk_id {schema['chunk_id']}, score double"
    # Vectors of different models have different dimensions: each question meets the chunks of its own.
    rows = rows.filter(F.forall("embedding", lambda x: x.isNotNull()))
    asked = asked.filter(F.forall("vector", lambda x: x.isNotNull()))
    sizes = [r[0] for r in asked.select(F.size("vector")).distinct().collect()]  # one for each dimension in use
    if len(sizes) > 1:
        parts = [semantic_search(rows.filter(F.size("embedding") == n), asked.filter(F.size("vector") == n), limit, query_block) for n in sizes]
        return reduce(DataFrame.unionByName, parts)
    rows = rows.filter(F.size("embedding").isin(*sizes)) if sizes else rows.limit(0)
    head = asked.limit(query_block + 1).collect()
    if len(head) > query_block:
        local = _grid_search(rows, asked, limit, query_block, out_schema)
    else:
        query_type = asked.schema["query_id"].dataType
        local = _matrix_search(rows, head, limit, out_schema, chunks.sparkSession, query_type)
    best = top_k(local, ["query_id"], [F.desc("score"), F.col("chunk_id")], limit)
    return best.withColumn("match_type", F.lit("semantic"))


def _matrix_search(rows: DataFrame, head: list, k: int, out_schema: str, spark, query_type) -> DataFrame:
    block = (
        _block([r[0] for r in head], [r[1] for r in head], [r[2] for r in head]) if head else None
    )
    shared = spark.sparkContext.broadcast(block)
    arrow_type = to_arrow_type(query_type)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        held: dict[int, tuple] = {}
        id_type = None
        for batch in batches:
            id_type = batch.column("chunk_id").type
            if b is None or batch.num_rows == 0:
                continue
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype("float64")
            ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)
            owners = batch.column("owner_id").to_numpy(zero_copy_only=False)
            _local_top(ids, flat.reshape(batch.num_rows, -1), owners, b, k, held)
        for pos, (ids, scores) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([b["ids"][pos]] * len(ids), type=arrow_type), pa.array(ids, type=id_type), pa.array(scores)],
                names=["query_id", "chunk_id", "score"],
            )

    return rows.mapInArrow(scan, out_schema)


def _grid_search(rows: DataFrame, asked: DataFrame, k: int, query_block: int, out_schema: str) -> DataFrame:
    """Question blocks x chunk blocks, each cell bounded in both directions."""
    q_blocks = 2 * (asked.count() // query_block + 1)
    c_blocks = 2 * (rows.count() // CHUNK_BLOCK + 1)

    def numbered(c: str, n: int) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    left = rows.withColumn("cb", numbered("chunk_id", c_blocks)).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
    )
    right = asked.withColumn("qb", numbered("query_id", q_blocks)).withColumn(
        "cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))
    )

    def cell(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, tuple] = {}
        empty = pd.DataFrame(columns=["query_id", "chunk_id", "score"])
        if c.empty or q.empty:
            return empty
        b = _block(q["query_id"].tolist(), q["owner_id"].tolist(), np.stack(q["vector"].to_list()))
        _local_top(
            c["chunk_id"].to_numpy(), np.stack(c["embedding"].to_list()).astype("float64"),
            c["owner_id"].to_numpy(), b, k, held,
        )
        if not held:
            return empty
        return pd.concat(
            [pd.DataFrame({"query_id": b["ids"][p], "chunk_id": i, "score": s}) for p, (i, s) in held.items()]
        )

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(cell, out_schema)


def merge_hits(keyword: DataFrame, semantic: DataFrame, limit: int = 20) -> DataFrame:
    """Union of two hit lists: best score per chunk, keyword wins ties, top ``limit`` per question."""
    cols = ["query_id", "chunk_id", "score", "match_type"]
    both = keyword.select(*cols).unionByName(semantic.select(*cols))
    merged = both.groupBy("query_id", "chunk_id").agg(
        F.max(F.struct("score", (F.col("match_type") == "keyword").alias("is_keyword"))).alias("_b")
    ).select("query_id", "chunk_id", F.col("_b.score").alias("score"),
             F.when(F.col("_b.is_keyword"), "keyword").otherwise("semantic").alias("signal"),
             F.lit("hybrid").alias("match_type"))
    return top_k(merged, ["query_id"], [F.desc("score"), F.col("chunk_id")], limit)


def search(chunks: DataFrame, questions: DataFrame, mode: str = "hybrid", limit: int = 20) -> DataFrame:
    """keyword, semantic, or anything else for hybrid."""
    if mode == "keyword":
        return keyword_search(chunks, questions, limit)
    if mode == "semantic":
        return semantic_search(chunks, questions, limit)
    return merge_hits(keyword_search(chunks, questions, limit), semantic_search(chunks, questions, limit), limit)


def _gram_hash(letters: Column, start: Column, n: Column | int) -> Column:
    return F.xxhash64(F.slice(letters, start, n))


def substring_matches(table: DataFrame, texts: Column, questions: DataFrame) -> DataFrame:
    """Rows of ``table`` where one of ``texts`` contains the whole question, with its query_id.

    Case-insensitive. Rows of the same owner and texts are one unit: units are searched, and their rows meet the hits afterwards, so
    the work on letters follows the different texts and not the rows. A question asks with the hash of its first ``GRAM`` letters (all of a shorter one); a text emits
    the different hashes of its runs of the asked lengths, at most ``GRAM`` for each letter. Only (unit, hash) rows meet the
    questions, texts and questions join the pairs afterwards and ``contains`` confirms them. Hashes of a checked
    number of questions are broadcast; otherwise rows without any asked hash are dropped first and hot ones are salted.
    """
    asked = questions.select("query_id", "owner_id", F.lower("question").alias("needle")).filter("needle <> ''")
    letters = F.split("needle", "")
    head = F.least(F.length("needle"), F.lit(GRAM))
    grams = asked.select("query_id", "owner_id", head.alias("n"), F.xxhash64(F.slice(letters, F.lit(1), head)).alias("gram"))
    lengths = sorted(r[0] for r in grams.select("n").distinct().collect())  # at most GRAM numbers
    table = table.withColumn("_texts", F.array_distinct(F.transform(F.filter(texts, lambda t: t.isNotNull()), F.lower)))
    # Small in bytes, much work a row: all cores take part.
    cores = max(table.sparkSession.sparkContext.defaultParallelism, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    units = table.select("owner_id", "_texts").filter("owner_id is not null").distinct().repartition(cores)
    rows = materialize(units.withColumn("_unit", F.monotonically_increasing_id()), "search-units")

    def runs(text: Column) -> Column:
        def of(parts: Column) -> Column:
            found = [
                F.when(F.size(parts) >= n, F.transform(F.sequence(F.lit(1), F.size(parts) - (n - 1)), lambda i: _gram_hash(parts, i, n)))
                .otherwise(F.array().cast("array<bigint>")) for n in lengths
            ]
            return F.array_distinct(F.concat(*found)) if found else F.array().cast("array<bigint>")

        return bind(F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "")), of)

    hashes = F.array_distinct(F.flatten(F.transform("_texts", runs)))
    keyed = rows.select("_unit", "owner_id", F.explode(hashes).alias("gram"))
    if is_small(grams, QUESTION_BOUND):
        met = keyed.join(F.broadcast(grams.drop("n")), ["owner_id", "gram"])
    else:
        keyed = keyed.join(grams.select("owner_id", "gram").distinct(), ["owner_id", "gram"], "left_semi")
        met = hot_join(keyed, grams.drop("n"), ["owner_id", "gram"], salts=SALTS)
    pairs = hot_join(met.select("_unit", "query_id"), asked.select("query_id", "needle"), ["query_id"])
    found = hot_join(pairs, rows, ["_unit"]).filter(F.exists("_texts", lambda t: F.contains(t, F.col("needle"))))
    hits = materialize(found.select("owner_id", "_texts", "query_id"), "search-hits")
    # Rows are only scanned where the hits of the units are few.
    same = ["owner_id", "_texts"]
    met = table.join(F.broadcast(hits), same) if is_small(hits) else hot_join(table, hits, same)
    return met.select("query_id", *[c for c in table.columns if c != "_texts"])


def entity_search(entities: DataFrame, questions: DataFrame, limit: int = 5) -> DataFrame:
    names = F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    hits = substring_matches(entities.select("owner_id", "entity_id", "canonical_name", "aliases"), names, questions)
    return top_k(hits.select("query_id", "entity_id", "canonical_name"), ["query_id"],
                 [F.col("canonical_name"), F.col("entity_id")], limit)


def claim_search(claims: DataFrame, questions: DataFrame, limit: int = 20) -> DataFrame:
    active = claims.filter(F.col("status") == "active").select(
        "owner_id", "claim_id", "subject_entity_id", "predicate", "object_value", "confidence"
    )
    hits = substring_matches(active, F.array("predicate", "object_value"), questions).drop("owner_id")
    return top_k(hits, ["query_id"], [F.desc("confidence"), F.col("claim_id")], limit)


def relationship_search(relationships: DataFrame, entities: DataFrame, questions: DataFrame, limit: int = 20) -> DataFrame:
    """Relationships whose type or endpoint name contains the question."""
    e = entities.select("entity_id", "canonical_name")
    src = e.select(F.col("entity_id").alias("source_entity_id"), F.col("canonical_name").alias("source_name"))
    dst = e.select(F.col("entity_id").alias("target_entity_id"), F.col("canonical_name").alias("target_name"))
    named = hot_join(hot_join(relationships, src, ["source_entity_id"]), dst, ["target_entity_id"])
    hits = substring_matches(
        named.select("owner_id", "relationship_id", "relationship_type", "source_name", "target_name"),
        F.array("relationship_type", "source_name", "target_name"), questions,
    )
    return top_k(hits.drop("owner_id"), ["query_id"], [F.col("relationship_id")], limit)


def chunk_citations(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with citation id, excerpt (500 characters) and retrieval signal."""
    c = chunks.select("chunk_id", F.left("text", F.lit(500)).alias("excerpt"))
    signal = F.when(F.col("match_type") == "semantic", "semantic").otherwise("keyword")
    return hits.join(c, "chunk_id").select(
        "query_id", F.concat(F.lit("chunk-"), F.col("chunk_id").cast("string")).alias("citation_id"), "excerpt",
        "score", signal.alias("signal"),
    )


def graph_citations(neighborhoods: DataFrame) -> DataFrame:
    """``neighborhoods(query_id, node_id, label, node_type)`` -> one citation per entity node."""
    nodes = neighborhoods.filter(F.col("node_type") == "entity").dropDuplicates(["query_id", "node_id"])
    return nodes.select(
        "query_id", F.concat(F.lit("graph-"), F.col("node_id").cast("string")).alias("citation_id"),
        F.concat(F.lit("Graph entity: "), F.col("label")).alias("excerpt"), F.lit(0.5).alias("score"),
        F.lit("graph").alias("signal"),
    )


def claim_citations(claims: DataFrame) -> DataFrame:
    return claims.select(
        "query_id", F.concat(F.lit("claim-"), F.col("claim_id").cast("string")).alias("citation_id"),
        F.concat_ws(": ", "predicate", "object_value").alias("excerpt"), F.col("confidence").alias("score"),
        F.lit("canonical").alias("signal"),
    )


def rank_citations(parts: list[DataFrame], limit: int = 20) -> DataFrame:
    """All citations of a question by score, one per citation id, top ``limit``."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    unique = union.groupBy("query_id", "citation_id").agg(
        F.max(F.struct("score", "excerpt", "signal")).alias("_c")
    ).select("query_id", "citation_id", "_c.excerpt", "_c.score", "_c.signal")
    return top_k(unique, ["query_id"], [F.desc("score"), F.col("citation_id")], limit)


def plan_steps(questions: DataFrame, hits: DataFrame, entities: DataFrame, claims: DataFrame, mode: str = "hybrid") -> DataFrame:
    """Three steps per question with result counts (also 0)."""
    first = "semantic" if mode == "semantic" else "keyword"
    parts = [
        (first, f"{mode} chunk search", hits),
        ("graph", "entity neighborhood expansion", entities),
        ("canonical", "canonical claim lookup", claims),
    ]
    counted = None
    for signal, _, rows in parts:
        part = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).withColumn("signal", F.lit(signal))
        counted = part if counted is None else counted.unionByName(part)
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(s).alias("signal"), F.lit(d).alias("description"))
                      for i, (s, d, _) in enumerate(parts)])
    asked = questions.select("query_id", F.explode(steps).alias("s")).select("query_id", "s.*")
    return asked.join(counted, ["query_id", "signal"], "left").select(
        "query_id", "step", "signal", "description", F.coalesce("n", F.lit(0)).alias("result_count")
    )


def related_entities(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """Matched entities, then claim subjects, each once per question (both lists are top-k bounded)."""
    a = entities.select("query_id", F.lit(0).alias("part"), "rank", F.col("entity_id").alias("id"))
    b = claims.filter("subject_entity_id is not null").select(
        "query_id", F.lit(1).alias("part"), "rank", F.col("subject_entity_id").alias("id")
    )
    ordered = F.sort_array(F.collect_list(F.struct("part", "rank", "id")))
    return a.unionByName(b).groupBy("query_id").agg(
        F.array_distinct(F.transform(ordered, lambda x: x["id"])).alias("related_entity_ids")
    )


def retrieval_audit(questions: DataFrame, citations: DataFrame, steps: DataFrame, mode: str = "hybrid") -> DataFrame:
    """Audit row per question with the plan and the ranked citation ids."""
    cited = citations.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "citation_id"))).alias("_c"))
    plan = steps.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("step", "signal", "description", "result_count"))).alias("_p")
    )
    joined = questions.join(cited, "query_id", "left").join(plan, "query_id", "left")
    metadata = F.to_json(
        F.struct(
            "question", F.lit(mode).alias("mode"),
            F.coalesce(F.transform("_c", lambda x: x["citation_id"]), F.array().cast("array<string>")).alias("citation_ids"),
            F.col("_p").alias("plan"),
        )
    )
    return joined.select(
        stable_id("audit", F.col("query_id"), "retrieval").alias("audit_id"),
        F.col("owner_id").cast("string").alias("actor_id"), F.lit("retrieval_planned").alias("action"),
        F.lit("question_answer").alias("object_type"), F.col("query_id").cast("string").alias("object_id"),
        metadata.alias("metadata"),
    )


