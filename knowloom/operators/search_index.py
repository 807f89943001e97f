"""A stored search index: the corpus is read and tokenised once, questions read only the postings of their own terms.

Tables below one folder: ``chunks`` (the chunk columns, ``ord`` and the tokens), ``postings`` (one row per owner,
term and block of up to 4096 chunks, in buckets of terms) and ``corpus`` (chunks and mean length per owner). A posting row
carries bounds that hold for any corpus mean, so blocks that cannot reach a question's top list are never opened.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knowloom.functions.layout import once
from knowloom.functions.skew import hot_join, is_small, small_side, top_k
from knowloom.operators.retrieval import K1, SCORE_DIGITS, STOP_WORDS, TERM_BOUND, B, merge_hits, semantic_search, terms
from knowloom.sources.sinks import materialize

BLOCK = 4096
BUCKETS = 16
PROBES = 8
_POSTING = "owner_id {owner}, term string, block long, n long, most int, shortest int, ords array<int>, tfs array<int>, sizes array<int>"
_NEAR = 2 * 10.0 ** -SCORE_DIGITS


def _bucket(owner: str = "owner_id", term: str = "term") -> Column:
    return F.pmod(F.xxhash64(owner, term), F.lit(BUCKETS)).cast("int")


def _postings(batches):
    """Chunks -> one row per owner, term and block, a run of up to BLOCK successive ords named by its first one."""

    def rows(parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts)
        owners = table.column("owner_id").combine_chunks().dictionary_encode()
        lists = table.column("tokens").combine_chunks()
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        words = lists.flatten().dictionary_encode()
        if not len(words):
            return
        base = table.column("ord")[0].as_py()
        owner_of = owners.indices.fill_null(len(owners.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        chunk = np.repeat(np.arange(len(lengths)), lengths)
        n_words, n_chunks = len(words.dictionary), len(lengths)
        code = (owner_of[chunk] * n_words + words.indices.to_numpy()) * n_chunks + chunk
        code, tf = np.unique(code, return_counts=True)
        entry, group = code % n_chunks, code // n_chunks
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        stops = np.concatenate([starts, [len(group)]])
        ords = table.column("ord").to_numpy()[entry] - base
        size = lengths[entry]

        def listed(values: np.ndarray):
            return pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(values.astype(np.int32)))

        head = group[starts]
        owner = pa.concat_arrays([owners.dictionary, pa.nulls(1, owners.dictionary.type)]).take(pa.array(head // n_words))
        yield pa.RecordBatch.from_arrays([
            owner, words.dictionary.take(pa.array(head % n_words)), pa.array(np.full(len(head), base)), pa.array(np.diff(stops)),
            pa.array(np.maximum.reduceat(tf, starts).astype(np.int32)), pa.array(np.minimum.reduceat(size, starts).astype(np.int32)),
            listed(ords), listed(tf), listed(size)], ["owner_id", "term", "block", "n", "most", "shortest", "ords", "tfs", "sizes"])

    held, last, size = [], None, 0
    for batch in batches:
        ords = batch.column("ord").to_numpy()
        a = 0
        while a < len(ords):
            if held and (ords[a] != last + 1 or size == BLOCK):
                yield from rows(held)
                held, size = [], 0
            jump = np.flatnonzero(ords[a + 1:] != ords[a:-1] + 1)
            b = min(a + int(jump[0]) + 1 if len(jump) else len(ords), a + BLOCK - size)
            held.append(batch.slice(a, b - a))
            last, size, a = ords[b - 1], size + b - a, b
    if held:
        yield from rows(held)


def write_index(chunks: DataFrame, folder: str, stop_words: tuple[str, ...] = STOP_WORDS) -> None:
    """Store ``chunks(owner_id, chunk_id, text, ...)`` and their postings below ``folder``. Other columns, such as embeddings, are kept.

    Chunks stay in the partitions they come in, and the postings of a block are gathered where its part of the chunk table
    is read: only finished blocks are shuffled, to their buckets.
    """
    spark = chunks.sparkSession
    rows = chunks.sortWithinPartitions("owner_id", "chunk_id").withColumn("ord", F.monotonically_increasing_id())
    rows = once(rows, tokens=terms(F.col("text"), stop_words))
    rows.write.mode("overwrite").parquet(f"{folder}/chunks")
    stored = spark.read.parquet(f"{folder}/chunks").filter("tokens is not null").select("owner_id", "ord", "tokens")
    owner = stored.schema["owner_id"].dataType.simpleString()
    postings = stored.mapInArrow(_postings, _POSTING.format(owner=owner))
    postings = postings.withColumn("bucket", _bucket())
    postings.repartition("bucket", F.pmod("block", F.lit(8))).sortWithinPartitions("bucket", "owner_id", "term", "block").write.mode(
        "overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    corpus = stored.select("owner_id", F.size("tokens").alias("n_tokens")).groupBy("owner_id").agg(F.count(F.lit(1)).alias("chunks"), F.avg("n_tokens").alias("avg_len"))
    corpus.write.mode("overwrite").parquet(f"{folder}/corpus")


def indexed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The stored chunk table without the index's own columns."""
    return spark.read.parquet(f"{folder}/chunks").drop("ord", "tokens")


def _impact(tf: Column, size: Column) -> Column:
    """Weight of a term in a chunk without its idf; rises with ``tf`` and falls with ``size``."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.col("avg_len")))


def _squash(c: Column) -> Column:
    return F.round(c / (c + 1), SCORE_DIGITS)


def _score(limit: int):
    """Rows (q_key, block, avg_len, parts) -> q_key, ord, raw: chunks of the block with all terms, those that may be among the first ``limit``."""

    def run(batches):
        for batch in batches:
            keys, blocks, means = (batch.column(i).to_numpy() for i in range(3))
            parts = batch.column(3)
            first = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))])
            flat = parts.flatten()
            idf = pc.struct_field(flat, "idf").to_numpy(zero_copy_only=False)
            lists = [pc.struct_field(flat, n) for n in ("ords", "tfs", "sizes")]
            cut = np.concatenate([[0], np.cumsum(pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False))])
            ords, tfs, sizes = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
            out: list[list[np.ndarray]] = [[], [], []]
            for r in range(len(keys)):
                spans = [slice(cut[i], cut[i + 1]) for i in range(first[r], first[r + 1])]
                both = ords[min(spans, key=lambda s: s.stop - s.start)]
                for s in spans:
                    both = both[np.isin(both, ords[s], assume_unique=True)]
                if not len(both):
                    continue
                raw = np.zeros(len(both))
                for i, s in zip(range(first[r], first[r + 1]), spans, strict=True):
                    at = s.start + np.searchsorted(ords[s], both)
                    tf, size = tfs[at].astype(np.float64), sizes[at]
                    raw = raw + idf[i] * tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * size / means[r]))
                order = np.lexsort((both, -raw))
                raw, both = raw[order], both[order]
                if len(raw) > limit:
                    # Scores that rounding may tie with the last one stay; of equal ones the first by id suffice.
                    least = raw[limit - 1] / (1 + raw[limit - 1]) - _NEAR
                    runs = np.flatnonzero(np.concatenate([[True], raw[1:] != raw[:-1]]))
                    place = np.arange(len(raw)) - np.repeat(runs, np.diff(np.concatenate([runs, [len(raw)]])))
                    keep = (raw / (1 + raw) >= least) & (place < limit)
                    raw, both = raw[keep], both[keep]
                out[0].append(np.full(len(raw), keys[r]))
                out[1].append(blocks[r] + both)
                out[2].append(raw)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["q_key", "ord", "raw"])

    return run


def keyword_search(spark: SparkSession, folder: str, questions: DataFrame, limit: int = 20, stop_words: tuple[str, ...] = STOP_WORDS,
                   probes: int = PROBES) -> DataFrame:
    """The result of ``retrieval.keyword_search`` from a stored index.

    1. Posting heads (no lists) of the asked terms give document frequencies and, for each question and block that has
       all its terms, an upper bound of the score. Many questions meet only the rows of their own terms.
    2. The ``probes`` blocks of the highest bound are opened; the ``limit``-th best score becomes the question's threshold.
    3. Of the other blocks, those whose bound reaches the threshold are opened as well. The rest cannot enter the list.
    """
    asked = questions.select(
        "query_id", "owner_id", F.array_sort(F.array_distinct(terms(F.col("question"), stop_words))).alias("q_terms")
    ).filter(F.size("q_terms") > 0).withColumn("q_key", F.xxhash64("owner_id", "q_terms"))
    per_term = asked.select("owner_id", "q_key", F.size("q_terms").alias("wanted"), F.explode("q_terms").alias("term")).distinct()
    per_term = materialize(per_term.withColumn("bucket", _bucket()), "index-terms")
    keys = ["bucket", "owner_id", "term"]
    vocabulary = per_term.select(*keys).distinct()
    few = is_small(vocabulary, TERM_BOUND)
    owner = spark.read.parquet(f"{folder}/chunks").schema["owner_id"].dataType.simpleString()
    postings = spark.read.schema(f"{_POSTING.format(owner=owner)}, bucket int").parquet(f"{folder}/postings")
    heads = postings.select(*keys, "block", "n", "most", "shortest")
    heads = materialize(heads.join(small_side(vocabulary, few), keys, "left_semi"), "index-heads")
    frequency = heads.groupBy("owner_id", "term").agg(F.sum("n").alias("df"))
    corpus = spark.read.parquet(f"{folder}/corpus")
    weights = per_term.join(frequency, ["owner_id", "term"]).join(corpus, "owner_id").select(
        *keys, "q_key", "wanted", "avg_len", F.log1p((F.col("chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weights = materialize(weights, "index-weights")
    few = is_small(weights, TERM_BOUND)
    bound = F.col("idf") * _impact(F.col("most").cast("double"), F.col("shortest"))
    bounds = heads.join(small_side(weights, few), keys).groupBy("q_key", "block").agg(
        F.count(F.lit(1)).alias("_m"), F.first("wanted").alias("wanted"), F.sum(bound).alias("bound")).filter("_m = wanted")
    bounds = materialize(bounds.select("q_key", "block", _squash(F.col("bound")).alias("bound")), "index-bounds")

    def opened(chosen: DataFrame) -> DataFrame:
        wanted = chosen.select("q_key", "block").join(small_side(weights, few), "q_key")
        lists = postings.select(*keys, "block", "ords", "tfs", "sizes")
        met = lists.join(small_side(wanted, is_small(wanted, TERM_BOUND)), [*keys, "block"])
        part = F.struct("term", "idf", "ords", "tfs", "sizes")
        # One entry per question term, each of at most one block of chunks.
        rows = met.groupBy("q_key", "block").agg(F.first("avg_len").alias("avg_len"), F.sort_array(F.collect_list(part)).alias("parts"))
        found = rows.mapInArrow(_score(limit), "q_key long, ord long, raw double")
        return materialize(found.select("q_key", "ord", _squash(F.col("raw")).alias("score")), "index-scores")

    first = top_k(bounds, ["q_key"], [F.desc("bound"), F.col("block")], probes).select("q_key", "block")
    scored = opened(first)
    last = top_k(scored, ["q_key"], [F.desc("score"), F.col("ord")], limit, "_rank").filter(F.col("_rank") == limit).select("q_key", F.col("score").alias("least"))
    others = bounds.join(first, ["q_key", "block"], "left_anti").join(last, "q_key", "left")
    others = materialize(others.filter("bound >= coalesce(least, 0)").select("q_key", "block"), "index-others")
    if not others.isEmpty():
        scored = scored.union(opened(others))
    ids = spark.read.parquet(f"{folder}/chunks").select("ord", "chunk_id")
    # The last score of a question ties at most limit chunks a block; ids decide between them.
    named = ids.join(small_side(scored, is_small(scored)), "ord") if is_small(scored) else hot_join(scored, ids, ["ord"])
    best = top_k(named.select("q_key", "chunk_id", "score"), ["q_key"], [F.desc("score"), F.col("chunk_id")], limit)
    return asked.select("query_id", "q_key").join(best, "q_key").select("query_id", "chunk_id", "score", "rank", F.lit("keyword").alias("match_type"))


def search(spark: SparkSession, folder: str, questions: DataFrame, mode: str = "hybrid", limit: int = 20) -> DataFrame:
    """keyword, semantic, or anything else for hybrid, over the stored chunks; see ``retrieval.search``."""
    if mode == "keyword":
        return keyword_search(spark, folder, questions, limit)
    semantic = semantic_search(indexed_chunks(spark, folder), questions, limit)
    if mode == "semantic":
        return semantic
    return merge_hits(keyword_search(spark, folder, questions, limit), semantic, limit)
