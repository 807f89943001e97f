"""SimHash near-dedup with covering locality-sensitive hashing."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowloom.functions.skew import hot_join, is_small, small_side
from knowloom.llm.shared import arrow_rows, connected_components, materialize

MAX_BUCKET = 8192
_STEP = 65_536
#: Texts or sets in an Arrow batch, shingles counted at a time and possible pairs made at a time: they bound a worker's memory.
BATCH_ROWS = 1000
COUNTED = 1 << 21
PAIRS = 1 << 18


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of the space-joined word shingles of a lower-cased text; fewer words give one shingle, none give none."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    last = max(0, len(found) - words) + 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:last].tolist()
    stops = ends[min(words, len(found)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, last)


def simhash(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; zero for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), _STEP):
        bits = np.unpackbits(hashes[a:a + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def word_hashes(text: bytes, seed: int) -> np.ndarray:
    """XXH64 of the different words of a lower-cased text."""
    found = set(text.lower().split())
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in found), np.uint64, len(found))


def fingerprints(docs: DataFrame, words: int | None, seeds: tuple[int, ...]) -> DataFrame:
    """doc_id, f0, f1, ...: one SimHash for each seed, as signed longs; of word shingles, or of the different words for None."""
    names = ["doc_id", *[f"f{i}" for i in range(len(seeds))]]

    def run(batches):
        for batch in batches:
            out = np.zeros((len(seeds), batch.num_rows), np.uint64)
            for j, text in enumerate(batch.column(1)):
                data = text.as_py() or b""
                for i, seed in enumerate(seeds):
                    out[i, j] = simhash(word_hashes(data, seed) if words is None else shingle_hashes(data, words, seed))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x.view(np.int64)) for x in out]], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    """2**(radius + 1) - 1 masks of which at least one hides every difference of any ``radius`` bits or fewer.

    Each bit position gets a vector over GF(2) of radius + 1 dimensions, each mask a nonzero vector v, and a mask keeps
    the positions whose vector is not orthogonal to v. ``radius`` vectors never span all dimensions, so some v is
    orthogonal to all differing positions and its mask keeps none of them. Vectors are dealt evenly in a seeded order.
    """
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(64)]
    random.Random(seed + radius).shuffle(vectors)
    return [sum(1 << b for b in range(64) if (v & vectors[b]).bit_count() % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _tables(rows: DataFrame, radius: int, level: int, key: list[str]) -> DataFrame:
    """Each row in all tables of one level: the earlier key plus the table's masked fingerprint."""
    masks = covering_masks(radius, 7 + level)
    each = F.explode(F.array(*[
        F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)]))
    return rows.select("fp", *key, each.alias("_e")).select("fp", *key, F.col("_e.t").alias(f"t{level}"), F.col("_e.k").alias(f"k{level}"))


def _bucket_links(radius: int):
    """Links of bounded buckets: pairs within the radius that join parts not yet joined, so fewer than there are members."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for members in batch.column(0):
                x = np.sort(np.array(members.as_py(), np.int64)).view(np.uint64)
                part = np.arange(len(x))
                for i in range(len(x) - 1):
                    near = i + 1 + np.flatnonzero(np.bitwise_count(x[i + 1:] ^ x[i]) <= radius)
                    for j in near[part[near] != part[i]].tolist():
                        if part[j] != part[i]:
                            part[part == part[j]] = part[i]
                            a.append(int(x[i].view(np.int64)))
                            b.append(int(x[j].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def fingerprint_links(distinct: DataFrame, radius: int, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (a, b) between different fingerprints whose connected parts are those of all pairs within ``radius`` bits.

    A bucket of up to ``max_bucket`` fingerprints is searched in one task. The members of a larger bucket go through
    another set of covering tables with other masks inside that bucket, which again keeps every close pair together,
    and so on: each level fixes about half of the bits that are still free, so buckets end at 2**free fingerprints.
    """
    parts: list[DataFrame] = []
    rows, key = distinct.select("fp"), []
    for level in range(6):
        rows = _tables(rows, radius, level, key)
        key = [*key, f"t{level}", f"k{level}"]
        sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("fp").alias("_a"), F.max("fp").alias("_b")).filter("_n > 1")
        sizes = materialize(sizes, f"simhash-sizes{level}")
        pairs = sizes.filter("_n = 2").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        parts.append(pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
        middle = sizes.filter(F.col("_n").between(3, max_bucket)).select(*key)
        lists = hot_join(rows, middle, key, "left_semi").groupBy(*key).agg(F.collect_list("fp").alias("fps")).select("fps")
        parts.append(lists.mapInArrow(_bucket_links(radius), "a long, b long"))
        large = sizes.filter(F.col("_n") > max_bucket).select(*key)
        if large.isEmpty():
            break
        rows = materialize(hot_join(rows, large, key, "left_semi"), f"simhash-rows{level}")
    else:
        raise RuntimeError("buckets did not shrink")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def hex64(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def near_duplicate_classes(docs: DataFrame, words: int = 3, radius: int = 3, seed: int = 42, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Links join fingerprints that differ in at most ``radius`` bits. Equal fingerprints meet in one aggregate, so copies
    cost nothing further. Null and wordless texts have fingerprint zero, linked like any other. Repeated rows return
    one row each; null ids get the smallest id of their class, null if it has none. An empty table gives no row.
    """
    prints = materialize(fingerprints(docs, words, (seed,)).withColumnRenamed("f0", "fp"), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    links = fingerprint_links(distinct, radius, max_bucket)
    parts = connected_components(links)
    owner = distinct.join(parts, distinct["fp"] == parts["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("part"))
    least = owner.groupBy("part").agg(F.min("first").alias("component_id"))
    named = owner.join(least, "part").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """node, shingles: sorted different 32-bit hashes of the word shingles of ``docs`` (node, text), as little-endian bytes."""

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py() or b"", words, 1).astype(np.uint32)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    return docs.select("node", F.col("text").cast("binary")).mapInArrow(run, "node long, shingles binary")


def _frequent(base: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes (sorted) and counts of those that recur within a task. They only order shingles: any order is exact, rare first is fast."""

    def run(batches):
        held, size = [], 0

        def flush():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= 3
            return pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int32)), pa.array(counts[often].astype(np.int64))], ["token", "n"])

        for batch in batches:
            for t in batch.column(0):
                held.append(np.unique(shingle_hashes(t.as_py() or b"", words, 1).astype(np.uint32)))
                size += len(held[-1])
                if size > COUNTED:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counted = base.select(F.col("text").cast("binary")).mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "token").limit(1 << 20).toArrow()
    tokens, counts = top.column("token").to_numpy().view(np.uint32), top.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _prefixes(base: DataFrame, words: int, similarity: float, all_up_to: int) -> DataFrame:
    """node, id, digest of the shingle set (null if empty), its size n and SimHash fp, and the first n - ceil(similarity n) + 1 shingles,
    rare ones first; ``often`` marks those known to be in more than ``all_up_to`` sets."""
    with arrow_rows(base.sparkSession, BATCH_ROWS):
        common = base.sparkSession.sparkContext.broadcast(_frequent(base, words))

    def run(batches):
        tokens, counts = common.value
        for batch in batches:
            digests, sizes, heads, often, prints = [], [], [], [], []
            for t in batch.column(2):
                whole = np.unique(shingle_hashes(t.as_py() or b"", words, 1))
                x = np.unique(whole.astype(np.uint32))
                rank = np.zeros(len(x), np.int64)
                if len(tokens) and len(x):
                    at = np.minimum(np.searchsorted(tokens, x), len(tokens) - 1)
                    rank = np.where(tokens[at] == x, counts[at], 0)
                keep = len(x) - math.ceil(similarity * len(x) - 1e-9) + 1 if len(x) else 0
                digests.append(np.uint64(xxhash.xxh64_intdigest(x.tobytes(), 9)).astype(np.int64).item() if len(x) else None)
                sizes.append(len(x))
                first = np.lexsort((x, rank))[:keep]
                heads.append(x[first].view(np.int32))
                often.append(rank[first] > all_up_to)
                prints.append(np.uint64(simhash(whole)).astype(np.int64).item())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(digests, pa.int64()), pa.array(sizes, pa.int32()), pa.array(heads, pa.list_(pa.int32())),
                pa.array(often, pa.list_(pa.bool_())), pa.array(prints, pa.int64())], ["node", "id", "digest", "n", "head", "often", "fp"])

    rows = base.select("node", "id", F.col("text").cast("binary"))
    with arrow_rows(base.sparkSession, BATCH_ROWS):
        return materialize(rows.mapInArrow(run, "node long, id long, digest long, n int, head array<int>, often array<boolean>, fp long"), "near-heads")


def _possible(n1, p1, n2, p2, similarity: float):
    """Whether sets of n1 and n2 shingles whose first shared one stands at p1 and p2 can still be alike."""
    most = np.minimum(n1 - p1, n2 - p2)
    return most >= similarity * (n1 + n2 - most) - 1e-9


def _meet(similarity: float, all_up_to: int):
    """Rows sorted by token -> possible pairs (a, b) of different parts, of tokens in up to ``all_up_to`` sets; the rows of others as
    token, a, n, p without b."""
    names = ["token", "a", "b", "n", "p"]

    def out(token, a, b, n, p):
        return pa.RecordBatch.from_arrays([pa.array(token, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int32()), pa.array(p, pa.int32())], names)

    def whole(token, node, n, p, part):
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        lengths = np.diff(np.concatenate([starts, [len(token)]]))
        for length in np.unique(lengths[(lengths > 1) & (lengths <= all_up_to)]).tolist():
            i, j = np.triu_indices(length, 1)
            for some in np.array_split(starts[lengths == length], max(1, -(-int((lengths == length).sum()) * len(i) // PAIRS))):
                x, y = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
                ok = (part[x] != part[y]) & _possible(n[x], p[x], n[y], p[y], similarity)
                a, b = node[x[ok]], node[y[ok]]
                if len(a):
                    none = np.full(len(a), None)
                    yield out(none, np.minimum(a, b), np.maximum(a, b), none, none)
        for s, length in zip(starts[lengths > all_up_to].tolist(), lengths[lengths > all_up_to].tolist(), strict=True):
            yield out(token[s:s + length], node[s:s + length], np.full(length, None), n[s:s + length], p[s:s + length])

    def run(batches):
        held, passing = None, None
        for batch in batches:
            now = [np.asarray(c) for c in batch.columns]
            if not len(now[0]):
                continue
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if passing is not None:
                # Rows of a token that is already known to be in many sets leave as they come.
                more = int(np.searchsorted(held[0], passing, side="right"))
                if more:
                    token, node, n, p, _ = (c[:more] for c in held)
                    yield out(token, node, np.full(more, None), n, p)
                held = [c[more:] for c in held]
            if not len(held[0]):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last token may go on
            if cut:
                yield from whole(*[c[:cut] for c in held])
                held = [c[cut:] for c in held]
            passing = None
            if len(held[0]) > all_up_to:
                passing = held[0][0]
                yield from whole(*held)
                held = [c[:0] for c in held]
        if held is not None and len(held[0]):
            yield from whole(*held)

    return run


def _cell_links(similarity: float):
    """Links of a cell by its whole sets: among its rows of side 0, or of side 0 with side 1 where there is a side 1.

    Only links that join parts not yet joined leave, so fewer than the cell has rows.
    """

    def run(batches):
        for batch in batches:
            for cell in batch.column(0):
                rows = cell.as_py()
                side, node, part, p = (np.array([r[k] for r in rows], np.int64) for k in ("side", "a", "part", "p"))
                n = np.array([len(r["shingles"]) // 4 for r in rows], np.int64)
                seen, flat = np.unique(np.concatenate([np.frombuffer(r["shingles"], np.uint32) for r in rows]), return_inverse=True)
                sets = np.split(flat, np.cumsum(n)[:-1])
                mine = np.zeros(len(seen), np.int64)
                crossing = bool(side.any())
                a, b = [], []
                for i in np.flatnonzero(side == 0).tolist():
                    to = np.flatnonzero(side == 1) if crossing else np.arange(i + 1, len(node))
                    to = to[(part[to] != part[i]) & _possible(n[i], p[i], n[to], p[to], similarity)]
                    if not len(to):
                        continue
                    mine[sets[i]] = 1
                    both = np.add.reduceat(mine[np.concatenate([sets[j] for j in to.tolist()])], np.cumsum(n[to]) - n[to])
                    mine[sets[i]] = 0
                    for j in to[both >= similarity * (n[i] + n[to] - both)].tolist():
                        if part[j] != part[i]:
                            part[part == part[j]] = part[i]
                            a.append(min(node[i], node[j]))
                            b.append(max(node[i], node[j]))
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _crossing(rows: DataFrame, base: DataFrame, heads: DataFrame, words: int, similarity: float, block: int) -> DataFrame:
    """Links (a, b) that join all parts with similar sets under one token, from rows (token, a, n, p, part).

    Alike sets differ in size by the similarity at most, so they fall into the same or adjacent size classes. The sets of a
    token and class are dealt to blocks of about ``block``; a cell compares a block with itself, with a later block of its
    class, or with one of the next class, so that every pair meets once a token. A cell holds whole sets and lets out only
    links that join its parts (see ``_cell_links``), so what leaves follows the rows and not their pairs.
    """
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(similarity)) + 1e-9).cast("int")
    sets = _sets(rows.select(F.col("a").alias("digest")).distinct(), base, heads, words)
    sets = sets.select(F.col("node").alias("a"), "shingles")
    rows = rows.select("token", "a", "n", "p", "part", size_class.alias("c"))
    blocks = rows.groupBy("token", "c").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("k"))
    before = blocks.select("token", (F.col("c") + 1).alias("c"), F.col("k").alias("k_before"))
    after = blocks.select("token", (F.col("c") - 1).alias("c"), F.col("k").alias("k_after"))
    counted = blocks.join(before, ["token", "c"], "left").join(after, ["token", "c"], "left").na.fill(0, ["k_before", "k_after"])
    mine = hot_join(rows, counted, ["token", "c"]).withColumn("i", F.pmod(F.xxhash64("a"), F.col("k")).cast("int"))

    def cell(c, d, u, v, side):
        return F.struct(c.cast("int").alias("c"), d.cast("int").alias("d"), u.cast("int").alias("u"), v.cast("int").alias("v"), side.cast("int").alias("side"))

    def each(k, make):
        return F.when(k > 0, F.transform(F.sequence(F.lit(0), k - 1), make)).otherwise(F.array().cast("array<struct<c:int,d:int,u:int,v:int,side:int>>"))

    c, i = F.col("c"), F.col("i")
    own = each(F.col("k"), lambda j: cell(c, c, F.least(i, j), F.greatest(i, j), (i > j)))
    up = each(F.col("k_after"), lambda j: cell(c, c + 1, i, j, F.lit(0)))
    down = each(F.col("k_before"), lambda j: cell(c - 1, c, j, i, F.lit(1)))
    dealt = hot_join(mine.select("token", "a", "p", "part", F.concat(own, up, down).alias("cells")), sets, ["a"]).withColumn("e", F.explode("cells"))
    row = F.struct(F.col("e.side").alias("side"), "a", "part", "p", "shingles")
    cells = dealt.groupBy("token", "e.c", "e.d", "e.u", "e.v").agg(F.collect_list(row).alias("rows"))
    # A cell of two blocks needs both sides.
    alone = (F.col("c") == F.col("d")) & (F.col("u") == F.col("v"))
    cells = cells.filter(alone | (F.exists("rows", lambda r: r["side"] == 0) & F.exists("rows", lambda r: r["side"] == 1)))
    with arrow_rows(base.sparkSession, BATCH_ROWS):
        return materialize(cells.select("rows").mapInArrow(_cell_links(similarity), "a long, b long").distinct(), "near-crossing")


def _sets(asked: DataFrame, base: DataFrame, heads: DataFrame, words: int) -> DataFrame:
    """node, shingles: the whole shingle sets of the asked digests, each made again from one text."""
    first = heads.filter("digest is not null").groupBy("digest").agg(F.min("node").alias("_node"))
    asked = materialize(first.join(small_side(asked, is_small(asked)), "digest"), "near-asked")
    texts = base.join(small_side(asked, is_small(asked)), F.col("node") == F.col("_node")).select(F.col("digest").alias("node"), "text")
    with arrow_rows(base.sparkSession, BATCH_ROWS):
        return materialize(shingle_sets(texts, words).dropDuplicates(["node"]), "near-sets")


def _alike(similarity: float):
    """Pairs (a, b) with both sets x and y -> those that have the similarity."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, base: DataFrame, heads: DataFrame, words: int, similarity: float) -> DataFrame:
    """Of pairs (a, b) of set digests those whose whole sets have the similarity."""
    with arrow_rows(base.sparkSession, BATCH_ROWS):
        pairs = materialize(pairs.distinct(), "near-pairs")
    sets = _sets(pairs.select(F.col("a").alias("digest")).union(pairs.select(F.col("b").alias("digest"))).distinct(), base, heads, words)
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    compared = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    with arrow_rows(base.sparkSession, BATCH_ROWS):
        return materialize(compared.mapInArrow(_alike(similarity), "a long, b long"), "near-links")


def _close_pairs(heads: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of set digests whose SimHashes differ in up to ``radius`` bits: each with the first of its fingerprint, the first
    ones of fingerprints along the links of the covering tables. No more than rows and links."""
    known = heads.filter("digest is not null").select("digest", "fp").distinct()
    firsts = materialize(known.groupBy("fp").agg(F.min("digest").alias("first")), "near-prints")
    same = hot_join(known, firsts, ["fp"]).filter("digest <> first").select(F.col("digest").alias("x"), F.col("first").alias("y"))
    links = fingerprint_links(firsts, radius)
    near = links.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    return same.union(near.select("x", "y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _open_tokens(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The rows, with their part, of tokens whose sets are not yet all in one connected part."""
    parts = connected_components(links)
    named = rows.join(parts, rows["a"] == parts["node"], "left").select("token", "a", "n", "p", F.coalesce("component", "a").alias("part"))
    named = materialize(named, "near-parts")
    several = named.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("part").alias("_x"), F.max("part").alias("_y")).filter("_x < _y").select("token", "m")
    return materialize(hot_join(named, several, ["token"]), "near-open")


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, all_up_to: int = 64, block: int = 256, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the document with the smallest doc_id stays.

    Two documents are linked if the sets of their ``shingle``-word shingles have a Jaccard similarity of ``similarity``
    or more; groups are the connected parts. Equal sets are one node.

    SimHash with covering tables comes first: fingerprints within ``radius`` bits meet without a miss (``fingerprint_links``),
    and links whose whole sets are similar join their documents. Similar sets may differ in more bits, most of all short ones,
    so an exact check follows on all pairs that are not yet joined: in any order of all shingles, two such sets share one
    among the first n - ceil(similarity n) + 1 of each (prefix filter). The order puts rare shingles first. Every possible pair of
    a shingle in up to ``all_up_to`` sets is compared by whole sets. The sets of a more common one meet, while they are in
    several parts, in cells of two blocks of about ``block`` sets, which compare whole sets and let out joining links only
    (see ``_crossing``).

    Null and wordless texts have an empty set and are never near copies. Rows that repeat id and text share their fate;
    null ids count as the largest. The columns of ``docs`` are returned as they are; an empty table stays empty.
    """
    node = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")))
    base = docs.select(node.alias("node"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), "text")
    heads = _prefixes(base, shingle, similarity, all_up_to)
    links = _verified(_close_pairs(heads, radius), base, heads, shingle, similarity)
    parts = connected_components(links)
    joined = heads.filter("digest is not null").join(small_side(parts, is_small(parts)), F.col("digest") == parts["node"], "left")
    each = joined.select("digest", "n", F.coalesce("component", "digest").alias("part"), F.posexplode(F.arrays_zip("head", "often")).alias("p", "h"))
    each = each.select(F.col("h.head").alias("token"), "digest", "n", "p", "part", F.col("h.often").alias("often"))
    # Shingles of one set meet nothing, so most rows end here; they are sorted, not aggregated. Those known to be frequent need no meeting.
    met = materialize(each.filter("not often").select("token", "digest", "n", "p", "part").repartition("token").sortWithinPartitions("token").mapInArrow(_meet(similarity, all_up_to), "token int, a long, b long, n int, p int"), "near-met")
    links = links.union(_verified(met.filter("b is not null").select("a", "b"), base, heads, shingle, similarity))
    large = met.filter("b is null").select("token", "a", "n", "p").union(each.filter("often").select("token", F.col("digest").alias("a"), "n", "p"))
    large = large.distinct()
    if not large.isEmpty():
        rows = _open_tokens(large, links)
        links = links.union(_crossing(rows, base, heads, shingle, similarity, block))
    parts = connected_components(links)
    names = heads.filter("digest is not null").select("node", "id", "digest")
    members = names.join(small_side(parts, is_small(parts)), names["digest"] == parts["node"], "left").select(
        names["node"], F.col("id").alias("_id"), F.coalesce("component", "digest").alias("component"))
    several = members.groupBy("component").agg(F.min(F.struct("_id", "node")).alias("_keep"), F.min("node").alias("_x"), F.max("node").alias("_y")).filter("_x < _y")
    several = materialize(several.select("component", "_keep"), "near-groups")
    lost = members.join(small_side(several, is_small(several)), "component").filter(F.col("node") != F.col("_keep.node"))
    lost = materialize(lost.select(F.col("node").alias("_node")).distinct(), "near-lost")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), node.alias("_key"))
    return rows.join(small_side(lost, is_small(lost)), F.col("_key") == F.col("_node"), "left_anti").select("_row.*")
