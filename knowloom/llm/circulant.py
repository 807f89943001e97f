"""Near duplicates by circulant MinHash: two permutations, one of them shifted for every signature coordinate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowloom.functions.skew import hot_join, is_small, small_side
from knowloom.llm.profiles import Profiles, set_profile
from knowloom.llm.shared import connected_components, materialize
from knowloom.llm.simhash import shingle_hashes

BANDS, ROWS = 32, 4
#: Of 128 pairs of 2-bit coordinates 112 or 114 agree on average at similarity 0.85; 44 or more differ with probability below 1e-15.
MOST_DIFFER = 44
BLOCK = 512
_SHIFTS = np.arange(1, BANDS * ROWS + 1, dtype=np.uint32)[:, None]
_COLUMNS = 512
_SIGMA = (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))
_PI = (np.uint32(0x9E3779B1), np.uint32(0x27D4EB2F))
_SKETCH = ["s0", "s1", "s2", "s3"]


def _permute(x: np.ndarray, odd: tuple[np.uint32, np.uint32]) -> np.ndarray:
    """A permutation of the 32-bit integers: odd factors and shifted differences can be undone."""
    x = x * odd[0]
    x ^= x >> np.uint32(16)
    x *= odd[1]
    x ^= x >> np.uint32(15)
    return x


def signature(hashes: np.ndarray) -> np.ndarray:
    """128 coordinates of a set of 64-bit hashes: the minimum of pi(sigma(v) + k) for the shifts k = 1 to 128, over 2**32 places."""
    places = _permute((hashes >> np.uint64(32)).astype(np.uint32), _SIGMA)
    least = np.full(len(_SHIFTS), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(places), _COLUMNS):
        np.minimum(least, _permute(places[a:a + _COLUMNS] + _SHIFTS, _PI).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of ROWS coordinates."""
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        key = (key ^ rows[:, i]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key


def sketch(least: np.ndarray) -> np.ndarray:
    """The two lowest bits of all coordinates, bit plane by bit plane, as four 64-bit words."""
    return np.packbits([(least & np.uint32(1)).astype(np.uint8), ((least >> np.uint32(1)) & np.uint32(1)).astype(np.uint8)], axis=1).view(np.uint64).ravel()


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text or b"", words, 1))


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return tuple(int(x) for x in np.array([h >> 64, h & ((1 << 64) - 1)], np.uint64).view(np.int64))


def _prints(base: DataFrame, words: int) -> DataFrame:
    """_id, _row, n, d0 and d1 (128-bit digest of the shingle set), sketch, band keys; null digest, sketch and keys for empty sets."""

    def run(batches):
        for batch in batches:
            sizes, digests, sketches, keys = [], [], [], []
            for t in batch.column(2):
                x = shingle_set(t.as_py(), words)
                sizes.append(len(x))
                if len(x):
                    least = signature(x)
                    digests.append(_digest(x))
                    sketches.append(sketch(least).view(np.int64).tolist())
                    keys.append(band_keys(least).view(np.int64))
                else:
                    digests.append((None, None))
                    sketches.append((None,) * 4)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *[pa.array(c, pa.int64()) for c in zip(*digests, strict=True)],
                *[pa.array(c, pa.int64()) for c in zip(*sketches, strict=True)], pa.array(keys, pa.list_(pa.int64()))], names)

    def nonempty(batches):
        return run(b for b in batches if b.num_rows)

    names = ["_id", "_row", "n", "d0", "d1", *_SKETCH, "keys"]
    schema = ", ".join(f"{c} long" for c in names[:-1]) + ", keys array<long>"
    return base.select("_id", "_row", F.col("_text").cast("binary")).mapInArrow(nonempty, schema)


def _of_nodes(asked: DataFrame, base: DataFrame, words: int, make, kind: str, name: str) -> DataFrame:
    """node and ``make`` of its whole shingle set, which is made again from a text of the node. ``asked``: node, row, d0, d1."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), words) for t in batch.column(3)]
            # Other rows may share the 64-bit row name; the digest tells whose text it is.
            mine = pa.array([_digest(x) == (a, b) for x, a, b in zip(sets, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], pa.bool_())
            made = pa.array([make(x) for x in sets], pa.list_(pa.int64()) if kind == "array<long>" else pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], ["node", "made"]).filter(mine)

    asked = materialize(asked, "circulant-asked")
    texts = base.select("_row", "_text").join(small_side(asked, is_small(asked)), F.col("_row") == F.col("row"))
    made = texts.select("node", "d0", "d1", F.col("_text").cast("binary")).mapInArrow(run, f"node long, made {kind}")
    return materialize(made.dropDuplicates(["node"]), name)


def _verified(pairs: DataFrame, nodes: DataFrame, base: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of nodes those whose whole sets have the similarity."""
    pairs = materialize(pairs, "circulant-pairs")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    asked = hot_join(nodes, asked, ["node"], "left_semi").select("node", "row", "d0", "d1")
    sets = _of_nodes(asked, base, words, lambda x: x.view(np.int64), "array<long>", "circulant-sets")
    compared = hot_join(hot_join(pairs, sets.select(F.col("node").alias("b"), F.col("made").alias("y")), ["b"]), sets.select(F.col("node").alias("a"), F.col("made").alias("x")), ["a"])
    both = F.size(F.array_intersect("x", "y"))
    return materialize(compared.filter(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b"), "circulant-links")


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose set sizes and sketches allow the similarity, with ``differ``, the number of differing coordinates."""
    sizes = nodes.select("node", "n", *_SKETCH)
    x = sizes.select(F.col("node").alias("a"), F.struct("n", *_SKETCH).alias("x"))
    y = sizes.select(F.col("node").alias("b"), F.struct("n", *_SKETCH).alias("y"))
    pairs = hot_join(hot_join(pairs, y, ["b"]), x, ["a"])
    differ = sum(F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}")).bitwiseOR(F.col(f"x.s{i + 2}").bitwiseXOR(F.col(f"y.s{i + 2}")))) for i in (0, 1))
    pairs = pairs.withColumn("differ", differ)
    return pairs.filter((100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & (F.col("differ") <= MOST_DIFFER)).select("a", "b", "differ")


def _open(met: DataFrame, links: DataFrame) -> DataFrame:
    """The members (key, node, part) of buckets that hold several connected parts."""
    parts = connected_components(links)
    named = hot_join(met.select("key", "node"), parts, ["node"], "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    named = materialize(named, "circulant-parts")
    several = named.groupBy("key").agg(F.min("part").alias("_x"), F.max("part").alias("_y"), F.count(F.lit(1)).alias("m")).filter("_x < _y").select("key", "m")
    return materialize(hot_join(named, several, ["key"]), "circulant-open")


def _cells(percent: int):
    """Pairs of different parts in a cell: of rows with side 0 among themselves, or of side 0 with side 1 where there is a side 1.

    A pair leaves the bucket of the first band that its sets share, and no other.
    """

    def run(batches):
        for batch in batches:
            for key, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = cell.as_py()
                keys = np.array([r["keys"] for r in rows], np.int64)
                side, node, part, n = (np.array([r[k] for r in rows], np.int64) for k in ("side", "node", "part", "n"))
                words = np.array([[r[s] for s in _SKETCH] for r in rows], np.int64).view(np.uint64)
                profiles = Profiles([r["made"] for r in rows])
                crossing = bool(side.any())
                others = np.flatnonzero(side == 1) if crossing else np.arange(len(node))
                for i in np.flatnonzero(side == 0).tolist():
                    to = others if crossing else others[i + 1:]
                    x = words[to] ^ words[i]
                    differ = np.bitwise_count(x[:, :2] | x[:, 2:]).sum(axis=1)
                    to = to[(part[to] != part[i]) & (differ <= MOST_DIFFER) & (100 * np.minimum(n[to], n[i]) >= percent * np.maximum(n[to], n[i]))]
                    same = keys[to] == keys[i]
                    to = to[keys[i][same.argmax(axis=1)] == key]
                    most = profiles.most_shared(i, to)
                    b = node[to[100 * most >= percent * (n[to] + n[i] - most)]]
                    if len(b):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(b, node[i])), pa.array(np.maximum(b, node[i]))], ["a", "b"])

    return run


def _crossing(members: DataFrame, nodes: DataFrame, base: DataFrame, words: int, percent: int) -> DataFrame:
    """All possible pairs of different parts in open buckets; a bucket of over BLOCK members is cut into cells of two blocks.

    Profiles bound the intersections so closely that few pairs leave a cell which do not have the similarity.
    """
    asked = hot_join(nodes, members.select("node").distinct(), ["node"], "left_semi")
    made = _of_nodes(asked.select("node", "row", "d0", "d1"), base, words, set_profile, "binary", "circulant-profiles")
    rows = hot_join(members, hot_join(nodes.select("node", "n", *_SKETCH, "keys"), made, ["node"]), ["node"])
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = rows.withColumn("i", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    row = F.struct(F.when(F.col("i") > F.col("j"), 1).otherwise(0).alias("side"), "node", "part", "n", *_SKETCH, "keys", "made")
    cells = rows.groupBy("key", F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v")).agg(F.collect_list(row).alias("rows"))
    # A cell of two different blocks needs both; one of a block with itself has side 0 alone.
    cells = cells.filter((F.col("u") == F.col("v")) | (F.exists("rows", lambda r: r["side"] == 0) & F.exists("rows", lambda r: r["side"] == 1)))
    return cells.select("key", "rows").mapInArrow(_cells(percent), "a long, b long").distinct()


def minhash_classes(docs: DataFrame, words: int = 3, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set), component_id (smallest doc_id reachable), kept.

    A document's set holds the different ``words``-word shingles of its text, A-Z lower-cased and split at ASCII spaces; with
    fewer words the whole sequence is the one shingle. Documents are linked if 100 x intersection >= ``percent`` x
    union. Null and wordless texts have an empty set and are linked with nothing, not even each other.

    Equal sets are one node, named by a 128-bit digest. Circulant MinHash: one permutation places the shingles, a second
    one, shifted by k, gives coordinate k. 32 bands of 4 of the 128 coordinates miss a pair of similarity 0.85 with
    probability 5e-11; pairs of a bucket are dropped early only by bounds on their whole sets (sizes, profiles) or by
    2-bit sketches that similar pairs fail with probability below 1e-15. All links are confirmed on full sets. Members of a bucket are first compared
    with one or two of them, so that a group of near copies joins with few comparisons; then all pairs of members that are
    not yet connected are compared.

    doc_id is carried as it is; rows that repeat stay rows of their own. Null ids are linked as well, get the smallest id
    of their class (null if it has none) and are not kept. Extra columns are ignored; an empty table gives no row.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    base = base.select("_id", F.xxhash64("_id", "_text").alias("_row"), "_text")
    prints = materialize(_prints(base, words), "circulant-prints")
    nodes = prints.filter("d0 is not null").groupBy("d0", "d1").agg(
        F.min("_id").alias("id"), F.min_by(F.struct(F.col("_row").alias("row"), "n", *_SKETCH, "keys"), "_row").alias("one"))
    nodes = materialize(nodes.select("d0", "d1", "id", "one.*", F.monotonically_increasing_id().alias("node")), "circulant-nodes")

    thin = nodes.select("node", F.explode("keys").alias("key"))
    buckets = thin.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("first")).filter("m > 1").select("key", "first")
    met = materialize(hot_join(thin, buckets, ["key"]), "circulant-met")
    links = None
    members = met.withColumnRenamed("first", "with")
    for _ in range(2):
        pairs = members.filter("node <> with").select(F.col("node").alias("a"), F.col("with").alias("b")).distinct()
        best = _possible(pairs, nodes, percent).groupBy("a").agg(F.min_by("b", F.struct("differ", "b")).alias("b"))
        found = _verified(best, nodes, base, words, percent)
        links = found if links is None else links.union(found)
        opened = _open(met, links)
        pivots = opened.groupBy("key").agg(F.max_by("node", F.xxhash64("node", "key")).alias("with"), F.max_by("part", F.xxhash64("node", "key")).alias("_with"))
        members = hot_join(opened, pivots, ["key"]).filter("part <> _with")
    links = links.union(_verified(_crossing(opened, nodes, base, words, percent), nodes, base, words, percent))

    parts = connected_components(links)
    classes = hot_join(nodes.select("node", "id", "d0", "d1"), parts, ["node"], "left").withColumn("part", F.coalesce("component", "node"))
    least = classes.groupBy("part").agg(F.min("id").alias("least"))
    named = hot_join(classes, least, ["part"]).select("d0", "d1", "least")
    known = hot_join(prints.filter("d0 is not null").select("_id", "n", "d0", "d1"), named, ["d0", "d1"]).select("_id", "n", "least")
    rows = known.union(prints.filter("d0 is null").select("_id", "n", F.col("_id").alias("least")))
    return rows.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), F.coalesce(F.col("_id") == F.col("least"), F.lit(False)).alias("kept"))
