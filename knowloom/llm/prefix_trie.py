"""Trie of conversation prefixes from vertical bitmaps: (position, turn) -> bitset of conversations."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowloom.functions.skew import hot_join
from knowloom.llm.shared import materialize

SHARD = 4096
_ROOT = bytes(16)
_NOTHING = hashlib.sha256(b"").hexdigest()


def turn_positions(conversations: DataFrame) -> DataFrame:
    """conv, at (from 1), said (16 bytes that name role and text), size (code points of the text).

    Turns are sorted by (conversation, turn, said) over ranges, so that a conversation of any length spreads over many
    tasks; a small table of runs (conversation x partition) turns places in partitions into places in conversations.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), said.alias("said"), F.length(text).cast("long").alias("size"))
    rows = rows.filter("conv is not null").repartitionByRange("conv", "turn", "said").sortWithinPartitions("conv", "turn", "said")
    placed = materialize(rows.select("conv", "said", "size", F.monotonically_increasing_id().alias("seq")), "trie-turns")
    placed = placed.withColumn("run", F.shiftright("seq", 33))
    runs = placed.groupBy("conv", "run").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return hot_join(placed, runs, ["conv", "run"]).select("conv", (F.col("seq") - F.col("first") + F.col("before") + 1).alias("at"), "said", "size")


def rebuilt(turns: DataFrame, block: int = 100, longest: int = 6) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (conv, at, said, size) and one row (conv, n) for each, turnless ones included.

    The first h = crc32(decimal conv) % longest turns come from the conversation that opens the block of ``block`` ids, the
    others are the conversation's own after its first h.
    """
    lengths = turns.groupBy("conv").agg(F.max("at").alias("own"))
    opener = F.col("conv") - F.pmod(F.col("conv"), F.lit(block))
    borrowed = F.crc32(F.col("conv").cast("string").cast("binary")) % longest
    plan = lengths.select("conv", "own", opener.alias("opener"), borrowed.alias("h"))
    had = lengths.filter(F.pmod("conv", F.lit(block)) == 0).select(F.col("conv").alias("opener"), F.col("own").alias("_had"))
    plan = plan.join(had, "opener", "left").withColumn("k", F.least("h", F.coalesce("_had", F.lit(0))))
    plan = materialize(plan.select("conv", "opener", "h", "k", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "trie-plan")
    own = hot_join(turns, plan, ["conv"]).filter("at > h").select("conv", (F.col("at") - F.col("h") + F.col("k")).alias("at"), "said", "size")
    heads = turns.filter((F.pmod("conv", F.lit(block)) == 0) & (F.col("at") < longest)).select(F.col("conv").alias("opener"), "at", "said", "size")
    taken = plan.join(heads, "opener").filter("at <= h").select("conv", "at", "said", "size")
    return materialize(own.union(taken), "trie-rebuilt"), plan.select("conv", "n")


class Shard:
    """Stems of up to SHARD conversations, bit i being the i-th in ascending id order."""

    def __init__(self) -> None:
        self.convs: list[int] = []
        self.owns: list[int] = []
        self.stems: list[list[tuple[bytes, int]]] = []
        self.tailed = self.leaves = 0

    def add(self, conv: int, tailed: bool, owns: int, leaf: bool) -> None:
        bit = 1 << len(self.convs)
        self.tailed |= bit * tailed
        self.leaves |= bit * leaf
        self.convs.append(conv)
        self.owns.append(owns)
        self.stems.append([])

    def walk(self):
        """Nodes in depth-first order: (key, parent's place, depth, size of the last text, members, members whose stem ends here)."""
        postings: dict[tuple[int, bytes], int] = defaultdict(int)
        stops: dict[int, int] = defaultdict(int)
        for i, stem in enumerate(self.stems):
            for at, (said, _) in enumerate(stem):
                postings[at, said] |= 1 << i
            stops[len(stem)] |= 1 << i
        out = []
        stack = [(_ROOT, -1, 0, 0, (1 << len(self.convs)) - 1)]
        while stack:
            key, parent, depth, size, members = stack.pop()
            here = members & stops[depth]
            place = len(out)
            out.append((key, parent, depth, size, members, here))
            rest = members & ~here
            while rest:
                said, n = self.stems[(rest & -rest).bit_length() - 1][depth]
                child = rest & postings[depth, said]
                rest &= ~child
                stack.append((hashlib.blake2b(key + said, digest_size=16).digest(), place, depth + 1, n, child))
        return out

    def ids(self, bits: int) -> list[int]:
        out = []
        while bits:
            low = bits & -bits
            out.append(self.convs[low.bit_length() - 1])
            bits ^= low
        return out

    def nodes(self):
        """Per node of the shard: key, parent, depth, n_convs, conv (smallest member), ends (joined ids), tails (ids)."""
        walked = self.walk()
        for key, parent, depth, _, members, here in walked:
            ends = ",".join(map(str, self.ids(here & ~self.tailed)))
            yield key, walked[parent][0] if depth else None, depth, members.bit_count(), self.convs[(members & -members).bit_length() - 1], ends, self.ids(here & self.tailed)

    def sums(self):
        """Per node of the shard: key, leaves owned by its members, saved tokens of its subtree as far as this shard holds members."""
        walked = self.walk()
        saved = [0] * len(walked)
        for i in range(len(walked) - 1, -1, -1):
            key, parent, depth, size, members, _ = walked[i]
            owner = self.owns[(members & -members).bit_length() - 1] <= depth
            saved[i] += (members.bit_count() - owner) * size
            if depth:
                saved[parent] += saved[i]
            yield key, (members & self.leaves).bit_count(), saved[i]


def _by_shard(method: str, names: list[str], types: list[pa.DataType]):
    """Rows sorted by (shard, place, at), the row with at = 0 opening a conversation -> the rows of ``method`` of each shard."""

    def batch(shard, number):
        columns = list(zip(*getattr(shard, method)(), strict=True))
        return pa.RecordBatch.from_arrays([pa.array([number] * len(columns[0]), pa.int64()), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["shard", *names])

    def run(batches):
        shard, number = None, None
        for rows in batches:
            for n, at, conv, said, size, tailed, owns, leaf in zip(*[c.to_pylist() for c in rows.columns], strict=True):
                if n != number:
                    if shard is not None:
                        yield batch(shard, number)
                    shard, number = Shard(), n
                if at == 0:
                    shard.add(conv, tailed, owns, leaf)
                else:
                    shard.stems[-1].append((said, size))
        if shard is not None:
            yield batch(shard, number)

    return run


def _digests(batches):
    """Rows (key, chunk) sorted by key and then by shard -> one SHA-256 a key over its chunks joined by commas, as a stream."""
    key, state = None, None
    for batch in batches:
        keys, digests = [], []
        for k, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k == key:
                state.update(b"," + chunk.encode())
                continue
            if key is not None:
                keys.append(key)
                digests.append(state.hexdigest())
            key, state = k, hashlib.sha256(chunk.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def _sharded(headers: DataFrame, stems: DataFrame, how) -> DataFrame:
    """``how`` over the shards. headers: conv, place, tailed, owns, leaf; stems: conv, at, said, size."""
    none = F.lit(None)
    opening = headers.select("place", F.lit(0).cast("long").alias("at"), "conv", none.cast("binary").alias("said"), none.cast("long").alias("size"), "tailed", "owns", "leaf")
    said = hot_join(stems, headers.select("conv", "place"), ["conv"]).select(
        "place", "at", "conv", "said", "size", none.cast("boolean").alias("tailed"), none.cast("long").alias("owns"), none.cast("boolean").alias("leaf"))
    rows = opening.union(said).select(F.expr(f"place div {SHARD}").alias("shard"), "*")
    rows = rows.repartition("shard").sortWithinPartitions("shard", "place", "at")
    method, schema, names, types = how
    return rows.select("shard", "at", "conv", "said", "size", "tailed", "owns", "leaf").mapInArrow(_by_shard(method, names, types), schema)


_NODES = ("nodes", "shard long, key binary, parent binary, depth long, n_convs long, conv long, ends string, tails array<long>",
          ["key", "parent", "depth", "n_convs", "conv", "ends", "tails"],
          [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())])
_SUMS = ("sums", "shard long, key binary, n_leaves long, saved_tokens long", ["key", "n_leaves", "saved_tokens"], [pa.binary(), pa.int64(), pa.int64()])


def prefix_trie(conversations: DataFrame, block: int = 100, longest: int = 6) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (see ``rebuilt``); a node is a sequence of (role, text).

    conv_id: smallest member; depth; parent_conv_id; n_convs; n_children; n_leaves: childless nodes of its subtree, top
    included; saved_tokens: over its subtree, (n_convs - 1) x code points of the last text; ends_sha256 of the ascending,
    comma-joined ids of the members that end there.

    Conversations, in ascending id order, fall into shards of 4096. A shard indexes (position, turn) -> bitset and walks
    depth first: the parent's bitset and a posting give a child, its population count and its end list. Shards know a
    node by a chained 128-bit digest; counts of all shards are added map-side. A conversation owns the nodes whose
    smallest member it is, always a suffix of its path, so that each node and leaf is counted by one shard in a second walk.
    From the first (position, turn) of a single conversation on, nodes have one member; they need no bitset and are
    made by columns alone. A shard holds the digests of its conversations' shared beginnings.

    Turns are ordered by turn (null first); equal turns by a digest of role and text. Null role and text are empty.
    Rows with null conv_id take no part; repeated rows are turns of their own. An empty table gives no node, not even a
    root. Extra columns are ignored.
    """
    turns, plan = rebuilt(turn_positions(conversations), block, longest)
    single = turns.groupBy("at", "said").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv")).filter("n = 1")
    single = single.groupBy("conv").agg(F.min("at").alias("tail"))
    sorted_plan = plan.join(single, "conv", "left").repartitionByRange("conv").sortWithinPartitions("conv")
    headers = materialize(sorted_plan.select("conv", "n", F.coalesce("tail", F.col("n") + 1).alias("tail"), F.monotonically_increasing_id().alias("place")), "trie-headers")
    headers = headers.withColumn("tailed", F.col("tail") <= F.col("n"))
    split = hot_join(turns, headers.select("conv", "tail", "n"), ["conv"])
    stems = materialize(split.filter("at < tail").select("conv", "at", "said", "size"), "trie-stems")

    unowned = headers.withColumn("owns", F.lit(0).cast("long")).withColumn("leaf", F.lit(False))
    parts = materialize(_sharded(unowned, stems, _NODES), "trie-parts")
    nodes = parts.groupBy("key").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.min("conv").alias("conv"), F.sum(F.size("tails")).alias("n_tails"))
    below = parts.filter("depth > 0").select("parent", "key").distinct().groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_below"))
    nodes = nodes.join(below, "key", "left").withColumn("n_children", F.coalesce("n_below", F.lit(0)) + F.col("n_tails"))
    nodes = materialize(nodes.select("key", "parent", "depth", "n_convs", "conv", "n_children"), "trie-nodes")

    owned = nodes.groupBy("conv").agg(F.min("depth").alias("owns"), F.max(F.col("n_children") == 0).alias("leaf"))
    owners = headers.join(owned, "conv", "left").select(
        "conv", "place", "tailed", F.coalesce("owns", F.lit((1 << 62))).alias("owns"), (F.col("tailed") | F.coalesce("leaf", F.lit(False))).alias("leaf"))
    sums = _sharded(owners, stems, _SUMS).groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    chunks = parts.filter("ends <> ''").select("key", "ends", "shard").repartition("key").sortWithinPartitions("key", "shard")
    ends = chunks.select("key", "ends").mapInArrow(_digests, "key binary, ends_sha256 string")
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"))
    shared = hot_join(nodes.filter("depth > 0"), parents, ["parent"]).select(*nodes.columns, "parent_conv_id")
    shared = shared.union(nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    shared = shared.join(sums, "key").join(ends, "key", "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"))

    tops = hot_join(parts.select("key", F.explode("tails").alias("_tail")), nodes.select("key", F.col("conv").alias("_above")), ["key"]).select("_tail", "_above")
    tails = hot_join(split.filter("at >= tail").select("conv", "at", "tail", "n"), tops.withColumnRenamed("_tail", "conv"), ["conv"])
    last = F.col("at") == F.col("n")
    one = F.lit(1).cast("long")
    digest: Column = F.when(last, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(F.lit(_NOTHING))
    alone = tails.select(
        F.col("conv").alias("conv_id"), F.col("at").alias("depth"), F.when(F.col("at") == F.col("tail"), F.col("_above")).otherwise(F.col("conv")).alias("parent_conv_id"),
        one.alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), digest.alias("ends_sha256"))
    return shared.union(alone)
