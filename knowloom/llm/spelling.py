"""Spelling variants: words one edit apart, found by PartEnum signatures of their letter multisets."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowloom.functions.skew import hot_join
from knowloom.llm.shared import materialize

#: Runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8 bytes whose A-Z are lower-cased.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_OTHER = re.compile(rb"[^a-z\x80-\xff]")
_PIECE = 1 << 20
_HELD = 400_000
_MASK = (1 << 64) - 1


def _runs(text: bytes):
    """Counts of the different runs of a lower-cased text, piece by piece for long texts; no run is cut."""
    start = 0
    while start < len(text):
        stop = min(start + _PIECE, len(text))
        if stop < len(text):
            found = _OTHER.search(text, stop)
            stop = found.start() if found else len(text)
        yield Counter(_RUN.findall(text, start, stop))
        start = stop


def _altered(run: bytes, h: int) -> bytes:
    word = run.decode()
    at = h % len(word)
    return (word[:at] + word[at + 1:]).encode()


def word_counts(docs: DataFrame, letters: int = 6, one_in: int = 199) -> DataFrame:
    """word, n: occurrences over all documents of words of at least ``letters`` code points, counted per task before the shuffle."""

    def run(batches):
        held: Counter[bytes] = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                base = zlib.crc32(b"%s:" % (b"" if doc is None else str(doc).encode()))
                for counts in _runs((text.as_py() or b"").lower()):
                    for word, n in counts.items():
                        h = zlib.crc32(word, base)
                        if h % one_in == 0:
                            word = _altered(word, h)
                        # Two bytes a code point at most: shorter byte strings are too short for sure.
                        if len(word) >= letters:
                            held[word] += n
                if len(held) > _HELD:
                    yield out(held)
                    held = Counter()
        if held:
            yield out(held)

    def out(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.length("word") >= letters)


def _dimension(letter: str, nth: int, parts: int) -> tuple[int, int]:
    """Part and random number of one dimension: the ``nth`` occurrence of a letter."""
    h = xxhash.xxh64_intdigest(f"{letter}{nth}", 7)
    return h % parts, h


def signature_keys(word: str, parts: int, cache: dict) -> list[int]:
    """Join keys of a word. Any two words that differ by one edit share one.

    The word's letter multiset is a binary vector with one dimension for each (letter, occurrence); an edit changes at
    most two. Dimensions are dealt to ``parts`` parts, so vectors within distance two agree on all but two parts: each
    choice of parts - 2 parts is one signature. As one edit also leaves one of the word's halves alone, the members of
    a signature are further divided by half; halves are those of the shorter word of a pair, so that a word meets words
    of its length and of one letter more as the shorter one, and words of one letter less as the longer one.
    """
    acc, seen = [0] * parts, {}
    for letter in word:
        nth = seen[letter] = seen.get(letter, 0) + 1
        dim = cache.get((letter, nth))
        if dim is None:
            dim = cache[letter, nth] = _dimension(letter, nth, parts)
        acc[dim[0]] = (acc[dim[0]] + dim[1]) & _MASK
    halves = []
    for shorter in (len(word), len(word) - 1):
        half = shorter // 2
        halves.append(f"{shorter}<{word[:half]}")
        halves.append(f"{shorter}>{word[len(word) - (shorter - half):]}")
    out = []
    for half in halves:
        h = xxhash.xxh64_intdigest(half)
        for n, chosen in enumerate(combinations(range(parts), parts - 2)):
            key = h ^ (n * 0x9E3779B97F4A7C15)
            for i in chosen:
                key = ((key ^ acc[i]) * 0xD6E8FEB86659FD93 + i) & _MASK
                key ^= key >> 32
            out.append(key & _MASK)
    return out


def near_words(words: DataFrame, parts: int = 5) -> DataFrame:
    """Pairs (a, b), a < b, of different words (word) that differ by exactly one inserted, deleted or replaced code point."""

    def run(batches):
        cache: dict = {}
        for batch in batches:
            for piece in range(0, batch.num_rows, 4096):
                some = batch.column(0).slice(piece, 4096)
                keys = np.array([signature_keys(w, parts, cache) for w in some.to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), some.take(pa.array(np.repeat(np.arange(len(some)), keys.shape[1])))], ["key", "word"])

    # Spark sizes the keys by the file of the words, some 400 times too low: the join is told not to broadcast them.
    keyed = words.select("word").mapInArrow(run, "key long, word string").hint("merge")
    left, right = keyed.select("key", F.col("word").alias("a")), keyed.select(F.col("key").alias("_key"), F.col("word").alias("b"))
    met = left.join(right, (F.col("key") == F.col("_key")) & (F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "b").distinct()


def spelling_variants(docs: DataFrame, letters: int = 6, least: int = 5, ratio: int = 5, one_in: int = 199, parts: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of at least ``letters`` code points and ``least`` occurrences.

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` of whole texts, A-Z lower-cased; a run whose unsigned crc32 h of
    ``<doc_id>:<run>`` is divisible by ``one_in`` loses its code point h % length. n_near counts the words one edit
    apart. form is the near word of largest n (ties: smallest in code-point order) if that is at least ``ratio`` * n,
    form_n its n; root follows forms to the last one, the word itself if it has none.

    Near words come from PartEnum signatures (``signature_keys``), joined by equality, and are verified; none is missed.
    Forms at least multiply n, so chains are short: roots come from doubling, which ends when no word moves.
    No table of words is broadcast: the size of its compressed file, which Spark goes by, is far below that of its rows.

    Null texts have no words; a null doc_id counts as the empty string in the hash; repeated rows count again. An
    empty table gives no row. Extra columns are ignored.
    """
    words = materialize(word_counts(docs, letters, one_in).filter(F.col("n") >= least), "spelling-words")
    pairs = materialize(near_words(words, parts), "spelling-pairs")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = words.select(F.col("word").alias("b"), F.col("n").alias("_n")).hint("merge")
    best = hot_join(both, known, ["b"]).groupBy("a").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("_n")).alias("m"), F.col("b").alias("w"))).alias("_best"))
    rows = words.join(best.hint("merge"), words["word"] == best["a"], "left")
    fits = F.coalesce(-F.col("_best.m") >= ratio * F.col("n"), F.lit(False))
    rows = materialize(rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("_best.w")).alias("form"), F.when(fits, -F.col("_best.m")).alias("form_n")), "spelling-forms")
    steps = materialize(rows.filter("form is not null").select("word", F.col("form").alias("to")), "spelling-roots")
    while True:
        further = steps.select(F.col("word").alias("to"), F.col("to").alias("_next")).hint("merge")
        moved = hot_join(steps, further, ["to"], "left").select("word", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("_moved"))
        moved = materialize(moved, "spelling-roots")
        steps = moved.select("word", "to")
        if moved.filter("_moved").isEmpty():
            break
    roots = steps.select("word", F.col("to").alias("_root")).hint("merge")
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")
