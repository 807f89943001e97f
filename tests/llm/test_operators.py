"""The operators against brute force on small rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from knowloom.llm import (
    ann, exact_dedup, license_scan, mixing, packing, quality, queries, range_coder, repeats, shared, simhash, token_files, tokens, url_filters,
)
from knowloom.llm.run_index import RunIndex

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, _norm string, copy int"
RNG = np.random.default_rng(5)
WORDS = ["".join(RNG.choice(list("abcdefghij"), RNG.integers(2, 9))) for _ in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def rows():
    passage = prose(60, 900)
    base = [
        (0, prose(80, 1)), (1, None), (2, ""), (3, " \t\n "), (4, prose(80, 1)), (4, prose(80, 1)), (5, prose(80, 1).replace(" ", "  \n", 3)),
        (6, prose(30, 2) + " " + passage + " " + prose(30, 3)), (7, passage), (8, "x" + passage + "y"), (9, "a" * 900), (10, "ab" * 450),
        (11, "Das häßliche Wörtchen élan 漢字 " * 20), (12, prose(4000, 4)), (13, "one"), (14, "One"), (None, prose(50, 5)), (None, None),
        (15, " lead  and trail \n"), (16, "it's they'll 123 45!? \u00a0x\u0301 e\u0301"),
    ]
    near = prose(200, 6).split(" ")
    for i in range(6):
        words = list(near)
        words[10 + 7 * i] = f"changed{i}"
        base.append((30 + i, " ".join(words)))
    return [(d, t, "en", None if i % 9 == 8 else f"s{i % 3 if i % 2 else 0}", None, "k", "n", 1) for i, (d, t) in enumerate(base)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def normal(t):
    return re.sub(rb"[ \t-\r]+", b" ", (t or "").encode())


@pytest.mark.parametrize("table_bytes", [exact_dedup.TABLE_BYTES, 3000])
def test_exact_duplicates(docs, table_bytes):
    groups = defaultdict(list)
    for r in rows():
        groups[normal(r[1])].append(r[0])
    want = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep, hashlib.sha256(t).hexdigest())] += 1
    assert bag(exact_dedup.exact_duplicates(docs, table_bytes), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


def test_drop_duplicates(docs, nothing):
    out = exact_dedup.drop_duplicates(docs)
    assert out.columns == docs.columns
    texts = [normal(r["text"]) for r in out.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {normal(r[1]) for r in rows()}
    assert exact_dedup.exact_duplicates(nothing).count() == 0 and exact_dedup.drop_duplicates(nothing).count() == 0


def test_content_table_compares_contents():
    table = exact_dedup.ContentTable()
    for i in range(3000):
        table.add(b"\0" * 32, b"%d" % (i % 1500), i, 1)
    assert len(table.contents) == 1500 and set(table.sizes) == {2}


def brute_repeats(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, np.int8)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = 1
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length, gram, max_group", [(200, 80, 8192), (200, 80, 1), (60, 20, 8192), (60, 20, 2)])
def test_repeats(docs, nothing, length, gram, max_group):
    data = rows()
    want = Counter((r[0], *x) for r, x in zip(data, brute_repeats([(r[1] or "").encode() for r in data], length)))
    assert bag(repeats.remove_repeats(docs, length, gram, max_group), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert repeats.remove_repeats(nothing, length, gram, max_group).count() == 0


def test_repeats_of_random_small_alphabet(spark):
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("ab"), rng.integers(0, 90))) for _ in range(60)]
    texts += [t[10:70] + "q" for t in texts[:20]] + ["abc" * 40, "c" * 70]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = Counter((i, *x) for i, x in enumerate(brute_repeats([t.encode() for t in texts], 14)))
    assert bag(repeats.remove_repeats(df, 14, 5), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_anchors_of_long_texts_meet_chunk_edges(monkeypatch):
    monkeypatch.setattr(repeats, "_CHUNK", 300)
    text = RNG.integers(97, 100, 2000).astype(np.uint8).tobytes()
    key, start, windows, head = repeats.Anchors(40, 12).runs(text)
    assert np.concatenate([np.arange(a, a + n) for a, n in zip(start, windows)]).tolist() == list(range(2000 - 39))
    assert all(w - 1 <= h <= 28 for w, h in zip(windows, head))


def test_run_index_streams_longest_matches():
    rng = np.random.default_rng(2)
    for _ in range(20):
        strings = [bytes(rng.choice([0, 97, 98], rng.integers(0, 25))) for _ in range(rng.integers(1, 8))]
        index = RunIndex(strings)
        found = index.matching_statistics()
        suffixes = [(i, j) for i, s in enumerate(strings) for j in range(len(s))]
        for i, j in suffixes:
            best = 0
            for k, m in suffixes:
                if (k, m) != (i, j):
                    x, y = strings[i][j:], strings[k][m:]
                    best = max(best, next((n for n, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y))))
            assert found[index.starts[i] + j] == best
    assert RunIndex([b"abcabc" * 20] * 30).runs < 200


def test_url_verdicts(spark):
    urls = [
        (1, "http://a.net/x"), (2, "https://Example.NET/en/1?q#f"), (3, "http://x.example.net/de/"), (4, "http://net"), (5, "http://example.com/de/z"),
        (6, "http://example.com/den"), (7, "http://a.b.org/fr/#t"), (8, "ftp://org/fr/x"), (9, None), (10, "no scheme"), (11, "http://"), (12, "http:///net/"),
        (1, "http://a.net/x"), (None, "http://q.net/"), (13, "http://anet/"), (14, "x://y://net/"), (15, "http://a.net?x/y"), (16, "http://www.example.net/en/\nz"),
    ]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[2] if fits else None, max(fits)[3] if fits else "allow"

    df = spark.createDataFrame([(*u, 7) for u in urls], "page_id long, url string, host int")
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("", "/", "block")], "host string, path string, action string")
    got = url_filters.url_verdicts(df, table)
    assert bag(got, "page_id", "host", "path", "rule", "verdict") == Counter((i, *judge(u)) for i, u in urls)
    assert url_filters.url_verdicts(df.limit(0), table).count() == 0
    assert {r[0] for r in url_filters.url_verdicts(df, table.limit(0)).select("verdict").collect()} == {"allow"}


def test_whole_licenses_are_known(spark):
    by = defaultdict(list)
    for name, text in license_scan.NOTICES:
        by[name].append(text)
    mit = next(t for t in by["MIT"] if t.startswith("MIT License")).split("\n\n", 1)[1]
    apache = max(by["Apache-2.0"], key=len)
    header = ("Copyright 2020 Someone\n\nLicensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\n"
              "You may obtain a copy of the License at\n\n    https://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\n"
              "distributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n"
              "See the License for the specific language governing permissions and\nlimitations under the License.\n")
    texts = [("MIT", "The MIT License (MIT)\n\nCopyright (c) 2021 A\n\n" + mit), ("MIT", "Copyright (c) 2021 A\n\n" + mit), ("Apache-2.0", apache), ("Apache-2.0", header)]
    for name in ("BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "MPL-2.0", "CC0-1.0", "Unlicense", "GPL-3.0-or-later"):
        texts.append((name, "Copyright (c) 2021 A. All rights reserved.\n\n" + max(by[name], key=len)))
    texts.append((None, apache + " and more"))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = dict(license_scan.scan_licenses(df, license_scan.known_licenses(spark)).select("doc_id", "text_license").collect())
    assert got == {i: name for i, (name, _) in enumerate(texts)}


def shingles(t, n):
    w = (t or "").encode().lower().split()
    return [b" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def plain_simhash(t, n, seed):
    h = [xxhash.xxh64_intdigest(s, seed) for s in shingles(t, n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, links):
    part = list(range(n))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for a, b in links:
        part[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("max_bucket", [1024, 3])
def test_simhash_classes(spark, docs, nothing, max_bucket):
    data = rows()
    prints = [plain_simhash(r[1], 3, 42) for r in data]
    part = components(len(data), [(i, j) for i, j in combinations(range(len(data)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3])
    least = {c: min((data[i][0] for i in range(len(data)) if part[i] == c and data[i][0] is not None), default=None) for c in part}
    want = Counter((r[0], f"{p:016x}", least[c]) for r, p, c in zip(data, prints, part))
    assert bag(simhash.near_duplicate_classes(docs, max_bucket=max_bucket), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicate_classes(nothing).count() == 0


def test_covering_masks_hide_any_differences():
    for radius in (3, 4):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(3000):
            bits = sum(1 << int(b) for b in RNG.choice(64, radius, replace=False))
            assert any(not m & bits for m in masks)


@pytest.mark.parametrize("max_bucket", [1024, 8])
def test_fingerprint_links_connect_all_close_pairs(spark, max_bucket):
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 1 << 63, 6).tolist()
    points = sorted({s ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for s in seeds for _ in range(40)})
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"), 3, max_bucket).collect()
    at = {p: i for i, p in enumerate(signed)}
    assert all((points[at[r["a"]]] ^ points[at[r["b"]]]).bit_count() <= 3 for r in links)
    want = components(len(points), [(i, j) for i, j in combinations(range(len(points)), 2) if (points[i] ^ points[j]).bit_count() <= 3])
    assert components(len(points), [(at[r["a"]], at[r["b"]]) for r in links]) == want


def test_drop_near_duplicates(spark, docs, nothing):
    unique = docs.dropDuplicates(["text"])
    out = simhash.drop_near_duplicates(unique)
    assert out.columns == docs.columns
    got = {r["doc_id"] for r in out.collect()}
    data = {r["doc_id"]: set(shingles(r["text"], 5)) for r in unique.collect() if r["doc_id"] is not None}
    assert got & set(range(30, 36)) == {30}
    assert all(len(data[a] & data[b]) < 0.9 * len(data[a] | data[b]) for a, b in combinations(got - {None}, 2) if len(data[a] | data[b]) > 100)
    assert set(data) - got <= {i for i in data if any(j < i and data[i] and len(data[i] & data[j]) >= 0.8 * len(data[i] | data[j]) for j in data)} | set(range(31, 36))
    assert simhash.drop_near_duplicates(nothing).count() == 0


def test_near_copies_at_the_threshold_are_candidates(spark):
    """Documents edited down to a similarity of just over 0.8: nine in ten are found, and no other document goes."""
    data = []
    for i in range(150):
        words = prose(180, 50_000 + i).split(" ")
        data.append((i, " ".join(words)))
        for p in np.random.default_rng(i).choice(180, 3, replace=False):
            words[p] = f"edit{i}x{p}"
        data.append((1000 + i, " ".join(words)))
    left = {r[0] for r in simhash.drop_near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).select("doc_id").collect()}
    assert set(range(150)) <= left and len(left) <= 165


def near_copy_parts(texts):
    """First ids of the groups by brute force over all pairs."""
    data = [set(shingles(t, 5)) for t in texts]
    alike = [(i, j) for i, j in combinations(range(len(data)), 2) if data[i] and len(data[i] & data[j]) >= 0.8 * len(data[i] | data[j])]
    part = components(len(data), alike)
    return {part.index(x) for x in part}


@pytest.mark.parametrize("all_up_to, block", [(64, 256), (4, 3)])
def test_near_copies_are_found_beside_representatives(spark, all_up_to, block):
    """Equal word sets in another order, and groups of over 16 sets that share their words or a passage."""
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[::-1]), " ".join(words), " ".join([*words[:39], "w39", "w39"])]
    for g in range(3):
        start = prose(60, 70 + g).split(" ")
        for i in range(24):
            own = list(start)
            own[5 + i // 2] = f"e{g}x{i}"
            texts.append(" ".join(own))
        texts += [" ".join([*start[:30], *prose(30, 900 + 40 * g + i).split(" ")]) for i in range(20)]
        texts += [" ".join(np.random.default_rng(i).permutation(start)) for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r[0] for r in simhash.drop_near_duplicates(df, all_up_to=all_up_to, block=block).select("doc_id").collect()}
    assert got == near_copy_parts(texts)


def test_near_copies_of_short_texts_are_all_found(spark):
    """Texts of 9 to 60 words whose last word is another: each pair of similarity 0.8 or more loses its copy, no other text goes."""
    data, lost = [], set()
    for i in range(200):
        words = prose(9 + i % 52, 70_000 + i).split(" ")
        edited = [*words[:-1], f"edit{i}"]
        data += [(i, " ".join(words)), (1000 + i, " ".join(edited))]
        a, b = set(shingles(data[-2][1], 5)), set(shingles(data[-1][1], 5))
        lost |= {1000 + i} if len(a & b) >= 0.8 * len(a | b) else set()
    df = spark.createDataFrame(data, "doc_id long, text string")
    left = {r[0] for r in simhash.drop_near_duplicates(df).select("doc_id").collect()}
    assert len(lost) > 150 and left == {d for d, _ in data} - lost


def test_near_dedup_bounds_what_a_worker_holds(spark):
    # 1000 shingles of 64 sets each: two million possible pairs must not be made at a time.
    n = 64_000
    token, node = np.repeat(np.arange(1000, dtype=np.int32), 64), np.arange(n)
    batch = pa.RecordBatch.from_arrays([pa.array(token), pa.array(node), pa.array(np.full(n, 100, np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(node)],
                                       ["token", "digest", "n", "p", "part"])
    sizes = [out.num_rows for out in simhash._meet(0.8, 64)([batch])]
    assert sum(sizes) == 1000 * 64 * 63 // 2 and max(sizes) <= simhash.PAIRS + 64 * 63 // 2
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with shared.arrow_rows(spark, simhash.BATCH_ROWS):
        rows = spark.range(3000, numPartitions=1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long")
        assert max(r[0] for r in rows.collect()) <= simhash.BATCH_ROWS
    assert spark.conf.get(name) == before


def test_near_copies_meet_by_covering_simhash_first(spark):
    """Long texts with one changed word are within three bits: the covering tables alone propose nearly all of them, in fewer pairs than rows."""
    texts = []
    for g in range(20):
        words = prose(400, 30_000 + g).split(" ")
        texts += [" ".join(words), " ".join([*words[:-1], f"edit{g}"]), " ".join([*words[:-1], f"other{g}"])]
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "node long, id long, text string")
    heads = simhash._prefixes(df, 5, 0.8, 64)
    digest = {r["node"]: r["digest"] for r in heads.collect()}
    prints = {r["digest"]: r["fp"] & ((1 << 64) - 1) for r in heads.collect()}
    pairs = {(r["a"], r["b"]) for r in simhash._close_pairs(heads, 3).distinct().collect()}
    assert pairs and len(pairs) < len(texts) and all((prints[a] ^ prints[b]).bit_count() <= 3 for a, b in pairs)
    at = {d: i for i, d in digest.items()}
    close = [(i, j) for i, j in combinations(range(len(texts)), 2) if (prints[digest[i]] ^ prints[digest[j]]).bit_count() <= 3]
    assert len(close) >= 30 and components(len(texts), [(at[a], at[b]) for a, b in pairs]) == components(len(texts), close)


def test_cells_let_out_joining_links_only():
    """A group of 120 alike sets leaves its cell in 119 links, not in its 7140 pairs; sets that are not alike leave none."""
    rng = np.random.default_rng(2)

    def row(i, group):
        x = np.unique(np.concatenate([np.arange(1000 * group, 1000 * group + 60), [10_000_000 + i]]).astype(np.uint32))
        return {"side": 0, "a": i, "part": i, "p": 0, "shingles": x.tobytes()}

    cell = [row(i, 1) for i in range(120)] + [row(200 + i, 2 + i) for i in range(50)]
    rng.shuffle(cell)
    kind = pa.list_(pa.struct([("side", pa.int32()), ("a", pa.int64()), ("part", pa.int64()), ("p", pa.int32()), ("shingles", pa.binary())]))
    for rows, sides in ((cell, None), ([r | {"side": r["a"] % 2} for r in cell], 2)):
        batch = pa.RecordBatch.from_arrays([pa.array([rows], kind)], ["rows"])
        links = [(r["a"], r["b"]) for out in simhash._cell_links(0.8)([batch]) for r in out.to_pylist()]
        assert len(links) == 119 and len(set(components(120, links))) == 1 and (not sides or all(a % 2 != b % 2 for a, b in links))


def test_connected_components(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [tuple(map(int, rng.integers(2000, 2200, 2))) for _ in range(120)]
    got = dict(shared.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    part = components(len(nodes), [(at[a], at[b]) for a, b in edges if a != b])
    assert got == {x: nodes[part[at[x]]] for x in nodes}


def check_pieces(got, ids, window):
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for s, parts in by.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == window or s == max(by)
    want, seen = Counter(), defaultdict(list)
    for doc_id, x in ids:
        want[(doc_id, x.tobytes())] += 1
    for r in got:
        seen[r["doc_id"]].append(r)
    for doc_id, parts in seen.items():
        texts = [np.frombuffer(t, "<u4") for (d, t), n in want.items() if d == doc_id for _ in range(n)]
        assert sum(r["length"] for r in parts) == sum(len(t) for t in texts)
        for r in parts:
            assert any(len(t) == r["doc_tokens"] and zlib.crc32(t[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for t in texts)


def plain_ids(name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary(name))
    return [(r[0], np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, end], "<u4")) for r in rows()]


@pytest.mark.parametrize("targets, max_queues", [(None, 1024), ({"s0": 0.2, "s1": 0.7, "s2": 0.1}, 1024), (None, 2), ({"s1": 0.6}, 2)])
def test_packing(docs, nothing, targets, max_queues):
    path = queries.vocabulary(queries.WORD_BPE)
    got = packing.pack(docs, path, window=64, targets=targets, spaces=tokens.DROPPED, max_queues=max_queues).collect()
    check_pieces(got, plain_ids(queries.WORD_BPE, 1), 64)
    assert packing.pack(nothing, path).count() == 0


def test_targets_hold_beyond_the_queue_bound(spark):
    rows = [(i, prose(30, 1000 + i % 7), f"s{i % 60}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(df, queries.vocabulary(queries.WORD_BPE), window=64, targets={"s3": 0.5}, spaces=tokens.DROPPED, max_queues=4).collect()
    total = sum(r["length"] for r in got)
    mine = sum(r["length"] for r in got if r["source"] == "s3")
    share = 0.5 / (0.5 + 1 - mine / total)
    early = [r for r in got if r["sequence_id"] < 0.8 * mine / (64 * share)]
    assert abs(sum(r["length"] for r in early if r["source"] == "s3") / sum(r["length"] for r in early) - share) < 0.02


def test_mixture_plan_keeps_to_targets():
    plan = packing.MixturePlan([50_000, 30_000, 400, 20_000], [0.5, 0.3, 0.05, 0.15], 128)
    position = np.concatenate([np.arange(0, t, 50) for t in (50_000, 30_000, 400, 20_000)])
    queue = np.repeat(np.arange(4), [1000, 600, 8, 400])
    row, start, length, at = plan.pieces(position, np.full(len(position), 50), queue)
    order = np.argsort(at)
    assert at[order][0] == 0 and (at[order][1:] == (at + length)[order][:-1]).all() and length.sum() == 100_400
    first = at // 128 < 40
    share = np.bincount(queue[row[first]], length[first], 4) / length[first].sum()
    assert np.abs(share - [0.5, 0.3, 0.05, 0.15]).max() < 0.002
    for w in range(40):
        inside = at // 128 == w
        assert np.abs(np.bincount(queue[row[inside]], length[inside], 4) - 128 * np.array([0.5, 0.3, 0.05, 0.15])).max() <= 4


def test_token_files(docs, nothing):
    path = queries.vocabulary(queries.BYTE_BPE)
    got = token_files.token_round_trip(docs, path, 2, tokens.LEADING, block_ids=70).collect()
    ids = plain_ids(queries.BYTE_BPE, 2)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((d, len(x), zlib.crc32(x.tobytes())) for d, x in ids)
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0, *[r["n_tokens"] for r in ordered]])[:-1].tolist()
    known = [r["doc_id"] for r in ordered if r["doc_id"] is not None]
    assert known == sorted(known) and ordered[0]["doc_id"] is None
    assert token_files.token_round_trip(nothing, path, 2).count() == 0


@pytest.mark.parametrize("width", [2, 4])
def test_range_coder_round_trip(width):
    rng = np.random.default_rng(3)
    top = 50_257 if width == 2 else 1 << 32
    blocks = [rng.integers(0, top, n).astype(f"u{width}") for n in (0, 1, 5, 300)] + [np.tile(rng.integers(0, top, 9), 60).astype(f"u{width}"), np.zeros(500, f"u{width}")]
    coded = range_coder.encode_blocks(blocks, width)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, range_coder.decode_blocks(coded)))
    assert range_coder.decode_blocks(coded[3:4])[0].tolist() == blocks[3].tolist()
    assert len(coded[5]) < 120 and len(coded[4]) < len(blocks[4]) * width / 4
    broken = bytearray(coded[3])
    broken[40] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        range_coder.decode_blocks([bytes(broken)])


def test_crc_join():
    for a, b in ((b"", b"x"), (b"abc", b""), (b"q" * 1000, b"rs" * 777)):
        assert token_files.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("name, spaces", [(queries.WORD_BPE, tokens.DROPPED), (queries.BYTE_BPE, tokens.LEADING), (queries.BYTE_BPE, tokens.WHOLE)])
def test_word_encoder_equals_whole_text(monkeypatch, name, spaces):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    e = tokens.WordEncoder(queries.vocabulary(name), spaces)
    rng = np.random.default_rng(9)
    odd = list("aB é\u0301漢 \n\t\u00a0\u2003'!.,12s") + ["  ", " \n", "'s ", "<|endoftext|>", "İ", "Σ", "ß ", " "]
    texts = ["".join(rng.choice(odd, rng.integers(0, 40))) for _ in range(3000)] + [r[1] or "" for r in rows()]
    want = e.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, e.code).tolist() for x in e.encode(texts)] == [w.ids for w in want]


@pytest.mark.parametrize("name, spaces", [(queries.WORD_BPE, tokens.DROPPED), (queries.BYTE_BPE, tokens.LEADING), (queries.BYTE_BPE, tokens.WHOLE)])
def test_added_tokens_are_encoded_as_by_a_fresh_tokenizer(name, spaces):
    from tokenizers import Tokenizer

    texts = ["see <|endoftext|> here", "a<|startoftext|>b c", "<|endoftext|>", "x <|endoftext|><|endoftext|>  y ", "<|ENDOFTEXT|> z", "<|endof text|> see here"]
    plain, e = Tokenizer.from_file(queries.vocabulary(name)), tokens.WordEncoder(queries.vocabulary(name), spaces)
    for _ in range(2):  # the second time from kept words
        assert [np.frombuffer(x, e.code).tolist() for x in e.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_poisson_mixture(spark, docs, nothing):
    rates = {r["source"]: r["rate"] for r in mixing.source_rates(docs).collect()}
    want = Counter()
    for r in rows():
        text = f"1|{'' if r[0] is None else r[0]}|{r[3] or ''}"
        u, rate = int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2 ** 52, rates[r[3]]
        k, p = 0, math.exp(-rate)
        total = p
        while u >= total:
            k += 1
            p = p * rate / k
            total += p
        want.update({(r[0], r[3], i): 1 for i in range(1, k + 1)} if k else {})
    out = mixing.poisson_mixture(docs)
    assert bag(out, "row.doc_id", "row.source", "copy") == want
    keys = [r[0] for r in out.select("mix_key").collect()]
    assert keys == sorted(keys)
    assert out.select("row.*").columns == docs.columns
    assert mixing.poisson_mixture(nothing).count() == 0
    assert mixing.tail_of(16.0) < 1e-12
    with pytest.raises(ValueError):
        mixing.source_rates(docs, max_rate=100.0)


def test_poisson_mixture_reaches_targets_of_rare_sources(spark):
    """A source with 1 % of the text and a target of 40 % needs 40 repetitions; one with 0.05 % and 5 % needs 100."""
    df = spark.createDataFrame([(i, "x" * 100, "big" if i >= 210 else "rare" if i >= 10 else "tiny") for i in range(20_000)], "doc_id long, text string, source string")
    targets = {"big": 0.55, "rare": 0.4, "tiny": 0.05}
    rates = {r["source"]: r["rate"] for r in mixing.source_rates(df, targets=targets).collect()}
    assert abs(rates["rare"] - 40) < 0.01 and abs(rates["tiny"] - 100) < 0.01
    got = mixing.poisson_mixture(df, targets=targets).groupBy("row.source", "row.doc_id").count().collect()
    total = sum(r["count"] for r in got)
    assert all(abs(sum(r["count"] for r in got if r["source"] == s) / total - w) < 0.01 for s, w in targets.items())
    rare = np.array([r["count"] for r in got if r["source"] == "rare"])
    assert len(rare) == 200 and 0.6 < rare.var() / 40 < 1.5


def test_poisson_mixture_reaches_targets(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.lit("x" * 50).alias("text"))
    counts = dict(mixing.poisson_mixture(df, targets={"s0": 0.5, "s1": 0.4, "s2": 0.1}).groupBy("row.source").count().collect())
    assert abs(counts["s0"] / 30_000 - 0.5) < 0.02 and abs(counts["s1"] / 30_000 - 0.4) < 0.02 and abs(counts["s2"] / 30_000 - 0.1) < 0.02


def test_license_scan(spark):
    mit = next(t for i, t in license_scan.NOTICES if t.startswith("MIT License"))
    data = [
        (1, "Copyright (c) 2020 Somebody\n" + mit.upper()), (2, mit.replace("sublicense", "sub-licence")), (3, None), (4, ""),
        (5, "Text.\nReleased under the MIT Licence!\nReleased under the MIT License."), (5, "Text.\nReleased under the MIT Licence!\nReleased under the MIT License."),
        (6, "It was released under the MIT License."), (None, "Licensed under CC BY-NC 4.0."), (7, "© x\n\n All rights reserved.\n"),
    ]
    df = spark.createDataFrame([(*d, "q") for d in data], "doc_id long, text string, license_id string")
    known = license_scan.known_licenses(spark)
    got = bag(license_scan.scan_licenses(df, known), "doc_id", "text_license", "line_licenses", "n_license_lines")
    assert got == Counter({
        (1, "MIT", None, 0): 1, (2, None, None, 0): 1, (3, None, None, 0): 1, (4, None, None, 0): 1, (5, None, "MIT", 2): 2, (6, None, None, 0): 1,
        (None, "CC-BY-NC-4.0", "CC-BY-NC-4.0", 1): 1, (7, None, None, 0): 1})
    assert license_scan.scan_licenses(df.limit(0), known).count() == 0


def test_nearest_reaches_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    data += [(5000 + i, x[7].tolist()) for i in range(60)] + [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [None] * 16), (9080, []), (None, x[3].tolist())]
    data += [data[20], (40, x[40].tolist()), (8000, [1.0, 2.0]), (8001, [3.0, 4.0])]
    df = spark.createDataFrame([(*d, "s") for d in data], "vec_id long, embedding array<double>, shard string")
    got = defaultdict(list)
    for r in ann.nearest(df, shard_rows=700).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.array(v) for i, v in data if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    queries_ = {i for i in good if i % 20 == 0}
    assert set(got) == queries_
    hits = total = 0
    for q in queries_:
        best = sorted((-float(v @ good[q]), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:20]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, len(best) + 1))
        assert all(abs(s - float(good[i] @ good[q])) < 1e-9 for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in best})
        total += len(best)
    assert hits / total >= 0.9
    assert ann.nearest(df.limit(0)).count() == 0


def test_quality(spark, docs, nothing):
    rng = np.random.default_rng(7)
    data = []
    for i in range(600):
        bad = rng.random() < (0.7 if i % 4 == 0 else 0.1)
        text = prose(int(rng.integers(20, 120)), 10_000 + i)
        data.append((i, text.upper().replace(" ", "!! ") if bad else text, f"h{i % 4}", "p", int(not bad)))
    df = spark.createDataFrame(data, "doc_id long, text string, source string, lang string, quality int")
    labels = df.filter("doc_id < 400").select("doc_id", "quality")
    out = {r["doc_id"]: r for r in quality.classify(df.drop("quality"), labels).collect()}
    held = [d for d in data if d[0] >= 400]
    assert sum(out[d[0]]["keep"] == bool(d[4]) for d in held) / len(held) > 0.95
    assert np.mean([out[d[0]]["path_rate"] for d in data if d[2] == "h0"]) < np.mean([out[d[0]]["path_rate"] for d in data if d[2] == "h1"])
    # The posterior by hand, with the model's own evidence.
    p = {d[0]: out[d[0]]["evidence"] for d in data}
    mean = (sum(p.values()) + 0.5) / (len(p) + 1)
    by = defaultdict(list)
    for d in data:
        by[d[2]].append(p[d[0]])
    n, s = len(p), {h: sum(v) for h, v in by.items()}
    within = sum(sum(x * x for x in v) - sum(v) ** 2 / len(v) for v in by.values()) / (n - len(by))
    between = sum(len(v) * (sum(v) / len(v) - mean) ** 2 for v in by.values())
    k = float(np.clip(within / max((between - len(by) * within) / n, 1e-12), 1, 10_000))
    for d in data[:50]:
        h = (s[d[2]] - p[d[0]] + k * mean) / (len(by[d[2]]) - 1 + k)
        r = (s[d[2]] - p[d[0]] + k * h) / (len(by[d[2]]) - 1 + k)
        z = math.log(p[d[0]] / (1 - p[d[0]])) + math.log(r / (1 - r)) - math.log(mean / (1 - mean))
        assert abs(out[d[0]]["posterior"] - 1 / (1 + math.exp(-z))) < 1e-6
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if r["keep"]}
    none = labels.limit(0)
    assert quality.classify(docs, none).count() == docs.count() and quality.classify(nothing, none).count() == 0
    assert quality.classify(docs, labels.select("doc_id", F.lit(None).cast("int").alias("quality"))).count() == docs.count()
