"""The prefix trie, circulant MinHash and spelling variants against brute force."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from knowloom.llm import circulant, prefix_trie, queries, spelling

TURNS = "conv_id long, turn long, role string, text string, conv string, place int, said string, shard long"
TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def bag(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in sorted(built.items()):
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = defaultdict(list)
    for c, ts in sorted(built.items()):
        ends[tuple(ts)].append(str(c))
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(ends[p]).encode()).hexdigest())
                   for p, m in members.items())


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(n * 3), n) + [0, 100, 200]:
        length = rng.choice([1, 2, 2, 3, 5, 7, 9]) if c % 11 else 40
        rows += [(c, None if t == 0 and c % 7 == 0 else t, rng.choice(["user", None, "", "é"]), rng.choice(["a", "bb", None, "", "漢字x"]) if c % 11 else f"same {t}") for t in range(length)]
    return rows + rows[:5] + [(None, 1, "user", "lost"), (7, 1, "u", "tie"), (7, 1, "u", "tie"), (7, 1, "v", "tie")]


@pytest.mark.parametrize("seed, n, shard", [(1, 120, 4096), (2, 300, 16), (3, 4, 1)])
def test_prefix_trie(spark, monkeypatch, seed, n, shard):
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    rows = conversations(seed, n)
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], TURNS).repartition(4)
    assert bag(prefix_trie.prefix_trie(df), *TRIE) == brute_trie(rows)


def test_prefix_trie_of_copies_long_and_empty(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(1, 40) for t in range(60)] + [(500, t, "u", "z" * (t % 9)) for t in range(3000)]
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], TURNS)
    got = bag(prefix_trie.prefix_trie(df), *TRIE)
    # The brute force is quadratic in depth; the long conversation is checked by its counts.
    assert sum(got.values()) == sum(brute_trie(rows[:39 * 60]).values()) + 3000 and max(r[1] for r in got) == 3000
    small = brute_trie(rows[:39 * 60])
    assert {r for r in small if r[1] > 5} <= set(got)
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0


DOCS = "doc_id long, text string, word string, n long, a string, key string, component_id long"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "w", 1, "x", "k", 0) for d, t in rows], DOCS).repartition(3)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def brute_variants(rows, letters, least):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            n[w[:h % len(w)] + w[h % len(w) + 1:] if h % 199 == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= least}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = Counter()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[(w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)] += 1
    return out


@pytest.mark.parametrize("letters, least, alphabet", [(6, 5, "abé"), (6, 2, "abcdefgh"), (2, 2, "abcÿ÷")])
def test_spelling_variants(spark, letters, least, alphabet):
    rng = random.Random(letters + least)
    stems = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9))) for _ in range(40)]
    words = []
    for k, s in enumerate(stems):
        words += [s] * rng.choice([1, 30, 200])
        for _ in range(3):
            i = rng.randint(0, len(s))
            words += [s[:i] + rng.choice(["", "a", alphabet[-1]]) + s[i + rng.randint(0, 1):]] * rng.choice([1, 3, 6])
    rng.shuffle(words)
    rows = [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words[i * 50:i * 50 + 50])) for i in range(len(words) // 50 + 1)]
    rows += [(None, "ababab ABABAB abababé"), (3, None), (4, ""), (5, "ab1ab-abĀab漢abababab"), (5, "ab1ab-abĀab漢abababab"), (6, "a" * 3000 + " " + "ab " * 5000)]
    rows += [(7, " ".join(["z" * 8] * 6 + ["z" * 7] * 30 + ["z" * 6] * 150))]
    got = bag(spelling.spelling_variants(documents(spark, rows), letters, least), "word", "form", "root", "n", "n_near", "form_n")
    want = brute_variants(rows, letters, least)
    assert got == want
    assert any(r[1] != r[2] for r in want if r[1])


def test_spelling_broadcasts_no_words(spark, monkeypatch):
    plans = []
    write = spelling.materialize

    def seen(df, name):
        plans.append(df)
        return write(df, name)

    monkeypatch.setattr(spelling, "materialize", seen)
    text = "spelling spellings spellling speling " * 5 + "spelling " * 30
    plans.append(spelling.spelling_variants(documents(spark, [(1, text)])))
    joins = [df._jdf.queryExecution().executedPlan().toString() for df in plans]
    assert not any("Broadcast" in plan for plan in joins) and sum("SortMergeJoin" in plan for plan in joins) >= 4
    assert {r.word: r.form for r in plans[-1].collect()} == {"spelling": None, "spellings": "spelling", "spellling": "spelling", "speling": "spelling"}


def test_spelling_pieces_and_empty(spark, monkeypatch):
    text = ("é" * 37 + " word lettersé, ").encode() * 50
    whole = Counter(spelling._RUN.findall(text))
    monkeypatch.setattr(spelling, "_PIECE", 41)
    pieces = Counter()
    for c in spelling._runs(text):
        pieces += c
    assert pieces == whole
    assert spelling.spelling_variants(documents(spark, [])).count() == 0


def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    part = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both) and part[i] != part[j]:
            old, new = part[j], part[i]
            part = [new if p == old else p for p in part]
    ids = defaultdict(list)
    for p, (d, _) in zip(part, rows):
        ids[p] += [d] * (d is not None)
    out = Counter()
    for i, (p, (d, _)) in enumerate(zip(part, rows)):
        least = min(ids[p], default=None) if sets[i] else d
        out[(d, len(sets[i]), least, d is not None and d == least)] += 1
    return out


@pytest.mark.parametrize("block", [512, 8])
def test_minhash_classes(spark, monkeypatch, block):
    monkeypatch.setattr(circulant, "BLOCK", block)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    texts = [None, "", " \t\n", "one", "One", "one two", "ONE  two", "a b c", "x\u00a0y z w", "\u00c9 \u00e9 x y", "a b c a b c a b c"]
    passage = rng.choices(words, k=60)
    for size in (8, 20, 25, 60, 300):
        for _ in range(6):
            near = rng.choices(words, k=size)
            for _ in range(rng.choice([1, 5, 30])):
                new = list(near)
                for _ in range(rng.randint(0, 2 + size // 30)):
                    new[rng.randrange(len(new))] = rng.choice(words)
                if rng.random() < 0.3:
                    near = new  # chains
                texts.append(" ".join(new))
    texts += [" ".join(passage + rng.choices(words, k=rng.choice([3, 10, 60]))) for _ in range(60)]
    texts.append(" ".join(rng.choices(words, k=20000)))
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, "one two"), (7, "ONE  two"), (7, "a b c"), (None, "one"), (None, "never else said here"), (None, None)]
    rng.shuffle(rows)
    assert bag(circulant.minhash_classes(documents(spark, rows)), "doc_id", "n_shingles", "component_id", "kept") == brute_classes(rows)


def test_circulant_signatures_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 1700, dtype=np.uint64) * np.uint64(2)
    agree = [np.mean(circulant.signature(x[a:a + 1000]) == circulant.signature(x[a + 200:a + 1200])) for a in range(0, 500, 20)]
    assert abs(np.mean(agree) - 800 / 1200) < 0.03
    assert len(np.unique(circulant._permute(np.arange(1 << 20, dtype=np.uint32), circulant._PI))) == 1 << 20


def test_profiles_bound_intersections():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 5, 60, 64, 200, 3000)]
    sets += [np.unique(np.concatenate([sets[4][:150], sets[2]])), np.unique(np.concatenate([sets[5][:2800], sets[4]])), np.arange(700, dtype=np.uint64) << np.uint64(32)]
    profiles = circulant.Profiles([circulant.set_profile(x) for x in sets])
    for i, x in enumerate(sets):
        most = profiles.most_shared(i, np.arange(len(sets)))
        real = np.array([len(np.intersect1d(x, y)) for y in sets])
        assert (most >= real).all()
        if i in (4, 5):
            assert most[i + 2] <= real[i + 2] + 0.02 * len(x) + 20 and most[i] == len(x)


def test_minhash_of_nothing(spark):
    assert circulant.minhash_classes(documents(spark, [])).count() == 0


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables not present")
def test_queries_equal_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    run = queries.QUERIES
    assert bag(run["op11_prefix_trie"](spark, SF), *TRIE) == brute_trie(turns)
    assert bag(run["op12_minhash"](spark, SF), "doc_id", "n_shingles", "component_id", "kept") == brute_classes(docs)
    assert bag(run["op13_spelling_variants"](spark, SF), "word", "form", "root", "n", "n_near", "form_n") == brute_variants(docs, 6, 5)
