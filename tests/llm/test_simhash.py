"""SimHash components against brute force over all pairs."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from matchframe.llm import simhash_gray as s
from matchframe.llm.base import prepare
from test_minhash import expected, plain_set


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(codes):
    codes = np.array(codes, np.uint64)
    label = list(range(len(codes)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for k in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[:k] ^ codes[k]) <= 4):
            a, b = find(k), find(int(j))
            label[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(codes))]


def clustered(n, seed):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        center = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 3, 40])):
            x = center
            for _ in range(rng.randrange(8)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return sorted(set(out))[:n]


def partition(labels, keys):
    groups = {}
    for k, x in zip(keys, labels):
        groups.setdefault(x, set()).add(k)
    return {frozenset(g) for g in groups.values()}


def test_fingerprint():
    for t in ["", " \n", "a", "A b", "a b c d", "The é Ä b c\td  e f\x0bg h", "x " * 50, "one two three four five six seven"]:
        assert s.fingerprint(t) == plain_fingerprint(t), t


def test_gray_rank(spark):
    prepare(spark)
    got = [r[0] for r in spark.range(16).select(s.gray_rank(F.col("id"))).collect()]
    assert [got[k ^ (k >> 1)] for k in range(16)] == list(range(16))


def test_index_equals_brute_force():
    for seed in range(4):
        codes = clustered(700, seed)
        rank = []
        for c in codes:
            for sh in (1, 2, 4, 8, 16, 32):
                c ^= c >> sh
            rank.append(c)
        codes = np.array([c for _, c in sorted(zip(rank, codes))], np.uint64)
        group = np.zeros(len(codes), int)
        assert partition(s.link_rows(codes, group).tolist(), codes.tolist()) == partition(plain_components(codes), codes.tolist())


def test_links_of_all_schemes_and_split_groups(spark, monkeypatch):
    prepare(spark)
    codes = clustered(600, 9)
    df = spark.createDataFrame([(s._signed(c),) for c in codes], "fp long")
    want = {g for g in partition(plain_components(codes), codes) if len(g) > 1}
    for blocks in (5, 6, 7):
        monkeypatch.setattr(s, "SCHEMES", ((blocks, 10**9),))
        monkeypatch.setattr(s, "CHUNK_ROWS", 1 << 14 if blocks > 5 else 8)  # the last case searches chunk by chunk
        roots = s.components(s.link_fingerprints(df)).collect()
        got = partition([r.root for r in roots], [r.node % (1 << 64) for r in roots])
        assert got == want, blocks


def test_documents(spark):
    prepare(spark)
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 6) for _ in range(200)) for _ in range(12)]
    table = [(k, b) for k, b in enumerate(base)]
    table += [(100 + k, base[k % 4] + " tail") for k in range(30)] + [(200 + k, base[5].upper()) for k in range(20)]
    table += [(300, None), (301, ""), (302, " \n\t"), (None, base[2]), (7, base[7]), (400, "x " * 20000)]
    docs = spark.createDataFrame(table, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS component_id", "'en' AS lang")
    got = s.near_duplicates(docs).collect()
    fps = {}
    for k, t in table:
        fps.setdefault(plain_fingerprint(t), []).append(k)
    codes = sorted(fps)
    labels = plain_components(codes)
    least = {}
    for c, x in zip(codes, labels):
        for k in fps[c]:
            if k is not None:
                least[x] = min(least.get(x, k), k)
    want = sorted(((k, s._signed(c), least[x]) for c, x in zip(codes, labels) for k in fps[c]), key=str)
    assert sorted(map(tuple, got), key=str) == want
    kept = s.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert s.near_duplicates(docs.limit(0)).count() == 0
    assert s.keep_one(docs.limit(0)).count() == 0


def test_keep_one_tells_rows_of_one_id_apart(spark):
    prepare(spark)
    rng = random.Random(8)
    a, b, c, d = (" ".join(rng.choice("abcdefghij") * rng.randrange(1, 6) for _ in range(150)) for _ in range(4))
    table = [(1, a, "x"), (1, b, "x"), (1, a, "x"), (2, b, "x"), (None, c, "x"), (None, c, "x"), (None, d, None), (None, a, "x"), (5, None, None), (6, "", None)]
    docs = spark.createDataFrame(table, "doc_id long, text string, __fp string")
    kept = s.keep_one(docs)
    assert kept.columns == docs.columns
    # one row of every group of near copies: both texts of document 1, both groups without an id, one empty text
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), (1, b), (None, c), (None, d), (5, None)], key=str)


def edited(rng, words, n):
    """A copy with n words replaced at places well apart."""
    out = list(words)
    for k in range(n):
        out[(len(words) // n) * k + rng.randrange(3)] = f"edit{rng.randrange(10 ** 9)}"
    return out


def test_near_copies_go_and_other_pairs_stay(spark):
    """Pairs of a similarity of 0.8 and more lose one, those of 0.5 to 0.8 keep both."""
    prepare(spark)
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    rows, near, apart = [], 0, 0
    for k in range(300):
        words = rng.choices(vocabulary, k=rng.choice([40, 120, 400]))
        copy = edited(rng, words, max(1, round(len(words) * rng.choice([0.004, 0.01, 0.018, 0.04, 0.08]))))
        a, b = plain_set(" ".join(words), 5), plain_set(" ".join(copy), 5)
        like = len(a & b) / len(a | b)
        near, apart = near + (like >= 0.8), apart + (0.3 <= like < 0.8)
        rows += [(2 * k, " ".join(words), like), (2 * k + 1, " ".join(copy), like)]
    assert near > 80 and apart > 80
    kept = {r.doc_id for r in s.keep_one(spark.createDataFrame(rows, "doc_id long, text string, like double")).collect()}
    assert all(2 * k in kept for k in range(300))
    gone = {k for k, _, _ in rows} - kept
    assert all(rows[k][2] >= 0.8 for k in gone)
    assert len(gone) >= 0.97 * near


def test_a_chain_of_copies_is_one_group(spark):
    """Each text is near the next one only; what is linked at the end is what brute force links."""
    prepare(spark)
    rng = random.Random(22)
    words, rows = [f"w{rng.randrange(900)}" for _ in range(150)], []
    for k in range(60):
        rows.append((k, " ".join(words)))
        words[rng.randrange(150)] = f"e{k}"
    want = sorted({c for _, _, c in expected(rows, 5)})
    assert len(want) < 10
    assert sorted(r.doc_id for r in s.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


def test_components_in_all_three_ways(spark):
    """Stars, chains, cliques and lone pairs, against a plain union of the links."""
    from matchframe.llm import graph
    rng = random.Random(30)
    links = [(0, k) for k in range(1, 40)] + [(k, k + 1) for k in range(100, 140)] + [(300 + i, 300 + j) for i in range(8) for j in range(i)]
    links += [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(90)]
    links = [(a, b) for a, b in links if a != b]
    label = {x: x for e in links for x in e}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(links, "a long, b long").distinct()
    for way in (graph.components, graph.reached, graph.gathered):
        assert {r.node: r.root for r in way(df).collect()} == label
        assert way(df.limit(0)).count() == 0
