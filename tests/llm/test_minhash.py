"""Tensored MinHash components against brute force over all pairs."""

import random
import re

import numpy as np

from matchframe.llm import minhash_tensor as m
from matchframe.llm import shingle_sets as ss


def plain_set(text, width=4):
    low = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {" ".join(words[k:k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def plain_components(rows, width=4):
    """component of every row (doc_id, text): all pairs of different sets."""
    sets = [frozenset(plain_set(t, width)) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for k, a in enumerate(sets):
        for j in range(k):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(k), find(j)
                label[max(x, y)] = min(x, y)
    return sets, [find(k) for k in range(len(rows))]


def near_copies(rng, n):
    """Groups of copies with a few edits, from one to many words."""
    out = []
    while len(out) < n:
        words = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(rng.choice([1, 3, 4, 6, 40, 120]))]
        for _ in range(rng.choice([1, 1, 2, 12])):
            copy = list(words)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(["Xyz", "new word", "same same same same"])
            out.append(" ".join(copy))
    return out


def expected(rows, width=4):
    sets, label = plain_components(rows, width)
    least = {}
    for (doc_id, _), x, s in zip(rows, label, sets):
        if doc_id is not None and s:
            least[x] = min(least.get(x, doc_id), doc_id)
    return [(d, len(s), least.get(x) if s else d) for (d, _), s, x in zip(rows, sets, label)]


def order(rows):
    return sorted(rows, key=repr)


def test_components_against_all_pairs(spark):
    rng = random.Random(1)
    rows = list(enumerate(near_copies(rng, 500)))
    rng.shuffle(rows)
    rows += [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "ONE  two"), (9005, "one\ttwo"), (None, rows[0][1]), (None, "only null ids here to see"), (None, None), rows[3], rows[3]]
    rows += [(9006, "w " * 30_000), (9007, " ".join(f"w{k}" for k in range(30_000))), (9008, " ".join(f"w{k}" for k in range(30_010)))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, n int")
    rows_out = m.near_duplicates(df).collect()
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in rows_out]
    want = expected(rows)
    assert len({c for _, _, c in want}) < len(rows) - 100
    assert order(got) == order(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows_out)


def test_a_large_group_is_compared_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(ss, "CELL_SETS", 16)
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for k in range(150):  # a chain: each copy moves on from the one before
        base[rng.randrange(150)] = f"e{k}"
        rows.append((k, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in m.near_duplicates(df).collect()) == order(expected(rows))


def test_linked_against_sets():
    rng = random.Random(3)
    for _ in range(30):
        sets = [np.unique(np.array(rng.sample(range(60), rng.randrange(1, 40)), np.uint64)) for _ in range(40)]
        sets += [np.union1d(sets[k], np.array([99], np.uint64)) for k in range(10)]
        label, root = ss.linked(sets), list(range(len(sets)))
        for k in range(len(sets)):
            for j in range(k):
                both = len(np.intersect1d(sets[k], sets[j]))
                if 100 * both >= 80 * (len(sets[k]) + len(sets[j]) - both):
                    a, b = root[j], root[k]
                    root = [min(a, b) if x in (a, b) else x for x in root]
        assert label.tolist() == root


def test_recall_of_the_tables():
    """Pairs at 0.8 have an equal half in both collections about as often as computed."""
    rng = np.random.default_rng(4)
    met = 0
    for _ in range(1000):
        shared, a, b = (rng.integers(0, 1 << 63, n, np.uint64) for n in (160, 20, 20))
        x, y = m.halves_of(np.concatenate([shared, a])), m.halves_of(np.concatenate([shared, b]))
        equal = x == y
        met += equal[:m.HALVES].any() and equal[m.HALVES:].any()
    assert met >= 993  # 998.7 expected


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert m.near_duplicates(df).count() == 0
    assert m.near_duplicates(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).where("kept AND component_id = doc_id AND n_shingles = 0").count() == 2


def test_rows_of_keys_are_dealt_once(spark, monkeypatch):
    """Each set makes 14 rows of the first tables and 28 of halves; none is shuffled a second time
    unless it meets another set."""
    moved = []

    def written(df):
        df.collect()
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted").split("Initial Plan")[0]
        stages = re.findall(r"ShuffleQueryStage \(\d+\), Statistics\(.*?rowCount=([\d.E+]+)\)\n\W*Exchange", plan)  # none that is reused
        moved.append(sum(map(float, stages)))
        return real(df)
    real = m.materialize
    monkeypatch.setattr(m, "materialize", written)
    rng = random.Random(5)
    texts = [[f"w{rng.randrange(10_000)}" for _ in range(30)] for _ in range(200)]
    texts += [[*t[:15], "other", *t[16:]] for t in texts[:20]]  # 23 of 31 shingles: they meet and are not linked
    rows, n = [(k, " ".join(t)) for k, t in enumerate(texts)], len(texts)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        got = m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert all(r.kept for r in got) and len(got) == n
    assert 42 * n <= sum(moved) < 60 * n  # over 84 rows a set when keys were counted first and then joined


def test_meeting_against_plain_groups(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(40), rng.randrange(6), k) for k in range(120)] + [(99, 1, k) for k in range(500, 540)] + [(98, k % 2, k) for k in range(600, 700)]
    df = spark.createDataFrame(rows, "key long, label long, id long").selectExpr("key", "named_struct('label', label, 'id', id) AS who")
    labels, least = {}, {}
    for key, label, k in rows:
        labels.setdefault(key, set()).add(label)
        least[key] = min(least.get(key, (label, k)), (label, k))
    want = sorted((key, label, k, least[key][1]) for key, label, k in rows if len(labels[key]) > 1)
    assert sorted((r.key, r.who.label, r.who.id, r.a) for r in m.meeting(df).collect()) == want
