"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from matchframe.llm import spelling as s

COLUMNS = ("form", "root", "n", "n_near", "form_n")


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(counts):
    out = {}
    for w, n in counts.items():
        about = sorted((-m, v) for v, m in counts.items() if near(w, v))
        form = about[0][1] if about and -about[0][0] >= 10 * n else None
        out[w] = [form, None, n, len(about), counts.get(form)]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def spelt(rng, n, letters="abcdeé÷"):
    """Words with a lot of near ones, repeated letters and common beginnings and ends."""
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 10))) for _ in range(n // 8)]
    out = []
    while len(out) < n:
        w = list(rng.choice(stems))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w))
            w[k:k + rng.randrange(2)] = rng.choice(["", rng.choice(letters), w[k] * 2])
        out.append("".join(w))
    return sorted(set(out))


def test_variants_against_all_pairs(spark):
    rng = random.Random(1)
    words = [*spelt(rng, 600), "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1499]
    counts = {w: rng.choice([1, 2, 30, 400, 5000]) for w in words}
    df = spark.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n long, id int").repartition(7)
    got = {r.word: tuple(r[c] for c in COLUMNS) for r in s.variants(df).collect()}
    assert got == plain_variants(counts)


def test_trie_numbers_name_prefixes(spark):
    """Two prefixes have one number just when they are equal, over all ranges and both directions."""
    rng = random.Random(2)
    words = spelt(rng, 500)
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for backwards in (False, True):
            number = {}
            rows = s.numbered(df, backwards).collect()
            assert len(rows) == len(words)
            for r in rows:
                spelled = r.word[::-1] if backwards else r.word
                for i, x in enumerate(s.nodes(r.upto, r.base)):
                    assert number.setdefault(spelled[:i], x) == x
            assert len(set(number.values())) == len(number)
            if not backwards:
                assert [r.word for r in sorted(rows, key=lambda r: r.id)] == sorted(words)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_common_prefix():
    for a, b in (("", ""), ("", "a"), ("abc", "abd"), ("abc", "abcd"), ("x" * 999 + "a", "x" * 999 + "b"), ("ab", "ba")):
        want = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert s.common_prefix(a, b) == want == s.common_prefix(b, a)


def test_whole_query_against_plain_python(spark, monkeypatch):
    rng = random.Random(3)
    words = spelt(rng, 250)
    rows = [(k, " ".join(rng.choice([w, w.upper(), w.title(), "short", "日本", w + "1"]) for w in rng.choices(words[:rng.choice([5, 250])], k=60))) for k in range(120)]
    rows += [(500, None), (501, ""), (502, "longword" * 20000 + " " + "longword" * 20000), (None, words[0] + "," + words[0]), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, 7, "w") for r in rows], "doc_id long, text string, id int, word string")
    monkeypatch.setattr(s, "HELD_WORDS", 50)
    got = {r.word: tuple(r[c] for c in COLUMNS) for r in s.spelling_variants(df).collect()}
    counts = plain_words(rows)
    assert any(len(w) > 100_000 for w in counts)
    assert got == plain_variants({w: n for w, n in counts.items() if len(w) < 1000}) | {w: (None, w, n, 0, None) for w, n in counts.items() if len(w) > 1000}


def test_empty(spark):
    assert s.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert s.spelling_variants(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")).select(F.max("n")).first()[0] is None
