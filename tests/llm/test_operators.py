"""Toxicity, decontamination, fingerprints, secrets, quality, pages and chats on small tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from matchframe.llm import chat_format, decontamination, fingerprints, html_extract, quality_lm, secret_scan, toxicity
from matchframe.llm.base import prepare, running

EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    prepare(spark)
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(400):
        text = words(rng, rng.randrange(20, 120))
        bad = k % 5 == 0
        if bad:
            parts = text.split()
            for _ in range(4):
                parts.insert(rng.randrange(len(parts)), rng.choice(["grumfle", "snotzig", "blarph"]))
            text = " ".join(parts)
        rows.append((k, text, "xx", "src", len(text)))
        labels.append((k, 1, int(bad)))
    rows += [(500, None, None, "src", None), (501, "", "xx", "src", 0), (None, "grumfle snotzig", "xx", "src", 15), (502, "a " * 30000 + "blarph", "xx", "src", 60006)]
    rows += [rows[3], rows[3]]
    return spark.createDataFrame(rows, EMPTY), spark.createDataFrame(labels + [(3, 1, None), (None, None, 1)], "doc_id long, quality int, toxic int")


# ---- toxicity

def plain_segments(scores):
    """Ruzzo-Tompa by its definition: take the best segment, then the same on both sides."""
    def best(a, b):
        top = None
        for i in range(a, b):
            run = 0.0
            for j in range(i, b):
                run += scores[j]
                if run > 1e-12 and (top is None or run > top[2] + 1e-9):
                    top = (i, j, run)
        return top

    def split(a, b):
        top = best(a, b)
        return split(a, top[0]) + [top] + split(top[1] + 1, b) if top else []
    return split(0, len(scores))


def test_segments_equal_their_definition():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(1, 25)
        scores = [round(rng.uniform(0.1, 2), 3) if rng.random() < 0.4 else -toxicity.DRIFT for _ in range(n)]
        at = [k for k, s in enumerate(scores) if s > 0]
        got = toxicity.segments(at, [scores[k] for k in at])
        want = plain_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_toxicity_held_out(corpus):
    docs, labels = corpus
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = {r.doc_id for r in docs.select("doc_id").where(~toxicity.in_training()).collect()}
    bad = [r.score for r in got if r.doc_id in held and r.doc_id < 400 and r.doc_id % 5 == 0]
    good = [r.score for r in got if r.doc_id in held and r.doc_id < 400 and r.doc_id % 5]
    assert min(bad) > max(good)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 500 in ids and 501 in ids and ids.count(3) == 3 and not [k for k in ids if k is not None and k < 400 and k % 5 == 0]


def test_toxicity_labels_of_held_out_rows_change_nothing(corpus, spark):
    docs, labels = corpus
    flipped = labels.selectExpr("doc_id", "quality", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2, 1 - toxic, toxic) AS toxic")
    a = sorted(map(str, toxicity.score_documents(docs, labels).collect()))
    assert a == sorted(map(str, toxicity.score_documents(docs, flipped).collect()))
    none = toxicity.score_documents(docs, labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_passages(corpus):
    docs, labels = corpus
    model, _ = toxicity.train(docs, labels)
    text = "ab cd ef " * 30 + "grumfle snotzig blarph grumfle" + " ab cd ef" * 30
    (a, b, score, expected), = toxicity.passages(text, model.weights)
    assert text[a:b] == "grumfle snotzig blarph grumfle" and score > 0 and expected < 0.01
    assert toxicity.passages("", model.weights) == []


# ---- decontamination

def plain_distance(item, text):
    row = list(range(len(item) + 1))
    best = (row[-1], 0)
    for e, c in enumerate(text, 1):
        new = [0]
        for j, d in enumerate(item, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
        if row[-1] < best[0]:
            best = (row[-1], e)
    return best


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(200):
        item, text = words(rng, 3, "abc"), words(rng, 12, "abc")
        want = plain_distance(item, text)
        assert decontamination.myers(item, text, len(item)) == (want if want[1] else decontamination.myers(item, text, len(item)))
        assert decontamination.myers(item, text, len(item))[0] == want[0]


def test_leaks_equal_brute_force(spark):
    prepare(spark)
    rng = random.Random(4)
    items = [(k, words(rng, 30)) for k in range(20)] + [(90, items_text := "Short one!"), (91, items_text), (92, None), (93, "!?"), (94, "")]
    docs = []
    for k in range(60):
        body = words(rng, 80)
        if k % 3 == 0:
            t = list(items[k % 20][1])
            for _ in range(k % 14):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            body = f"{body}. {''.join(t).upper()}! {body}"
        docs.append((k, body))
    docs += [(70, None), (71, ""), (72, "x SHORT,  one y"), (None, items[2][1]), (73, items[1][1]), (73, items[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS first")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in docs:
        for i, x in items:
            if x and decontamination.normal(x).strip():
                n = decontamination.normal(x)
                if plain_distance(n, decontamination.normal(t or ""))[0] <= decontamination.budget(n):
                    want.add((d, i))
    for chars in (10**6, 300):  # one block, and many
        got = decontamination.find_leaks(df, bench, block_chars=chars).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
    by = {(r.doc_id, r.item_id): r for r in got}
    assert by[(72, 90)].edits == 0 and "x SHORT,  one y"[by[(72, 90)].first:by[(72, 90)].last] == "SHORT,  one"
    kept = decontamination.drop_leaks(df, bench)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in {x for x, _ in want})
    assert decontamination.find_leaks(df, bench.limit(0)).count() == 0
    assert decontamination.find_leaks(df.limit(0), bench).count() == 0


# ---- fingerprints

def shingles(text):
    w = [None] * 4 + (text or "").split()
    return collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))


def test_fingerprint_likeness_estimates_generalised_jaccard(spark):
    prepare(spark)
    rng = random.Random(8)
    base = words(rng, 2000)
    table = [(0, base), (1, base[:len(base) // 2] + words(rng, 900)), (2, base + " " + base), (3, words(rng, 2000)), (4, None), (5, " "), (6, "one"), (6, "one")]
    df = spark.createDataFrame(table, "id long, text string").withColumn("sig", fingerprints.signature(fingerprints.whole_text()))
    pairs = df.selectExpr("id a", "sig x", "text t").crossJoin(df.selectExpr("id b", "sig y", "text u")).withColumn("near", fingerprints.likeness(fingerprints.F.col("x"), fingerprints.F.col("y"))).collect()
    for r in pairs:
        p, q = shingles(r.t), shingles(r.u)
        union = sum((p | q).values())
        assert abs(r.near - (sum((p & q).values()) / union if union else 1.0)) < 0.17, (r.a, r.b)
        if (r.t or "").split() == (r.u or "").split():
            assert r.near == 1 and r.x == r.y


def test_likeness_of_repetitive_texts_is_not_biased(spark):
    prepare(spark)
    rng = random.Random(13)
    table = []
    for k in range(60):
        line, rest = words(rng, 8), words(rng, 300)
        table.append((k, " ".join([rest] + [line] * 60), " ".join([words(rng, 300)] + [line] * 60)))
    near = fingerprints.likeness(fingerprints.signature(fingerprints.F.col("x")), fingerprints.signature(fingerprints.F.col("y")))
    errors = []
    for r in spark.createDataFrame(table, "id long, x string, y string").withColumn("near", near).collect():
        p, q = shingles(r.x), shingles(r.y)
        errors.append(r.near - sum((p & q).values()) / sum((p | q).values()))
    assert abs(np.mean(errors)) < 0.025 and np.sqrt(np.mean(np.square(errors))) < 0.06


@pytest.mark.parametrize("rows", [1, 3, 50])
def test_next_document_over_ranges(spark, monkeypatch, rows):
    prepare(spark)
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", rows)
    rng = random.Random(rows)
    table = [(i, f"t{i}") for i in rng.sample(range(-10**12, 10**12), 40)] + [(None, "last")]
    df = spark.createDataFrame(table, "doc_id long, text string").selectExpr("*", "7 AS next")
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(df, "doc_id", "text", {}).collect()}
    order = sorted(table, key=lambda r: -10**13 if r[0] is None else r[0], reverse=True)
    assert got == {a[0]: b[1] for a, b in zip(order, order[1:] + order[:1])}
    one = fingerprints.with_next(df.limit(1), "doc_id", "text", {}).first()
    assert one.next_text == one.text
    assert fingerprints.with_next(df.limit(0), "doc_id", "text", {}).count() == 0


def test_equal_ids_still_form_one_cycle(spark):
    prepare(spark)
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (0, "d")], "doc_id long, text string")
    got = fingerprints.with_next(df, "doc_id", "text", {}).collect()
    assert sorted(r.next_text for r in got) == ["a", "b", "c", "d"]


# ---- secrets

PATTERNS = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
            ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]


def test_secrets_equal_brute_force(spark):
    prepare(spark)
    rng = random.Random(6)
    pieces = ["password = hunter2hunter2", "Token:'abcdefgh", "secret: token: abcdefgh12", "api_key=ab.cd-ef=", "APIKEY : \"zzzzzzzz", "AKIA" + "Q" * 12, "AKIA123", "xAKIAAKIA12345678Z",
              "0123456789abcdef" * 2, "deadbeef" * 5, "é🙂", "plain words", "\n", "passwd=ſecret99", "token=AKIA" + "7" * 16, "DEADBEEF" * 4]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", "\n", ";"]) for _ in range(rng.randrange(8))) for _ in range(150)] + ["", None, "f" * 70000, "token=12345678 " * 3000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, texts[0])], "doc_id long, text string").selectExpr("*", "1 AS base", "2 AS spans")
    got = {r.doc_id: r for r in secret_scan.scan(df).withColumn("listed", secret_scan.as_text(secret_scan.F.col("base"))).withColumn("all", secret_scan.as_text(secret_scan.F.col("spans"))).collect()}
    for k, t in enumerate(texts):
        spans = sorted((m.start(), n, m.end()) for n, (_, p, g, least) in enumerate(PATTERNS) for m in p.finditer(t or "") if len(m[g]) >= least)
        want = ",".join(f"{PATTERNS[n][0]}:{a}:{b}" for a, n, b in spans)
        assert got[k].listed == want, t
        assert set(filter(None, want.split(","))) <= set(got[k]["all"].split(","))
    masked = {r.doc_id: r.text for r in secret_scan.mask_secrets(df).collect()}
    assert masked[len(texts) - 3] is None and masked[len(texts) - 4] == "" and masked[len(texts) - 1] == "[SECRET] " * 3000
    for k, t in enumerate(texts):
        for _, p, g, least in PATTERNS:
            assert not any(len(m[g]) >= least for m in p.finditer(masked[k] or ""))
    assert secret_scan.scan(df.limit(0)).count() == 0 and secret_scan.mask_secrets(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_equals_a_plain_fold(spark, n):
    values = [(k * 7919) % 101 - 50 for k in range(n)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    F = secret_scan.F
    got = df.select(running(F.col("v"), F.lit(0), lambda a, b: a + b).alias("total"), running(F.col("v"), F.lit(-99), lambda a, b: F.greatest(a, b)).alias("top")).first()
    assert got.total == [sum(values[:k]) for k in range(n + 1)]
    assert got.top == [max(values[:k], default=-99) for k in range(n + 1)]


def test_spans_of_a_text_with_thousands_of_them(spark):
    prepare(spark)
    rng = random.Random(21)
    pieces = ["token = abcdefgh12", "AKIA" + "Q7" * 9, "0a1b" * 9, "word", "xK9fQ2mZ7pL4vB8nR1tY6w", "é🙂", "token=" + "ab12" * 9, "secret:AKIA" + "Z5" * 8]
    text = " ".join(rng.choice(pieces) for _ in range(3000))
    F = secret_scan.F
    base, found = secret_scan.base_spans(F.col("text")), secret_scan.candidates(F.col("text"))
    row = spark.createDataFrame([(text,)], "text string").select(base.alias("base"), found.alias("found"), secret_scan.all_spans(base, found, [0.001] * 4).alias("all")).first()
    want = sorted((m.start(), n, m.end()) for n, (_, p, g, least) in enumerate(PATTERNS) for m in p.finditer(text) if len(m[g]) >= least)
    assert [tuple(s) for s in row.base] == want and len(want) > 1000
    apart = [(c.start, 3, c.end) for c in row.found if not c.decoy and c.p >= 0.001 and not any(a < c.end and c.start < e for a, _, e in want)]
    assert apart and sorted(tuple(s) for s in row["all"]) == sorted(want + apart)


def test_random_strings_are_found_and_natural_ones_are_not(spark):
    prepare(spark)
    rng = random.Random(11)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    natural = [" ".join("".join(rng.choice(["then", "ing", "er", "ation", "the"]) for _ in range(7))[:rng.randrange(20, 30)] for _ in range(4)) for _ in range(200)]
    keys = ["".join(rng.choice(chars) for _ in range(40)) for _ in range(40)]
    ids = ["theingtheringthe2020erationtheringtheeration1" for _ in range(3)]
    table = [(k, t) for k, t in enumerate(natural + [f"x {v} y" for v in keys + ids])]
    got = {r.doc_id: r.spans for r in secret_scan.scan(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert sum(bool(got[k]) for k in range(200)) == 0
    assert sum(len(got[k]) == 1 and got[k][0].start == 2 and got[k][0].end == 42 for k in range(200, 240)) >= 36
    assert not any(got[k] for k in range(240, 243))


@pytest.mark.parametrize("n", [1, 8])
def test_keys_of_a_small_table_are_found(spark, n):
    prepare(spark)
    rng = random.Random(17)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(chars) for _ in range(40)) for _ in range(n)]
    table = [(k, f"x {v} y") for k, v in enumerate(keys)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secret_scan.scan(df).collect()}
    assert sum([(s.start, s.end) for s in got[k]] == [(2, 42)] for k in range(n)) >= 0.8 * n
    assert sum(r.text == "x [SECRET] y" for r in secret_scan.mask_secrets(df).collect()) >= 0.8 * n
    names = spark.createDataFrame([(k, "see theingtheringthe2020erationtheringtheeration1 and theRingOfTheNation2020Then") for k in range(n)], "doc_id long, text string")
    assert not any(r.spans for r in secret_scan.scan(names).collect())


# ---- quality

def test_kneser_ney_is_a_distribution_and_shards_agree(corpus):
    docs, labels = corpus
    model = quality_lm.train(docs.where("doc_id < 300").select("text"))
    tables = ([quality_lm._arrays(t) for t in model[0]], [quality_lm._arrays(t) for t in model[1]])
    for context in ("\0\0\0", "abc", "zzz", "a b"):
        h = sum(ord(c) << 16 * (3 - k) for k, c in enumerate(context))
        g = np.array([h | c for c in range(1 << 16)], np.uint64)
        assert abs(np.exp(quality_lm.log_probabilities(g, *tables)).sum() - 1) < 1e-9, context
    whole = {(r.doc_id, r.digest): r.ln_p for r in quality_lm.perplexities(docs, model).collect()}
    for r in quality_lm.perplexities(docs.dropDuplicates(), model, shard_rows=200).collect():
        assert abs(whole[(r.doc_id, r.digest)] - r.ln_p) < 1e-6


def test_repeated_rows_stay_over_shards(corpus):
    docs, labels = corpus
    plain, sharded = ([tuple(r)[:1] + (round(r.perplexity or 0, 6), r.keep) for r in quality_lm.classify(docs, labels, shard_rows=n).collect()] for n in (4_000_000, 8_000))
    assert sorted(plain, key=str) == sorted(sharded, key=str) and len(plain) == docs.count()


def test_large_models_take_all_characters(spark):
    prepare(spark)
    rng = random.Random(23)
    texts = ["".join(rng.choice("가힣퀀🙂ｱＡab ") for _ in range(60)) for _ in range(20)] + ["", None]
    docs = spark.createDataFrame([(k, t, "xx", "s", 0) for k, t in enumerate(texts)], EMPTY)
    model = quality_lm.train(docs.where("doc_id < 10").select("text"))
    small, large = ({r.doc_id: (r.ln_p, r.n) for r in quality_lm.perplexities(docs, model, n).collect()} for n in (4_000_000, 50))
    assert set(small) == set(large) == set(range(22))
    assert all(abs(small[k][0] - large[k][0]) < 1e-6 and small[k][1] == large[k][1] for k in small)


def test_quality_keeps_what_looks_like_trusted_text(corpus, spark):
    docs, labels = corpus
    junk = spark.createDataFrame([(900 + k, "|#%|" * 40, "xx", "s", 160) for k in range(5)], EMPTY)
    got = {r.doc_id: r for r in quality_lm.classify(docs.unionByName(junk), labels).collect()}
    assert not any(got[900 + k].keep for k in range(5))
    assert np.mean([got[k].keep for k in range(400)]) > 0.9
    assert got[500].perplexity is None and not got[500].keep and not got[501].keep
    assert quality_lm.classify(docs.limit(0), labels).count() == 0
    assert all(r.keep for r in quality_lm.classify(docs.where("doc_id < 9"), labels.limit(0)).collect())


# ---- pages

@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("plain  words", "plain words"), ("<p>a</p><p>b &amp;amp; &eacute;&#8217;</p>", "a b &amp; é’"),
    ("<nav>menu</nav><header>top</header><article><h1>T</h1><p>one<br>two<p>three <b>bold<i>er</i></b></article><aside>side</aside><footer>f</footer>", "T one two three bolder"),
    ("<div class='ad'>buy</div><div id=content><p>Long text, with commas, and more of it.</p><p>Second.</p></div><div class='comments'><p>me too, and me, and me, long long long</p></div>", "Long text, with commas, and more of it. Second."),
    ("<article><section><p>short</p></section><section><p>A much longer paragraph, with commas, that scores.</p></section></article>", "short A much longer paragraph, with commas, that scores."),
    ("<body><ul class=menu><li><a href=x>x</a></ul><form>f<input></form><p>Text</p><script>var a='<p>';</script><!-- c --></body>", "Text"),
    ("<main><article><p>story, story, story</p><div class=comment><p>reader</p></div></article></main>", "story, story, story"),
    ("<div role=alert>n</div><article><p>x&nbsp;y\n z</p><ul><li>item one</li></ul></article>", "x y z item one"),
    ("<article><p>unclosed <b>tags <a href='q'>link", "unclosed tags link"), ("<div>" * 3000 + "deep" + "</div>" * 10, "deep"),
])
def test_pages(html, want):
    assert " ".join(html_extract.main_blocks(html)) == want


def test_page_table(spark):
    prepare(spark)
    df = spark.createDataFrame([(1, "u", "<p>é🙂</p>"), (1, "u", "<p>é🙂</p>"), (None, None, None)], "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = sorted(map(str, (tuple(r)[:4] for r in html_extract.extract_pages(df).collect())))
    assert got == sorted(map(str, [(1, "u", "é🙂", 2), (1, "u", "é🙂", 2), (None, None, "", 0)]))
    assert html_extract.extract_pages(df.limit(0)).count() == 0


# ---- chats

def test_chat_events_fold(spark):
    prepare(spark)
    log = [(1, 1, 1, "message", "user", "hi"), (1, 2, 2, "delta", "assistant", "Hel"), (1, 3, 2, "delta", "assistant", "lo"), (1, 4, 2, "regenerate", "assistant", None),
           (1, 5, 2, "delta", "assistant", "Good "), (1, 6, 2, "delta", "assistant", "day"), (1, 7, 1, "edit", "user", "hi!"), (1, 8, 3, "message", "user", "gone"), (1, 9, 3, "delete", "user", None)]
    got = chat_format.fold_messages(spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string")).orderBy("first").collect()
    assert [(r.role, r.text) for r in got] == [("user", "hi!"), ("assistant", "Good day")]


def test_chat_round_trip(spark):
    prepare(spark)
    rng = random.Random(7)
    odd = ["", "<|end|>", "<|turn|>user<|text|>x<|end|>", "<\\|end|>", "<\\\\|", "a\nb", "</s>[INST] ok [/INST]", "<|", "🙂é", "<", "|>", None]
    table = [(c, t, rng.choice(["user", "assistant", "<|text|>", None]), "".join(rng.choice(odd[:-1]) for _ in range(3)) if rng.random() < .8 else None) for c in [1, 2, 3, None] for t in range(12)]
    table += [(5, t, "assistant", f"m{t}") for t in range(3000)]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS seq", "2 AS kind")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    for c in {r[0] for r in table}:
        turns = [(r or "", t or "") for k, _, r, t in table if k == c]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.read_back(chat_format.format_conversations(df.limit(0))).count() == 0
    twice = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.format_conversations(twice)).first().n_turns == 2
