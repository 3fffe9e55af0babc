"""Long and broken inputs, and names that clash."""

import hashlib
import random
import time

from pyspark.sql import functions as F

from matchframe.llm import fingerprints as fp
from matchframe.llm import html_extract as h
from matchframe.llm.base import QUERIES, prepare


def test_unclosed_tags_cost_linear_time():
    """Pages of a quarter of a megabyte; looking through all open elements took minutes."""
    for page in ("<p>x</p>" + "<span>" * 20_000 + "</div>" * 20_000, "<p>x</p>" + "<span>" * 15_000 + "<td>z</td>" * 15_000, "<div>" * 20_000 + "y</p>" * 20_000, "<li>a<ul>" * 20_000):
        start = time.perf_counter()
        h.main_blocks(page)
        assert time.perf_counter() - start < 10


def test_implied_and_stray_ends():
    assert h.main_blocks("<div><p>one, long enough to count as text<p>two, which ends the first</div>")[:2] == ["one, long enough to count as text", "two, which ends the first"]
    assert h.main_blocks("<div><p>a paragraph with a stray</span> end tag inside it</p></div>") == ["a paragraph with a stray end tag inside it"]
    assert h.main_blocks("<table><tr><td>cell one<td>cell two<tr><td>cell three</table>") == ["cell one", "cell two", "cell three"]


def test_next_rows_with_clashing_names(spark):
    prepare(spark)
    rows = [(k, f"text {k}", k, "t", 1, 2, 3) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tie int, tail string, at int, head int, _next int").selectExpr("*", "5 AS `range`", "6 AS _tie", "7 AS _range", "8 AS _tail", "9 AS `next`")
    out = fp.with_next(df, "doc_id", "text", {"size": F.length("text")})
    assert {(r.doc_id, r.next_text, r.tie, r._tail) for r in out.collect()} == {(k, f"text {(k - 1) % 50}", k, 8) for k in range(50)}


def test_fingerprint_query_against_plain_python(spark, tmp_path):
    prepare(spark)
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefg") * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 3, 60, 200]))) for _ in range(60)]
    rows = [(k * 3, texts[rng.randrange(60)] if k % 9 else None) for k in range(80)] + [(7, "é" * 5), (8, "日本 text " * 30), (10_000, "w " * 100_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op5_cws_fingerprints"](spark, str(tmp_path)).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    prints = {}
    for (k, t), (_, after) in zip(order, [*order[1:], order[0]]):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        assert got[k].n_chars == len(t) and got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for text, name in ((t, got[k].fingerprint), (edited, got[k].edited_fingerprint)):
            assert prints.setdefault(text, name) == name
        assert 0 <= got[k].near_edited <= 1 and 0 <= got[k].near_next <= 1
        if edited.split() == t.split():
            assert got[k].near_edited == 1
        if after.split() == t.split():
            assert got[k].near_next == 1
    assert len(got) == len(rows)
