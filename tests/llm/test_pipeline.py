"""The pipeline against the stages done by hand on a small corpus."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from test_minhash import plain_components


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 6))) for _ in range(n))


def test_pipeline_equals_the_stages_by_hand(spark, tmp_path):
    rng = random.Random(12)
    bad, item = ["grumfle", "snotzig", "blarph"], text(rng, 30)
    docs, labels = {}, []
    for k in range(300):
        body = text(rng, 60)
        if k % 6 == 0:
            body = f"{body} {rng.choice(bad)} {rng.choice(bad)} {rng.choice(bad)}"
        if k % 25 == 1:
            body = f"{body} {item} {body}"
        if k % 20 == 3:
            body += " password=hunter2hunter2 end"
        docs[k] = body
        labels.append((k, 1, int(k % 6 == 0)))
    for k in range(40):
        docs[300 + k] = docs[2 + k % 4]
    for k in range(20):  # near copies: one word of sixty
        words = docs[8 + k].split(" ")
        docs[350 + k] = " ".join([*words[:-1], "changed"])
    docs[400], docs[401] = "", None
    rows = [(k, t, "xx", "s", len(t or "")) for k, t in docs.items()] + [(5, docs[5], "xx", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS ids", "2 AS fp").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = {k: t or "" for k, t in docs.items() if not any(b in (t or "") for b in bad)}
    sets, labels = plain_components(sorted(left.items()), 5)
    lowest = {}
    for k, label, found in zip(sorted(left), labels, sets):
        lowest.setdefault(label if found else "empty", k)
    left = {k: left[k] for k in lowest.values()}
    left = {k: t.replace("password=hunter2hunter2", "[SECRET]") for k, t in left.items() if item not in t}
    assert set(got) == set(left)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for k, t in left.items():
        assert got[k].ids == tok.encode(t, add_special_tokens=False).ids
        assert got[k].decoded == tok.decode(got[k].ids, skip_special_tokens=False)


def test_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, extra int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
