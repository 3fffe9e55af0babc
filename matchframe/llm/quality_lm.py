"""Quality by perplexity under an interpolated modified Kneser-Ney character model.

The model counts character four-grams of trusted texts (label quality = 1). Counts,
continuation counts, context totals and discounts are grouped and joined by Spark on the
n-gram, so they are spread over the n-gram space. A model of a bounded number of rows is
broadcast; the tables of a larger one are joined on the n-gram to the different n-grams of the
documents, whose log-probabilities are added up per document. A document is kept if its
perplexity is at most a quantile of the trusted texts of its language.

Four-grams are packed as four 16-bit codes; characters beyond U+FFFF share one code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize, query, read, whole_text
from .toxicity import in_training

ORDER = 4
QUANTILE = 0.97
SHARD_ROWS = 4_000_000    # a model of fewer rows is broadcast, a larger one joined
BATCH_CHARS = 1_000_000
MASKS = [(1 << 16 * k) - 1 for k in range(ORDER)] + [-1]


def codes_of(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 0xFFFD).astype(np.uint64)


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Four-grams ending at every character (zeros stand before a text), and each text's length."""
    sizes = np.array([len(t) for t in texts], np.int64)
    pad = ORDER - 1
    flat = np.zeros(int(sizes.sum()) + pad * len(texts), np.uint64)
    starts = np.cumsum(sizes + pad) - sizes
    at = np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(int(sizes.sum()))
    flat[at] = np.concatenate([codes_of(t) for t in texts]) if texts else flat[:0]
    out = np.zeros(len(at), np.uint64)
    for k in range(ORDER):
        out |= flat[at - k] << np.uint64(16 * k)
    return out, sizes


def _groups(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about BATCH_CHARS characters."""
    a = chars = 0
    for k, t in enumerate(column):
        chars += len(t.as_py())
        if chars >= BATCH_CHARS:
            yield a, k + 1
            a, chars = k + 1, 0
    if a < len(column):
        yield a, len(column)


COUNTS = pa.schema([("g", pa.int64()), ("c", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in _groups(batch.column(0)):
            g, n = np.unique(grams_of(batch.column(0)[a:b].to_pylist())[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], schema=COUNTS)


def _discounts(table: DataFrame) -> list[float]:
    n = table.agg(*[F.coalesce(F.sum((F.col("c") == k).cast("double")), F.lit(0.0)) for k in (1, 2, 3, 4)]).first()
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    return [min(float(k), max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else k / 2 for k in (1, 2, 3)]


def train(texts: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Per order the tables (g, p) and (h, gamma), h being the context. Orders below the
    highest count the different characters before an n-gram."""
    counts = texts.mapInArrow(_count, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))
    tables = [materialize(counts)]
    for k in range(ORDER - 1, 0, -1):
        tables.insert(0, materialize(tables[0].groupBy(F.col("g").bitwiseAND(F.lit(MASKS[k])).alias("g")).agg(F.count("*").alias("c"))))
    probabilities, gammas = [], []
    for k, table in enumerate(tables, 1):
        d = _discounts(table)
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = table.select("g", "c", F.shiftrightunsigned("g", 16).alias("h"), off.alias("off"))
        contexts = rows.groupBy("h").agg(F.sum("c").alias("total"), F.sum("off").alias("held"))
        joined = rows.join(contexts, "h").select("g", "h", (F.greatest(F.lit(0.0), F.col("c") - F.col("off")) / F.col("total")).alias("own"), (F.col("held") / F.col("total")).alias("gamma"))
        if k == 1:
            p = joined.select("g", (F.col("own") + F.col("gamma") / F.lit(float(1 << 16))).alias("p"))
        else:
            lower = probabilities[-1].select(F.col("g").alias("s"), F.col("p").alias("q"))
            p = joined.withColumn("s", F.col("g").bitwiseAND(F.lit(MASKS[k - 1]))).join(lower, "s").select("g", (F.col("own") + F.col("gamma") * F.col("q")).alias("p"))
        probabilities.append(materialize(p))
        gammas.append(materialize(contexts.select("h", (F.col("held") / F.col("total")).alias("gamma"))))
    return probabilities, gammas


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = df.toPandas()
    key = t.iloc[:, 0].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], t.iloc[:, 1].to_numpy(float)[order]


def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k, v = table
    if not len(k):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
    return k[at] == keys, v[at]


def log_probabilities(g: np.ndarray, probabilities: list, gammas: list) -> np.ndarray:
    """ln p of the last character of each four-gram given the three before it."""
    p = np.full(len(g), 1.0 / (1 << 16))
    for k in range(1, ORDER + 1):
        part = g & np.uint64(MASKS[k] & 0xFFFFFFFFFFFFFFFF)
        seen, own = _look(probabilities[k - 1], part)
        known, gamma = _look(gammas[k - 1], part >> np.uint64(16))
        p = np.where(seen, own, np.where(known, gamma * p, p))
    return np.log(p)


SCORES = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("digest", pa.int64()), ("ln_p", pa.float64()), ("n", pa.int64())])


def perplexities(docs: DataFrame, model: tuple[list[DataFrame], list[DataFrame]], shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, lang, digest, ln_p, n: summed log-probability of every whole text. A model of
    fewer than shard_rows rows is broadcast, a larger one is joined to the n-grams of the texts."""
    probabilities, gammas = model
    taken = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.xxhash64("text").alias("digest"), whole_text().alias("text"))
    if sum(t.count() for t in probabilities + gammas) >= shard_rows:
        return _joined(taken, probabilities, gammas)
    tables = [_arrays(t) for t in probabilities], [_arrays(t) for t in gammas]
    return taken.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(tables)), "doc_id long, lang string, digest long, ln_p double, n long")


def _joined(taken: DataFrame, probabilities: list[DataFrame], gammas: list[DataFrame]) -> DataFrame:
    """perplexities() by joins on the n-gram: each different one is looked up once."""
    counts = materialize(taken.mapInArrow(_count_rows, "doc_id long, lang string, digest long, g long, c long"))
    found = counts.where("g IS NOT NULL").select("g").distinct().withColumn("p", F.lit(1.0 / (1 << 16)))
    for k in range(1, ORDER + 1):
        own = probabilities[k - 1].select(F.col("g").alias("part"), F.col("p").alias("own"))
        gamma = gammas[k - 1].select(F.col("h").alias("context"), "gamma")
        part = F.col("g").bitwiseAND(F.lit(MASKS[k]))
        keyed = found.select("g", "p", part.alias("part"), F.shiftrightunsigned(part, 16).alias("context"))
        # the only context of the first order is the empty one
        both = keyed.join(own, "part", "left").join(F.broadcast(gamma) if k == 1 else gamma, "context", "left")
        found = both.select("g", F.coalesce("own", F.col("gamma") * F.col("p"), "p").alias("p"))
    ln_p = F.when(F.col("p") > 0, F.log("p")).otherwise(F.lit(float("-inf")))
    known = materialize(found.select("g", ln_p.alias("ln")))
    # a text without n-grams has one row of none; repeated rows were counted as often as they occur
    summed = counts.join(known, "g", "left").groupBy("doc_id", "lang", "digest").agg(
        F.sum(F.when(F.col("g").isNull(), 0.0).otherwise(F.col("c") * F.col("ln"))).alias("ln_p"), F.sum("c").alias("n"))
    copies = taken.groupBy("doc_id", "lang", "digest").agg(F.count("*").alias("copies"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("doc_id", "lang", "digest")]
    rows = summed.alias("s").join(copies.alias("t"), same[0] & same[1] & same[2]).select("s.*", "copies")
    return rows.select("doc_id", "lang", "digest", (F.col("ln_p") / F.col("copies")).alias("ln_p"), (F.col("n") / F.col("copies")).cast("long").alias("n"),
                       F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


ROW_COUNTS = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("digest", pa.int64()), ("g", pa.int64()), ("c", pa.int64())])


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            g, n = np.unique(grams_of([batch.column(3)[k].as_py()])[0], return_counts=True)
            at = pa.array(np.full(max(1, len(g)), k))
            grams = [pa.array(g.view(np.int64)), pa.array(n)] if len(g) else [pa.array([None], pa.int64()), pa.array([0], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(at) for j in range(3)), *grams], schema=ROW_COUNTS)


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probabilities, gammas = shared.value
        for batch in batches:
            for a, b in _groups(batch.column(3)):
                g, sizes = grams_of(batch.column(3)[a:b].to_pylist())
                distinct, at = np.unique(g, return_inverse=True)
                ln_p = log_probabilities(distinct, probabilities, gammas)[at] if len(g) else np.zeros(0)
                # summed per document, so that an impossible character weighs on its own document only
                of = np.repeat(np.arange(len(sizes)), sizes)
                total = np.bincount(of, ln_p, len(sizes))
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[a:b] for k in range(3)), pa.array(total), pa.array(sizes)], schema=SCORES)
    return run


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, lang, perplexity, threshold, keep for every row.

    Two thirds of the trusted training texts make the model, the quantile is taken over the
    rest, which it hasn't seen. Empty and null texts have no perplexity and are not kept. A language without trusted texts,
    null too, takes the quantile of all of them; without any trusted text nothing is kept out
    but the empty ones. Repeated rows come out as often as they occur.
    """
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    trusted = labels.where(in_training() & (F.col("quality") == 1)).select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("unseen", part == 3)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).join(trusted.where("NOT unseen").hint("merge"), "doc_id", "left_semi").select("text")
    scored = materialize(perplexities(docs, train(texts), shard_rows).select("doc_id", "lang", F.when(F.col("n") > 0, F.exp(-F.col("ln_p") / F.col("n"))).alias("perplexity")))
    good = scored.join(trusted.where("unseen"), "doc_id", "left_semi").where("perplexity IS NOT NULL")
    limit = F.percentile_approx("perplexity", quantile, 10_000).alias("threshold")
    overall = good.agg(limit).first().threshold
    per = good.groupBy(F.col("lang").alias("of_lang")).agg(limit)
    out = scored.join(per, F.col("lang").eqNullSafe(F.col("of_lang")), "left").select("doc_id", "lang", "perplexity", F.coalesce("threshold", F.lit(float("inf") if overall is None else overall)).alias("threshold"))
    return out.withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)))


@query("op8_quality_lm")
def op8_quality_lm(spark, sf_dir):
    """Perplexity and verdict of every document."""
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("lang")
