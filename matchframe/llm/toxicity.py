"""Toxic passages by maximum-scoring segments.

Tokens get log-odds of toxic against clean documents, shrunk by an informative Dirichlet
prior whose shape is the token's frequency in the whole corpus. A token whose log-odds are
not certain enough scores a small negative drift; every maximal segment of a text then comes
from one linear scan (Ruzzo and Tompa). Segment scores follow an extreme-value distribution:
lambda solves the score equation over the clean token frequencies, K is fitted on clean
documents, and a document's statistic sums the normalised scores of its segments. Counts of
(statistic, label) of documents that the weights have not seen give the probability, made
monotone by pooling.

Tokens are hashed to 2**18 buckets, so counts, weights and everything that is broadcast have
a fixed bound however large the corpus is.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import by_rows, held, materialize, query, read, whole_text

BUCKETS = 1 << 18
PRIOR_SHARE = 0.15   # Dirichlet mass as a share of the labelled token presences
CERTAIN = 1.0        # log-odds count from so many standard deviations above zero
DRIFT = 0.2          # per token that is no evidence
SIGNIFICANT = 0.01   # expected number of clean documents' segments of a reported passage
NONE, BINS, BIN_FROM, BIN_WIDTH = -99.0, 64, -10.0, 0.5  # the first bin is for texts without any evidence
REJECT = 0.3         # documents are toxic from this probability on
WORD = re.compile(r"\w+")
MEMO_ENTRIES = 400_000


class Memo(dict):
    """Bucket by word, made where it is missing."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO_ENTRIES:
            self.clear()
        got = zlib.crc32(word.encode()) & (BUCKETS - 1)
        if len(word) <= 40:
            self[word] = got
        return got


def buckets_of(text: str) -> list[int]:
    return list(map(held("toxicity", Memo).__getitem__, WORD.findall(text.lower())))


def in_training(id_col: str = "doc_id") -> Column:
    """Whether a row's label may be learnt from; a null id is in no part."""
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 4) != 2


def fold_of(id_col: str = "doc_id") -> Column:
    """0 or 1: the half of the training rows a document belongs to."""
    return (F.floor(F.crc32(F.col(id_col).cast("string").cast("binary")) / 4) % 2).cast("int")


@dataclass
class Weights:
    """Scores of the positive buckets per set of labels (all, each half) and what the
    extreme-value distribution needs."""
    scores: dict[int, tuple[float, float, float]]
    lam: tuple[float, float, float]
    k: float = 1.0


def segments(positions: list[int], scores: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last token, score) of a token sequence that has
    the given positive scores at the given positions and -drift elsewhere. Linear: every
    candidate is merged or kept once."""
    found: list[tuple[int, int, float, float]] = []  # first, last, total before it, total up to its end
    total, at = 0.0, 0
    best: list[int] = []  # per candidate: the last one before it that starts from a lower total, or -1
    for pos, score in zip(positions, scores):
        before = total - drift * (pos - at)
        total, at = before + score, pos + 1
        first, last, low, high = pos, pos, before, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = best[j]
            if j < 0 or found[j][3] >= high:
                best.append(j)
                found.append((first, last, low, high))
                break
            first, low = found[j][0], found[j][2]
            del found[j:], best[j:]
    return [(a, b, high - low) for a, b, low, high in found]


def statistic(buckets: list[int], weights: Weights, which: int) -> float:
    """-ln of the expected number of clean segments as good as all of this text's together:
    ln of the sum of exp(lambda * S) over its maximal segments, less ln(K n). NONE without one."""
    scores = weights.scores
    hit = [(p, scores[b][which]) for p, b in enumerate(buckets) if b in scores and scores[b][which] > 0]
    if not hit:
        return NONE
    lam = weights.lam[which]
    parts = [lam * s for _, _, s in segments([p for p, _ in hit], [s for _, s in hit])]
    top = max(parts)
    return top + math.log(sum(math.exp(p - top) for p in parts)) - math.log(weights.k * len(buckets))


def passages(text: str, weights: Weights, significant: float = SIGNIFICANT) -> list[tuple[int, int, float, float]]:
    """Every significant toxic passage: start, end (code points), score, expected number of
    such passages in a clean text of this length."""
    words = list(WORD.finditer(text))
    hit = [(p, s) for p, b in enumerate(buckets_of(text)) if (s := weights.scores.get(b, (0.0,))[0]) > 0]
    out = []
    for a, b, score in segments([p for p, _ in hit], [s for _, s in hit]):
        expected = weights.k * len(words) * math.exp(-weights.lam[0] * score)
        if expected <= significant:
            out.append((words[a].start(), words[b].end(), score, expected))
    return out


# ---- learning

TERMS = pa.schema([("doc_id", pa.int64()), ("terms", pa.binary())])
COUNTS = pa.schema([("bucket", pa.int32()), *((n, pa.int64()) for n in ("seen", "toxic0", "clean0", "toxic1", "clean1"))])


def _terms(doc_id, text):
    return doc_id, np.unique(np.array(buckets_of(text), "<i4")).tobytes()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document counts per bucket of one task, in arrays of fixed size."""
    seen = np.zeros((5, BUCKETS), np.int64)
    for batch in batches:
        for terms, label, fold in zip(*(c.to_pylist() for c in batch.columns)):
            at = np.frombuffer(terms, "<i4")
            seen[0, at] += 1
            if label is not None:
                seen[1 + 2 * fold + (label == 0), at] += 1
    at = np.flatnonzero(seen[0])
    for k in range(0, len(at), 50_000):
        part = at[k:k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype("i4")), *(pa.array(row[part]) for row in seen)], schema=COUNTS)


def labels_of(labels: DataFrame) -> DataFrame:
    """One training label per document; rows that disagree count as toxic, null labels are none."""
    return labels.where(in_training() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))


def _root(rates: np.ndarray, scores: np.ndarray) -> float:
    """lambda > 0 with an expectation of exp(lambda * score) of one under the clean rates."""
    rest = max(0.0, 1.0 - rates.sum())
    value = lambda x: float((rates * np.exp(x * scores)).sum() + rest * math.exp(-x * DRIFT)) - 1
    low, high = 0.0, 1e-3
    while value(high) < 0 and high < 50:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return max(high, 1e-3)


def learn_weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Weights:
    """Scores from all documents (prior) and the labelled training rows (counts).

    The join that brings labels to documents moves sets of bucket numbers instead of texts.
    At most 2**18 count rows reach the driver, whatever the input.
    """
    schema = "doc_id long, terms binary"
    terms = docs.select(F.col(id_col).cast("long"), whole_text(text_col)).mapInArrow(by_rows(lambda: _terms, TERMS), schema)
    joined = terms.join(labels_of(labels).hint("merge"), "doc_id", "left").select("terms", "label", F.coalesce(fold_of(), F.lit(0)))
    counts = joined.mapInArrow(_count, "bucket int, seen long, toxic0 long, clean0 long, toxic1 long, clean1 long")
    summed = materialize(counts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in COUNTS.names[1:]]))
    total = summed.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS.names[1:]]).first()
    mass = max(1.0, PRIOR_SHARE * (total.toxic0 + total.clean0 + total.toxic1 + total.clean1))
    odds = []
    for k, (toxic, clean) in enumerate((("(toxic0 + toxic1)", "(clean0 + clean1)"), ("toxic0", "clean0"), ("toxic1", "clean1"))):
        sums = [(total.toxic0 + total.toxic1, total.clean0 + total.clean1), (total.toxic0, total.clean0), (total.toxic1, total.clean1)][k]
        prior = f"({mass} * seen / {max(total.seen, 1)}D)"
        side = lambda c, n: f"ln(({c} + {prior}) / ({n + mass}D - {c} - {prior}))"
        spread = f"sqrt(1 / ({toxic} + {prior}) + 1 / ({clean} + {prior}))"
        odds.append(F.expr(f"greatest(0D, {side(toxic, sums[0])} - {side(clean, sums[1])} - {CERTAIN} * {spread})").alias(f"s{k}"))
    positive = summed.select("bucket", (F.expr(f"(clean0 + clean1 + {mass} * seen / {max(total.seen, 1)}D) / {total.clean0 + total.clean1 + mass}D")).alias("rate"), *odds)
    rows = positive.where("s0 > 0 OR s1 > 0 OR s2 > 0").collect()
    table = np.array([tuple(r)[1:] for r in rows], float).reshape(-1, 4)
    lam = tuple(_root(table[table[:, k] > 0, 0], table[table[:, k] > 0, k]) for k in (1, 2, 3))
    return Weights({r.bucket: (r.s0, r.s1, r.s2) for r in rows}, lam)


STATS = pa.schema([("doc_id", pa.int64()), ("stat", pa.float64()), ("blind", pa.float64())])


def statistics(docs: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, stat, blind: the statistic under all weights, and under those of the other half."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # at most 2**18 buckets

    def make():
        w = shared.value

        def one(doc_id, fold, text):
            b = buckets_of(text)
            return doc_id, statistic(b, w, 0), statistic(b, w, 2 - fold)
        return one

    taken = docs.select(F.col(id_col).cast("long"), F.coalesce(fold_of(id_col), F.lit(0)), whole_text(text_col))
    return taken.mapInArrow(by_rows(make, STATS), "doc_id long, stat double, blind double")


def pooled(toxic: list[float], total: list[float]) -> list[float]:
    """Rates per bin, made to rise by pooling neighbours that don't; a bin without labels gets
    its lower neighbour's."""
    overall = (sum(toxic) + 0.5) / (sum(total) + 1)
    blocks: list[list[float]] = []
    for t, n in zip(toxic, total):
        blocks.append([t + overall, n + 1, 1] if n else [0, 0, 1])
        if not n and len(blocks) > 1:
            blocks.pop()
            blocks[-1][2] += 1
        elif not n:
            blocks[-1] = [overall, 1, 1]
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            t2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return [b[0] / b[1] for b in blocks for _ in range(int(b[2]))]


@dataclass
class Model:
    weights: Weights
    chance: list[float]

    def probability(self, stat: float) -> float:
        """The bin's rate; a small share of the way to the next one keeps the order within it."""
        if stat <= NONE:
            return self.chance[0]
        k = bin_of(stat)
        inside = min(1.0, max(0.0, (stat - BIN_FROM) / BIN_WIDTH - (k - 1))) if k < BINS - 1 else 1 - math.exp(-max(stat, 0.0) / 20)
        here, after = self.chance[k], self.chance[k + 1] if k + 1 < BINS else 1.0
        return here + (after - here) * inside * 0.01


def bin_of(stat: float) -> int:
    return 0 if stat <= NONE else max(1, min(BINS - 1, 1 + math.floor((stat - BIN_FROM) / BIN_WIDTH)))


def calibrate(stats: DataFrame, labels: DataFrame, weights: Weights) -> Model:
    """Chances per bin from the statistic of the half that the weights have not seen."""
    bin_ = F.when(F.col("blind") <= NONE, 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(BINS - 1), 1 + F.floor((F.col("blind") - BIN_FROM) / BIN_WIDTH))))
    seen = stats.join(labels_of(labels), "doc_id").groupBy(bin_.alias("bin")).agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).collect()
    toxic, total = [0.0] * BINS, [0.0] * BINS
    for r in seen:
        toxic[int(r.bin)], total[int(r.bin)] = float(r.toxic), float(r.n)
    return Model(weights, pooled(toxic, total))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the written statistics of every document (doc_id, stat, blind).

    K is fitted on the clean training documents: so that no more of them than expected reach
    the level that one in twenty should. Labels of rows outside the training part, and null or
    missing labels, are never read; without any toxic label every document gets the base rate.
    """
    weights = learn_weights(docs, labels, id_col, text_col)
    stats = materialize(statistics(docs, weights, id_col, text_col))
    clean = stats.join(labels_of(labels).where("label = 0"), "doc_id")
    # documents that should be one in twenty, against how many there are
    share = clean.agg(F.avg((F.col("blind") > math.log(20)).cast("double")).alias("share")).first().share
    weights.k = max(1.0, float(share or 0) * 20)
    stats = stats.select("doc_id", *[F.when(F.col(c) > NONE, F.col(c) - math.log(weights.k)).otherwise(NONE).alias(c) for c in ("stat", "blind")])
    return calibrate(stats, labels, weights), stats


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row (null text: empty, repeated rows as often as they occur);
    a null doc_id is scored and never learnt from."""
    model, stats = train(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model.chance)

    @F.pandas_udf("double")
    def probability(stat: pd.Series) -> pd.Series:
        m = Model(Weights({}, (1.0, 1.0, 1.0)), shared.value)
        return stat.map(m.probability)
    return stats.select("doc_id", probability("stat").alias("score"))


def find_passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first, last (code points, end exclusive), score, expected: every significant passage."""
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])))])

    def make():
        w = shared.value
        return lambda k, t: (k, [dict(zip(("first", "last", "score", "expected"), p)) for p in passages(t, w)])
    taken = docs.select(F.col(id_col).cast("long"), whole_text(text_col))
    spans = taken.mapInArrow(by_rows(make, schema), "doc_id long, spans array<struct<first:int,last:int,score:double,expected:double>>")
    return spans.selectExpr("doc_id", "inline(spans)")


def drop_toxic(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """Documents below the rejecting probability, with all their columns. The model is small
    and the texts are scored where they are, so the filter shuffles nothing."""
    model, _ = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def stays(texts: pd.Series) -> pd.Series:
        m = shared.value
        return texts.map(lambda t: m.probability(statistic(buckets_of(t), m.weights, 0)) < reject).astype(bool)
    return docs.where(stays(whole_text()))


@query("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    """Probability of a toxic label for every document."""
    scored = score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(~in_training(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
