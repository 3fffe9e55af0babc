"""Three-class gradient boosting on histograms.

A round grows one tree per class from the softmax gradients of all three. A level is one scan:
every task adds up gradient and curvature by (class, node, column, bin), vectors are added in two
levels by class, and the best split of each node is found where its histogram is summed. Rows are
stored once in chunks of a few thousand, one byte per column, column after column; their margins are
written anew every few rounds, and the trees grown since are applied while a task reads. What returns
to the driver is a few splits per level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..plans.packed import CHUNK, write_chunks
from ..plans.session import scratch_scope
from .newton import _moments

BINS = 64            # bins of a column, cut at quantiles
RIDGE = 1.0          # added to the curvature of a leaf
LEAST_CURVATURE = 1.0
REFRESH = 25         # rounds between written margins
SLOTS = 32
K = 3


@dataclass
class Tree:
    """A complete binary tree: per inner node (breadth first) the column and the highest bin that
    goes left, -1 where all go left; one value per leaf."""

    column: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """Leaf of each row: whole columns are compared, fast if `bins` is stored by column. Per level one
        bit is chosen among those of its nodes by the bits above."""
        out, above, first = np.zeros(len(bins), np.intp), [], 0
        while first < len(self.column):
            # plain numbers: bytes are compared with bytes
            right = [bins[:, c] > cut if c >= 0 else np.zeros(len(bins), bool) for c, cut in zip(self.column[first:2 * first + 1].tolist(), self.cut[first:2 * first + 1].tolist())]
            for bit in reversed(above):
                right = [a ^ (bit & (a ^ b)) for a, b in zip(right[::2], right[1::2])]
            above.append(right[0])
            out = 2 * out + right[0]
            first = 2 * first + 1
        return out


@dataclass
class Boosted:
    """Means, bin edges per column, class priors on the log scale and the trees of every round."""

    name: str
    cols: list[str]
    n_train: int
    means: list[float]
    edges: list[list[float]]
    prior: list[float]
    rate: float
    rounds: list[list[Tree]]
    link: str = "softmax"
    log: dict = field(default_factory=dict)

    def filled(self) -> list[Column]:
        return [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(m)) for c, m in zip(self.cols, self.means)]

    def margins(self, x: np.ndarray) -> np.ndarray:
        return _margins(binned(x, self.edges), np.tile(self.prior, (len(x), 1)), self.rounds, self.rate)

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows with the margins as columns _m0, _m1, _m2."""
        d = len(self.cols)

        @arrow_udf("array<double>")
        def score(x: pa.Array) -> pa.Array:
            m = self.margins(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)) if len(x) else np.zeros((0, K))
            return pa.ListArray.from_arrays(pa.array(np.arange(0, K * len(x) + 1, K), pa.int32()), pa.array(m.ravel()))
        scored = df.withColumn("_m", score(F.array(*self.filled())))
        return scored.select(*df.columns, *[F.col("_m")[k].alias(f"_m{k}") for k in range(K)])

    def state(self) -> dict:
        """Plain values, for a metadata row."""
        return {"means": self.means, "edges": self.edges, "prior": self.prior, "rate": self.rate,
                "rounds": [[[t.column.tolist(), t.cut.tolist(), t.value.tolist()] for t in r] for r in self.rounds]}


def from_state(name: str, cols: list[str], n_train: int, state: dict) -> Boosted:
    rounds = [[Tree(np.array(a), np.array(b), np.array(c)) for a, b, c in r] for r in state["rounds"]]
    return Boosted(name, cols, n_train, state["means"], state["edges"], state["prior"], state["rate"], rounds)


CHUNKS = "bins binary, y binary, margins binary"


def _chunk(bins: np.ndarray, y: np.ndarray, margins: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v.tobytes("F")], pa.binary()) for v in (bins, y.astype(np.uint8), margins)], names=["bins", "y", "margins"])


def _chunks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, d) bins, classes and (rows, K) margins of a task's chunks, stored by column."""
    for batch in batches:
        for bins, y, margins in zip(*batch.columns):
            y = np.frombuffer(y.as_buffer(), np.uint8)
            yield (np.frombuffer(bins.as_buffer(), np.uint8).reshape(d, len(y)).T, y.astype(int), np.frombuffer(margins.as_buffer()).reshape(K, len(y)).T)


def binned(x: np.ndarray, edges: Sequence[Sequence[float]]) -> np.ndarray:
    """One byte per value: the number of edges below it."""
    return np.column_stack([np.searchsorted(np.asarray(e), x[:, i], side="left") for i, e in enumerate(edges)]).astype(np.uint8)


def _margins(bins: np.ndarray, start: np.ndarray, rounds: Sequence[Sequence[Tree]], rate: float) -> np.ndarray:
    out = start.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[:, k] += (rate * tree.value)[tree.leaf(bins)]
    return out


def gradients(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = np.exp(margins - margins.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    g = p.copy()
    g[np.arange(len(y)), y] -= 1.0
    return g, p * (1 - p)


def histogram(bins: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int) -> np.ndarray:
    """(2, nodes, columns, BINS): sums of gradient and curvature."""
    d, first = bins.shape[1], node * BINS
    out = np.empty((2, nodes, d, BINS))
    for c in range(d):  # one column at a time stays in the processor's cache
        at = first + bins[:, c]
        for k, v in enumerate((g, h)):
            out[k, :, c] = np.bincount(at, v, nodes * BINS).reshape(nodes, BINS)
    return out


def best_splits(hist: np.ndarray) -> list[tuple[int, int, float, float, float, float]]:
    """Per node: column, cut and gradient and curvature on both sides; column -1 without a gain.
    Of equal gains the first column and cut count."""
    left = hist.cumsum(3)[..., :-1]
    total = hist.sum(3, keepdims=True)
    right = total - left
    gain = left[0] ** 2 / (left[1] + RIDGE) + right[0] ** 2 / (right[1] + RIDGE) - total[0] ** 2 / (total[1] + RIDGE)
    gain[(left[1] < LEAST_CURVATURE) | (right[1] < LEAST_CURVATURE)] = -np.inf
    out = []
    for n in range(hist.shape[1]):
        flat = int(gain[n].argmax())
        c, cut = divmod(flat, BINS - 1)
        if gain[n, c, cut] > 1e-9:
            out.append((c, cut, left[0, n, c, cut], left[1, n, c, cut], right[0, n, c, cut], right[1, n, c, cut]))
        else:
            out.append((-1, 0, total[0, n, 0, 0], total[1, n, 0, 0], 0.0, 0.0))
    return out


SUMS = pa.schema([("cls", pa.int32()), ("slot", pa.int32()), ("v", pa.binary())])


def _scan(recent: list[list[Tree]], growing: list[Tree], level: int, rate: float, d: int):
    """Histograms of the growing trees' nodes over a task's rows (bins, y, margins)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, total = TaskContext.get().partitionId() % SLOTS, np.zeros((K, 2, 1 << level, d, BINS))
        for bins, y, start in _chunks(batches, d):
            g, h = gradients(_margins(bins, start, recent, rate), y)
            for k, tree in enumerate(growing):
                node = tree.leaf(bins) if level else np.zeros(len(y), int)
                total[k] += histogram(bins, node, np.ascontiguousarray(g[:, k]), np.ascontiguousarray(h[:, k]), 1 << level)
        yield pa.RecordBatch.from_arrays([pa.array(range(K), pa.int32()), pa.array([slot] * K, pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], schema=SUMS)
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for cls, _, v in zip(*(c.to_pylist() for c in batch.columns)):
            v = np.frombuffer(v)
            total[cls] = total[cls] + v if cls in total else v
    return total


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = _added(batches)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([0] * len(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], schema=SUMS)


def _split(level: int, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(cls, n, *s) for cls, v in _added(batches).items() for n, s in enumerate(best_splits(v.reshape(2, 1 << level, d, BINS)))]
        if rows:
            kinds = [pa.int32()] * 4 + [pa.float64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["cls", "node", "col", "cut", "gl", "hl", "gr", "hr"])
    return run


def _deeper(tree: Tree | None, splits: list[tuple]) -> Tree:
    """The tree with its leaves split; values are the best ones of the new leaves."""
    column, cut = ([], []) if tree is None else (tree.column.tolist(), tree.cut.tolist())
    value = []
    for c, at, gl, hl, gr, hr in splits:
        column.append(c)
        cut.append(at)
        value += [-gl / (hl + RIDGE), -gr / (hr + RIDGE)]
    return Tree(np.array(column), np.array(cut), np.array(value))


def fit(train: DataFrame, cols: Sequence[str], rounds: int = 250, depth: int = 3, rate: float = 0.1, label: str = "y") -> Boosted:
    """Mean-filled columns; rows with a null label are left out. A deterministic fit: no sampling."""
    cols, d = list(cols), len(cols)
    train = train.where(F.col(label).isNotNull())
    moments = _moments(train, cols, None)
    if not moments:
        raise ValueError("no training rows")
    n, means = moments[0]["n"], [moments[0][f"m{i}"] for i in range(d)]
    counts = {row[label]: row["count"] for row in train.groupBy(label).count().collect()}
    prior = [math.log(max(counts.get(k, 0), 0.5) / n) for k in range(K)]
    filled = train.select(F.col(label).cast("int").alias("y"), *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(m)).alias(f"x{i}") for i, (c, m) in enumerate(zip(cols, means))])
    cuts = filled.approxQuantile([f"x{i}" for i in range(d)], [q / BINS for q in range(1, BINS)], 0.001)
    edges = [sorted(set(e)) for e in cuts]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, CHUNK):
                y, *x = (c.to_numpy(zero_copy_only=False) for c in batch.slice(first, CHUNK).columns)
                yield _chunk(binned(np.column_stack(x), edges), y, np.tile(prior, (len(y), 1)))
    model = Boosted("boosted", cols, n, means, edges, prior, rate, [])
    with scratch_scope(train.sparkSession):
        _grow(model, write_chunks(filled.mapInArrow(pack, CHUNKS)), rounds, depth)
    return model


def _grow(model: Boosted, table: DataFrame, rounds: int, depth: int) -> None:
    """Add the trees of all rounds, grown on the rows of a table of chunks."""
    d, rate = len(model.cols), model.rate
    many = table.rdd.getNumPartitions() > 2 * SLOTS
    recent: list[list[Tree]] = []
    for _ in range(rounds):
        growing: list[Tree | None] = [None] * K
        for level in range(depth):
            sums = table.mapInArrow(_scan(recent, growing, level, rate, d), "cls int, slot int, v binary")
            if many:
                sums = sums.repartition("cls", "slot").mapInArrow(_add, "cls int, slot int, v binary")
            found = sums.repartition(K, "cls").mapInArrow(_split(level, d), "cls int, node int, col int, cut int, gl double, hl double, gr double, hr double").collect()
            for k in range(K):
                growing[k] = _deeper(growing[k], [tuple(row)[2:] for row in sorted(found, key=lambda r: r.node) if row.cls == k])
        model.rounds.append(growing)
        recent.append(growing)
        if len(recent) == REFRESH:
            table, recent = write_chunks(table.mapInArrow(_refresh(recent, rate, d), CHUNKS)), []


def _refresh(recent: list[list[Tree]], rate: float, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins, y, start in _chunks(batches, d):
            yield _chunk(bins, y, _margins(bins, start, recent, rate))
    return run
