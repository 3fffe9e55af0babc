"""Exact similarity of documents as sets of word shingles, within groups of candidates.

A set is known by a digest; copies are one set. Candidates arrive as clusters of sets. A cluster
that is too large for a task is cut into chunks, and every pair of chunks is a task of its own;
a set is compared with those only that are not linked to it yet, so a group of near copies costs
about one comparison per member, and only a star of links per component leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
CELL_SETS, CELL_SHINGLES = 1024, 1 << 21  # a chunk holds no more of either, but for a single set
SHARE = 80                                # percent of the union that linked sets share


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.encode("utf-8", "replace").translate(LOWER).split()


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Hashes of all shingles in order, repeats included; fewer words make one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b]) for a, b in zip(starts, ends[min(width, len(words)) - 1:])), np.uint64)


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    return np.unique(shingles(words_of(text), width))


def set_digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


KEYED = pa.schema([("digest", pa.binary()), ("text", pa.string())])


def _keyed(width: int):
    """digest, text from text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [set_digest(shingle_set(t, width)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), batch.column(0).cast(pa.string())], schema=KEYED)
    return run


def _sets(width: int):
    """text, shingles instead of text, which follows chunks: a set that several tasks need is made
    here and its text is dropped, any other is left to its task, as its text takes less room."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, many = batch.column(batch.num_columns - 1).to_pylist(), [c > 1 for c in batch.column(batch.num_columns - 2).to_pylist()]
            found = [shingle_set(t, width).view(np.int64) if m else None for t, m in zip(texts, many)]
            texts = pa.array([None if m else t for t, m in zip(texts, many)], pa.string())
            names = [*batch.schema.names, "shingles"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts, pa.array(found, pa.list_(pa.int64()))], names=names)
    return run


def linked(sets: list[np.ndarray], share: int = SHARE) -> np.ndarray:
    """The component (its first set) of each set; two link where their intersection is at least
    `share` percent of their union."""
    n = len(sets)
    label, sizes = np.arange(n), np.array([len(s) for s in sets])
    if n < 2:
        return label
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    mark = np.zeros(len(flat) and flat.max() + 1, bool)
    for u in range(n - 1):
        rest = np.arange(u + 1, n)
        low, high = np.minimum(sizes[u], sizes[rest]), np.maximum(sizes[u], sizes[rest])
        rest = rest[(label[rest] != label[u]) & (100 * low >= share * high) & (low > 0)]
        if not len(rest):
            continue
        own = flat[starts[u]:ends[u]]
        mark[own] = True
        if 2 * len(rest) > n - u:  # one pass over all that follow
            both = np.add.reduceat(mark[flat[starts[u + 1]:]].view(np.int8), np.minimum(starts[u + 1:], len(flat) - 1) - starts[u + 1], dtype=np.int64)[rest - u - 1]
        else:
            both = np.array([np.count_nonzero(mark[flat[starts[v]:ends[v]]]) for v in rest])
        mark[own] = False
        for v in rest[100 * both >= share * (sizes[u] + sizes[rest] - both)]:
            if label[v] != label[u]:
                a, b = sorted((label[u], label[v]))
                label[label == b] = a
    return label


EDGES = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("split", pa.bool_())])


def _links(width: int, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def out():
            digests = list(held)
            label = linked(list(held.values()), share)
            rows = [(digests[a], d) for a, d in zip(label, digests) if digests[a] != d]
            return [pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary()) for c in zip(*rows)), pa.array([now[3] > 1] * len(rows))], schema=EDGES)] if rows else []
        for batch in batches:
            texts, values = batch.columns[5:]
            for k, key in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]))):
                if key != now:
                    yield from out()
                    now, held = key, {}
                held[batch.column(4)[k].as_py()] = values[k].values.to_numpy().view(np.uint64) if values[k].is_valid else shingle_set(texts[k].as_py(), width)
        yield from out()
    return run


def confirm(docs: DataFrame, clusters: DataFrame, width: int, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b, split: stars of links between sets that make the same components as all pairs of one
    cluster whose similarity is at least `share` percent; split marks those of a cluster in chunks.

    clusters: digest, root (the cluster), least (an id of a row that has the set), n (its size).
    Texts of these rows are read again, so that sets are held for candidates only.
    """
    size = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("w")).where("g > 1")
    chunks = F.greatest(F.ceil(F.col("g") / CELL_SETS), F.ceil(F.col("w") / CELL_SHINGLES)).cast("int")
    placed = clusters.join(size.select("root", chunks.alias("chunks")), "root")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("digest"), F.col("chunks")).cast("int"))
    wanted = placed.select(F.col("least").alias("id_")).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(wanted, F.col("id").eqNullSafe(F.col("id_")), "left_semi")
    keyed = texts.select("text").mapInArrow(_keyed(width), "digest binary, text string")
    found = keyed.join(placed, "digest").select("digest", "root", "own", "chunks", "text")
    kind = placed.schema["root"].dataType.simpleString()
    sets = found.mapInArrow(_sets(width), f"digest binary, root {kind}, own int, chunks int, text string, shingles array<long>")
    cells = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = cells.select("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "chunks", "digest", "text", "shingles")
    ordered = rows.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "digest")
    return ordered.mapInArrow(_links(width, share), "a binary, b binary, split boolean")
