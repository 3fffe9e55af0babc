"""SimHash near-duplicates with a Gray-order hierarchical index.

Two fingerprints that differ in at most four bits agree exactly in all but four of m bit
blocks, so they meet under the masked value of at least one choice of m - 4 blocks. The
distinct fingerprints are dealt out by (choice, masked value), sorted by Gray rank and indexed
there: neighbours in Gray order share bit patterns, which are factored into the nodes above
them, and a pair of nodes whose shared patterns differ too much is pruned with all that hangs
below it. Pairs of nodes that already are one component are skipped, so a large group of near
copies costs no pair list; of each group only a star of links per component leaves the task.

Copies of a text have one fingerprint and take part once. Groups beyond a fixed size are cut
into chunks of the Gray order, and every pair of chunks is searched by a task of its own.

near_duplicates() links fingerprints of shingles as they are. keep_one() searches the same index
for candidates among several fingerprints of the words and compares them on full shingle sets.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import by_rows, materialize, query, read, unused, whole_text
from .graph import components, gathered, settled
from .shingle_sets import confirm, set_digest, shingles, words_of

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
GROUP_ROWS = 1 << 12   # wanted mean size of a group when the number of blocks is chosen
CHUNK_ROWS = 1 << 14   # a group beyond two chunks is searched chunk by chunk
BATCH_ROWS = 1 << 15   # groups are searched together up to this many rows
FAN = 8                # children of an index node
PAIRS = 1 << 20        # node pairs that are compared at once
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
# blocks and the largest number of fingerprints for which their masked values are selective
SCHEMES = tuple((m, GROUP_ROWS * 2 ** (BITS * (m - RADIUS) // m)) for m in (5, 6, 7, 8))


def fingerprint(text: str) -> int:
    """64-bit SimHash of the four-word shingles, repeats included; zero without words."""
    words = text.encode().translate(LOWER).split()  # splits at the six ASCII white space bytes
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends.tolist()[min(SHINGLE, len(words)) - 1:]
    votes = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(last), 8192):
        part = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k:k + 8192], last[k:k + 8192])], "<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(last), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    taken = docs.select(F.col(id_col).cast("long"), whole_text(text_col))
    return taken.mapInArrow(by_rows(lambda: lambda k, t: (k, _signed(fingerprint(t))), schema), "doc_id long, fp long")


def gray_rank(c: Column) -> Column:
    """Position of a bit string in the binary reflected Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, shift))
    return c


def choices(blocks: int) -> list[int]:
    """Masks of all choices of blocks that a pair within the radius leaves untouched."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    part = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in itertools.combinations(part, blocks - RADIUS)]


# ---- the index over one batch of sorted rows

def _levels(codes: np.ndarray, group: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """From the rows upwards: shared pattern, its mask, first and last group of each node."""
    full = np.full(len(codes), np.uint64(0xFFFFFFFFFFFFFFFF))
    levels = [(codes, full, group, group)]
    while len(levels[-1][0]) > FAN:
        pattern, mask, first, last = levels[-1]
        cuts = np.arange(0, len(pattern), FAN)
        ones = np.bitwise_and.reduceat(pattern & mask, cuts)   # bits shared as one
        zeros = np.bitwise_and.reduceat(~pattern & mask, cuts)  # bits shared as zero
        ends = np.minimum(cuts + FAN, len(pattern)) - 1
        levels.append((ones, ones | zeros, first[cuts], last[ends]))
    return levels


class _Components:
    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up

    def single(self, width: int) -> np.ndarray:
        """Per node of so many rows: its only component, or -1."""
        cuts = np.arange(0, len(self.root), width)
        low, high = np.minimum.reduceat(self.root, cuts), np.maximum.reduceat(self.root, cuts)
        return np.where(low == high, low, -1)


def link_rows(codes: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The component (its first row) of each row; rows are sorted by group and Gray rank and
    link within a group at no more than radius differing bits."""
    found = _Components(len(codes))
    for step in (1, 2):  # most near copies are neighbours in Gray order
        near = (group[step:] == group[:-step]) & (np.bitwise_count(codes[step:] ^ codes[:-step]) <= radius)
        a = np.flatnonzero(near)
        found.join(a, a + step)
    levels = _levels(codes, group)
    top = len(levels) - 1
    a, b = np.triu_indices(len(levels[top][0]))
    stack = [(top, a, b)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > PAIRS:
            half = len(a) // 2
            stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
            continue
        pattern, mask, first, last = levels[level]
        one = found.single(FAN ** level)
        keep = (first[b] <= last[a]) & ((one[a] < 0) | (one[a] != one[b]))
        a, b = a[keep], b[keep]
        differ = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= radius
        a, b = a[differ], b[differ]
        if not len(a):
            continue
        if level == 0:
            same = (a != b) & (group[a] == group[b])
            found.join(a[same], b[same])
            continue
        size, below = len(levels[level - 1][0]), np.arange(FAN)
        take = max(1, PAIRS // FAN ** 2)
        for k in range(0, len(a), take):
            x = (a[k:k + take, None, None] * FAN + below[None, :, None] + np.zeros((1, 1, FAN), int)).ravel()
            y = (b[k:k + take, None, None] * FAN + below[None, None, :] + np.zeros((1, FAN, 1), int)).ravel()
            good = (x < size) & (y < size) & (x <= y)
            stack.append((level - 1, x[good], y[good]))
    return found.root


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (choice, masked, cell, fp) in order: a star of links per component."""
    held: list[tuple[np.ndarray, ...]] = []

    def search(rows):
        group = np.cumsum(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in rows[:3]])])
        root = link_rows(rows[3].view(np.uint64), group)
        a = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(rows[3][root[a]]), pa.array(rows[3][a])], schema=EDGES)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(tuple(np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns))
        if sum(len(h[0]) for h in held) < BATCH_ROWS:
            continue
        rows = tuple(map(np.concatenate, zip(*held)))
        same = np.logical_and.reduce([c == c[-1] for c in rows[:3]])  # the last group may go on
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield search(tuple(c[:cut] for c in rows))
        held = [tuple(c[cut:] for c in rows)]
    if held and len(held[0][0]):
        yield search(tuple(map(np.concatenate, zip(*held))))


def link_fingerprints(distinct: DataFrame, n: int | None = None) -> DataFrame:
    """a, b: links between different fingerprints (column fp, each once) that join the same
    fingerprints into components as all pairs within the radius do."""
    n = distinct.count() if n is None else n
    blocks = next((m for m, most in SCHEMES if n <= most), SCHEMES[-1][0])
    masks = [_signed(m) for m in choices(blocks)]
    dealt = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "masked"))
    sizes = dealt.groupBy("choice", "masked").count().where(F.col("count") > 2 * CHUNK_ROWS)
    split = dealt.join(sizes, ["choice", "masked"], "left").withColumn("chunks", F.when(F.col("count").isNull(), 1).otherwise(F.ceil(F.col("count") / CHUNK_ROWS)).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    # a chunk meets every other one, itself included, in a cell of its own
    cells = split.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = cells.withColumn("cell", F.least("own", "other").cast("long") * 1_000_000 + F.greatest("own", "other"))
    ordered = cells.repartition("choice", "masked", "cell").sortWithinPartitions("choice", "masked", "cell", gray_rank(F.col("fp")))
    return ordered.select("choice", "masked", "cell", "fp").mapInArrow(_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id for every row: the smallest doc_id that is reachable over
    links of at most four differing bits.

    Null texts are empty; texts without words share the fingerprint zero. Rows with a null
    doc_id take part, and a component of only such rows has a null component_id. Repeated
    rows come out as often as they went in.
    """
    fps = materialize(fingerprints(docs, id_col, text_col))
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(link_fingerprints(distinct.select("fp")))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # most fingerprints are alone: only those with links have to be gathered by root
    linked = rooted.join(roots.select("root").distinct(), "root", "left_semi")
    lowest = linked.groupBy("root").agg(F.min("least").alias("lowest"))
    per_fp = rooted.join(lowest, "root", "left").select("fp", F.coalesce("lowest", "least").alias("component_id"))
    return fps.join(per_fp, "fp", "left").select("doc_id", "fp", "component_id")


# ---- near copies by similarity: the index finds candidates, full sets decide

WORD_SEEDS, WIDTH = (1, 2, 3), 5  # two fingerprints a seed; words of a shingle
SKETCHES = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("fps", pa.list_(pa.int64()))])


def word_fingerprints(words: list[bytes]) -> list[int]:
    """64-bit SimHashes of the distinct words, as signed longs. A changed word changes one word
    but five shingles: near copies are much closer here than in fingerprints of shingles."""
    found = list(dict.fromkeys(words))
    out: list[int] = []
    for seed in WORD_SEEDS:
        bits = np.unpackbits(np.frombuffer(b"".join(xxhash.xxh3_128_digest(w, seed) for w in found), np.uint8).reshape(len(found), 16), axis=1)
        out += np.packbits(2 * bits.sum(0, dtype=np.int64) > len(found)).view("<i8").tolist()
    return out


def _sketch(doc_id, row, text):
    words = words_of(text)
    found = np.unique(shingles(words, WIDTH))
    return doc_id, row, len(found), set_digest(found), word_fingerprints(words)


def candidates(sets: DataFrame) -> DataFrame:
    """a, b: sets with an equal fingerprint, or one within the radius, hang together. All
    fingerprints of a set are searched in one index."""
    fps = sets.select("digest", F.explode("fps").alias("fp"))
    first = materialize(fps.groupBy("fp").agg(F.min("digest").alias("a")))
    links = link_fingerprints(first.select("fp"))
    of_a, of_b = (first.select(F.col("fp").alias(c), F.col("a").alias(f"set_{c}")) for c in ("a", "b"))
    across = links.join(of_a, "a").join(of_b, "b").select(F.col("set_a").alias("a"), F.col("set_b").alias("b"))
    within = fps.join(first, "fp").select("a", F.col("digest").alias("b"))
    return across.union(within).where("a <> b").distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; all columns stay.

    Two texts are near copies if their sets of five-word shingles share at least 80 percent of
    their union; groups are what such links reach. Candidates differ in at most four bits of one
    of six fingerprints of their words and are compared on full sets, so nothing goes unchecked.
    Texts without words are copies of each other. Rows that share an id but not a text are told
    apart; a group of rows without ids keeps one of them, as do rows of the same id and text.
    """
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(whole_text(text_col)).alias("row"), whole_text(text_col).alias("text"))
    marked = materialize(table.mapInArrow(by_rows(lambda: _sketch, SKETCHES), "doc_id long, row long, n long, digest binary, fps array<long>"))
    # of the rows of a set the one with the smallest id, ids before none
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("low")
    sets = materialize(marked.groupBy("digest").agg(lowest, F.first("n").alias("n"), F.first("fps").alias("fps")))
    clusters = gathered(candidates(sets.select("digest", "fps"))).withColumnRenamed("node", "digest")
    clusters = materialize(clusters.join(sets.select("digest", F.col("low.doc_id").alias("least"), "n"), "digest"))
    roots = settled(confirm(table, clusters, WIDTH)).withColumnRenamed("node", "digest")
    alone = sets.join(roots, "digest", "left_anti").select("low")
    groups = sets.select("digest", "low").join(roots, "digest").groupBy("root").agg(F.min("low").alias("low")).select("low")
    kept_id, kept_row, own_row, place = unused(docs, "kept_id", "kept_row", "own_row", "place")
    kept = alone.union(groups).select(F.col("low.doc_id").alias(kept_id), F.col("low.row").alias(kept_row))
    keyed = docs.withColumn(own_row, F.xxhash64(whole_text(text_col)))
    named = keyed.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(kept_id)) & (F.col(own_row) == F.col(kept_row)), "left_semi")
    first = F.row_number().over(Window.partitionBy(id_col, own_row).orderBy(F.lit(0)))
    return named.withColumn(place, first).where(F.col(place) == 1).select(docs.columns)


@query("op10_simhash_gray")
def op10_simhash_gray(spark, sf_dir):
    """Fingerprint and component of every document."""
    marked = near_duplicates(read(spark, sf_dir, "documents"))
    return marked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
