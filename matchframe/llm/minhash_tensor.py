"""MinHash near-duplicates by tensored banding.

A table of banding needs a key of eight minhashes, and 196 tables would need 1,568 of them. Here
two collections of 14 half keys, four minhashes each, are drawn, and table (i, j) takes half i of
the first collection with half j of the second: 112 minhashes make all 196 tables. Two sets of
similarity J meet unless one collection has no equal half: at 0.8 that is one pair in 800, at 0.85
one in 20,000, and a pair that is missed mostly is linked over a third document.

The diagonal tables (i, i) come first: what meets there is compared on full sets and linked, which
joins most groups of near copies. The other tables then only have to bring sets of different
components together: halves that sets of one component share with no other set form no keys. All
candidates of a table are one cluster, and clusters are compared on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize, query, read, whole_text
from .graph import reached, settled
from .shingle_sets import confirm, set_digest, shingle_set

WIDTH = 4                 # words of a shingle
HALVES, PER_HALF = 14, 4  # half keys of a collection, minhashes of a half
SEED = 13
BLOCK = 2048              # shingles that are hashed at once
_rng = np.random.default_rng(SEED)
FACTORS = _rng.integers(0, 1 << 63, 2 * HALVES * PER_HALF, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 1 << 63, 2 * HALVES * PER_HALF, np.uint64)
MIX = _rng.integers(0, 1 << 63, (PER_HALF, 2 * HALVES), np.uint64) * np.uint64(2) + np.uint64(1)

SKETCHES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("halves", pa.list_(pa.int64()))])


def halves_of(found: np.ndarray) -> np.ndarray:
    """Half keys of a set: the first collection, then the second."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), BLOCK):
        np.minimum(least, (found[k:k + BLOCK, None] * FACTORS + SHIFTS).min(0), out=least)
    least = least.reshape(PER_HALF, 2 * HALVES)
    return (((least ^ (least >> np.uint64(29))) * MIX).sum(0) + np.arange(2 * HALVES, dtype=np.uint64)).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            found = shingle_set(text, WIDTH)
            rows.append((doc_id, len(found), set_digest(found), halves_of(found).tolist() if len(found) else None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), SKETCHES)], schema=SKETCHES)


def diagonal_keys(sets: DataFrame) -> DataFrame:
    """key, who: one row per diagonal table; who has the set's label and id."""
    keys = F.expr(f"transform(sequence(0, {HALVES - 1}), i -> xxhash64(halves[i], halves[i + {HALVES}]))")
    return sets.select(F.explode(keys).alias("key"), F.struct(F.col("id").alias("label"), "id").alias("who"))


def tensor_keys(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """key, who: one row per table in which a set may meet one of another component.
    roots: digest, root of the sets that have links."""
    label = F.xxhash64(F.coalesce("root", "digest")).alias("label")
    # a half's number takes the place of its five highest bits
    halves = F.expr("transform(halves, (h, k) -> shiftleft(h, 5) | k)")
    half = sets.join(roots, "digest", "left").select(F.explode(halves).alias("key"), F.struct(label, "id").alias("who"))
    shared = meeting(half).groupBy("who").agg(F.collect_list("key").alias("halves"))
    first, second = (f"filter(halves, h -> (h & 31) {side} {HALVES})" for side in ("<", ">="))
    keys = F.expr(f"flatten(transform({first}, i -> transform({second}, j -> xxhash64(i, j))))")
    return shared.select(F.explode(keys).alias("key"), "who")


def meeting(rows: DataFrame) -> DataFrame:
    """key, who, a: the rows whose key has more than one label, with the id of one of them.

    Rows are dealt by key once: the least and the greatest of a key are taken and looked up where
    its rows are. Both sides need both columns, so Spark makes one exchange for the two.
    """
    dealt = rows.repartition("key")
    ends = dealt.groupBy("key").agg(F.min("who").alias("x"), F.max("who").alias("y"))
    other = F.expr("who.label <> x.label OR who.label <> y.label")
    return dealt.join(ends, "key").where(other).select("key", "who", F.col("x.id").alias("a"))


def clusters_of(keys: DataFrame) -> DataFrame:
    """id, root: what tables hold together, of the keys with more than one label.

    Each set first follows one set of each of its tables, the least of these, so one link per set;
    then only tables that still hold several clusters link these. So a large group costs a few
    links per set, not one per table.
    """
    rows = materialize(meeting(keys).select("key", F.col("who.id").alias("id"), "a"))
    least = materialize(rows.groupBy("id").agg(F.min("a").alias("a")))
    near = reached(least.where("a <> id").select("a", F.col("id").alias("b"))).withColumnRenamed("node", "id")
    near = materialize(least.join(near, "id", "left").select("id", F.coalesce("root", "id").alias("r")))
    held = rows.select("key", "id").join(near, "id").select("key", "r")
    span = held.groupBy("key").agg(F.min("r").alias("a"), F.max("r").alias("z")).where("a <> z").select("key", "a")
    over = reached(held.join(span, "key").where("a <> r").select("a", F.col("r").alias("b")).distinct()).select(F.col("node").alias("r"), F.col("root").alias("top"))
    return near.join(over, "r", "left").select("id", F.coalesce("top", "r").alias("root"))


def confirmed(docs: DataFrame, sets: DataFrame, clusters: DataFrame) -> DataFrame:
    """digest, root: the components, on full sets, of each cluster of candidates."""
    clusters = materialize(clusters.join(sets.select("id", "digest", "least", "n"), "id").drop("id"))
    return settled(confirm(docs, clusters, WIDTH)).withColumnRenamed("node", "digest")


def joined(first: DataFrame, more: DataFrame) -> DataFrame:
    """digest, root: components of both tables of the same kind together."""
    of = first.select(F.col("digest").alias("d"), F.col("root").alias("r"))
    ends = more.join(of, F.col("digest") == F.col("d"), "left").select("root", F.coalesce("r", "digest").alias("x"))
    # sets that were found together, by the roots that they had
    links = ends.join(of.withColumnsRenamed({"d": "d2", "r": "r2"}), F.col("root") == F.col("d2"), "left").select(F.col("x").alias("a"), F.coalesce("r2", "root").alias("b"))
    over = reached(links.where("a <> b").distinct()).select(F.col("node").alias("n"), F.col("root").alias("top"))
    every = first.select("digest", F.col("root").alias("r")).union(more.join(first.select("digest"), "digest", "left_anti").select("digest", F.col("digest").alias("r")))
    return materialize(every.join(over, F.col("r") == F.col("n"), "left").select("digest", F.coalesce("top", "r").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: the smallest doc_id that is reachable
    over links of sets that share at least 80 percent of their union.

    Null, empty and blank texts have no shingles and are linked with nothing; texts of fewer words
    than a shingle have one. Rows with a null id take part; where a component has no other, its id
    is null and its rows are kept. Repeated rows come out as often as they went in; other columns
    are ignored; an empty table gives no rows.
    """
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    sketched = materialize(table.mapInArrow(_sketch, "doc_id long, n long, digest binary, halves array<long>"))
    sets = materialize(sketched.where("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("halves").alias("halves")))
    sets = sets.withColumn("id", F.xxhash64("digest"))
    roots = confirmed(table, sets, clusters_of(diagonal_keys(sets)))
    roots = joined(roots, confirmed(table, sets, clusters_of(tensor_keys(sets, roots))))
    # sets without copies and links keep their own id and are not looked up
    near = sets.select("digest", "least").join(roots, "digest")
    named = near.join(near.groupBy("root").agg(F.min("least").alias("lowest")), "root").select("digest", "lowest")
    copied = sets.where("copies > 1").select("digest", F.col("least").alias("lowest")).join(roots, "digest", "left_anti")
    out = sketched.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(named.unionByName(copied), "digest", "left")
    component = F.when(F.col("digest").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("lowest", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@query("op13_minhash_tensor")
def op13_minhash_tensor(spark, sf_dir):
    """Shingles and component of every document."""
    return near_duplicates(read(spark, sf_dir, "documents"))
