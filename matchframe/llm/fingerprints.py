"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is a set of weighted terms: its five-word shingles (the first ones padded with
nothing before the text, so every text with a word has terms), weighted by how often they
occur. The weight of a term is split over 128 slots: each of its occurrences, numbered from
zero, goes to a slot by a hash of the term and the number. Of two documents the smaller weight
is the smaller one in every slot as well, so the slots' common and whole weights add up to
those of the documents. In its slot a term draws gamma(2, 1) variables r and c and a uniform b
from a hash; with t = floor(ln w / r + b) its sample is ln a = ln c - r (t - b + 1), and the
term with the smallest a is chosen (Ioffe's scheme). Two documents choose the same (term, t)
in a slot with a probability equal to the generalised Jaccard similarity of the slot's weights,
whose mean over the hashes is that of the documents. The likeness of two fingerprints is the
share of slots filled in either one that agree.

All steps are array functions within the row: the fingerprint shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import let, query, read, unused, whole_text

SLOTS, SHINGLE = 128, 5
RANGE_ROWS = 2000        # wanted rows of one range of ids
MOST_RANGES = 1 << 16    # bound of the table of range heads that is broadcast
SCALE, SHIFT, SLOT_SHIFT = float(1 << 46), 256.0, 56  # ln a as 55-bit fixed-point number
PLACE_SHIFT = 57


def uniform(bits: Column) -> Column:
    """A 32-bit number to (0, 1)."""
    return (bits + F.lit(0.5)) / F.lit(float(1 << 32))


def _placed(term: Column, number: Column) -> Column:
    """The slot of an occurrence of a term (7 bits) above 57 bits of the term."""
    slot = F.xxhash64(term, number).bitwiseAND(F.lit(SLOTS - 1))
    return F.shiftleft(slot, PLACE_SHIFT).bitwiseOR(F.shiftrightunsigned(term, 64 - PLACE_SHIFT))


def _sample(term: Column, weight: Column) -> Column:
    """Slot and fixed-point ln a of a placed term and its weight in the slot, in one long that
    sorts by both."""
    low = F.lit(0xFFFFFFFF)
    one, two, three = (F.xxhash64(term, F.lit(k)) for k in (1, 2, 3))

    def drawn(h1, h2, h3):
        r = -F.log(uniform(F.shiftrightunsigned(h1, 32)) * uniform(h1.bitwiseAND(low)))
        ln_c = F.log(-F.log(uniform(F.shiftrightunsigned(h2, 32)) * uniform(h2.bitwiseAND(low))))
        b = uniform(F.shiftrightunsigned(h3, 32))
        ln_a = let(r, lambda r: let(b, lambda b: ln_c - r * (F.floor(F.log(weight) / r + b) - b + 1)))
        slot = F.shiftrightunsigned(term, PLACE_SHIFT)
        fixed = ((ln_a + F.lit(SHIFT)) * F.lit(SCALE)).cast("long")
        return F.shiftleft(slot, SLOT_SHIFT).bitwiseOR(fixed)
    return let(one, lambda h1: let(two, lambda h2: let(three, lambda h3: drawn(h1, h2, h3))))


def signature(text: Column) -> Column:
    """The filled slots in order: (slot << 24 | 24 bits of the chosen sample) as ints; an
    empty array for a text without words."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def shingles(h):
        return F.transform(h, lambda x, i: F.xxhash64(*[F.get(h, i - k) for k in range(SHINGLE - 1, 0, -1)], x))

    def weighted(s, each):
        """each(value, weight) of the different values of a sorted array."""
        ends = F.filter(F.transform(s, lambda x, i: F.when(x == F.get(s, i + 1), F.lit(None).cast("int")).otherwise(i)), lambda e: e.isNotNull())
        return let(ends, lambda e: F.transform(e, lambda at, p: each(F.get(s, at), at - F.coalesce(F.get(e, p - 1), F.lit(-1)))))

    def places(term, weight):
        return F.when(weight == 1, F.array(_placed(term, F.lit(0)))).otherwise(F.transform(F.sequence(F.lit(0), weight - 1), lambda k: _placed(term, k)))

    def samples(s):
        placed = F.sort_array(F.flatten(weighted(s, places)))
        return let(placed, lambda p: weighted(p, lambda x, w: _sample(x, w.cast("double"))))

    def chosen(a):
        first = F.filter(a, lambda x, i: (i == 0) | (F.shiftrightunsigned(x, SLOT_SHIFT) != F.shiftrightunsigned(F.get(a, i - 1), SLOT_SHIFT)))
        return F.transform(first, lambda x: (F.shiftrightunsigned(x, SLOT_SHIFT) * F.lit(1 << 24) + F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFF)) - F.lit(1 << 31)).cast("int"))
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    terms = let(hashed, lambda h: F.sort_array(shingles(h)))
    return let(terms, lambda s: let(F.sort_array(samples(s)), chosen))


def likeness(a: Column, b: Column) -> Column:
    """Share of the slots filled in a or b that hold the same sample; one for two empty ones."""
    slots = lambda x: F.transform(x, lambda v: F.shiftright(v, 24))
    same = F.size(F.array_intersect(a, b))
    filled = F.size(F.array_union(slots(a), slots(b)))
    return F.when(filled == 0, 1.0).otherwise(same / filled).cast("double")


def as_text(sig: Column) -> Column:
    """Eight hexadecimal digits per filled slot: two of the slot, six of the sample."""
    return F.concat(F.lit("cws:"), F.array_join(F.transform(sig, lambda v: F.lower(F.lpad(F.hex((v.cast("long") + F.lit(1 << 31))), 8, "0"))), ""))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint of every row; null texts are empty, repeated rows stay repeated."""
    return docs.select(F.col(id_col), as_text(signature(whole_text(text_col))).alias("fingerprint"))


# ---- every text next to the one that follows it in descending order of ids

def range_number(cuts: list[int], value: Column) -> Column:
    """1 + how many of the sorted cuts lie below the value, by bisection; 0 for null."""
    edges = F.from_json(F.lit(str(cuts)), "array<bigint>")  # folded to one literal
    number = F.lit(0)

    def half(size: int) -> Callable[[Column], Column]:
        return lambda n: F.when(F.get(edges, n + (size - 1)) < value, n + size).otherwise(n)
    for k in reversed(range(len(cuts).bit_length())):
        number = let(number, half(1 << k))
    return F.when(value.isNull(), 0).otherwise(number + 1)


def with_next(rows: DataFrame, id_col: str, text_col: str, derived: dict[str, Column]) -> DataFrame:
    """Adds the derived columns, and next_<c> for them and the text: the values of the row that
    follows in descending order of id (null ids last, equal ids by the hash of the text), the
    first row's for the last one. A single row follows itself. Other columns may have any names
    but those of the derived ones.

    Ids are cut into ranges at their quantiles, a number that grows with the table up to a
    fixed bound; a range is one window group, so rows are shuffled once. The head of each
    range also goes to the range before it, whose last row it follows.
    """
    n = rows.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    cuts = []
    if ranges > 1:
        shares = [k / ranges for k in range(1, ranges)]
        cuts = sorted(set(rows.select(F.percentile_approx(id_col, shares, F.lit(max(10_000, 4 * ranges))).alias("cuts")).first().cuts or []))
    tie, place, tail, at, target, head, head_tie, after = unused(rows, "tie", "range", "tail", "at", "target", "head", "head_tie", "next")
    placed = rows.withColumns({tie: F.xxhash64(text_col), place: range_number(cuts, F.col(id_col))})
    first = F.max(F.struct(F.col(id_col).isNotNull().alias("known"), F.col(id_col).alias("id"), F.col(tie).alias("tie")))
    heads = placed.groupBy(F.col(place).alias("r")).agg(first.alias("o")).orderBy(F.desc("r")).collect()  # a row per range, at most MOST_RANGES
    before = [(r.r, heads[k - 1].r, r.o.id, r.o.tie) for k, r in enumerate(heads)]
    kind = rows.schema[id_col].dataType.simpleString()
    table = F.broadcast(rows.sparkSession.createDataFrame(before, f"{at} int, {target} int, {head} {kind}, {head_tie} long"))
    same = (F.col(place) == F.col(at)) & F.col(id_col).eqNullSafe(F.col(head)) & (F.col(tie) == F.col(head_tie))
    tails = placed.join(table, same).select(*rows.columns, tie, F.col(target).alias(place), F.lit(True).alias(tail))
    both = placed.withColumn(tail, F.lit(False)).unionByName(tails)
    marked = both.withColumns(derived)
    carried = [text_col, *derived]
    follows = F.lead(F.struct(*carried)).over(Window.partitionBy(place).orderBy(tail, F.desc_nulls_last(id_col), F.desc(tie)))
    kept = marked.withColumn(after, follows).where(~F.col(tail))
    return kept.select(*rows.columns, *derived, *[F.col(after)[c].alias(f"next_{c}") for c in carried])


@query("op5_cws_fingerprints")
def op5_cws_fingerprints(spark, sf_dir):
    """Fingerprints of every document, of its edited form, and their likenesses."""
    docs = read(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text"))
    pairs = with_next(docs, "doc_id", "text", {"sig": signature(F.col("text"))})
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), (F.length("text") - half)), F.when(half > 0, F.left(F.col("next_text"), half)).otherwise(F.lit("")))
    out = pairs.withColumn("edited", edited).select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited", "sig", "next_sig")
    out = out.withColumn("edited_sig", signature(F.col("edited")))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sig")).alias("fingerprint"),
        as_text(F.col("edited_sig")).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))
