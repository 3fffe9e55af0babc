"""Ordered computations that survive a hot key.

A window partitioned by team (or pair, or league) puts that key's whole history
into one task. The helpers here cut a history into contiguous blocks of about
``rows_per_block`` rows, and hand every block the little it needs from the blocks
before it: the last n rows (`with_carry`), or running totals (`running_totals`).
Day-level summaries are the other way out: a calendar has few days, so anything
keyed by (key, day) is small per key whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 1_000_000
BEFORE = (Window.unboundedPreceding, -1)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on `keys` where null meets null; keeps the left key columns."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys]
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


FAN = 64        # cuts are looked up in two steps of about this many
PER_BLOCK = 64  # sampled ids per block of a hot day


def _place(value: Column, cuts: Column, heads: Column) -> Column:
    """How many of the sorted cuts are at most the value; heads is every FAN-th cut."""
    head = F.size(F.filter(heads, lambda c: c <= value))
    start = (head - 1) * FAN
    return F.when(head == 0, 0).otherwise(start + F.size(F.filter(F.slice(cuts, start + 1, F.lit(FAN)), lambda c: c <= value)))


def ordered_blocks(df: DataFrame, keys: Sequence[str], date: str, id_col: str,
                   rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Add `_block`, non-decreasing in (date, id) within a key.

    Days are counted; a day that is larger than a block is cut at quantiles of its ids, taken
    from a sample by hash that is gathered while counting (some 64 ids per block). So a block
    holds at most about two blocks' rows however the ids lie. `id_col` is numeric and unique.
    """
    keys = list(keys)
    sampled = F.pmod(F.xxhash64(F.col(id_col)), F.lit(max(1, rows_per_block // PER_BLOCK))) == 0
    days = df.groupBy(*keys, date).agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(F.when(sampled, F.col(id_col)))).alias("_s"))
    earlier = Window.partitionBy(*keys).orderBy(date).rowsBetween(*BEFORE)
    days = days.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    # so many cuts that blocks of later days stay above those of this one
    some, size = F.least(F.floor(F.col("_n") / rows_per_block), F.size("_s")).cast("int"), F.size("_s")
    cuts = F.when((F.col("_n") > rows_per_block) & (some > 0), F.transform(F.sequence(F.lit(1), F.greatest(some, F.lit(1))), lambda k: F.get(F.col("_s"), F.floor(k * size / (some + 1)).cast("int"))))
    days = days.select(*keys, date, F.floor(F.col("_before") / rows_per_block).cast("long").alias("_first"), cuts.alias("_cuts"))
    days = days.withColumn("_heads", F.filter("_cuts", lambda c, i: i % FAN == 0))
    block = F.col("_first") + F.when(F.col("_cuts").isNull(), 0).otherwise(_place(F.col(id_col), F.col("_cuts"), F.col("_heads")))
    return null_safe_join(df, days, [*keys, date]).withColumn("_block", block).drop("_first", "_cuts", "_heads")


def with_carry(df: DataFrame, keys: Sequence[str], date: str, id_col: str, n: int,
               rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Blocks plus, in each block, copies (`_carry` = 1) of the n rows before it.

    A frame `rowsBetween(-n, -1)` over `block_window` then sees exactly the n
    previous rows of the key. Drop the copies afterwards with `_carry = 0`.
    """
    keys = list(keys)
    blocked = ordered_blocks(df, keys, date, id_col, rows_per_block)
    # row_number() <= n is applied before the shuffle as well, so a hot block
    # sends at most n rows per task
    latest = Window.partitionBy(*keys, "_block").orderBy(F.col(date).desc(), F.col(id_col).desc())
    tails = blocked.withColumn("_r", F.row_number().over(latest)).where(F.col("_r") <= n).drop("_r")
    by_key = Window.partitionBy(*keys).orderBy("_block", date, id_col)
    payload = [c for c in df.columns if c not in keys]
    carried = (tails
               .withColumn("_head", ~F.col("_block").eqNullSafe(F.lag("_block").over(by_key)))
               .withColumn("_prev", F.collect_list(F.struct(*payload)).over(by_key.rowsBetween(-n, -1)))
               .where("_head")
               .select(*keys, "_block", F.explode("_prev").alias("_p"))
               .select(*keys, "_block", *[F.col("_p")[c].alias(c) for c in payload], F.lit(1).alias("_carry")))
    return blocked.withColumn("_carry", F.lit(0)).unionByName(carried.select(*df.columns, "_block", "_carry"))


def block_window(keys: Sequence[str], date: str, id_col: str):
    return Window.partitionBy(*keys, "_block").orderBy(date, id_col)


def running_totals(df: DataFrame, keys: Sequence[str], date: str, id_col: str,
                   values: Mapping[str, Column], rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Add the sums of `values` over all earlier rows of the key (0 at the start)."""
    keys = list(keys)
    blocked = ordered_blocks(df, keys, date, id_col, rows_per_block)
    for name, value in values.items():
        blocked = blocked.withColumn(f"_v_{name}", value)
    per_block = blocked.groupBy(*keys, "_block").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(*BEFORE)
    offsets = per_block.select(*keys, "_block", *[
        F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values])
    inner = block_window(keys, date, id_col).rowsBetween(*BEFORE)
    out = null_safe_join(blocked, offsets, [*keys, "_block"])
    for name in values:
        out = out.withColumn(name, F.col(f"_o_{name}") + F.coalesce(F.sum(f"_v_{name}").over(inner), F.lit(0)))
    return out.drop("_block", *[f"_v_{n}" for n in values], *[f"_o_{n}" for n in values])


def dated_rank(df: DataFrame, keys: Sequence[str], date: str, id_col: str, name: str = "row_rank",
               rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Exact 1-based rank in (date, id) order within a key (keys may be empty)."""
    out = running_totals(df, keys, date, id_col, {name: F.lit(1).cast("long")}, rows_per_block)
    return out.withColumn(name, F.col(name) + 1)


def cell_rank(df: DataFrame, keys: Sequence[str], cell: Column, order: Sequence[Column | str], name: str) -> DataFrame:
    """Exact rank within a key, where `cell` is a coarse, order-preserving bucket."""
    keys = list(keys)
    celled = df.withColumn("_cell", cell)
    counts = celled.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(*BEFORE)
    offsets = counts.select(*keys, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inner = Window.partitionBy(*keys, "_cell").orderBy(*order)
    return (null_safe_join(celled, offsets, [*keys, "_cell"])
            .withColumn(name, F.col("_o") + F.row_number().over(inner))
            .drop("_cell", "_o"))


def day_tails(df: DataFrame, keys: Sequence[str], date: str, id_col: str, n: int) -> DataFrame:
    """The last n rows of every (key, day); limited map-side before the shuffle."""
    latest = Window.partitionBy(*keys, date).orderBy(F.col(id_col).desc())
    return df.withColumn("_r", F.row_number().over(latest)).where(F.col("_r") <= n).drop("_r")


def prior_day_state(tails: DataFrame, keys: Sequence[str], date: str, id_col: str,
                    state: Mapping[str, tuple[int, Column]]) -> DataFrame:
    """One row per (key, day): aggregates over the last n rows of earlier days.

    `tails` comes from `day_tails`, so a key has at most n rows per calendar day.
    The first row of a day sees only earlier days in `rowsBetween(-n, -1)`.
    """
    by_key = Window.partitionBy(*keys).orderBy(date, id_col)
    first = ~F.col(date).eqNullSafe(F.lag(date).over(by_key))
    cols = [agg.over(by_key.rowsBetween(-n, -1)).alias(name) for name, (n, agg) in state.items()]
    return tails.select(*keys, date, first.alias("_first"), *cols).where("_first").drop("_first")
