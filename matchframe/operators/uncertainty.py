"""Bootstrap intervals and paired tests.

Draws come from an md5 hash of (seed, draw, slot), so they are the same on any
engine and after any retry. Clusters are summed first: a draw costs one row per
cluster, whatever the number of matches behind it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import HASH_SPAN, binomial_tail, hash32, normal_cdf
from ..plans.blocks import ROWS_PER_BLOCK, block_window, cell_rank, null_safe_join, with_carry


def _intervals(reps: DataFrame, points: DataFrame, metrics: Sequence[str], prefix: str = "ci95") -> DataFrame:
    per = reps.agg(*[F.percentile(m, F.array(F.lit(0.025), F.lit(0.975))).alias(m) for m in metrics])
    def unpivot(df, value):
        items = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(value)) for m in metrics])
        return df.select(F.explode(items).alias("x")).select("x.*")
    low_high = unpivot(per, "q").select("metric", F.col("q")[0].alias(f"{prefix}_low"), F.col("q")[1].alias(f"{prefix}_high"))
    return unpivot(points, "delta").join(low_high, "metric")


def bootstrap_draws(deltas: DataFrame, cluster: str, metrics: Sequence[str], reps: int, seed: int, stratum: str | None = None) -> DataFrame:
    """One row per draw: mean of every metric over whole clusters resampled within their stratum."""
    keys = [stratum] if stratum else []
    per = deltas.groupBy(*keys, cluster).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(m).alias(f"_s_{m}") for m in metrics])
    h = hash32(cluster)
    ranked = cell_rank(per, keys, F.floor(h / (1 << 20)), [h, F.col(cluster)], "_slot")
    sizes = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    ranked = null_safe_join(ranked, sizes, keys) if keys else ranked.withColumn(
        "_size", sizes.select("_size").scalar())
    draw = hash32(F.lit(seed), F.col("_rep"), *keys, F.col("_slot")) % F.col("_size") + 1
    # few cluster rows become many draws: spread them over the tasks in chunks of draws first
    chunk = max(1, reps // 64)
    spread = (ranked.select(*keys, "_slot", "_size").withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // chunk))))
              .repartition(deltas.sparkSession.sparkContext.defaultParallelism, "_c"))
    ids = F.sequence(F.col("_c") * chunk, F.least(F.col("_c") * chunk + chunk, F.lit(reps)) - 1)
    slots = spread.withColumn("_rep", F.explode(ids)).withColumn("_pick", draw).select("_rep", *keys, "_pick")
    # draws grow from few rows, so their size is estimated far too low: neither side may be broadcast
    picked = null_safe_join(slots.hint("merge"), ranked.select(*keys, F.col("_slot").alias("_pick"), "_n", *[f"_s_{m}" for m in metrics]),
                            [*keys, "_pick"])
    return picked.groupBy(F.col("_rep").alias("rep")).agg(*[(F.sum(f"_s_{m}") / F.sum("_n")).alias(m) for m in metrics])


def cluster_bootstrap(deltas: DataFrame, cluster: str = "match_date", reps: int = 2000, seed: int = 123,
                      metrics: Sequence[str] = ("d_accuracy", "d_log_loss"), stratum: str | None = None) -> DataFrame:
    """Mean difference and 95 % interval per metric, resampling whole clusters."""
    points = deltas.agg(*[F.avg(m).alias(m) for m in metrics])
    return _intervals(bootstrap_draws(deltas, cluster, metrics, reps, seed, stratum), points, metrics).withColumn("repeats", F.lit(reps))


def stratified_bootstrap(deltas: DataFrame, cluster: str = "match_date", stratum: str = "season", reps: int = 4000, seed: int = 123,
                         metrics: Sequence[str] = ("d_accuracy", "d_log_loss")) -> DataFrame:
    return cluster_bootstrap(deltas, cluster, reps, seed, metrics, stratum)


def season_bootstrap(deltas: DataFrame, season: str = "season", reps: int = 4000, seed: int = 123,
                     metrics: Sequence[str] = ("d_accuracy", "d_log_loss")) -> DataFrame:
    return cluster_bootstrap(deltas, season, reps, seed, metrics)


# P(X <= k) for X ~ Poisson(1), from the definition
_POISSON1 = [sum(math.exp(-1.0) / math.factorial(i) for i in range(k + 1)) for k in range(13)]
LANES = 4  # 32-bit numbers in one md5


def _poisson1(u: Column) -> Column:
    weight = F.lit(0)
    for cut in _POISSON1:
        weight = weight + (u > cut).cast("int")
    return weight


BUCKETS = 4096  # a variance estimate from so many bags is off by about 2 %, an interval's width by 1 %


def iid_bootstrap_brier(diffs: DataFrame, reps: int = 5000, seed: int = 42, diff: str = "diff", id_col: str = "match_id",
                        buckets: int | None = BUCKETS) -> DataFrame:
    """Row bootstrap of a mean difference with Poisson(1) weights.

    Rows are dealt to `buckets` bags by hash and summed there, one row per bag; a draw weighs bags.
    Bags of independent rows vary as their rows do, so the draws have the spread of a row bootstrap
    while their cost doesn't depend on the number of rows; below that number of rows most bags hold
    one row. buckets=None weighs every row itself: weights are made where the rows are, rows x draws.
    Result: mean of the draws, order-statistic interval, share of draws below 0.
    """
    groups = -(-reps // LANES)
    rows = diffs.select(F.col(id_col).alias("_id"), F.col(diff).cast("double").alias("_d"), F.lit(1).cast("long").alias("_n")).where("_d IS NOT NULL")
    if buckets:
        bag = hash32(F.lit("bag"), "_id") % buckets
        # as many rows as bags become many draws: spread them over the tasks first
        rows = rows.groupBy(bag.alias("_id")).agg(F.sum("_d").alias("_d"), F.count(F.lit(1)).alias("_n"))
        rows = rows.repartition(diffs.sparkSession.sparkContext.defaultParallelism, "_id")
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_g").cast("string"), F.col("_id").cast("string")))
    lanes = F.array(*[F.struct((F.col("_g") * LANES + i).alias("rep"),
                               (F.conv(F.substring("_md5", 8 * i + 1, 8), 16, 10).cast("double") / HASH_SPAN).alias("u")) for i in range(LANES)])
    drawn = (rows.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
             .withColumn("_md5", digest).select("_d", "_n", F.explode(lanes).alias("x")).where(F.col("x.rep") < reps)
             .select("_d", "_n", F.col("x.rep").alias("rep"), _poisson1(F.col("x.u")).alias("w")))
    draws = drawn.groupBy("rep").agg((F.sum(F.col("w") * F.col("_d")) / F.nullif(F.sum(F.col("w") * F.col("_n")), F.lit(0))).alias("m"))
    # `reps` values, a parameter
    ordered = draws.agg(F.sort_array(F.collect_list("m")).alias("v"), F.avg("m").alias("mean_diff"),
                        (100.0 * F.avg((F.col("m") < 0).cast("double"))).alias("pct_below_zero"))
    return ordered.select("mean_diff", F.element_at("v", int(0.025 * reps) + 1).alias("ci_lower"),
                          F.element_at("v", int(0.975 * reps) + 1).alias("ci_upper"), "pct_below_zero")


def diebold_mariano(losses: DataFrame, loss_a: str = "loss_a", loss_b: str = "loss_b", date: str = "match_date", id_col: str = "match_id",
                    rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Mean loss difference over its lag-1 standard error, and the two-sided normal p.

    The previous row crosses block borders as a carried copy, so the order spans the whole table.
    """
    d = losses.select(F.col(date), F.col(id_col), (F.col(loss_a) - F.col(loss_b)).alias("d"))
    rows = with_carry(d, [], date, id_col, 1, rows_per_block)
    lagged = rows.withColumn("prev", F.lag("d").over(block_window([], date, id_col))).where("_carry = 0")
    s = lagged.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_diff"), F.var_samp("d").alias("g0"),
                   F.coalesce(F.covar_samp("prev", "d"), F.lit(0.0)).alias("g1"))
    var = (F.col("g0") + 2 * F.col("g1")) / F.col("n")
    stat = F.when(var > 0, F.col("mean_diff") / F.sqrt(F.when(var > 0, var))).otherwise(0.0)
    return s.select("n", "mean_diff", stat.alias("dm_stat")).withColumn(
        "p_value", F.when(F.col("dm_stat") == 0, 1.0).otherwise(2 * (1 - normal_cdf(F.abs("dm_stat")))))


def mcnemar_exact(hits: DataFrame, hit_a: str = "hit_a", hit_b: str = "hit_b", by: Sequence[str] = ()) -> DataFrame:
    """Discordant counts and the exact two-sided binomial p at one half."""
    counts = hits.groupBy(*by).agg(F.count_if((F.col(hit_a) == 1) & (F.col(hit_b) == 0)).alias("b"),
                                   F.count_if((F.col(hit_a) == 0) & (F.col(hit_b) == 1)).alias("c"))
    n = F.col("b") + F.col("c")
    p = F.least(F.lit(1.0), 2 * binomial_tail(F.greatest("b", "c"), n))
    return counts.withColumn("p_value", F.when(n == 0, 1.0).otherwise(p))


def binomial_test(table: DataFrame, wins: str = "wins", n: str = "n", p0: float = 1.0 / 3.0) -> DataFrame:
    """One-sided P(X >= wins)."""
    return table.withColumn("p_value", binomial_tail(F.col(wins), F.col(n), p0))


def positive_share(by_season: DataFrame, roi: str = "roi") -> DataFrame:
    return by_season.agg(F.count(F.lit(1)).alias("n_seasons"), F.avg((F.col(roi) > 0).cast("double")).alias("positive_share"))
