"""Skew-safe ordered computations against plain Python."""

from pyspark.sql import functions as F

from conftest import MATCH_SCHEMA, random_matches
from matchframe.plans import blocks as B


def hot(spark):
    rows = random_matches(300, seed=5, hot=True)
    return rows, spark.createDataFrame(rows, MATCH_SCHEMA).select("match_id", "match_date", "home_team", "home_goals")


def ordered(rows, key=lambda r: r[5]):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        groups.setdefault(key(r), []).append(r)
    return groups


def test_blocks_are_contiguous_and_small(spark):
    rows, df = hot(spark)
    got = {r.match_id: r._block for r in B.ordered_blocks(df, ["home_team"], "match_date", "match_id", 10).collect()}
    for group in ordered(rows).values():
        seq = [got[r[0]] for r in group]
        assert seq == sorted(seq)
        # a third of the rows share one day of one team; it is cut as well
        assert max(seq.count(b) for b in set(seq)) <= 25


def test_clustered_ids_of_a_hot_day_are_cut_evenly(spark):
    """Nearly all ids of the day lie close together, with a few far away on both sides."""
    import datetime
    day = datetime.date(2020, 5, 1)
    ids = [1, 2, 10 ** 12, 10 ** 12 + 5, *range(5 * 10 ** 8, 5 * 10 ** 8 + 20_000)]
    rows = [(i, day, "A") for i in ids] + [(10 ** 13 + k, day + datetime.timedelta(days=1 + k % 40), "A") for k in range(2000)]
    df = spark.createDataFrame(rows, "match_id long, match_date date, home_team string")
    for per_block in (500, 3000):
        got = sorted((r.match_date, r.match_id, r._block) for r in B.ordered_blocks(df, ["home_team"], "match_date", "match_id", per_block).collect())
        blocks = [b for _, _, b in got]
        assert blocks == sorted(blocks) and len(got) == len(rows)
        sizes = [blocks.count(b) for b in set(blocks)]
        assert max(sizes) <= 2.5 * per_block and len(sizes) >= len(rows) / (2.5 * per_block)
    ranks = {r.match_id: r.row_rank for r in B.dated_rank(df, ["home_team"], "match_date", "match_id", rows_per_block=700).collect()}
    assert [ranks[i] for _, i, _ in got] == list(range(1, len(rows) + 1))


def test_cuts_are_found_in_two_steps(spark):
    for n in (1, 63, 64, 65, 300):
        cuts = [10 * k for k in range(1, n + 1)]
        df = spark.createDataFrame([(v, cuts, cuts[::B.FAN]) for v in (0, 5, 10, 11, 640, 641, 650, 10 * n, 10 * n + 9)], "v long, cuts array<long>, heads array<long>")
        for r in df.withColumn("k", B._place(F.col("v"), F.col("cuts"), F.col("heads"))).collect():
            assert r.k == sum(c <= r.v for c in cuts)


def test_carry_gives_the_same_window_as_one_partition(spark):
    rows, df = hot(spark)
    for per_block in (7, 10_000):
        c = B.with_carry(df, ["home_team"], "match_date", "match_id", 4, per_block)
        frame = B.block_window(["home_team"], "match_date", "match_id").rowsBetween(-4, -1)
        got = {r.match_id: (r.s, r.n) for r in c.withColumn("s", F.sum("home_goals").over(frame)).withColumn("n", F.count("*").over(frame))
               .where("_carry = 0").collect()}
        assert len(got) == len(rows)
        for group in ordered(rows).values():
            for i, r in enumerate(group):
                prev = [p[7] for p in group[max(0, i - 4):i]]
                assert got[r[0]] == (sum(prev) if prev else None, len(prev))


def test_running_totals_and_ranks(spark):
    rows, df = hot(spark)
    out = B.running_totals(df, ["home_team"], "match_date", "match_id", {"goals": F.col("home_goals")}, 9)
    got = {r.match_id: r.goals for r in out.collect()}
    for group in ordered(rows).values():
        total = 0
        for r in group:
            assert got[r[0]] == total
            total += r[7]
    ranks = {r.match_id: r.row_rank for r in B.dated_rank(df, [], "match_date", "match_id", rows_per_block=11).collect()}
    assert [ranks[r[0]] for r in sorted(rows, key=lambda r: (r[1], r[0]))] == list(range(1, len(rows) + 1))


def test_cell_rank(spark):
    rows, df = hot(spark)
    out = B.cell_rank(df, ["home_team"], F.floor(F.col("match_id") / 50), ["match_id"], "k")
    got = {r.match_id: r.k for r in out.collect()}
    for key in {r[5] for r in rows}:
        ids = sorted(r[0] for r in rows if r[5] == key)
        assert [got[i] for i in ids] == list(range(1, len(ids) + 1))


def test_null_keys_survive(spark):
    df = spark.createDataFrame([(1, None, "2020-01-01"), (2, None, "2020-01-02"), (3, "a", None)], "id long, k string, d string").withColumn("d", F.to_date("d"))
    assert B.ordered_blocks(df, ["k"], "d", "id").count() == 3
    assert B.running_totals(df, ["k"], "d", "id", {"n": F.lit(1)}).count() == 3


def test_limits_are_applied_before_the_shuffle(spark):
    _, df = hot(spark)
    plan = B.day_tails(df, ["home_team"], "match_date", "match_id", 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")


def test_no_fact_window_on_a_single_partition(spark, small):
    from matchframe.operators import history as H
    for df in (H.prior_day_form(H.to_team_rows(small)), H.venue_form(small), H.h2h_clean(small), H.cumulative_ppg(small), H.last_k_sequences(small)):
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
