"""History features against plain Python and pandas on small tables."""

import datetime
import math

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import MATCH_SCHEMA, random_matches
from matchframe.functions.scalars import CURRENT_MATCH_STATS, feature_names
from matchframe.operators import folds as E
from matchframe.operators import history as H


def prior_rows(rows, team, day, rule="day", before_id=None):
    out = []
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        if (r[1] < day) if rule == "day" else ((r[1], r[0]) < (day, before_id)):
            if r[5] == team:
                out.append((r[7], r[8], r[10], r[12]))
            elif r[6] == team:
                out.append((r[8], r[7], r[11], r[13]))
    return out


def mean(xs):
    xs = [x for x in xs if x is not None]
    return sum(xs) / len(xs) if xs else None


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))


def expected_form(rows, team, day, n, league):
    last = prior_rows(rows, team, day)[-n:]
    gf, ga = mean([x[0] for x in last]), mean([x[1] for x in last])
    shots, sot = mean([x[2] for x in last]), mean([x[3] for x in last])
    total_shots = sum(x[2] for x in last if x[2] is not None)
    return {
        "team_state_points": mean([3 if x[0] > x[1] else 1 if x[0] == x[1] else 0 for x in last]), "goals_for": gf, "goals_against": ga,
        "attack_strength": gf / league if gf is not None and league else None, "defense_strength": ga / league if ga is not None and league else None,
        "win_rate": mean([x[0] > x[1] for x in last]), "draw_rate": mean([x[0] == x[1] for x in last]), "loss_rate": mean([x[0] < x[1] for x in last]),
        "win_margin_goals": mean([max(x[0] - x[1], 0) for x in last]), "loss_margin_goals": mean([max(x[1] - x[0], 0) for x in last]),
        "goal_differential": mean([x[0] - x[1] for x in last]), "avg_shots": shots, "avg_sot": sot,
        "shot_accuracy": sot / shots if shots and sot is not None else None,
        "conversion_rate": sum(x[0] for x in last) / total_shots if total_shots > 0 else None}


def test_feature_matrix_against_brute_force(small, match_rows):
    got = {r.match_id: r.asDict() for r in H.feature_matrix_66(small).collect()}
    assert len(got) == len(match_rows)
    for r in match_rows:
        g = got[r[0]]
        assert len(feature_names(g)) == 66
        earlier = [x for x in match_rows if x[1] < r[1]]
        league = sum(x[7] + x[8] for x in earlier) / (2 * len(earlier)) if earlier else None
        for side, team in (("home", r[5]), ("away", r[6])):
            for n in (5, 10):
                for name, want in expected_form(match_rows, team, r[1], n, league).items():
                    assert close(g[f"{side}_{name}_{n}"], want), (r[0], side, name, n)
        met = sorted((x for x in earlier if {x[5], x[6]} == {r[5], r[6]}), key=lambda x: (x[1], x[0]))[-5:]
        mine = [(x[7], x[8]) if x[5] == r[5] else (x[8], x[7]) for x in met]
        assert g["h2h_home_wins"] == sum(a > b for a, b in mine) and g["h2h_away_wins"] == sum(a < b for a, b in mine)
        assert close(g["h2h_home_avg_goals"], mean([a for a, _ in mine]) or 0.0)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000), st.integers(0, 59))
def test_no_look_ahead(spark, seed, pick):
    """Changing one result changes nothing on that day or before."""
    rows = random_matches(60, teams=4, days=15, seed=seed)
    changed = rows[pick]
    other = [r if r is not changed else (*r[:7], r[7] + 3, r[8], 2 if r[7] + 3 > r[8] else 1, *r[10:]) for r in rows]
    cols = [c for c in H.matrix_columns()] + list(H.H2H_COLUMNS)
    def table(data):
        df = H.feature_matrix_66(spark.createDataFrame(data, MATCH_SCHEMA))
        return {x.match_id: (x.match_date, tuple(x[c] for c in cols)) for x in df.collect()}
    a, b = table(rows), table(other)
    for k, (day, values) in a.items():
        if day <= changed[1]:
            assert values == b[k][1]


def test_later_matches_do_change(spark):
    d = datetime.date
    base = [(1, d(2022, 7, 29), 2022, "E1", 1, "A", "B", 1, 0, 2), (2, d(2022, 7, 29), 2022, "E1", 1, "C", "D", 2, 2, 1),
            (3, d(2022, 7, 30), 2022, "E1", 1, "A", "C", 0, 1, 0), (4, d(2022, 7, 30), 2022, "E1", 1, "B", "D", 3, 1, 2), (5, d(2022, 7, 31), 2022, "E1", 1, "A", "B", 1, 1, 1)]
    full = [(*r, 10.0, 9.0, 4.0, 3.0, 2.0, 3.0, 4.0) for r in base]
    edited = [(*full[0][:7], 5, 0, 2, *full[0][10:]), *full[1:]]
    def points(data):
        return {r.match_id: r.home_goals_for_5 for r in H.feature_matrix_66(spark.createDataFrame(data, MATCH_SCHEMA)).collect()}
    a, b = points(full), points(edited)
    assert a[1] is None and b[1] is None and a[2] == b[2]
    assert a[3] == 1.0 and b[3] == 5.0 and a[5] != b[5]


def to_pandas(rows):
    cols = [c.split()[0] for c in MATCH_SCHEMA.split(", ")]
    return pd.DataFrame(rows, columns=cols).sort_values(["match_date", "match_id"]).reset_index(drop=True)


@pytest.mark.parametrize("per_block", [15, 10_000])
def test_venue_form_literal_equals_the_rolling_expression(small, match_rows, per_block):
    pdf = to_pandas(match_rows)
    pdf["points"] = [3.0 if h > a else 1.0 if h == a else 0.0 for h, a in zip(pdf.home_goals, pdf.away_goals)]
    g = pdf.groupby("home_team")
    shifted = g["points"].transform(lambda x: x.shift(1))
    pdf["win"] = shifted.groupby(pdf.home_team).transform(lambda x: (x == 3).rolling(5, min_periods=1).mean())
    pdf["gf"] = g["home_goals"].transform(lambda x: x.shift(1).rolling(5, min_periods=1).mean())
    got = {r.match_id: r for r in H.venue_form(small, (5,), rates="literal", rows_per_block=per_block).collect()}
    for r in pdf.itertuples():
        assert close(got[r.match_id].home_win_rate_5, r.win)
        assert close(got[r.match_id].home_avg_goals_for_5, None if math.isnan(r.gf) else r.gf)


def test_venue_shots_equal_rolling_sums(small, match_rows):
    pdf = to_pandas(match_rows)
    def roll(col, how):
        return pdf.groupby("away_team")[col].transform(lambda x: getattr(x.astype(float).shift(1).rolling(5, min_periods=1), how)())
    pdf["shots"], pdf["sum_s"], pdf["sum_g"] = roll("away_shots", "mean"), roll("away_shots", "sum"), roll("away_goals", "sum")
    got = {r.match_id: r for r in H.venue_shots(small, (5,)).collect()}
    for r in pdf.itertuples():
        conv = r.sum_g / r.sum_s if r.sum_s and not math.isnan(r.sum_s) else None
        assert close(got[r.match_id].away_avg_shots_5, None if math.isnan(r.shots) else r.shots)
        assert close(got[r.match_id].away_conversion_rate_5, conv)


def test_rolling_accuracy_equals_pandas(spark, small, match_rows):
    pdf = to_pandas(match_rows)
    pdf["correct"] = (pdf.match_id % 4 == 1).astype(int)
    pdf.index = pd.to_datetime(pdf.match_date)
    pdf["want"] = pdf["correct"].rolling("30D", min_periods=5).mean()
    preds = small.select("match_id", "match_date", F.lit("m").alias("model"), (F.col("match_id") % 4 == 1).cast("int").alias("correct"))
    got = {r.match_id: r.rolling_accuracy for r in H.rolling_time_accuracy(preds, rows_per_block=20).collect()}
    for r in pdf.itertuples():
        assert close(got[r.match_id], None if math.isnan(r.want) else r.want)


def test_sequences_are_left_padded(small, match_rows):
    got = {r.match_id: r for r in H.last_k_sequences(small, 4, rows_per_block=10).collect()}
    for r in match_rows:
        past = prior_rows(match_rows, r[5], r[1], "row", r[0])[-4:]
        seq = got[r[0]].home_seq
        assert len(seq) == 4 and len(got[r[0]].mask) == 4
        assert [(x.gf, x.ga) for x in seq[4 - len(past):]] == [(p[0], p[1]) for p in past]
        other = prior_rows(match_rows, r[6], r[1], "row", r[0])[-4:]
        k = max(len(past), len(other))
        assert got[r[0]].mask == [0.0] * (4 - k) + [1.0] * k


def test_cumulative_ppg_skips_unplayed(spark):
    d = datetime.date
    rows = [(1, d(2020, 1, 1), 0, "E0", 0, "A", "B", 1, 0, 2), (2, d(2020, 1, 2), 0, "E0", 0, "A", "C", None, None, None), (3, d(2020, 1, 3), 0, "E0", 0, "A", "B", 0, 0, 1)]
    df = spark.createDataFrame([(*r, 1.0, 1.0, 1.0, 1.0, 2.0, 2.0, 2.0) for r in rows], MATCH_SCHEMA)
    got = {r.match_id: (r.home_ppg, r.away_ppg) for r in H.cumulative_ppg(df).collect()}
    assert got == {1: (0.0, 0.0), 2: (3.0, 0.0), 3: (3.0, 0.0)}


def test_feature_names_hold_no_current_match_statistics(small):
    assert len(CURRENT_MATCH_STATS) == 12
    names = feature_names([*CURRENT_MATCH_STATS, *small.columns, "home_avg_shots_5"])
    assert names == ["league_level", "home_avg_shots_5"]


def test_fold_guard_raises_on_overlap(small):
    with pytest.raises(ValueError):
        E.check_fold(small, small.where("season = 2020"))
    E.check_fold(small.where("season < 2020"), small.where("season = 2020"))


def test_season_ratings_without_goals(spark):
    """A season without away goals keeps its attack; one without home goals has ones only."""
    import datetime
    day = datetime.date(2001, 9, 1)
    rows = [(1, 2001, "A", "B", 2, 0), (2, 2001, "B", "A", 1, 0), (3, 2002, "A", "B", 0, 3), (4, 2003, "A", "B", 1, 1)]
    df = spark.createDataFrame([(i, day, s, "E0", h, a, hg, ag) for i, s, h, a, hg, ag in rows],
                               "match_id long, match_date date, season int, division string, home_team string, away_team string, home_goals int, away_goals int")
    for c in ("home_shots", "away_shots", "home_sot", "away_sot"):
        df = df.selectExpr("*", f"CAST(NULL AS DOUBLE) AS {c}")
    got = {(r.season, r.team): (r.attack, r.defence) for r in H.season_ratings(df).collect()}
    assert got == {(2001, "A"): (2 / 3, 1.0), (2001, "B"): (1 / 3, 1.0), (2002, "A"): (1.0, 1.0), (2002, "B"): (1.0, 1.0), (2003, "A"): (1.0, 1.0), (2003, "B"): (1.0, 1.0)}


def test_division_means_reach_rows_without_dealing_them_by_division(small):
    from matchframe.operators import history
    out = history.league_relative(small, ["home_goals"], "full")
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and all("broadcast" in line for line in joins)
