"""Classification, probability and goal metrics over groups, and squad summaries.

Every metric is a set of conditional sums, so a group of any size is combined
map-side and only one row per (task, group) is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import P_COLS, arg_max
from ..plans.blocks import BEFORE, ROWS_PER_BLOCK, null_safe_join

CLASSES = (0, 1, 2)
POINT_FIELDS = ("accuracy", "log_loss", "brier", "exact_score_accuracy", "score_nll", "home_goal_mae", "away_goal_mae",
                "total_goal_mae", "home_within_1", "away_within_1", "total_within_1")
SCORE_FIELDS = {"exact_score_accuracy": "exact_score_hit", "score_nll": "true_score_nll", "home_goal_mae": "home_abs_error",
                "away_goal_mae": "away_abs_error", "total_goal_mae": "total_abs_error", "home_within_1": "home_within_1",
                "away_within_1": "away_within_1", "total_within_1": "total_within_1"}


def _zero_div(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def true_probability(y: str = "y", p_cols: Sequence[str] = P_COLS) -> Column:
    return F.when(F.col(y) == 0, F.col(p_cols[0])).when(F.col(y) == 1, F.col(p_cols[1])).when(F.col(y) == 2, F.col(p_cols[2]))


def row_log_loss(y: str = "y", p_cols: Sequence[str] = P_COLS, eps: float = 1e-15) -> Column:
    return -F.ln(F.greatest(true_probability(y, p_cols), F.lit(eps)))


def row_brier(y: str = "y", p_cols: Sequence[str] = P_COLS) -> Column:
    total = F.lit(0.0)
    for k, p in zip(CLASSES, p_cols):
        gap = (F.col(y) == k).cast("double") - F.col(p)
        total = total + gap * gap
    return total / 3.0


def confusion(preds: DataFrame, by: Sequence[str] = (), y: str = "y", predicted: str = "predicted", normalise: bool = False) -> DataFrame:
    """Rows per true class, columns pred_0..pred_2 (counts, or shares of the true class)."""
    counts = preds.groupBy(*by, y).agg(*[F.count_if(F.col(predicted) == k).alias(f"pred_{k}") for k in CLASSES])
    if not normalise:
        return counts
    total = sum((F.col(f"pred_{k}") for k in CLASSES[1:]), F.col("pred_0"))
    return counts.select(*by, y, *[_zero_div(F.col(f"pred_{k}").cast("double"), total).alias(f"pred_{k}") for k in CLASSES])


def _counts(y: str, predicted: str) -> list[Column]:
    t, p = F.col(y), F.col(predicted)
    cols = [F.count(F.lit(1)).alias("n_matches"), F.count_if(t == p).alias("correct")]
    for k in CLASSES:
        cols += [F.count_if((t == k) & (p == k)).alias(f"_tp_{k}"), F.count_if(t == k).alias(f"_t_{k}"),
                 F.count_if(p == k).alias(f"_p_{k}")]
    return cols


def _class_scores(k: int) -> tuple[Column, Column, Column]:
    tp, t, p = F.col(f"_tp_{k}"), F.col(f"_t_{k}"), F.col(f"_p_{k}")
    return _zero_div(tp, p), _zero_div(tp, t), _zero_div(2.0 * tp, t + p)


def classification_metrics(preds: DataFrame, by: Sequence[str] = (), y: str = "y", predicted: str = "predicted",
                           per_class: bool = True) -> DataFrame:
    """Accuracy, macro and weighted precision / recall / F1; a division by zero counts as 0."""
    base = preds.groupBy(*by).agg(*_counts(y, predicted))
    scores = {k: dict(zip(("precision", "recall", "f1"), _class_scores(k))) for k in CLASSES}
    n = F.col("n_matches")
    cols = [n, F.col("correct"), _zero_div(F.col("correct"), n).alias("accuracy")]
    for name in ("precision", "recall", "f1"):
        s = [scores[k][name] for k in CLASSES]
        cols.append(((s[0] + s[1] + s[2]) / 3.0).alias(f"macro_{name}"))
        weighted = s[0] * F.col("_t_0") + s[1] * F.col("_t_1") + s[2] * F.col("_t_2")
        cols.append(_zero_div(weighted, n).alias(f"weighted_{name}"))
    if per_class:
        for k in CLASSES:
            cols.append(F.col(f"_t_{k}").alias(f"support_{k}"))
            cols += [scores[k][name].alias(f"{name}_{k}") for name in ("precision", "recall", "f1")]
    return base.select(*by, *cols)


def log_loss(preds: DataFrame, by: Sequence[str] = (), y: str = "y", p_cols: Sequence[str] = P_COLS, eps: float = 1e-15) -> DataFrame:
    return preds.groupBy(*by).agg(F.avg(row_log_loss(y, p_cols, eps)).alias("log_loss"))


def brier(preds: DataFrame, by: Sequence[str] = (), y: str = "y", p_cols: Sequence[str] = P_COLS) -> DataFrame:
    """Mean over rows and classes of (1[y=c] - p)^2, and the mean per class."""
    per = []
    for k, p in zip(CLASSES, p_cols):
        gap = (F.col(y) == k).cast("double") - F.col(p)
        per.append(F.avg(gap * gap).alias(f"brier_{k}"))
    return preds.groupBy(*by).agg(F.avg(row_brier(y, p_cols)).alias("brier"), *per)


def long_classes(preds: DataFrame, keep: Sequence[str], y: str = "y", p_cols: Sequence[str] = P_COLS) -> DataFrame:
    """One row per (prediction, class): class, p, hit."""
    items = F.array(*[F.struct(F.lit(k).alias("cls"), F.col(p).alias("p"), (F.col(y) == k).cast("int").alias("hit"))
                      for k, p in zip(CLASSES, p_cols)])
    return preds.select(*keep, F.explode(items).alias("c")).select(*keep, "c.*")


def roc_auc(preds: DataFrame, by: Sequence[str] = (), y: str = "y", p_cols: Sequence[str] = P_COLS, cells: int = 65536,
            scores_per_cell: int = ROWS_PER_BLOCK) -> DataFrame:
    """Exact one-vs-rest AUC per class and their mean; ties count half.

    Rows are reduced to distinct scores; scores are ranked in two levels (cell
    totals, then inside a cell) so no window spans all scores of a class. A cell
    with too many scores, as in a narrow band, is cut into `cells` of its own.
    """
    by = list(by)
    keys = [*by, "cls"]
    scaled = F.col("p") * cells
    scores = (long_classes(preds, by, y, p_cols).groupBy(*keys, "p")
              .agg(F.sum("hit").cast("double").alias("pos"), F.sum(1 - F.col("hit")).cast("double").alias("neg"))
              .withColumn("coarse", F.floor(scaled)))
    full = scores.groupBy(*keys, "coarse").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > scores_per_cell).drop("n").withColumn("hot", F.lit(1))
    fine = F.when(F.col("hot").isNotNull(), F.floor((scaled - F.col("coarse")) * cells)).otherwise(0)
    scores = null_safe_join(scores, full, [*keys, "coarse"], "left").withColumn("cell", F.col("coarse") * (cells + 1) + fine).drop("coarse", "hot")
    per_cell = scores.groupBy(*keys, "cell").agg(F.sum("neg").alias("n"))
    lower = Window.partitionBy(*keys).orderBy("cell").rowsBetween(*BEFORE)
    offsets = per_cell.select(*keys, "cell", F.coalesce(F.sum("n").over(lower), F.lit(0.0)).alias("below_cells"))
    inside = Window.partitionBy(*keys, "cell").orderBy("p").rowsBetween(*BEFORE)
    joined = null_safe_join(scores, offsets, [*keys, "cell"])
    below = F.col("below_cells") + F.coalesce(F.sum("neg").over(inside), F.lit(0.0))
    wins = joined.withColumn("w", F.col("pos") * (below + F.col("neg") / 2.0))
    per = wins.groupBy(*keys).agg((F.sum("w") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc"))
    return per.groupBy(*by).agg(*[F.max(F.when(F.col("cls") == k, F.col("auc"))).alias(f"auc_{k}") for k in CLASSES],
                                F.avg("auc").alias("auc_macro"))


def calibration_bins(preds: DataFrame, bins: int = 10, rule: str = "half_open", min_n: int = 10, by: Sequence[str] = (),
                     y: str = "y", p_cols: Sequence[str] = P_COLS) -> DataFrame:
    """Mean prediction against observed rate per probability bin and class.

    rule='edge_low': an edge value falls into the lower bin, empty bins vanish;
    rule='half_open': bins are [lo, hi), p = 1 is left out, only bins of min_n rows or more.
    """
    long = long_classes(preds, by, y, p_cols)
    scaled = F.col("p") * bins
    if rule == "edge_low":
        long, least = long.withColumn("bin", F.greatest(F.ceil(scaled) - 1, F.lit(0))), 1
    else:
        long, least = long.where("p < 1").withColumn("bin", F.floor(scaled)), min_n
    out = long.groupBy(*by, "cls", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_predicted"),
                                             F.avg(F.col("hit").cast("double")).alias("observed"))
    return out.where(F.col("n") >= least).withColumn("gap", F.col("mean_predicted") - F.col("observed"))


def probability_histogram(preds: DataFrame, bins: int = 10, by: Sequence[str] = (), y: str = "y", p_cols: Sequence[str] = P_COLS) -> DataFrame:
    """Counts of p in equal bins by class and true class; p = 1 belongs to the last bin."""
    long = long_classes(preds, [*by, y], y, p_cols)
    return (long.withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)))
            .groupBy(*by, y, "cls", "bin").agg(F.count(F.lit(1)).alias("n")))


def goal_metrics(score_preds: DataFrame, by: Sequence[str] = (), hg: str = "home_goals", ag: str = "away_goals") -> DataFrame:
    """MAE of expected goals, exact hits of the modal score, within-one shares."""
    mh, ma, h, a = F.col("mode_home_goals"), F.col("mode_away_goals"), F.col(hg), F.col(ag)
    as_share = lambda c: F.avg(c.cast("double"))
    return score_preds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("expected_home_goals") - h)).alias("home_goal_mae"),
        F.avg(F.abs(F.col("expected_away_goals") - a)).alias("away_goal_mae"), as_share(mh == h).alias("home_exact"),
        as_share(ma == a).alias("away_exact"), as_share((mh == h) & (ma == a)).alias("score_exact"),
        as_share(F.abs(mh - h) <= 1).alias("home_within_1"), as_share(F.abs(ma - a) <= 1).alias("away_within_1"),
        as_share(F.abs(mh + ma - h - a) <= 1).alias("total_within_1"))


def per_match_metrics(preds: DataFrame, score_stats: DataFrame | None = None, keys: Sequence[str] = ("match_id",), y: str = "y",
                      keep: Sequence[str] = ("match_date", "season", "division")) -> DataFrame:
    """Long table (match, model): hit, log loss, Brier and, where given, the score metrics."""
    pred = arg_max(P_COLS, CLASSES)
    out = preds.select(*keys, *keep, "model", F.col(y).alias("actual"), pred.alias("predicted"),
                       (pred == F.col(y)).cast("double").alias("accuracy"), (-F.ln(true_probability(y))).alias("log_loss"),
                       row_brier(y).alias("brier"))
    if score_stats is None:
        return out.select("*", *[F.lit(None).cast("double").alias(c) for c in SCORE_FIELDS])
    side = score_stats.select(*keys, "model", *[F.col(s).cast("double").alias(c) for c, s in SCORE_FIELDS.items()])
    return out.join(side, [*keys, "model"], "left")


def summarize_scopes(per_match: DataFrame, fields: Sequence[str] = POINT_FIELDS, season: str = "season", division: str = "division",
                     actual: str = "actual") -> DataFrame:
    """Overall, season, league, outcome and season x league summaries per model, in one GROUPING SETS pass."""
    fields = [f for f in fields if f in per_match.columns]
    aggs = [*_counts(actual, "predicted"), *[F.avg(f).alias(f"_a_{f}") for f in fields], *[F.count(f).alias(f"_c_{f}") for f in fields]]
    m, s, d, a = F.col("model"), F.col(season), F.col(division), F.col("_actual")
    per_match = per_match.withColumn("_actual", F.col(actual))
    base = per_match.groupingSets([[m], [m, s], [m, d], [m, a], [m, s, d]], m, s, d, a).agg(
        F.grouping_id().alias("_g"), *aggs)
    # bits of grouping_id: model, season, division, outcome (1 = not grouped)
    scope = (F.when(F.col("_g") == 7, "overall").when(F.col("_g") == 3, "season").when(F.col("_g") == 5, "league")
             .when(F.col("_g") == 6, "actual_outcome").otherwise("season_league"))
    group = (F.when(F.col("_g") == 7, "ALL").when(F.col("_g") == 3, s.cast("string")).when(F.col("_g") == 5, d)
             .when(F.col("_g") == 6, a.cast("string")).otherwise(F.concat_ws("/", s.cast("string"), d)))
    f1 = [_class_scores(k)[2] for k in CLASSES]
    whole = [F.when(F.col(f"_c_{f}") == F.col("n_matches"), F.col(f"_a_{f}")).alias(f) for f in fields]
    return base.select(scope.alias("scope"), group.alias("group"), "model", "n_matches", "correct", *whole,
                       ((f1[0] + f1[1] + f1[2]) / 3.0).alias("macro_f1"), f1[1].alias("draw_f1"))


def contrast(summary: DataFrame, base: str, selected: str) -> DataFrame:
    """Per scope group: accuracy of both models, extra correct, log-loss difference."""
    def value(model, c):
        return F.max(F.when(F.col("model") == model, F.col(c)))
    out = summary.where(F.col("model").isin(base, selected)).groupBy("scope", "group").agg(
        value(base, "n_matches").alias("n_matches"), value(base, "accuracy").alias("base_accuracy"),
        value(selected, "accuracy").alias("selected_accuracy"),
        (value(selected, "correct") - value(base, "correct")).alias("extra_correct"),
        (value(selected, "log_loss") - value(base, "log_loss")).alias("log_loss_delta"))
    return out.withColumn("accuracy_delta", F.col("selected_accuracy") - F.col("base_accuracy"))


def contrast_counts(rows: DataFrame) -> DataFrame:
    """Per scope: groups that improved in accuracy and in log loss."""
    return rows.groupBy("scope").agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("accuracy_delta") > 0).alias("accuracy_up"),
                                     F.count_if(F.col("log_loss_delta") < 0).alias("log_loss_down"))


def model_table(summary: DataFrame, by: Sequence[str] = (), score: str = "accuracy", second: str = "macro_f1") -> DataFrame:
    """Leaderboard position within each group; position 1 is the best model of a fold."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(second).desc(), "model")
    return summary.withColumn("position", F.row_number().over(order))


def class_balance(df: DataFrame, label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Count and share per label value, and the majority share as naive baseline."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    return (counts.withColumn("share", F.col("n") / F.sum("n").over(w))
            .withColumn("naive_accuracy", F.max("n").over(w) / F.sum("n").over(w)))


def per_class_accuracy(preds: DataFrame, by: Sequence[str] = (), y: str = "y", columns: Mapping[str, str] | None = None) -> DataFrame:
    """Recall per outcome for each prediction column (e.g. model and market)."""
    columns = columns or {"model": "predicted"}
    aggs = [F.avg(F.when(F.col(y) == k, (F.col(c) == k).cast("double"))).alias(f"{name}_{n}")
            for name, c in columns.items() for k, n in ((2, "home"), (1, "draw"), (0, "away"))]
    return preds.groupBy(*by).agg(*aggs)


def fit_complexity(fit_log: DataFrame) -> DataFrame:
    return fit_log.groupBy("model").agg(F.count(F.lit(1)).alias("n_fits"), F.avg("fit_seconds").alias("fit_seconds"),
                                        F.avg("predict_seconds").alias("predict_seconds"), F.max("n_features").alias("n_features"),
                                        F.max("n_parameters").alias("n_parameters"), F.avg("model_bytes").alias("model_bytes"))


def recompute_audit(per_match: DataFrame, stored: DataFrame, fields: Sequence[str] = ("accuracy", "log_loss", "brier", "macro_f1", "draw_f1")) -> DataFrame:
    """Recompute every summary from the per-match table: largest difference per field, rows without partner."""
    fresh = summarize_scopes(per_match).alias("f")
    keys = ["scope", "group", "model"]
    old = stored.select(*keys, *[F.col(f).alias(f"_o_{f}") for f in fields], F.lit(1).alias("_stored"))
    joined = fresh.withColumn("_fresh", F.lit(1)).join(old, keys, "full_outer")
    lone = F.col("_fresh").isNull() | F.col("_stored").isNull()
    return joined.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(lone).alias("n_unmatched"),
                      *[F.max(F.abs(F.col(f) - F.col(f"_o_{f}"))).alias(f"max_diff_{f}") for f in fields])


# ---------------------------------------------------------------- squads

def _count_position(*names) -> Column:
    return F.count_if(F.col("position").isin(*names))


def _herfindahl(c: str) -> Column:
    total = F.sum(F.col(c).cast("double"))
    return F.when(total > 0, F.sum(F.col(c).cast("double") * F.col(c)) / F.nullif(total * total, F.lit(0.0)))


def _mean_or_zero(c: str) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def squad_profile(players: DataFrame, keys: Sequence[str] = ("season", "club_id"), minutes: str = "minutes") -> DataFrame:
    """Composition, age, depth and minutes concentration per squad; undefined values are 0."""
    n = F.count(F.lit(1))
    cols = [n.alias("n_players")]
    for short, pos in (("gk", "Goalkeeper"), ("def", "Defender"), ("mid", "Midfielder"), ("fwd", "Forward")):
        cols.append(_count_position(pos).alias(f"n_{short}"))
        if short != "gk":
            cols += [(_count_position(pos) / n).alias(f"{short}_ratio"), (_count_position(pos) / n * 10).alias(f"{short}_per_10players")]
    cols += [_mean_or_zero(c).alias(f"avg_{c}") for c in ("age", "height", "weight", "min_per_match") if c in players.columns]
    regular = F.count_if(F.col(minutes) >= 900)
    cols += [regular.alias("n_regulars"), (regular / n).alias("regular_ratio"),
             F.coalesce(_herfindahl(minutes), F.lit(0.0)).alias("min_concentration"), _mean_or_zero(minutes).alias("avg_minutes")]
    return players.groupBy(*keys).agg(*cols)


def squad_production(players: DataFrame, keys: Sequence[str] = ("season", "club_id"), minutes: str = "minutes", goals: str = "goals",
                     assists: str = "assists", weighted: Sequence[str] = (), ranks: Sequence[str] = (),
                     clean_sheets: str | None = None, conceded: str | None = None) -> DataFrame:
    """Goals, assists, minutes-weighted rates and concentration per squad; undefined values are 0."""
    n = F.count(F.lit(1))
    total = F.sum(goals)
    zero = F.lit(0.0)

    def scored(pos):
        return F.coalesce(F.sum(F.when(F.col("position") == pos, F.col(goals))), F.lit(0))

    regular = F.count_if(F.col(minutes) >= 900)
    cols = [n.alias("n_players"), regular.alias("n_regulars"), (regular / n).alias("regular_ratio"), _mean_or_zero("age").alias("avg_age"),
            F.sum(minutes).alias("total_minutes"), total.alias("total_goals"), F.sum(assists).alias("total_assists"),
            (total + F.sum(assists)).alias("total_goal_involvement"), scored("Forward").alias("forward_goals"),
            scored("Midfielder").alias("midfielder_goals"), scored("Defender").alias("defender_goals"),
            F.coalesce(_herfindahl(goals), 1.0 / n).alias("goal_concentration"),
            F.coalesce(_herfindahl(minutes), 1.0 / n).alias("min_concentration"),
            _zero_div(scored("Forward"), total).alias("forward_goal_share"),
            _zero_div(scored("Midfielder"), total).alias("midfielder_goal_share"),
            F.max(goals).alias("top_scorer_goals"), _zero_div(F.max(goals), total).alias("top_scorer_share")]
    for c in weighted:
        weight = F.when(F.col(c).isNotNull(), F.col(minutes))
        cols.append(_zero_div(F.sum(F.col(c) * F.col(minutes)), F.sum(weight)).alias(f"team_{c}"))
    for c in ranks:
        cols.append(F.coalesce(F.avg(c), zero).alias(f"avg_{c}"))
    if clean_sheets:
        cols.append(F.coalesce(F.sum(F.when(F.col("position").isin("Defender", "Goalkeeper"), F.col(clean_sheets))), F.lit(0)).alias("clean_sheets_def_gk"))
    if conceded:
        cols.append(F.sum(conceded).alias("team_conceded_total"))
    return players.groupBy(*keys).agg(*cols)
