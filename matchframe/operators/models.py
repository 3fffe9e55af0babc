"""Outcome and goal models on pyspark.ml or plain aggregation.

Linear models (logistic, L1, Poisson) are fitted by `newton` and hold their coefficients; they
are applied as column expressions. Trees and nets are a `PipelineModel`: a SQL projection that
fills nulls with the training means (and scales where asked), a vector assembler, and the
estimator's model. Both can be saved, loaded and applied.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import P_COLS, single_row
from ..plans.session import materialize
from . import boosting
from .boosting import Boosted
from .folds import check_fold
from .history import to_team_rows
from .joins import team_param_join
from .metrics import classification_metrics, row_brier, row_log_loss
from .newton import Fit, Solution, fit_many

LABEL = "y"
CLASSES = (0, 1, 2)


@dataclass
class Fitted:
    """A pipeline with its column list, class order and fit log."""

    name: str
    pipeline: PipelineModel
    cols: list[str]
    n_train: int
    link: str = "probability"
    log: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(df)


def _sum(terms: list[Column]) -> Column:
    """A sum as a balanced tree, so that many columns make no deep expression."""
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + (terms[-1:] if len(terms) % 2 else [])
    return terms[0] if terms else F.lit(0.0)


@dataclass
class Linear:
    """Coefficients per output in units of the mean-filled columns; link: softmax over the
    classes, logistic scores per class that are normalised, or poisson rates."""

    name: str
    cols: list[str]
    n_train: int
    link: str
    means: list[float]
    coef: list[list[float]]
    intercept: list[float]
    sds: list[float] = field(default_factory=list)
    penalty: str = "none"
    c: float = 1.0
    scaled: bool = False
    log: dict = field(default_factory=dict)

    def filled(self) -> list[Column]:
        return [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(m)) for c, m in zip(self.cols, self.means)]

    def margins(self, inputs: Sequence[Column] | None = None) -> list[Column]:
        inputs = self.filled() if inputs is None else inputs
        return [_sum([F.lit(b), *[x * F.lit(w) for x, w in zip(inputs, row) if w]]) for row, b in zip(self.coef, self.intercept)]

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows with the margins as columns _m0, _m1, ..."""
        return df.select("*", *[m.alias(f"_m{k}") for k, m in enumerate(self.margins())])


LINEAR_PARTS = ("means", "coef", "intercept", "sds", "penalty", "c", "scaled")


def _linear(name: str, link: str, solutions: Sequence[Solution], seconds: float) -> Linear:
    first = solutions[0]
    coef = [[float(v) for v in row] for s in solutions for row in s.coef]
    intercept = [float(v) for s in solutions for v in s.intercept]
    return Linear(name, list(first.fit.cols), first.n, link, [float(m) for m in first.means], coef, intercept, [float(v) for v in first.sds],
                  first.fit.penalty, first.fit.c, first.fit.scaled, {
        "model": name, "n_features": len(first.fit.cols), "n_train": first.n, "fit_seconds": seconds, "passes": max(s.passes for s in solutions),
        "converged": all(s.converged for s in solutions), "n_parameters": sum(len(row) + 1 for row in coef)})


def _fit_linear(name: str, train: DataFrame, fits: Sequence[Fit], link: str, tol: float = 1e-12) -> Linear:
    start = time.perf_counter()
    return _linear(name, link, fit_many(train, fits, tol=tol), time.perf_counter() - start)


def _prepare(train: DataFrame, cols: Sequence[str], scaled: bool) -> tuple[list, int]:
    """Fill (and scale) projection from training statistics: one aggregation, one small row."""
    sds = [F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)] if scaled else []
    stats = train.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"m{i}") for i, c in enumerate(cols)], *sds).first()
    parts = []
    for i, c in enumerate(cols):
        mean = stats[f"m{i}"]
        value = f"COALESCE(CAST(`{c}` AS DOUBLE), CAST({mean!r} AS DOUBLE))"
        if scaled:
            value = f"({value} - CAST({mean!r} AS DOUBLE)) / CAST({(stats[f's{i}'] or 1.0)!r} AS DOUBLE)"
        parts.append(f"{value} AS `_x{i}`")
    fill = SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")
    vector = VectorAssembler(inputCols=[f"_x{i}" for i in range(len(cols))], outputCol="features")
    return [fill, vector], stats["n"]


def _fit(name: str, train: DataFrame, cols: Sequence[str], make: Callable, scaled: bool = False, link: str = "probability",
         label: str = LABEL) -> Fitted:
    start = time.perf_counter()
    train = train.where(F.col(label).isNotNull())  # counts and means come from the rows that are fitted
    stages, n = _prepare(train, cols, scaled)
    if n == 0:
        raise ValueError("no training rows")
    estimator = make(n)
    pipeline = Pipeline(stages=[*stages, estimator]).fit(train)
    last = pipeline.stages[-1]
    return Fitted(name, pipeline, list(cols), n, link, {
        "model": name, "n_features": len(cols), "n_train": n, "fit_seconds": time.perf_counter() - start,
        "n_parameters": last.weights.size if hasattr(last, "weights") else 3 * last.totalNumNodes})


def stationarity(model: Linear, train: DataFrame, label: str | None = None, weight: str | None = None) -> DataFrame:
    """output, feature, residual: how far each coefficient is from its optimality condition, as a
    share of the largest gradient its column could have. One scan; tasks send one sum per
    coefficient. The feature of an intercept is null."""
    k, d, names = len(model.coef), len(model.cols), [*model.cols, None]
    means, sds = np.array(model.means), np.array(model.sds)
    coef, intercept, link = np.array(model.coef), np.array(model.intercept), model.link
    label = label or (model.name.removeprefix("poisson_") if link == "poisson" else LABEL)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, k, d + 1))
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
            if not batch.num_rows:
                continue
            x, y, w = np.column_stack(cols[:d]), cols[d], cols[d + 1]
            x = np.where(np.isnan(x), means, x)
            z = x @ coef.T + intercept
            if link == "softmax":
                e = np.exp(z - z.max(1, keepdims=True))
                fitted = e / e.sum(1, keepdims=True)
            else:
                fitted = np.exp(z) if link == "poisson" else 1 / (1 + np.exp(-z))
            err = (fitted - (y[:, None] if link == "poisson" else y[:, None] == np.arange(k))) * w[:, None]
            inner = np.column_stack([(x - means) / sds, np.ones(len(x))])
            total += np.stack([err.T @ inner, np.abs(err).T @ np.abs(inner)])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k, dtype=np.int32), d + 1)), pa.array(np.tile(np.arange(d + 1, dtype=np.int32), k)),
                                          pa.array(total[0].ravel()), pa.array(total[1].ravel())], names=["output", "j", "g", "most"])
    rows = train.where(F.col(label).isNotNull()).select(*[F.col(f"`{c}`").cast("double") for c in model.cols], F.col(label).cast("double").alias("_y"),
                                                        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    got = rows.mapInArrow(sums, "output int, j int, g double, most double").groupBy("output", "j").agg(F.sum("g").alias("g"), F.sum("most").alias("most"))
    w = coef * sds
    lam = np.zeros(d) if model.penalty == "none" else 1.0 / model.c / (1.0 if model.scaled else sds ** (2 if model.penalty == "l2" else 1)) * np.ones(d)
    own = F.array(*[F.array(*[F.lit(float(v)) for v in [*row, 0.0]]) for row in w])
    own, pull = own[F.col("output")][F.col("j")], F.array(*[F.lit(float(v)) for v in [*lam, 0.0]])[F.col("j")]
    if model.penalty == "l1":
        gap = F.when(own != 0, F.abs(F.col("g") + pull * F.signum(own))).otherwise(F.greatest(F.abs("g") - pull, F.lit(0.0)))
    else:
        gap = F.abs(F.col("g") + pull * own)
    label_of = F.array(*[F.lit(n) for n in names])[F.col("j")]
    return got.select("output", label_of.alias("feature"), (gap / F.greatest("most", F.lit(1.0))).alias("residual"))


def class_scores(margins: Sequence[Column], link: str) -> list[Column]:
    """Class probabilities from the margins of a linear model."""
    if link == "softmax":
        top = F.greatest(*margins)
        each = [F.exp(m - top) for m in margins]
    else:  # one against the rest: logistic of each, divided by their sum
        each = [1.0 / (1.0 + F.exp(-m)) for m in margins]
    return [e / (each[0] + each[1] + each[2]) for e in each]


def predict(model: Fitted | Linear | Boosted, df: DataFrame, keep: Sequence[str] = ("match_id",)) -> DataFrame:
    """Class probabilities (away, draw, home) and the predicted class."""
    out = model.transform(df)
    if isinstance(model, (Linear, Boosted)):
        out = out.select(*keep, "_m0", "_m1", "_m2")
        p = class_scores([F.col(f"_m{k}") for k in CLASSES], model.link)
    else:
        raw = vector_to_array("probability")
        p = [raw[k] for k in CLASSES]
    best = F.greatest(*p)
    return out.select(*keep, *[c.alias(n) for c, n in zip(p, P_COLS)],
                      F.when(p[0] == best, 0).when(p[1] == best, 1).otherwise(2).alias("predicted"))


def lr_spec(name: str, cols: Sequence[str], c: float = 1.0, **kw) -> Fit:
    """Total log loss times C plus half the squared coefficients; intercepts are free."""
    return Fit(name, tuple(cols), "softmax", "l2", c, **kw)


def fit_lr(train: DataFrame, cols: Sequence[str], c: float = 1.0, tol: float = 1e-12, **kw) -> Linear:
    """Multinomial logistic regression, L2, mean-filled, unscaled."""
    return _fit_linear("lr", train, [lr_spec("lr", cols, c, **kw)], "softmax", tol)


def fit_lr_scaled(train: DataFrame, cols: Sequence[str], c: float = 1.0, tol: float = 1e-12, **kw) -> Linear:
    return _fit_linear("lr_scaled", train, [lr_spec("lr_scaled", cols, c, scaled=True, **kw)], "softmax", tol)


def fit_lr_l1(train: DataFrame, cols: Sequence[str], c: float = 1.0, tol: float = 1e-12, label: str = LABEL) -> Linear:
    """L1 penalty on standardised columns, one model per class against the rest, fitted in shared scans."""
    fits = [Fit(f"lr_l1_{k}", tuple(cols), "logistic", "l1", c, True, label, k) for k in CLASSES]
    return _fit_linear("lr_l1", train, fits, "logistic", tol)


def class_weights(train: DataFrame, label: str = LABEL) -> DataFrame:
    """weight = n / (k * n_class), one row per class."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    total = single_row(counts.agg(F.sum("n_class").alias("n"), F.count(F.lit(1)).alias("k")))
    return counts.select(label, "n_class", (total["n"] / (total["k"] * F.col("n_class"))).alias("class_weight"))


def with_class_weights(train: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows with a label and their weight: a literal per class (one row each comes to the driver), as
    a join on the label would deal all rows to one task per class."""
    weights = F.create_map(*[F.lit(v) for row in class_weights(train, label).collect() if row[label] is not None for v in (row[label], row["class_weight"])])
    return train.where(F.col(label).isNotNull()).withColumn("class_weight", weights[F.col(label)])


def fit_balanced(train: DataFrame, cols: Sequence[str], kind: str = "lr", **kw) -> Fitted | Linear:
    """Logistic regression or forest with balanced class weights (one row per class comes to the driver)."""
    weights = F.create_map(*[F.lit(v) for row in class_weights(train.where(F.col(LABEL).isNotNull())).collect() for v in (row[LABEL], row["class_weight"])])
    weighted = train.withColumn("class_weight", weights[F.col(LABEL)])
    if kind == "lr":
        return _fit_linear("lr_balanced", weighted, [lr_spec("lr_balanced", cols, weight="class_weight", **kw)], "softmax")
    return _fit("forest_balanced", weighted, cols, lambda n: _forest(**kw).setWeightCol("class_weight"))


def _forest(trees: int = 250, depth: int = 10, leaf: int = 8, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed, labelCol=LABEL)


def fit_forest(train: DataFrame, cols: Sequence[str], trees: int = 250, depth: int = 10, leaf: int = 8, seed: int = 42) -> Fitted:
    return _fit("forest", train, cols, lambda n: _forest(trees, depth, leaf, seed))


def fit_boosted(train: DataFrame, cols: Sequence[str], rounds: int = 250, depth: int = 3, rate: float = 0.1, label: str = LABEL) -> Boosted:
    """Boosted trees on softmax gradients, one tree per class and round (see `boosting`)."""
    start = time.perf_counter()
    model = boosting.fit(train, cols, rounds, depth, rate, label)
    model.log = {"model": model.name, "n_features": len(model.cols), "n_train": model.n_train, "fit_seconds": time.perf_counter() - start,
                 "n_parameters": sum(len(t.value) + 2 * len(t.column) for r in model.rounds for t in r)}
    return model


def fit_mlp(train: DataFrame, cols: Sequence[str], layers: Sequence[int] = (64, 128, 128, 128), max_iter: int = 100, seed: int = 42) -> Fitted:
    return _fit("mlp", train, cols, lambda n: MultilayerPerceptronClassifier(
        layers=[len(cols), *layers, 3], maxIter=max_iter, seed=seed, labelCol=LABEL, blockSize=256), scaled=True)


# ---------------------------------------------------------------- closed-form classifiers

def naive_bayes_params(train: DataFrame, cols: Sequence[str], label: str = LABEL, smoothing: float = 1e-9) -> DataFrame:
    """Per class: prior, and mean / variance of every mean-filled column (plus smoothing * largest variance)."""
    means = train.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in cols]).first()
    filled = train.select(label, *[F.coalesce(F.col(c), F.lit(means[c])).alias(c) for c in cols])
    # the overall variance is the within-class variance plus that of the class means, so one pass is enough
    per = filled.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in cols],
                                    *[F.var_pop(c).alias(f"v_{c}") for c in cols])
    every = Window.partitionBy()  # one row per class
    n = F.sum("n").over(every)
    spread = []
    for c in cols:
        mean = F.sum(F.col("n") * F.col(f"mean_{c}")).over(every) / n
        square = F.sum(F.col("n") * (F.col(f"v_{c}") + F.col(f"mean_{c}") * F.col(f"mean_{c}"))).over(every) / n
        spread.append(square - mean * mean)
    floor = smoothing * F.greatest(*spread, F.lit(0.0))
    return per.select(label, (F.col("n") / n).alias("prior"), *[f"mean_{c}" for c in cols],
                      *[(F.col(f"v_{c}") + floor).alias(f"var_{c}") for c in cols])


def fit_naive_bayes(train: DataFrame, test: DataFrame, cols: Sequence[str], keep: Sequence[str] = ("match_id",), label: str = LABEL) -> DataFrame:
    """Gaussian naive Bayes: parameters by aggregation (one small row per class), log densities as expressions."""
    params = {row[label]: row for row in naive_bayes_params(train, cols, label).collect()}
    means = {c: sum(p["prior"] * p[f"mean_{c}"] for p in params.values()) for c in cols}
    scores = []
    for k in CLASSES:
        par = params.get(k)
        if par is None:
            scores.append(F.lit(float("-inf")))
            continue
        log_p = F.lit(math.log(par["prior"]) - 0.5 * sum(math.log(2 * math.pi * par[f"var_{c}"]) for c in cols))
        for c in cols:
            gap = F.coalesce(F.col(c), F.lit(means[c])) - par[f"mean_{c}"]
            log_p = log_p - gap * gap / (2 * par[f"var_{c}"])
        scores.append(log_p)
    out = test.select(*keep, *[s.alias(f"_l{k}") for k, s in enumerate(scores)]).withColumn("_top", F.greatest("_l0", "_l1", "_l2"))
    e = [F.exp(F.col(f"_l{k}") - F.col("_top")) for k in CLASSES]
    return out.select(*keep, *[(x / (e[0] + e[1] + e[2])).alias(n) for x, n in zip(e, P_COLS)])


def fit_majority(train: DataFrame, test: DataFrame, keep: Sequence[str] = ("match_id",), label: str = LABEL) -> DataFrame:
    """The most frequent training class with probability one (lowest class on ties)."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    best = single_row(counts.agg(F.max_by(label, F.struct("n", -F.col(label))).alias("c")))["c"]
    return test.select(*keep, *[(best == k).cast("double").alias(n) for k, n in zip(CLASSES, P_COLS)], best.cast("int").alias("predicted"))


# ---------------------------------------------------------------- combining predictions

def _both(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    other = b.select(*keys, *[F.col(p).alias(f"b_{p}") for p in P_COLS])
    return a.join(other, list(keys), how)


def soft_vote(preds_a: DataFrame, preds_b: DataFrame, keys: Sequence[str] = ("match_id",)) -> DataFrame:
    both = _both(preds_a, preds_b, keys)
    return both.select(*[((F.col(c) + F.col(f"b_{c}")) / 2).alias(c) if c in P_COLS else F.col(c) for c in preds_a.columns])


def blend_weight(preds_a: DataFrame, preds_b: DataFrame, grid: Sequence[float] = tuple(round(0.30 + 0.05 * i, 2) for i in range(10)),
                 keys: Sequence[str] = ("match_id",), y: str = LABEL) -> DataFrame:
    """Validation log loss of w * a + (1 - w) * b per weight, with the best weight marked.

    All weights are evaluated in one aggregation over the joined rows.
    """
    both = _both(preds_a, preds_b, keys)
    true_a = F.when(F.col(y) == 0, F.col("p_away")).when(F.col(y) == 1, F.col("p_draw")).otherwise(F.col("p_home"))
    true_b = F.when(F.col(y) == 0, F.col("b_p_away")).when(F.col(y) == 1, F.col("b_p_draw")).otherwise(F.col("b_p_home"))
    row = both.select(true_a.alias("a"), true_b.alias("b")).agg(*[
        F.avg(-F.ln(F.greatest(w * F.col("a") + (1 - w) * F.col("b"), F.lit(1e-15)))).alias(f"l{i}") for i, w in enumerate(grid)])
    items = F.array(*[F.struct(F.lit(float(w)).alias("weight"), F.col(f"l{i}").alias("log_loss")) for i, w in enumerate(grid)])
    long = row.select(F.explode(items).alias("x")).select("x.*")
    order = Window.orderBy("log_loss", "weight")  # one row per weight
    return long.withColumn("best", (F.row_number().over(order) == 1).cast("int"))


def two_tier(preds_rich: DataFrame, preds_fallback: DataFrame, keys: Sequence[str] = ("match_id",)) -> DataFrame:
    """The enriched model's probabilities where it covers the row, else the fallback model's."""
    rich = preds_rich.select(*keys, *[F.col(p).alias(f"b_{p}") for p in P_COLS])
    both = preds_fallback.join(rich, list(keys), "left")
    covered = F.col("b_p_away").isNotNull() & F.col("b_p_draw").isNotNull() & F.col("b_p_home").isNotNull()
    return both.select(*[F.when(covered, F.col(f"b_{c}")).otherwise(F.col(c)).alias(c) if c in P_COLS else F.col(c)
                         for c in preds_fallback.columns], F.when(covered, 1).otherwise(2).alias("tier"))


# ---------------------------------------------------------------- goal models

def fit_poisson_glm(train: DataFrame, cols: Sequence[str], home: str = "home_goals", away: str = "away_goals") -> tuple[Linear, Linear]:
    """Two log-link Poisson regressions without a penalty, fitted in shared scans."""
    start = time.perf_counter()
    found = fit_many(train, [Fit(f"poisson_{label}", tuple(cols), "poisson", "none", label=label) for label in (home, away)])
    return tuple(_linear(s.fit.name, "poisson", [s], time.perf_counter() - start) for s in found)


def predict_rates(models: tuple[Linear, Linear], df: DataFrame, keep: Sequence[str] = ("match_id",)) -> DataFrame:
    return df.select(*keep, *[F.exp(m.margins()[0]).alias(n) for m, n in zip(models, ("lambda_home", "lambda_away"))])


def fit_attack_defence(matches: DataFrame, smoothing: float = 0.05) -> DataFrame:
    """Per team: attack and defence on the log scale, with mu and mu_home repeated on each row."""
    played = matches.where(F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull())
    s = F.lit(smoothing)
    log_floor = lambda x: F.ln(F.greatest(x, s))
    base = single_row(played.agg(log_floor(F.avg("away_goals")).alias("mu"),
                                 (log_floor(F.avg("home_goals")) - log_floor(F.avg("away_goals"))).alias("mu_home")))
    teams = to_team_rows(played).groupBy("team").agg(F.count(F.lit(1)).alias("n"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga"))
    rate = lambda c: log_floor((F.col(c) + s) / (F.col("n") + s)) - base["mu"]
    return teams.select("team", "n", rate("gf").alias("attack"), rate("ga").alias("defence"), base["mu"].alias("mu"),
                        base["mu_home"].alias("mu_home"))


def expected_goals(matches: DataFrame, params: DataFrame) -> DataFrame:
    """Rates from attack and defence; an unknown team counts 0."""
    base = single_row(params.agg(F.first("mu").alias("mu"), F.first("mu_home").alias("mu_home")))
    joined = team_param_join(matches, params)
    home = F.exp(base["mu"] + base["mu_home"] + F.col("home_attack") + F.col("away_defence"))
    away = F.exp(base["mu"] + F.col("away_attack") + F.col("home_defence"))
    return joined.select(*matches.columns, home.alias("lambda_home"), away.alias("lambda_away"))


def ratio_poisson(matches: DataFrame, ratings: DataFrame, train: DataFrame) -> DataFrame:
    """Rates as league mean * attack * opponent defence; unknown teams count 1."""
    league = single_row(train.agg(F.avg("home_goals").alias("h"), F.avg("away_goals").alias("a")))
    joined = team_param_join(matches, ratings, default=1.0)
    return joined.select(*matches.columns, (league["h"] * F.col("home_attack") * F.col("away_defence")).alias("lambda_home"),
                         (league["a"] * F.col("away_attack") * F.col("home_defence")).alias("lambda_away"))


# ---------------------------------------------------------------- suites and persistence

REGISTRY: dict[str, Callable[[DataFrame, Sequence[str]], Fitted]] = {
    "lr": fit_lr, "lr_scaled": fit_lr_scaled, "lr_l1": fit_lr_l1, "lr_balanced": fit_balanced, "forest": fit_forest,
    "boosted": fit_boosted, "mlp": fit_mlp,
}


def save_model(model: Fitted | Linear | Boosted, path: str) -> None:
    """One metadata row (columns, class order, link; a linear model's coefficients) and the pipeline of other models."""
    meta = {"name": model.name, "cols": model.cols, "n_train": model.n_train, "link": model.link, "classes": list(P_COLS)}
    if isinstance(model, Linear):
        meta |= {k: getattr(model, k) for k in LINEAR_PARTS}
    elif isinstance(model, Boosted):
        meta |= {"boosted": model.state()}
    else:
        model.pipeline.write().save(f"{path}/pipeline")
    _session().createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.text(f"{path}/meta")


def load_model(path: str) -> Fitted | Linear | Boosted:
    meta = json.loads(_session().read.text(f"{path}/meta").first()[0])
    if "coef" in meta:
        return Linear(meta["name"], meta["cols"], meta["n_train"], meta["link"], **{k: meta[k] for k in LINEAR_PARTS})
    if "boosted" in meta:
        return boosting.from_state(meta["name"], meta["cols"], meta["n_train"], meta["boosted"])
    return Fitted(meta["name"], PipelineModel.load(f"{path}/pipeline"), meta["cols"], meta["n_train"], meta["link"])


def _session():
    return SparkSession.getActiveSession()


def run_model_suite(df: DataFrame, cols: Sequence[str], folds: Sequence[int], registry: Mapping[str, Callable], season: str = "season",
                    keep: Sequence[str] = ("match_id", "season", "division", "match_date", "y")) -> tuple[DataFrame, list[dict]]:
    """Fit every model on every fold; long predictions and a fit log. A failed fit is logged, not fatal.

    `df` should be materialised: it is read once per fold and model.
    """
    parts, log = [], []
    for fold in folds:
        train, test = df.where(F.col(season) < fold), df.where(F.col(season) == fold)
        try:
            check_fold(train, test, season)
        except ValueError as err:
            log.append({"fold": fold, "model": "*", "error": str(err)})
            continue
        for name, build in registry.items():
            try:
                model = build(train, cols)
                start = time.perf_counter()
                part = predict(model, test, keep).withColumn("model", F.lit(name)).withColumn("fold", F.lit(fold))
                parts.append(materialize(part))
                log.append({"fold": fold, **model.log, "predict_seconds": time.perf_counter() - start, "model_bytes": model_bytes(model), "model": name})
            except Exception as err:  # noqa: BLE001 - recorded per fold
                log.append({"fold": fold, "model": name, "error": str(err).splitlines()[0][:500]})
    if not parts:
        raise RuntimeError(f"no model could be fitted: {log}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, log


def model_bytes(model: Fitted | Linear | Boosted) -> int:
    """Size of the model's numbers in bytes (a pipeline's: of its trees or weights)."""
    if isinstance(model, Linear):
        return 8 * (sum(map(len, model.coef)) + len(model.intercept) + len(model.means))
    if isinstance(model, Boosted):
        return 8 * (model.log.get("n_parameters", 0) + sum(map(len, model.edges)) + len(model.means))
    last = model.pipeline.stages[-1]
    return 8 * (last.weights.size if hasattr(last, "weights") else 3 * last.totalNumNodes)


def suite_log(spark: SparkSession, log: Sequence[dict]) -> DataFrame:
    """The fit log of a suite as a table: one row per successful fit."""
    rows = [(e["model"], int(e["fold"]), float(e["fit_seconds"]), float(e["predict_seconds"]), int(e["n_features"]), int(e["n_parameters"]), int(e["model_bytes"]), int(e["n_train"]))
            for e in log if "error" not in e]
    return spark.createDataFrame(rows, "model string, fold int, fit_seconds double, predict_seconds double, n_features int, n_parameters long, model_bytes long, n_train long")


def suite_failures(spark: SparkSession, log: Sequence[dict]) -> DataFrame:
    """Fits of a suite's log that failed: one row per fold and model (model '*': the whole fold) with the error."""
    rows = [(entry["model"], int(entry["fold"]), entry["error"]) for entry in log if "error" in entry]
    return spark.createDataFrame(rows, "model string, fold int, error string")


def suite_metrics(preds: DataFrame) -> DataFrame:
    """Fold rows and a pooled row (fold null) per model."""
    def block(by):
        probs = preds.groupBy(*by).agg(F.avg(row_log_loss()).alias("log_loss"), F.avg(row_brier()).alias("brier"))
        return classification_metrics(preds, by, per_class=False).join(probs, by)
    pooled = block(["model"]).withColumn("fold", F.lit(None).cast("int"))
    return block(["model", "fold"]).unionByName(pooled)


def train_on_all(df: DataFrame, cols: Sequence[str], name: str = "lr", registry: Mapping[str, Callable] = REGISTRY,
                 keep: Sequence[str] = ("match_id", "y")) -> DataFrame:
    """Fit on all rows and predict the same rows."""
    if name not in registry:
        raise KeyError(f"unknown model {name!r}; known: {sorted(registry)}")
    return predict(registry[name](df, cols), df, keep)
