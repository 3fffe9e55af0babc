"""Feature importance, correlation and column-set search."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import single_row
from ..functions.stats import hash32
from ..plans.blocks import BEFORE, cell_rank, null_safe_join
from ..plans.packed import expand_block, expand_ids, gathered, runs, slot_of, squeeze_block, squeeze_ids
from ..plans.session import materialize
from .folds import check_fold
from .metrics import classification_metrics, row_brier, row_log_loss
from .models import Fitted, Linear, lr_spec, predict
from .newton import fit_many

HASH_CELL = 1 << 20
IDS_PER_CELL = 1 << 17   # ids a task ranks at once
RANKS_PER_PART = 1 << 16  # ranks a task pairs at once
DEALT = 1 << 20          # ids a task holds to deal them out
ROWS_PER_SLOT = 1 << 17  # rows with all their values a task holds


def family(col: str) -> str:
    """Feature family by name."""
    if col == "league_level":
        return "league"
    if col.startswith("h2h_"):
        return "h2h"
    for name, marks in (("shooting", ("avg_shots", "avg_sot", "shot_accuracy", "conversion_rate")), ("margins", ("margin",)),
                        ("form", ("team_state", "win_rate", "draw_rate", "loss_rate"))):
        if any(m in col for m in marks):
            return name
    return "goals_strength"


def shuffle_within(df: DataFrame, cols: Sequence[str], block: Sequence[str] = ("division",), seed: int | Column = 42, id_col: str = "match_id",
                   suffix: str = "_shuffled") -> DataFrame:
    """Permute `cols` jointly inside each block (block=() permutes over all rows).

    Rows are numbered twice by two hash orders and joined by number. Numbers come
    from hash cells, so a block of any size is spread over many tasks.
    """
    block = list(block)
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    if list(cols) == [id_col] and set(df.columns) == {id_col, *block} and df.schema[id_col].dataType.typeName() in ("long", "integer"):
        return _permuted_ids(df, block, seed, id_col, id_col + suffix)

    def numbered(data, salt):
        h = hash32(seed, F.lit(salt), id_col)
        return cell_rank(data, block, F.floor(h / HASH_CELL), [h, F.col(id_col)], "_k")

    target = numbered(df, "to")
    source = numbered(df.select(*dict.fromkeys([*block, id_col, *cols])), "from").select(
        *block, "_k", *[F.col(c).alias(c + suffix) for c in cols])
    return target.join(source, [*block, "_k"]).drop("_k")


def _permuted_ids(df: DataFrame, block: list[str], seed: Column, id_col: str, name: str) -> DataFrame:
    """shuffle_within() of ids alone, which travel as compressed runs: by cells of either hash to be
    ranked, then by rank to meet. As there, rows of a null block meet nothing."""
    df = df.dropna(subset=block) if block else df
    cells = -(-df.count() // IDS_PER_CELL) or 1
    sides = [hash32(seed, F.lit(salt), id_col) for salt in ("to", "from")]
    keys = "".join(f"`{b}` {df.schema[b].dataType.simpleString()}, " for b in block)
    whole = pa.int32() if df.schema[id_col].dataType.typeName() == "integer" else pa.int64()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, DEALT):
            ids, *hashes = (table.column(c).to_numpy() for c in ("_id", "_h0", "_h1"))
            code = table.select(block).to_pandas().groupby(block, dropna=False, sort=False).ngroup().to_numpy() if block else np.zeros(len(ids), int)
            for side, h in enumerate(hashes):
                out = []
                for key, at in runs(code * cells + (h * cells >> 32)):
                    out.append((at[0], key % cells, len(at), squeeze_ids(h[at], ids[at])))
                first, cell, n, v = zip(*out)
                own = table.select(block).take(pa.array(first)).combine_chunks()
                yield pa.RecordBatch.from_arrays([*[own.column(b).combine_chunks() if len(own) else own.column(b) for b in block], pa.array([side] * len(n), pa.int32()),
                                                  pa.array(cell, pa.int32()), pa.array(n, pa.int32()), pa.array(v, pa.binary())], names=[*block, "side", "cell", "n", "v"])

    def ranked(key: tuple, table: pa.Table) -> pa.Table:
        h, ids = np.concatenate([expand_ids(v, 2, n) for n, v in zip(table.column("n").to_pylist(), table.column("v").to_pylist())], 1)
        ids, start = ids[np.lexsort((ids, h))], table.column("_o")[0].as_py()
        cuts = [0, *range(RANKS_PER_PART - start % RANKS_PER_PART, len(ids), RANKS_PER_PART), len(ids)]
        out = [(start + a, b - a, squeeze_ids(ids[a:b])) for a, b in zip(cuts, cuts[1:]) if b > a]
        return pa.table({**{b: pa.array([k.as_py()] * len(out), k.type) for b, k in zip(block, key)}, "side": pa.array([key[len(block)].as_py()] * len(out), pa.int32()),
                         "part": pa.array([o[0] // RANKS_PER_PART for o in out], pa.int64()), "start": pa.array([o[0] for o in out], pa.int64()),
                         "n": pa.array([o[1] for o in out], pa.int32()), "v": pa.array([o[2] for o in out], pa.binary())})

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        sides: list[list[tuple[int, np.ndarray]]] = [[], []]
        for side, start, n, v in zip(*(table.column(c).to_pylist() for c in ("side", "start", "n", "v"))):
            sides[side].append((start, expand_ids(v, 1, n)[0]))
        to, source = (np.concatenate([ids for _, ids in sorted(side, key=lambda r: r[0])]) for side in sides)
        return pa.table({**{b: pa.array([k.as_py()] * len(to), k.type) for b, k in zip(block, key)}, id_col: pa.array(to).cast(whole), name: pa.array(source).cast(whole)})

    hashed = df.select(*block, F.col(id_col).cast("long").alias("_id"), *[h.cast("long").alias(f"_h{i}") for i, h in enumerate(sides)])
    dealt = hashed.mapInArrow(deal, keys + "side int, cell int, n int, v binary")
    spots = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.shiftright(F.col(f"_h{i}") * cells, 32).cast("int").alias("cell")) for i in range(2)]))
    counts = hashed.select(*block, spots.alias("_s")).groupBy(*block, "_s.side", "_s.cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*block, "side").orderBy("cell").rowsBetween(*BEFORE)
    offsets = counts.select(*block, "side", "cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    placed = null_safe_join(dealt, offsets, [*block, "side", "cell"])
    order = placed.groupBy(*block, "side", "cell").applyInArrow(ranked, keys + "side int, part long, start long, n int, v binary")
    return order.groupBy(*block, "part").applyInArrow(meet, f"{keys}`{id_col}` {df.schema[id_col].dataType.simpleString()}, `{name}` {df.schema[id_col].dataType.simpleString()}")


def _vectors(model: Fitted, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Filled (and scaled) model inputs as one array column."""
    filled = model.pipeline.stages[0].transform(df)
    return filled.select(*keep, F.array(*[f"_x{i}" for i in range(len(model.cols))]).alias("x"))


def _score(model: Fitted, df: DataFrame) -> DataFrame:
    """Probabilities from an array column `x`."""
    scored = model.pipeline.stages[-1].transform(df.withColumn("features", array_to_vector("x")))
    p = vector_to_array("probability")
    return scored.select(*df.columns, p[0].alias("p_away"), p[1].alias("p_draw"), p[2].alias("p_home")).withColumn(
        "predicted", F.when(F.col("p_away") >= F.greatest("p_draw", "p_home"), 0).when(F.col("p_draw") >= F.col("p_home"), 1).otherwise(2))


def _importance(model: Fitted, df: DataFrame, groups: Mapping[str, Sequence[int]], repeats: int, block: Sequence[str], seed: int,
                global_groups: Sequence[str], y: str) -> DataFrame:
    keys = ["match_id", *block, y]
    base_rows = materialize(_vectors(model, df, keys))
    hit = (F.col("predicted") == F.col(y)).cast("double")
    loss = row_log_loss(y)
    base = single_row(_score(model, base_rows).agg(F.avg(loss).alias("l"), F.avg(hit).alias("a")))
    local = {k: v for k, v in groups.items() if k not in global_groups}
    wide = {k: v for k, v in groups.items() if k in global_groups}
    parts = []
    for r in range(repeats):
        for part, blocks in ((local, block), (wide, ())):
            if not part:
                continue
            both = shuffle_within(base_rows, ["x"], blocks, seed + r)
            # every row meets every group once, scored and averaged in place
            items = F.array(*[F.struct(F.lit(k).alias("feature"), F.array(*[F.lit(i) for i in idx]).alias("idx")) for k, idx in part.items()])
            rows = both.select(*keys, "x", "x_shuffled", F.explode(items).alias("g"))
            moved = F.transform("x", lambda v, i: F.when(F.array_contains(F.col("g.idx"), i), F.element_at("x_shuffled", i + 1)).otherwise(v))
            rows = rows.select(*keys, F.col("g.feature").alias("feature"), moved.alias("x"))
            parts.append(_score(model, rows).groupBy("feature").agg((F.avg(loss) - base["l"]).alias("d_loss"), (base["a"] - F.avg(hit)).alias("d_acc")))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return _ranked(long)


def _linear_sums(coef: np.ndarray, own: list[int], groups: list[tuple[str, list[int]]]):
    """Adds up rise of loss and fall of hits per repeat and group over rows (rep, y, base, x, moved):
    margins of the row, and its own and the permuted values of the columns `own`. Margins stay, only
    the changed terms are replaced."""
    at = {i: k for k, i in enumerate(own)}
    single = all(len(idx) == 1 for _, idx in groups)

    def add(total: dict[tuple[int, str], np.ndarray], rep: np.ndarray, y: np.ndarray, base: np.ndarray, x: np.ndarray, moved: np.ndarray) -> None:
        change = moved - x
        rows, reps = np.arange(len(y)), [(int(r), rep == r) for r in np.unique(rep)]

        def scored(z):
            e = np.exp(z - z.max(-1, keepdims=True))
            p = e / e.sum(-1, keepdims=True)
            return -np.log(np.maximum(p[rows, ..., y], 1e-15)), p.argmax(-1)
        loss0, guess0 = scored(base)
        for first in range(0, len(groups), 16):
            part = groups[first:first + 16]
            if single:
                z = base[:, None, :] + change[:, [at[idx[0]] for _, idx in part], None] * coef[:, [idx[0] for _, idx in part]].T
            else:
                z = np.stack([base + change[:, [at[i] for i in idx]] @ coef[:, idx].T for _, idx in part], 1)
            loss, guess = scored(z)
            rise = loss - loss0[:, None]
            fall = (guess0 == y).astype(float)[:, None] - (guess == y[:, None])
            for r, mine in reps:
                for g, (name, _) in enumerate(part):
                    total[r, name] = total.get((r, name), np.zeros(3)) + [mine.sum(), rise[mine, g].sum(), fall[mine, g].sum()]
    return add


def _met_sums(rows: DataFrame, pairs: DataFrame, d: int, y: str, add) -> DataFrame:
    """Sums by `add` over rows (match_id, y, base, x: d values) and pairs (rep, match_id, _from): the values of
    _from replace those of match_id. Rows are dealt to slots by id, the pairs follow to the slot of
    _from, and values go on to that of match_id, column after column and compressed."""
    n = rows.count()
    slots = max(-(-n // ROWS_PER_SLOT), min(-(-n // 16384), 24), 1)
    names, kinds = ["slot", "n", "ids", "v"], "slot int, n int, ids binary, v binary"

    def packs(found: list[tuple]) -> list[pa.Array]:
        return [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, ROWS_PER_SLOT // 2):
            ids = table.column("match_id").to_numpy()
            wide = [np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column(k).chunks]).reshape(len(ids), -1).T for k in ("base", "x")]
            block = np.vstack([table.column(y).to_numpy()[None].astype(float), *wide])
            yield pa.RecordBatch.from_arrays(packs([(k, len(at), squeeze_ids(ids[at]), squeeze_block(block[:, at])) for k, at in runs(slot_of(ids, slots))]), names=names)

    def deal_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, DEALT):
            rep, to, source = (table.column(c).to_numpy() for c in ("rep", "match_id", "_from"))
            yield pa.RecordBatch.from_arrays(packs([(k, len(at), squeeze_ids(rep[at], to[at], source[at]), b"") for k, at in runs(slot_of(source, slots))]), names=names)

    def blobs(table: pa.Table):
        return zip(*(table.column(c).to_pylist() for c in names[1:]))

    def held(table: pa.Table):
        """A slot's (y, base, x) and where each of some ids stands in it."""
        ids = np.concatenate([expand_ids(i, 1, k)[0] for k, i, _ in blobs(table)])
        block, at, order = np.empty((4 + d, len(ids))), 0, np.argsort(ids)
        for k, _, v in blobs(table):
            block[:, at:at + k] = expand_block(v, 4 + d, k)
            at += k
        return block, lambda some: order[np.searchsorted(ids, some, sorter=order)]

    def send(_key, mine: pa.Table, wanted: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if mine.num_rows and wanted.num_rows:
            block, places = held(mine)
            rep, to, source = np.concatenate([expand_ids(i, 3, k) for k, i, _ in blobs(wanted)], 1)
            place = places(source)
            order = np.argsort(place, kind="stable")  # rows that stand together are alike
            rep, to, place = rep[order], to[order], place[order]
            found = [(k, len(at), squeeze_ids(rep[at], to[at]), squeeze_block(block[4:, place[at]])) for k, at in runs(slot_of(to, slots))]
        return pa.Table.from_arrays(packs(found), names=names)

    def score(_key, mine: pa.Table, moved: pa.Table) -> pa.Table:
        total: dict[tuple[int, str], np.ndarray] = {}
        if mine.num_rows and moved.num_rows:
            block, places = held(mine)
            for k, i, v in blobs(moved):
                (rep, to), values = expand_ids(i, 2, k), expand_block(v, d, k)
                for at in range(0, k, 4096):
                    some = slice(at, at + 4096)
                    own = block[:, places(to[some])]
                    add(total, rep[some], own[0].astype(int), own[1:4].T, own[4:].T, values[:, some].T)
        return pa.table({"rep": pa.array([k[0] for k in total], pa.int32()), "feature": pa.array([k[1] for k in total], pa.string()),
                         **{c: pa.array([float(v[i]) for v in total.values()], pa.float64()) for i, c in enumerate(("n", "rise", "fall"))}})
    dealt = rows.mapInArrow(deal, kinds)
    asked = pairs.select(F.col("rep").cast("long"), F.col("match_id").cast("long"), F.col("_from").cast("long")).mapInArrow(deal_pairs, kinds)
    moved = dealt.groupBy("slot").cogroup(asked.groupBy("slot")).applyInArrow(send, kinds)
    return dealt.groupBy("slot").cogroup(moved.groupBy("slot")).applyInArrow(score, "rep int, feature string, n double, rise double, fall double")


def _linear_importance(model: Linear, df: DataFrame, groups: Mapping[str, Sequence[int]], repeats: int, block: Sequence[str], seed: int,
                       global_groups: Sequence[str], y: str) -> DataFrame:
    """Rows meet their permuted partner once per repeat and are scored for all groups in place.

    Ids alone are permuted; a row's values then travel once per repeat, to the row they replace.
    """
    rows = materialize(df.select("match_id", *block, y, F.array(*model.filled()).alias("x"), F.array(*model.margins()).alias("base")))
    ids = rows.select("match_id", *block).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    coef = np.array(model.coef)
    sums = []
    for part, blocks in (({k: v for k, v in groups.items() if k not in global_groups}, list(block)), ({k: v for k, v in groups.items() if k in global_groups}, [])):
        if not part:
            continue
        own = sorted({i for idx in part.values() for i in idx})
        values = F.col("x") if len(own) == len(model.cols) else F.array(*[F.col("x")[i] for i in own])
        pairs = shuffle_within(ids.select("match_id", "rep", *blocks), ["match_id"], ["rep", *blocks], F.lit(seed) + F.col("rep")).select("rep", "match_id", F.col("match_id_shuffled").alias("_from"))
        add = _linear_sums(coef, own, [(k, list(v)) for k, v in part.items()])
        sums.append(_met_sums(rows.select(F.col("match_id").cast("long"), y, "base", values.alias("x")), pairs, len(own), y, add))
    long = sums[0]
    for other in sums[1:]:
        long = long.unionByName(other)
    per = long.groupBy("rep", "feature").agg((F.sum("rise") / F.sum("n")).alias("d_loss"), (F.sum("fall") / F.sum("n")).alias("d_acc"))
    return _ranked(per)


def _ranked(deltas: DataFrame) -> DataFrame:
    out = deltas.groupBy("feature").agg(F.avg("d_loss").alias("permutation_logloss_mean"), F.stddev_samp("d_loss").alias("permutation_logloss_std"),
                                        F.avg("d_acc").alias("permutation_accuracy_mean"), F.stddev_samp("d_acc").alias("permutation_accuracy_std"))
    # one row per feature
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("permutation_logloss_mean").desc(), "feature")))


def permutation_importance(model: Fitted | Linear, df: DataFrame, repeats: int = 5, block: Sequence[str] = ("division",), seed: int = 42,
                           y: str = "y") -> DataFrame:
    """Rise in log loss and fall in accuracy when one column is permuted; the league column is permuted globally."""
    groups = {c: [i] for i, c in enumerate(model.cols)}
    return _any_importance(model, df, groups, repeats, block, seed, ["league_level"], y).withColumn("family", _family_column())


def _any_importance(model: Fitted | Linear, *args) -> DataFrame:
    return (_linear_importance if isinstance(model, Linear) else _importance)(model, *args)


def _family_column():
    return (F.when(F.col("feature") == "league_level", "league").when(F.col("feature").startswith("h2h_"), "h2h")
            .when(F.col("feature").rlike("avg_shots|avg_sot|shot_accuracy|conversion_rate"), "shooting")
            .when(F.col("feature").contains("margin"), "margins")
            .when(F.col("feature").rlike("team_state|win_rate|draw_rate|loss_rate"), "form").otherwise("goals_strength"))


def group_importance(model: Fitted | Linear, df: DataFrame, families: Mapping[str, Sequence[str]], repeats: int = 5,
                     block: Sequence[str] = ("division",), seed: int = 42, y: str = "y") -> DataFrame:
    """The same for whole families of columns, permuted together."""
    where = {c: i for i, c in enumerate(model.cols)}
    groups = {name: [where[c] for c in cols] for name, cols in families.items()}
    wide = [name for name, cols in families.items() if list(cols) == ["league_level"]]
    sizes = F.create_map(*[F.lit(x) for k, v in groups.items() for x in (k, len(v))])
    return (_any_importance(model, df, groups, repeats, block, seed, wide, y).withColumn("n_features", sizes[F.col("feature")])
            .withColumnRenamed("feature", "family"))


def coef_table(model: Linear, train: DataFrame) -> DataFrame:
    """Coefficients minus their class mean, per training deviation of the filled column, and the mean absolute value."""
    coef = np.array(model.coef)
    coef = coef - coef.mean(axis=0, keepdims=True)
    sds = train.agg(*[F.stddev_pop(x).alias(str(i)) for i, x in enumerate(model.filled())]).first()
    rows = []
    for i, c in enumerate(model.cols):
        per = [float(coef[k, i] * sds[i]) for k in range(3)]
        rows.append((c, family(c), *per, float(np.mean(np.abs(per)))))
    return train.sparkSession.createDataFrame(rows, "feature string, family string, coef_away double, coef_draw double, coef_home double, "
                                                    "coefficient_mean_abs double")


def importance_stability(by_season: DataFrame, top: int = 15) -> DataFrame:
    rise, rank = F.col("permutation_logloss_mean"), F.col("rank")
    return by_season.groupBy("feature").agg(
        F.avg(rise).alias("mean_logloss_increase"), F.avg(rank.cast("double")).alias("mean_rank"), F.max(rank).alias("worst_rank"),
        F.count_if(rise > 0).alias("positive_seasons"), F.count_if(rank <= top).alias("top_seasons"))


def correlation_pairs(df: DataFrame, cols: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """Pairs of columns with |Pearson| >= threshold over rows where both are present.

    Each task turns its rows into five small cross-product matrices; these are
    summed per pair. Columns are centred first, so the sums stay well scaled.
    """
    cols = list(cols)
    means = single_row(df.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"m{i}") for i, c in enumerate(cols)]))
    x = df.select(*[(F.col(c).cast("double") - means[f"m{i}"]).alias(f"c{i}") for i, c in enumerate(cols)])
    k = len(cols)
    upper = np.triu_indices(k, 1)

    def cross(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, k, k))
        for frame in frames:
            a = frame.to_numpy(dtype=float)
            mask = ~np.isnan(a)
            a = np.where(mask, a, 0.0)
            m, sq = mask.astype(float), a * a
            total += np.stack([m.T @ m, a.T @ m, m.T @ a, sq.T @ m, m.T @ sq, a.T @ a])
        i, j = upper
        yield pd.DataFrame({"i": i, "j": j, **{f"t{q}": total[q][upper] for q in range(6)}})

    sums = x.mapInPandas(cross, "i int, j int, " + ", ".join(f"t{q} double" for q in range(6)))
    s = sums.groupBy("i", "j").agg(*[F.sum(f"t{q}").alias(f"t{q}") for q in range(6)])
    n, sx, sy, sxx, syy, sxy = (F.col(f"t{q}") for q in range(6))
    var = (n * sxx - sx * sx) * (n * syy - sy * sy)
    r = F.abs(n * sxy - sx * sy) / F.sqrt(F.when(var > 0, var))
    names = F.array(*[F.lit(c) for c in cols])
    return (s.select(F.element_at(names, F.col("i") + 1).alias("feature_a"), F.element_at(names, F.col("j") + 1).alias("feature_b"),
                     r.alias("absolute_correlation"))
            .where(F.col("absolute_correlation") >= threshold))


def _pooled(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    probs = preds.groupBy(*by).agg(F.avg(row_log_loss()).alias("log_loss"), F.avg(row_brier()).alias("brier"))
    return classification_metrics(preds, by, per_class=True).select(*by, "n_matches", "accuracy", "macro_f1", F.col("f1_1").alias("draw_f1")).join(probs, list(by))


def candidate_sets(cols: Sequence[str], ranked: Sequence[str], positive: Sequence[str], correlated: Sequence[tuple[str, str]] = (),
                   tops: Sequence[int] = (8, 16, 24, 32, 48, 60), drops: Sequence[int] = (5, 10, 20), windows: Sequence[int] = (5, 10)) -> dict[str, list[str]]:
    """Named column sets: all, every combination of families, the best and all but the worst by
    importance, those with a rise in loss, one window only, and one of each correlated pair.
    A set that several names stand for is listed once, under the first."""
    cols = list(cols)
    families = sorted({family(c) for c in cols})
    sets: dict[str, list[str]] = {f"all_{len(cols)}": cols}
    for size in range(1, len(families)):
        for some in combinations(families, size):
            sets["groups__" + "__".join(some)] = [c for c in cols if family(c) in some]
    for k in tops:
        sets[f"top_{k}"] = [c for c in cols if c in set(ranked[:k])]
    for k in drops:
        sets[f"drop_bottom_{k}"] = [c for c in cols if c in set(ranked[:-k])]
    sets["positive_permutation"] = [c for c in cols if c in set(positive)]
    for w in windows:
        sets[f"window_{w}_only"] = [c for c in cols if c.endswith(f"_{w}") or family(c) in ("h2h", "league")]
    twins: dict[str, set[str]] = {}
    for a, b in correlated:
        twins.setdefault(a, set()).add(b)
        twins.setdefault(b, set()).add(a)
    kept: list[str] = []
    for c in ranked:
        if not twins.get(c, set()) & set(kept):
            kept.append(c)
    sets["correlation_pruned"] = [c for c in cols if c in set(kept)]
    unique: dict[tuple, str] = {}
    for name, members in sets.items():
        if members:
            unique.setdefault(tuple(members), name)
    return {name: list(members) for members, name in unique.items()}


def _score_models(df: DataFrame, models: Sequence[tuple[tuple, Linear]], season: str, y: str) -> DataFrame:
    """One row per (config, c, n_features, fold, y, predicted) with counts and summed losses: a scan
    in which each row is scored by the models of its season, none of them by an expression."""
    cols = list(dict.fromkeys(c for _, m in models for c in m.cols))
    where = {c: i for i, c in enumerate(cols)}
    ready = [(key, np.array([where[c] for c in m.cols]), np.array(m.means), np.array(m.coef), np.array(m.intercept)) for key, m in models]
    names = ["config", "c", "n_features", "fold", "y", "predicted", "n", "log_loss", "brier"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            values = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
            if not batch.num_rows:
                continue
            when, label, raw = values[0], values[1].astype(int), np.column_stack(values[2:])
            for fold in np.unique(when):
                mine = when == fold
                y_, x_ = label[mine], raw[mine]
                rows = np.arange(len(y_))
                for key, index, means, coef, intercept in ready:
                    if key[3] != fold:
                        continue
                    x = x_[:, index]
                    z = np.where(np.isnan(x), means, x) @ coef.T + intercept
                    e = np.exp(z - z.max(1, keepdims=True))
                    p = e / e.sum(1, keepdims=True)
                    guess = p.argmax(1)
                    loss = -np.log(np.maximum(p[rows, y_], 1e-15))
                    gap = ((np.eye(3)[y_] - p) ** 2).mean(1)
                    cell = 3 * y_ + guess
                    for v in np.unique(cell):
                        at = cell == v
                        k = (*key, int(v) // 3, int(v) % 3)
                        total[k] = total.get(k, np.zeros(3)) + [at.sum(), loss[at].sum(), gap[at].sum()]
        if total:
            kinds = [pa.string(), pa.float64(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in total], t) for i, t in enumerate(kinds)],
                                              *[pa.array([float(v[i]) for v in total.values()]) for i in range(3)]], names=names)
    table = df.where(F.col(season).isin(sorted({key[3] for key, _ in models})) & F.col(y).isNotNull())
    rows = table.select(F.col(season).cast("double").alias("_season"), F.col(y).cast("double").alias("_y"), *[F.col(f"`{c}`").cast("double") for c in cols])
    cells = rows.mapInArrow(run, "config string, c double, n_features int, fold int, y int, predicted int, n double, log_loss double, brier double")
    return cells.groupBy(*names[:6]).agg(*[F.sum(v).alias(v) for v in names[6:]])


def _cell_metrics(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """The columns of _pooled() from counted cells of (y, predicted)."""
    def n(where):
        return F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0.0))
    t, p = F.col("y"), F.col("predicted")
    f1 = {}
    for k in range(3):
        both = n(t == k) + n(p == k)
        f1[k] = F.coalesce(2.0 * n((t == k) & (p == k)) / F.nullif(both, F.lit(0.0)), F.lit(0.0))
    every = F.sum("n")
    return cells.groupBy(*by).agg(every.cast("long").alias("n_matches"), (n(t == p) / every).alias("accuracy"), ((f1[0] + f1[1] + f1[2]) / 3.0).alias("macro_f1"),
                                  f1[1].alias("draw_f1"), (F.sum("log_loss") / every).alias("log_loss"), (F.sum("brier") / every).alias("brier"))


def validate_grid(df: DataFrame, candidates: Mapping[str, Sequence[str]], folds: Sequence[int], cs: Sequence[float] = (1.0,),
                  scaled: bool = False, model_name: str = "lr", season: str = "season", y: str = "y") -> DataFrame:
    """Every (candidate, C) fitted on every fold; pooled metrics and the worst season of each.

    All fits share the scans of one second-order fit, and one more scan scores them all. `df`
    should be a written table with the columns of every candidate.
    """
    for f in folds:
        check_fold(df.where(F.col(season) < f), df.where(F.col(season) == f), season)
    jobs = [(name, float(c), len(candidates[name]), int(f)) for name in candidates for c in cs for f in folds]
    found = fit_many(df, [lr_spec(name, candidates[name], c, scaled=scaled, until=f, label=y) for name, c, _, f in jobs], season)
    models = [(job, Linear(job[0], list(s.fit.cols), s.n, "softmax", s.means.tolist(), s.coef.tolist(), s.intercept.tolist())) for job, s in zip(jobs, found)]
    cells = materialize(_score_models(df, models, season, y))  # nine rows per model
    by = ["config", "c", "n_features"]
    per_fold = _cell_metrics(cells, [*by, "fold"])
    worst = per_fold.groupBy(*by).agg(F.min("accuracy").alias("min_season_accuracy"), F.max("log_loss").alias("max_season_log_loss"))
    return _cell_metrics(cells, by).join(worst, by).withColumn("model", F.lit(model_name))


def pick_winner(grid: DataFrame, objective: str = "logloss") -> DataFrame:
    """Best configuration: lowest log loss, then fewer columns, name, C; or highest accuracy, then log loss, columns."""
    if objective == "logloss":
        return grid.orderBy("log_loss", "n_features", "config", "c").limit(1)
    return grid.orderBy(F.col("accuracy").desc(), "log_loss", "n_features", "config", "c").limit(1)


def drop_family_ablation(df: DataFrame, cols: Sequence[str], season_value: int, families: Mapping[str, Sequence[str]] | None = None, **kw) -> DataFrame:
    """All columns, and all but one family, evaluated once on one season."""
    if families is None:
        families = {}
        for c in cols:
            families.setdefault(family(c), []).append(c)
    sets = {f"all_{len(cols)}": list(cols)}
    for name, members in families.items():
        rest = [c for c in cols if c not in members]
        if rest:
            sets[f"drop_{name}"] = rest
    return validate_grid(df, sets, [season_value], **kw)


def retention_table(features: DataFrame, selected: DataFrame) -> DataFrame:
    """feature, family, selected flag (0 = dropped)."""
    flags = selected.select("feature", F.lit(1).alias("selected")).dropDuplicates(["feature"])
    return (features.select("feature").withColumn("family", _family_column()).join(flags, "feature", "left").na.fill(0, subset=["selected"]))


def feature_set_comparison(df: DataFrame, sets: Mapping[str, Sequence[str]], fold: int, market: Sequence[str] | None = None,
                           season: str = "season", y: str = "y") -> DataFrame:
    """Metrics of several column sets, and of market probabilities, on one test season."""
    out = validate_grid(df, sets, [fold], season=season, y=y).select(F.col("config").alias("feature_set"), "n_matches", "accuracy", "macro_f1", "draw_f1", "log_loss", "brier")
    if not market:
        return out
    best = F.greatest(*market)
    test = df.where(F.col(season) == fold).select(F.lit("market").alias("feature_set"), y, *[F.col(m).alias(p) for m, p in zip(market, ("p_away", "p_draw", "p_home"))],
                                                  F.when(F.col(market[0]) == best, 0).when(F.col(market[1]) == best, 1).otherwise(2).alias("predicted"))
    return out.unionByName(_pooled(test, ["feature_set"]))
