"""Online forms of the history, rating and accuracy operators.

Order defines the result of the two stateful jobs, so their input must arrive in
date order (each trigger's files none older than the last one's); a row older than its key's last day is an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.kernels import KERNELS
from ..plans.blocks import day_tails, null_safe_join, prior_day_state

FORM_FIELDS = ("points", "gf", "ga")


def run_stream_form(stream: DataFrame, path: str, checkpoint: str, team_col: str = "team", n: int = 10) -> None:
    """Means over the team's last n rows of earlier days, written to `path` before the rows are learned.

    Each trigger's rows go through the batch form's day tails, so a team that fills a batch is spread
    like any other, and the tails meet the table of what the teams had before (a team's rows of its
    last day and the n rows before that day, at most n each). A batch is read twice, for its tails and
    for its output; tails and state are small and written beside the checkpoint like the table, so that
    their size is known where they are joined. A repeated batch starts from the same table and replaces
    its own output. A row older than its team's last day is an error.
    """
    keys, rows_of = ["team"], ["team", "match_id", "match_date", *FORM_FIELDS]
    means = {"n_prior": (n, F.count(F.lit(1))), "avg_points": (n, F.avg("points")), "avg_gf": (n, F.avg("gf")), "avg_ga": (n, F.avg("ga")),
             "win_rate": (n, F.avg((F.col("points") == 3).cast("double")))}

    def keep(df: DataFrame, folder: str) -> DataFrame:
        df.write.mode("overwrite").parquet(folder)
        return df.sparkSession.read.schema(df.schema).parquet(folder)

    def learn(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # at most n rows per team and day, and one for every team and day of the batch
        own = every = keep(day_tails(batch, keys, "match_date", "match_id", n).select(*rows_of), f"{checkpoint}-days/{batch_id}")
        if batch_id:
            known = spark.read.parquet(f"{checkpoint}-tails/{batch_id - 1}")
            last = known.groupBy("team").agg(F.max("match_date").alias("_last"))
            late = null_safe_join(own, last, keys).where(F.col("match_date") < F.col("_last")).select("team", "match_date").head()
            if late:
                raise ValueError(f"late row for team {late.team}: {late.match_date}")
            every = known.unionByName(own)
        tails = day_tails(every, keys, "match_date", "match_id", n)
        state = prior_day_state(tails, keys, "match_date", "match_id", means).withColumn("n_prior", F.col("n_prior").cast("int"))
        state = keep(state, f"{checkpoint}-before/{batch_id}")
        null_safe_join(batch.select("team", "match_id", "match_date"), state, [*keys, "match_date"]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        ends = null_safe_join(tails, tails.groupBy("team").agg(F.max("match_date").alias("_last")), keys)
        latest = Window.partitionBy("team").orderBy(F.col("match_date").desc(), F.col("match_id").desc())
        before = ends.where(F.col("match_date") < F.col("_last")).withColumn("_r", F.row_number().over(latest)).where(F.col("_r") <= n)
        kept = ends.where(F.col("match_date") == F.col("_last")).select(*rows_of).unionByName(before.select(*rows_of))
        kept.write.mode("overwrite").parquet(f"{checkpoint}-tails/{batch_id}")

    rows = stream.select(F.col(team_col).cast("string").alias("team"), F.col("match_id").cast("long").alias("match_id"), "match_date",
                         *[F.col(c).cast("double").alias(c) for c in FORM_FIELDS])
    query = rows.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_rating(stream: DataFrame, league_col: str = "division", params: Mapping | None = None, kind: str = "pi") -> DataFrame:
    """Predict, then learn, match by match; state per league is one small record per team."""
    out_schema = "match_id long, match_date date, league string, y int, p_away double, p_draw double, p_home double"
    state_schema = "teams array<string>, flat array<double>, last_day int"
    spec = dict(params or {})

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kernel = KERNELS[kind](spec)
        width = len(kernel.new_team())
        teams, last_day = {}, -1
        if state.exists:
            names, flat, last_day = state.get
            teams = {t: list(flat[i * width:(i + 1) * width]) for i, t in enumerate(names)}
        rows = pd.concat(list(frames)).sort_values(["match_date", "match_id"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            day = pd.Timestamp(r.match_date).toordinal()
            if day < last_day:
                raise ValueError(f"late match in league {key[0]}: {r.match_date}")
            last_day = day
            for t in (r.home_team, r.away_team):
                if t not in teams:
                    teams[t] = kernel.new_team()
            vals = kernel.step(teams[r.home_team], teams[r.away_team], r.home_goals, r.away_goals, True)
            y = 2 if r.home_goals > r.away_goals else 1 if r.home_goals == r.away_goals else 0
            out.append((r.match_id, r.match_date, key[0], y, *vals[:3]))
        state.update((list(teams), [x for v in teams.values() for x in v], last_day))
        yield pd.DataFrame(out, columns=["match_id", "match_date", "league", "y", "p_away", "p_draw", "p_home"])

    rows = stream.select(F.col(league_col).cast("string").alias("league"), "match_id", "match_date",
                         F.col("home_team").cast("string").alias("home_team"), F.col("away_team").cast("string").alias("away_team"),
                         F.col("home_goals").cast("double").alias("home_goals"), F.col("away_goals").cast("double").alias("away_goals"))
    return rows.groupBy("league").applyInPandasWithState(update, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def stream_hit_rate(stream: DataFrame, time_col: str = "ts", hit: str = "hit", span: str = "30 days", slide: str = "1 day",
                    lateness: str = "2 days", by: tuple[str, ...] = ()) -> DataFrame:
    """Hit rate per sliding window; rows later than the watermark allows are dropped."""
    return (stream.withWatermark(time_col, lateness)
            .groupBy(F.window(time_col, span, slide).alias("w"), *by)
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(hit).cast("long")).alias("hits"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "hits",
                    (F.col("hits") / F.col("n")).alias("hit_rate")))


def closing_row(rows: DataFrame, time_col: str = "ts", span: str = "30 days", lateness: str = "2 days", slide: str = "1 day") -> DataFrame:
    """A row so late that the watermark passes every window of the rows, for a stream that has
    ended; its own windows hold none of them and stay open. All other columns are null."""
    after = F.max(time_col) + F.expr(f"INTERVAL {span} + INTERVAL {lateness} + INTERVAL {slide}")
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name != time_col]
    return rows.agg(after.alias(time_col)).where(F.col(time_col).isNotNull()).select(time_col, *others)


def run_available(stream_df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there, one trigger per file, into parquet, and stop."""
    query = (stream_df.writeStream.outputMode(mode).format("parquet").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
