"""Head-to-head tables derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEAMS = 40
MODELS = (("m1", 31, 17, 13), ("m2", 29, 23, 11))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _count_if(cond, value=1):
    return F.sum(F.when(cond, value).otherwise(0))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: two teams, goals from the return flags, shots from quantities."""
    late = F.col("l_linestatus") == "O"
    early = F.col("l_linestatus") == "F"
    sharp = F.col("l_discount") > 0.05
    lines = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        _count_if(F.col("l_returnflag") == "R").alias("hg"),
        _count_if(F.col("l_returnflag") == "A").alias("ag"),
        _count_if(late, F.col("l_quantity")).alias("hs"),
        _count_if(early, F.col("l_quantity")).alias("aws"),
        _count_if(late & sharp, F.col("l_quantity")).alias("hst"),
        _count_if(early & sharp, F.col("l_quantity")).alias("awst")))
    key = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    home = F.col("o_custkey") % TEAMS
    hg, ag = F.coalesce("hg", F.lit(0)), F.coalesce("ag", F.lit(0))

    def odds(base, step, span):
        return (F.lit(base) + (key * step) % span).cast("double") / 100

    return (table(spark, sf_dir, "orders").join(lines, key == F.col("l_orderkey"), "left").select(
        key.alias("match_id"),
        day.alias("match_date"),
        (F.year(day) - F.when(F.month(day) >= 8, 0).otherwise(1)).alias("season"),
        F.concat(F.lit("E"), (key % 4).cast("string")).alias("division"),
        (key % 4).cast("int").alias("league_level"),
        home.cast("int").alias("home_team"),
        ((home + 1 + key % (TEAMS - 1)) % TEAMS).cast("int").alias("away_team"),
        hg.cast("int").alias("home_goals"),
        ag.cast("int").alias("away_goals"),
        F.when(hg > ag, 2).when(hg == ag, 1).otherwise(0).alias("y"),
        F.col("hs").alias("home_shots"), F.col("aws").alias("away_shots"),
        F.col("hst").alias("home_sot"), F.col("awst").alias("away_sot"),
        F.when(key % 50 != 0, odds(120, 37, 400)).alias("odds_home"),
        odds(280, 53, 200).alias("odds_draw"),
        odds(130, 71, 500).alias("odds_away")))


def preds(m: DataFrame) -> DataFrame:
    """Two probability models per match, long form."""
    key = F.col("match_id")
    models = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"))
                       for n, a, b, c in MODELS])
    long = m.select("match_id", "season", "division", "match_date", "y", F.explode(models).alias("t"))
    a, b, c = (key * F.col("t.a")) % 89, (key * F.col("t.b")) % 53, (key * F.col("t.c")) % 97
    total = 3 + a + b + c
    return long.select("match_id", "season", "division", "match_date", "y", F.col("t.model").alias("model"),
                       ((1 + a).cast("double") / total).alias("p_away"),
                       ((1 + b).cast("double") / total).alias("p_draw"),
                       ((1 + c).cast("double") / total).alias("p_home"))


def club_name(team) -> "F.Column":
    return F.concat(F.lit("Club "), F.lpad(F.col(team).cast("string"), 2, "0"))


def feed(m: DataFrame) -> DataFrame:
    """Enrichment rows for four of five matches, under other team names."""
    def extra(step, span):
        return ((F.col("match_id") * step) % span).cast("double") / 100
    return m.where(F.col("match_id") % 5 != 0).select(
        F.col("match_date").alias("feed_date"), F.col("season").alias("feed_season"),
        club_name("home_team").alias("home_name"), club_name("away_team").alias("away_name"),
        extra(7, 300).alias("home_ppg"), extra(11, 300).alias("away_ppg"),
        extra(3, 250).alias("home_xg"), extra(19, 250).alias("away_xg"))


def name_map(spark: SparkSession) -> DataFrame:
    """team -> feed name for all teams but the last."""
    return spark.range(TEAMS - 1).select(F.col("id").cast("int").alias("team")).withColumn("name", club_name("team"))


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    segment = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        key.alias("player_id"),
        (F.lit(1995) + key % 6).cast("int").alias("season"),
        F.col("c_nationkey").cast("int").alias("club_id"),
        F.when(segment == "HOUSEHOLD", "Goalkeeper").when(segment == "BUILDING", "Defender")
         .when(segment.isin("MACHINERY", "FURNITURE"), "Midfielder").otherwise("Forward").alias("position"),
        F.when(key % 41 != 0, (17 + key % 20).cast("double")).alias("age"),
        F.when(F.col("c_acctbal") < 0, 0.0).otherwise(F.col("c_acctbal") / 3).alias("minutes"),
        ((key * 7) % 12).cast("int").alias("goals"), ((key * 5) % 9).cast("int").alias("assists"))
