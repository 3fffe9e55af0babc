"""File readers, checks, text and streams."""

import datetime
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import MATCH_SCHEMA, random_matches
from matchframe.operators import history as C
from matchframe.operators import ratings as R
from matchframe.operators.text import keyword_in_context
from matchframe.sources import files as A
from matchframe.sources import quality as Q
from matchframe.streaming import streams as S


def test_season_file_names(spark):
    names = ["E01920.csv", "E12223.csv", "E32526.csv", "E12224.csv", "E42223.csv", "../E12223.csv", "PL2223.csv"]
    df = spark.createDataFrame([(n,) for n in names], "source_file string")
    got = [r.s for r in df.select(Q.season_from_source("source_file", strict=False).alias("s")).collect()]
    assert got == ["2019-20", "2022-23", "2025-26", None, None, None, None]
    with pytest.raises(Exception, match="Invalid source season"):
        df.select(Q.season_from_source("source_file")).collect()


def test_dates(spark):
    df = spark.createDataFrame([("05/08/2017",), ("05/08/17",), ("13/08/93",), ("2017-08-05",), ("31/02/2017",), (None,), ("",)], "date string")
    d = datetime.date
    assert [r.date for r in A.parse_match_date(df).collect()] == [d(2017, 8, 5), d(2017, 8, 5), d(1993, 8, 13), None, None, None, None]


def test_header_names_cover_the_layout():
    names = A.HEADER_NAMES
    assert len(names) == 65 and len(A.NUMERIC_COLUMNS) == 16
    assert names["PSCD"] == "odds_draw_ps_close" and names["AvgC<2.5"] == "under_2.5_avg_close" and names["B365H"] == "odds_home"


def test_csv_reader_and_union(spark, tmp_path):
    (tmp_path / "E02122.csv").write_text("Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,HS,Weather\nE0,14/08/2021,A,B,2,x,H,12,rain\n")
    (tmp_path / "E02223.csv").write_text("Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,B365>2.5\nE0,06/08/22,B,A,1,1,D,1.9\n")
    parts = [A.coerce_numeric(A.parse_match_date(A.read_match_csv(spark, str(tmp_path / f)))) for f in ("E02122.csv", "E02223.csv")]
    both = A.union_seasons(parts, ["a", "b"])
    rows = both.orderBy("date").collect()
    assert "Weather" not in both.columns and rows[0].away_goals_full is None and rows[0].home_shots == 12.0 and rows[1]["over_2.5"] == "1.9"
    assert [r.source for r in rows] == ["a", "b"] and rows[1].source_file == "E02223.csv"
    t = Q.add_targets(both).orderBy("date").collect()
    assert (t[0]["target_result"], t[0]["total_goals"], t[0]["target_over_2_5"], t[0]["home_win"]) == (2, None, 0, 0)
    assert Q.add_targets(both, null_as_zero=False).orderBy("date").first().home_win is None


def test_layouts_of_many_files_take_one_job(spark, tmp_path):
    """Jobs don't grow with the files (stages of one header scan, listings of many paths); layouts differ in columns, order, repeats, line ends and byte order marks."""
    heads = ["Div,Date,HomeTeam,AwayTeam,FTHG", "\ufeffFTHG,AwayTeam,HomeTeam,Date,Div,Extra", "Div,Date,HomeTeam,HomeTeam,AwayTeam,FTHG\r"]
    for k in range(300):
        row = ["E0,14/08/2021,A,B,2", "2,B,A,14/08/2021,E0,x", "E0,14/08/2021,A,Z,B,2\r"][k % 3]
        (tmp_path / f"E0 {k:04d}.csv").write_text(f"{heads[k % 3]}\n{row}\n")
    (tmp_path / "empty.csv").write_text("")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("layouts", "")
    try:
        df = A.read_match_csv(spark, str(tmp_path))
        assert len(tracker.getJobIdsForGroup("layouts")) <= 7
        rows = df.groupBy("division", "date", "home_team", "away_team", "home_goals_full").agg(F.count_distinct("source_file").alias("n")).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [tuple(r) for r in rows] == [("E0", "14/08/2021", "A", "B", "2", 300)]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty.csv").write_text("")
    assert A.read_match_csv(spark, str(tmp_path / "none")).count() == 0


def test_feed_times(spark):
    df = spark.createDataFrame([("Aug 10 2018 - 7:00pm",), ("Jan 1 2019 - 12:30am",), ("soon",)], "t string")
    got = [r.k for r in df.select(A.parse_feed_time("t").alias("k")).collect()]
    assert got == [datetime.datetime(2018, 8, 10, 19), datetime.datetime(2019, 1, 1, 0, 30), None]


def test_feed_json_array(spark, tmp_path):
    (tmp_path / "1625-x.json").write_text('[{"date_unix": 1533927600, "home_name": "A", "away_name": "B", "pre_match_home_ppg": 0}]')
    (tmp_path / "9999-x.json").write_text('[{"date_unix": 1533927600, "home_name": "C"}]')
    rows = A.read_feed_json(spark, str(tmp_path), {"1625": "2018-19"}).collect()
    assert [(r.season, r.home_name, r.feed_date) for r in rows] == [("2018-19", "A", datetime.date(2018, 8, 10))]


def test_fingerprints(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for name, text in (("same.csv", b"a\nb\n"), ("crlf.csv", b"a\r\nb\r\n"), ("changed.csv", "é\xff".encode("latin-1"))):
        (src / name).write_bytes(text)
    lf = hashlib.sha256(b"a\nb\n").hexdigest()
    manifest = spark.createDataFrame([("same.csv", lf), ("crlf.csv", lf), ("changed.csv", lf), ("gone.csv", lf)], "file string, sha256 string")
    got = {r.file: r.status for r in A.fingerprint_files(spark, str(src), manifest).collect()}
    assert got == {"same.csv": "same", "crlf.csv": "line_endings_only", "changed.csv": "changed", "gone.csv": "missing"}


def test_fingerprints_of_files_in_many_pieces(spark, tmp_path):
    """Files that several splits read, with and without a last line end, a byte order mark, lone
    carriage returns, no line at all, packed; the digests are those of the bytes."""
    import gzip
    rng = random.Random(7)
    big = b"".join(bytes(rng.choices(range(1, 256), k=60)).replace(b"\n", b"") + rng.choice([b"\n", b"\r\n", b"\r"]) for _ in range(8000))
    bodies = {"big.csv": big, "open.csv": b"a\r\nb", "cr.csv": b"a\r\n\r\nb\r", "mark.csv": b"\xef\xbb\xbfa\r\nb\n", "mark open.csv": b"\xef\xbb\xbfa\nb",
              "empty.csv": b"", "line.csv": b"\n", "packed.csv.gz": gzip.compress(b"a\r\nb\n")}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        got = {r.file: r for r in A.fingerprint_files(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got.keys() == bodies.keys()
    for name, body in bodies.items():
        assert got[name].length == len(body), name
        assert got[name].sha256 == hashlib.sha256(body).hexdigest(), name
        assert got[name].sha256_lf == hashlib.sha256(body.replace(b"\r\n", b"\n")).hexdigest(), name


@pytest.mark.parametrize("fmt", ["csv.gz", "parquet", "json"])
def test_sinks_round_trip_exactly_and_do_not_overwrite(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, 0.1 + 0.2), (2, 1 / 3), (3, 5e-324)], "id int, x double")
    path = str(tmp_path / "out")
    A.write_table(df, path, fmt)
    read = spark.read.schema("id int, x double")
    back = read.csv(path, header=True) if fmt == "csv.gz" else read.format(fmt).load(path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception, match="(?i)exists"):
        A.write_table(df, path, fmt)


def test_contract_and_reconcile(spark, small):
    bad = small.withColumn("y", F.when(F.col("match_id") == 4, (F.col("y") + 1) % 3).otherwise(F.col("y")))
    rules = {r.rule for r in Q.contract_checks(bad).collect()}
    assert "score_agrees" in rules and "once_a_day" in rules and "not_null" not in rules
    twice = small.limit(1)
    s = Q.reconcile_summary(Q.reconcile(small.unionByName(twice), small.where("match_id > 10"), ["match_id"], ["y"])).first()
    assert s.repeated_key + s.left_only >= 1 and s.same + s.mismatch + s.left_only + s.repeated_key == small.count()


def test_keyword_in_context(spark):
    text = "Data about dATa. " * 300 + "Aİ dataé end"
    docs = spark.createDataFrame([(1, text), (2, "nothing"), (3, "data"), (4, "a.b a+b A.B")], "doc_id long, text string")
    got = keyword_in_context(docs, "data").collect()
    hits = list(re.finditer("data", text, re.IGNORECASE))
    one = sorted((r for r in got if r.doc_id == 1), key=lambda r: r.hit)
    assert len(one) == 5 and all(r.n_hits == len(hits) for r in one)
    for r, m in zip(one, hits):
        assert r.context == text[max(0, m.start() - 1200):m.end() + 2200] and r.start == m.start()
    assert [r.n_hits for r in got if r.doc_id == 3] == [1]
    assert sorted(r.start for r in keyword_in_context(docs, "a.b").collect()) == [0, 8]


# ---------------------------------------------------------------- streams

def _feed(spark, df, base, cuts):
    """One file per date range, in order."""
    for lo, hi in cuts:
        df.where((F.col("match_date") >= lo) & (F.col("match_date") < hi)).coalesce(1).write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")


CUTS = (("2020-01-01", "2020-03-01"), ("2020-03-01", "2020-06-01"), ("2020-06-01", "2022-01-01"))


@pytest.mark.parametrize("hot", [False, True])
def test_stream_form_equals_batch(spark, tmp_path, hot):
    """Also with one team in most rows of every file and days that go on in the next file."""
    df = spark.createDataFrame(random_matches(120, days=20, seed=4, hot=hot), MATCH_SCHEMA)
    rows = C.to_team_rows(df).select("team", "match_id", "match_date", "points", "gf", "ga")
    middle = rows.where("match_date >= '2020-03-01' AND match_date < '2020-06-01'")
    for part in (rows.where("match_date < '2020-03-01'"), middle.where("match_id % 2 = 0 AND match_date <= '2020-03-04'"), middle.where("NOT (match_id % 2 = 0 AND match_date <= '2020-03-04')"),
                 rows.where("match_date >= '2020-06-01'")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    S.run_stream_form(stream, f"{tmp_path}/out", f"{tmp_path}/cp", n=5)
    got = {(r.team, r.match_id): r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = {(r.team, r.match_date): r for r in C.prior_day_form(C.to_team_rows(df), (5,)).collect()}
    assert len(got) == 240
    for (team, _), r in got.items():
        b = batch[(team, r.match_date)]
        assert r.avg_gf == (pytest.approx(b.goals_for_5) if b.goals_for_5 is not None else None)
        assert r.win_rate == (pytest.approx(b.win_rate_5) if b.win_rate_5 is not None else None)
        assert (r.n_prior == 0) == (b.goals_for_5 is None) and r.n_prior <= 5
    tail = spark.read.parquet(f"{tmp_path}/cp-tails/3").groupBy("team").count().agg(F.max("count").alias("n")).first()
    assert tail.n <= 10


def test_seasons_land_in_many_files_and_one_trigger_each(spark, tmp_path):
    """No season goes through one task, and each trigger takes all files of its season."""
    from matchframe.catalog import model_queries as Q
    df = spark.createDataFrame(random_matches(120, days=20, seed=4), MATCH_SCHEMA)
    rows = C.to_team_rows(df).select("team", "match_id", "match_date", "points", "gf", "ga").withColumn("season", F.month("match_date")).repartition(4).cache()
    before, months = 0, 0
    for _ in Q._land_seasons(rows, f"{tmp_path}/in"):
        S.run_stream_form(Q._stream(rows, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", n=5)
        files = len(list((tmp_path / "in").glob("*.parquet")))
        assert files - before > 1
        before, months = files, months + 1
    out = spark.read.parquet(f"{tmp_path}/out")
    assert months > 3 and out.select("batch").distinct().count() == months
    batch = {(r.team, r.match_date): r.goals_for_5 for r in C.prior_day_form(C.to_team_rows(df), (5,)).collect()}
    got = out.collect()
    assert len(got) == 240
    for r in got:
        assert r.avg_gf == (pytest.approx(batch[r.team, r.match_date]) if batch[r.team, r.match_date] is not None else None)
    # what a batch keeps of itself are day tails
    kept = spark.read.parquet(f"{tmp_path}/cp-days/0").groupBy("team", "match_date").count()
    assert kept.agg(F.max("count")).first()[0] <= 5


def test_stream_form_rejects_late_rows(spark, tmp_path):
    df = spark.createDataFrame(random_matches(60, days=20, seed=4), MATCH_SCHEMA)
    rows = C.to_team_rows(df).select("team", "match_id", "match_date", "points", "gf", "ga")
    with pytest.raises(Exception, match="late row"):
        S.run_stream_form(_feed(spark, rows, tmp_path, CUTS[::-1]), f"{tmp_path}/out", f"{tmp_path}/cp")


def test_stream_rating_equals_batch_and_rejects_late_rows(spark, tmp_path):
    df = spark.createDataFrame(random_matches(80, days=20, seed=4), MATCH_SCHEMA)
    S.run_available(S.stream_rating(_feed(spark, df, tmp_path / "a", CUTS)), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {r.match_id: r.p_home for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = {r.match_id: r.p_home for r in R.pi_rating(df).collect()}
    assert got.keys() == batch.keys() and all(got[k] == pytest.approx(batch[k], abs=1e-12) for k in got)
    late = S.stream_rating(_feed(spark, df, tmp_path / "b", CUTS[::-1]))
    with pytest.raises(Exception, match="late match"):
        S.run_available(late, f"{tmp_path}/out2", f"{tmp_path}/cp2")


def test_mixed_layouts_dates_and_text(spark, tmp_path):
    from matchframe.functions.scalars import market_probs
    from matchframe.sources import files
    (tmp_path / "E01415.csv").write_text("Div,Date,HomeTeam,AwayTeam,FTHG,FTAG\nE0,1/8/2015,A,B,2,1\n")
    (tmp_path / "E01516.csv").write_text("Div,Date,Time,HomeTeam,AwayTeam,FTAG,FTHG\nE0,12/8/15,15:00,C,D,0,3\n")
    (tmp_path / "E09900.csv").write_text("Date,Div,AwayTeam,HomeTeam\n02/09/99,E0,F,E\n")
    got = files.parse_match_date(files.read_match_csv(spark, str(tmp_path))).orderBy("date").collect()
    assert [(str(r.date), r.home_team, r.away_team, r.home_goals_full, r.time) for r in got] == [
        ("1999-09-02", "E", "F", None, None), ("2015-08-01", "A", "B", "2", None), ("2015-08-12", "C", "D", "3", "15:00")]
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "f.csv").write_text("home_team_name,away_team_name,date_GMT,status,goals\nA,B,Aug 01 2015 - 3:00pm,complete,2\nC,D,Aug 02 2015 - 3:00pm,NA,N/A\n")
    feed = files.read_feed_csv(spark, str(tmp_path / "feed")).orderBy("home_team_name").collect()
    assert [(r.status, r.goals) for r in feed] == [("complete", 2.0), (None, None)]
    odds = spark.createDataFrame([(None, 3.0, 2.0)], "odds_home double, odds_draw double, odds_away double")
    assert market_probs(odds, on_invalid="floor").first().q_home is None
