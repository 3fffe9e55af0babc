"""Readers and writers for season files, feeds, players, odds, and file fingerprints."""

from __future__ import annotations

import codecs
import csv
import hashlib
import re
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import map_names
from .quality import season_from_source

# Source header -> canonical name (fixed values)
HEADER_NAMES = {
    "Div": "division", "Date": "date", "Time": "time",
    "HomeTeam": "home_team", "AwayTeam": "away_team",
    "FTHG": "home_goals_full", "FTAG": "away_goals_full", "FTR": "result_full",
    "HTHG": "home_goals_half", "HTAG": "away_goals_half", "HTR": "result_half",
    "Referee": "referee",
    "HS": "home_shots", "AS": "away_shots",
    "HST": "home_shots_target", "AST": "away_shots_target",
    "HF": "home_fouls", "AF": "away_fouls",
    "HC": "home_corners", "AC": "away_corners",
    "HY": "home_yellow", "AY": "away_yellow",
    "HR": "home_red", "AR": "away_red",
    "B365H": "odds_home", "B365D": "odds_draw", "B365A": "odds_away",
    "BWH": "odds_home_bw", "BWD": "odds_draw_bw", "BWA": "odds_away_bw",
    "PSH": "odds_home_ps", "PSD": "odds_draw_ps", "PSA": "odds_away_ps",
    "MaxH": "odds_home_max", "MaxD": "odds_draw_max", "MaxA": "odds_away_max",
    "AvgH": "odds_home_avg", "AvgD": "odds_draw_avg", "AvgA": "odds_away_avg",
    "B365CH": "odds_home_close", "B365CD": "odds_draw_close", "B365CA": "odds_away_close",
    "BWCH": "odds_home_bw_close", "BWCD": "odds_draw_bw_close", "BWCA": "odds_away_bw_close",
    "PSCH": "odds_home_ps_close", "PSCD": "odds_draw_ps_close", "PSCA": "odds_away_ps_close",
    "MaxCH": "odds_home_max_close", "MaxCD": "odds_draw_max_close", "MaxCA": "odds_away_max_close",
    "AvgCH": "odds_home_avg_close", "AvgCD": "odds_draw_avg_close", "AvgCA": "odds_away_avg_close",
    "B365>2.5": "over_2.5", "B365<2.5": "under_2.5",
    "Avg>2.5": "over_2.5_avg", "Avg<2.5": "under_2.5_avg",
    "B365C>2.5": "over_2.5_close", "B365C<2.5": "under_2.5_close",
    "AvgC>2.5": "over_2.5_avg_close", "AvgC<2.5": "under_2.5_avg_close",
    "AHh": "asian_handicap", "B365AHH": "ah_home", "B365AHA": "ah_away",
}
# Columns read as numbers (fixed values)
NUMERIC_COLUMNS = (
    "home_goals_full", "away_goals_full", "home_goals_half", "away_goals_half", "home_shots", "away_shots",
    "home_shots_target", "away_shots_target", "home_fouls", "away_fouls", "home_corners", "away_corners",
    "home_yellow", "away_yellow", "home_red", "away_red",
)


def read_match_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Season files with known headers renamed and all others dropped, as text.

    Files may differ in their columns and the order of these: one job takes the first line of
    every file, files are read by layout, and layouts are combined by name. A column that a
    layout lacks is null; of two columns with one header the first counts. Files without a line
    give no rows.
    """
    found = _layouts(spark, paths)
    if not found:
        return spark.createDataFrame([], "source_file string")
    return union_seasons([_read_layout(spark, header, files) for header, files in sorted(found.items())])


def _layouts(spark: SparkSession, paths: str | Sequence[str]) -> dict[str, list[str]]:
    """Files by header line (the list of files comes to the driver, as a file listing does)."""
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths)).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    # rows of a block come in order, so the lowest row number of the first block is the first line
    heads = lines.where("file_block_start = 0").groupBy("file_path").agg(F.min_by("value", "row").alias("header"))
    out: dict[str, list[str]] = {}
    for row in sorted(heads.collect()):
        out.setdefault(row.header.removeprefix("\ufeff").rstrip("\r"), []).append(unquote(row.file_path))
    return out


def _read_layout(spark: SparkSession, header: str, files: list[str]) -> DataFrame:
    names = [c.strip() for c in next(csv.reader([header]))]
    known = [c if c in HEADER_NAMES and names.index(c) == i else None for i, c in enumerate(names)]
    schema = T.StructType([T.StructField(c or f"_c{i}", T.StringType()) for i, c in enumerate(known)])
    raw = spark.read.schema(schema).csv(files, header=True)
    kept = [F.col(f"`{c}`").alias(HEADER_NAMES[c]) for c in known if c]
    return raw.select(*kept, F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"))


def parse_match_date(df: DataFrame, col: str = "date") -> DataFrame:
    """Day-first dates with two- or four-digit years; anything else becomes null."""
    text = F.trim(F.col(col))
    long = F.try_to_timestamp(text, F.lit("d/M/yyyy")).cast("date")
    short = F.try_to_timestamp(text, F.lit("d/M/yy")).cast("date")
    # two-digit years 69..99 belong to the last century (the POSIX rule)
    short = F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)
    return df.withColumn(col, F.when(F.length(F.substring_index(text, "/", -1)) > 2, long).otherwise(short))


def coerce_numeric(df: DataFrame, cols: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    present = {c for c in cols if c in df.columns}
    return df.select(*[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) if c in present else F.col(f"`{c}`")
                       for c in df.columns])


def union_seasons(dfs: Sequence[DataFrame], tags: Sequence[str] | None = None) -> DataFrame:
    """Stack tables with different columns, tagging each row with its source."""
    out = None
    for i, df in enumerate(dfs):
        tagged = df.withColumn("source", F.lit(tags[i])) if tags else df
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


FEED_SCHEMA = T.StructType([
    T.StructField("date_unix", T.LongType()), T.StructField("home_name", T.StringType()),
    T.StructField("away_name", T.StringType()), T.StructField("homeID", T.LongType()),
    T.StructField("awayID", T.LongType()), T.StructField("game_week", T.IntegerType()),
    T.StructField("homeGoalCount", T.IntegerType()), T.StructField("awayGoalCount", T.IntegerType()),
    T.StructField("pre_match_home_ppg", T.DoubleType()), T.StructField("pre_match_away_ppg", T.DoubleType()),
    T.StructField("team_a_xg_prematch", T.DoubleType()), T.StructField("team_b_xg_prematch", T.DoubleType()),
])


def _with_season(df: DataFrame, season_map: Mapping[str, str] | None, from_folder: bool = False) -> DataFrame:
    """Season label from the file name, or from the folder's (`id` or `key=id`), by a map of season
    id to label; files not listed are dropped.

    Without a map the columns stay as read (e.g. a season folder column).
    """
    if season_map is None:
        return df
    pairs = [F.lit(x) for kv in season_map.items() for x in kv]
    parts = F.split(F.input_file_name(), "/")
    file_id = F.regexp_extract(F.element_at(parts, -2), r"([^=]+)$", 1) if from_folder else F.regexp_extract(F.element_at(parts, -1), r"^([^.-]+)", 1)
    return df.withColumn("season", F.try_element_at(F.create_map(*pairs), file_id)).where(F.col("season").isNotNull())


def read_feed_json(spark: SparkSession, path: str | Sequence[str], season_map: Mapping[str, str] | None,
                   schema: T.StructType = FEED_SCHEMA, multi_line: bool = True, from_folder: bool = False) -> DataFrame:
    """JSON arrays of matches, files or folders per season; epoch seconds become a day."""
    raw = spark.read.schema(schema).json(path if isinstance(path, str) else list(path), multiLine=multi_line)
    return (_with_season(raw, season_map, from_folder)
            .withColumn("feed_date", F.to_date(F.timestamp_seconds("date_unix"))))


PLAYER_SCHEMA = T.StructType([
    T.StructField("player_id", T.LongType()), T.StructField("club_team_id", T.LongType()),
    T.StructField("position", T.StringType()), T.StructField("age", T.DoubleType()),
    T.StructField("minutes_played_overall", T.DoubleType()), T.StructField("goals_overall", T.IntegerType()),
    T.StructField("assists_overall", T.IntegerType()),
])


def read_players(spark: SparkSession, path: str | Sequence[str], fmt: str = "json", season_map: Mapping[str, str] | None = None,
                 schema: T.StructType = PLAYER_SCHEMA, multi_line: bool = True, from_folder: bool = False) -> DataFrame:
    """Player records. CSV text N/A, NA and empty are null; numbers are cast softly."""
    where = path if isinstance(path, str) else list(path)
    if fmt == "json":
        raw = spark.read.schema(schema).json(where, multiLine=multi_line)
    else:
        raw = spark.read.csv(where, header=True)
        casts = []
        for f in schema.fields:
            text = F.when(~F.trim(F.col(f"`{f.name}`")).isin("N/A", "NA", ""), F.col(f"`{f.name}`"))
            casts.append(text.try_cast(f.dataType).alias(f.name))
        raw = raw.select(*casts)
    return _with_season(raw, season_map, from_folder)


def parse_feed_time(col) -> Column:
    """'Aug 10 2018 - 7:00pm' -> timestamp, else null."""
    text = F.upper(F.trim(F.col(col) if isinstance(col, str) else col))
    # month names are matched in title case
    titled = F.concat(F.substring(text, 1, 1), F.lower(F.substring(text, 2, 2)), text.substr(F.lit(4), F.length(text)))
    return F.try_to_timestamp(titled, F.lit("MMM d yyyy - h:mma"))


def read_feed_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Feed matches: `N/A`, `NA` and empty fields are null; a column becomes numeric if all its
    other values are numbers (counted in one pass), text stays text. Where goals are given, class,
    total goals and over-2.5 follow; a comparison with a missing number is false."""
    raw = spark.read.csv(path if isinstance(path, str) else list(path), header=True)
    raw = raw.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin("N/A", "NA", ""), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    text = {"home_team_name", "away_team_name", "date_GMT"}
    odd = raw.agg(*[F.count(F.when(F.col(f"`{c}`").try_cast("double").isNull(), F.col(f"`{c}`"))).alias(c) for c in raw.columns]).first()
    cols = [F.col(f"`{c}`") if c in text or odd[c] else F.col(f"`{c}`").try_cast("double").alias(c) for c in raw.columns]
    out = raw.select(*cols).withColumn("kickoff", parse_feed_time("date_GMT")).withColumn("feed_date", F.to_date("kickoff"))
    home, away = "home_team_goal_count", "away_team_goal_count"
    if not {home, away} <= set(out.columns):
        return out
    h, a = F.col(home).try_cast("double"), F.col(away).try_cast("double")
    return (out.withColumn("target_result", F.when(h > a, 2).when(h == a, 1).otherwise(0)).withColumn("total_goal_count", h + a)
            .withColumn("target_over_2_5", F.coalesce((h + a > 2.5).cast("int"), F.lit(0))))


def read_closing_odds(spark: SparkSession, paths: str | Sequence[str], name_map: Mapping[str, str], season: Column | None = None) -> DataFrame:
    """Closing odds per fixture; unknown names stay, the earliest row of a fixture wins.

    The season is taken from the file name unless an expression is given.
    """
    raw = parse_match_date(read_match_csv(spark, paths).withColumn(
        "season", season if season is not None else season_from_source("source_file")))
    odds = [c for c in ("odds_home_close", "odds_draw_close", "odds_away_close") if c in raw.columns]
    named = map_names(raw, ["home_team", "away_team"], name_map, lenient=True, suffix="")
    named = coerce_numeric(named, odds)
    # one struct minimum per fixture: combined map-side, no sort of a fixture's rows
    first = F.min(F.struct("date", *odds)).alias("r")
    return named.groupBy("season", "home_team", "away_team").agg(first).select("season", "home_team", "away_team", "r.*")


PACKED = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"  # Spark's text reader would unpack these
HASHES = pa.schema([("key", pa.string()), ("sha256", pa.string()), ("sha256_lf", pa.string())])


class _Hashes:
    """Both digests of a file that arrives line by line. The reader drops a byte order mark at the
    start and doesn't tell whether the last line is ended: the file's size does."""

    def __init__(self, key: str, size: int) -> None:
        self.key, self.size, self.seen, self.last = key, size, 0, None
        self.kept = [(hashlib.sha256(mark), hashlib.sha256(mark)) for mark in (b"", codecs.BOM_UTF8)]

    def add(self, line: bytes) -> None:
        if self.last is not None:
            self._write(self.last, b"\n")
        self.last = line

    def _write(self, line: bytes, end: bytes) -> None:
        self.seen += len(line) + len(end)
        folded = line[:-1] if end and line.endswith(b"\r") else line
        for raw, lf in self.kept:
            raw.update(line + end)
            lf.update(folded + end)

    def row(self) -> tuple[str, str, str]:
        rest = self.size - self.seen - len(self.last)  # 0: no line end, 1: one; 3 more with a mark
        self._write(self.last, b"\n" if rest % 3 == 1 else b"")
        raw, lf = self.kept[rest >= 3]
        return self.key, raw.hexdigest(), lf.hexdigest()


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    for batch in batches:
        out = []
        for key, size, line in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now.key != key:
                if now is not None:
                    out.append(now.row())
                now = _Hashes(key, size)
            now.add(line)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], schema=HASHES)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in now.row()], schema=HASHES)


def fingerprint_files(spark: SparkSession, path: str | Sequence[str], manifest: DataFrame | None = None) -> DataFrame:
    """SHA-256 per file, as stored and with CRLF folded to LF, against a manifest (file or path, sha256).

    A digest is sequential, so the lines of a file stream through one task in order and no more
    than a batch is held; files are spread over the tasks. Packed files are hashed as one value
    each. Columns: path, file (its last part), length, sha256, sha256_lf.
    """
    where = path if isinstance(path, str) else list(path)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(where)
    # a file system without a host is written with one slash or three
    key = F.regexp_replace("_metadata.file_path", "^([^/]+):///", "$1:/")
    # a scan passes over files without content: the listing has them
    names = spark.createDataFrame([(re.sub("^([^/]+):///", r"\1:/", k), unquote(k)) for k in listed.inputFiles()], "key string, path string")
    every = names.join(listed.select(key.alias("key"), "length"), "key", "left").withColumn("length", F.coalesce("length", F.lit(0).cast("long")))
    # ISO-8859-1 maps every byte to one character and back
    latin = "ISO-8859-1"
    folded = F.encode(F.replace(F.decode("content", latin), F.lit("\r\n"), F.lit("\n")), latin)
    whole = listed.where(F.col("path").rlike(PACKED)).select(key.alias("key"), F.sha2("content", 256).alias("sha256"), F.sha2(folded, 256).alias("sha256_lf"))
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(where).select(
        key.alias("key"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    ordered = lines.where(~F.col("key").rlike(PACKED)).repartition("key").sortWithinPartitions("key", "start", "row").select("key", "size", "line")
    hashed = ordered.mapInArrow(_hash_lines, "key string, sha256 string, sha256_lf string").unionByName(whole)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    files = every.join(hashed, "key", "left").select("path", F.element_at(F.split("path", "/"), -1).alias("file"), "length",
                                                      *[F.coalesce(c, F.when(F.col("length") == 0, empty)).alias(c) for c in ("sha256", "sha256_lf")])
    if manifest is None:
        return files
    by = "path" if "path" in manifest.columns else "file"
    joined = manifest.select(by, F.col("sha256").alias("expected")).join(files, by, "left")
    status = (F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") == F.col("expected"), "same")
              .when(F.col("sha256_lf") == F.col("expected"), "line_endings_only").otherwise("changed"))
    return joined.withColumn("status", status)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Write to a new folder; an existing one is an error. csv.gz round-trips doubles exactly."""
    out = df.write.mode("errorifexists")
    if partition_by:
        out = out.partitionBy(*partition_by)
    if fmt == "parquet":
        out.parquet(path)
    elif fmt == "json":
        out.json(path)
    elif fmt in ("csv", "csv.gz"):
        # Java prints the shortest text that reads back to the same double
        out.csv(path, header=True, compression="gzip" if fmt == "csv.gz" else "none")
    else:
        raise ValueError(f"unknown format {fmt}")
