import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from matchframe.plans.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("wh"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


MATCH_SCHEMA = ("match_id long, match_date date, season int, division string, league_level int, home_team string, away_team string, "
                "home_goals int, away_goals int, y int, home_shots double, away_shots double, home_sot double, away_sot double, "
                "odds_home double, odds_draw double, odds_away double")


def random_matches(n=240, teams=6, days=40, seed=1, hot=False):
    """Plain-Python match rows with same-day ties; hot=True gives one team and one day a third of all rows."""
    import datetime
    import random
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        day = 7 if hot and rng.random() < 0.34 else rng.randrange(days)
        date = datetime.date(2020, 1, 1) + datetime.timedelta(days=day * 9)
        h = "T0" if hot and rng.random() < 0.5 else f"T{rng.randrange(teams)}"
        a = rng.choice([f"T{k}" for k in range(teams) if f"T{k}" != h])
        hg, ag = rng.randrange(5), rng.randrange(4)
        shots = [float(rng.randrange(15)) if rng.random() > 0.1 else None for _ in range(4)]
        season = date.year if date.month >= 8 else date.year - 1
        rows.append((i * 3 + 1, date, season, f"E{rng.randrange(2)}", 1, h, a, hg, ag, 2 if hg > ag else 1 if hg == ag else 0, *shots,
                     1.5 + rng.random(), 3.0, 2.0 + rng.random()))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def match_rows():
    return random_matches()


@pytest.fixture(scope="session")
def small(spark, match_rows):
    return spark.createDataFrame(match_rows, MATCH_SCHEMA).cache()
