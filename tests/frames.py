"""A contest small enough to count by hand: home runs 10 plays, away 9 for 36 yards."""

from __future__ import annotations

SCHEMA = (
    "season int, week int, game_id string, home_team string, away_team string, posteam string, defteam string, play_type string, "
    "epa double, success int, down int, yards_gained double, interception int, fumble_lost int, wp double, third_down_converted int, "
    "third_down_failed int, return_yards double, return_team string, fumble_recovery_1_team string, fumble_recovery_1_yards double, "
    "fumble_recovery_2_team string, fumble_recovery_2_yards double, td_team string, touchdown double, play_id double"
)
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def play(n, side="HOM", **change):
    other = "AWY" if side == "HOM" else "HOM"
    row = dict.fromkeys(NAMES)
    row |= dict(season=2016, week=1, game_id="2016_01_AWY_HOM", home_team="HOM", away_team="AWY", posteam=side, defteam=other,
                play_type="pass", epa=0.1, success=1, down=1, yards_gained=5.0, interception=0, fumble_lost=0, wp=0.5,
                third_down_converted=0, third_down_failed=0, return_yards=0.0, touchdown=0.0, play_id=float(n))
    return row | change


def base(home_successes=6, ladder=False):
    home = [play(i, success=1 if i < home_successes else 0, yards_gained=5.0 + i if ladder else 5.0) for i in range(10)]
    away = [play(100 + i, "AWY", yards_gained=4.0) for i in range(9)]
    return home + away


def pick(n, yards=30.0, epa=-4.0, **change):
    return play(n, "AWY", interception=1, return_yards=yards, epa=epa, success=0, yards_gained=0.0, **change)


def fumble(n, yards=5.0, epa=-2.0, **change):
    return play(n, "AWY", fumble_lost=1, fumble_recovery_1_team="HOM", fumble_recovery_1_yards=yards, epa=epa, success=0,
                yards_gained=0.0, **change)


def plays(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], SCHEMA)


def scores(spark):
    return spark.createDataFrame([("2016_01_AWY_HOM", 2016, 1, "HOM", "AWY", 24, 17)],
                                 "game_id string, season int, week int, home string, away string, home_score int, away_score int")
