"""Validation and guards as report frames. Each is one pass plus per-contest counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry import constants as C

REPORT = "dataset string, season int, n_rows long, n_games long, errors array<string>, warnings array<string>"


def expected_games(season: str | Column = "season") -> Column:
    """256 then 272 from 2021, plus 11 then 13 from 2020, one fewer in 2022."""
    s = F.col(season) if isinstance(season, str) else season
    return (
        F.when(s < 2021, 256).otherwise(272) + F.when(s < 2020, 11).otherwise(13)
        - F.when(s == 2022, 1).otherwise(0))


def _messages(*pairs: tuple[Column, Column]) -> Column:
    """Messages whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), m) for c, m in pairs]))


def _fmt(pattern: str, *cols: Column) -> Column:
    return F.format_string(pattern, *cols)


def _stopped(df: DataFrame, dataset: str, season: int, missing: list[str]) -> DataFrame:
    message = f"missing required columns: {', '.join(missing)}"
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(dataset).alias("dataset"), F.lit(season).alias("season"), "n_rows", F.lit(0).cast("long").alias("n_games"),
        F.array(F.lit(message)).alias("errors"), F.array().cast("array<string>").alias("warnings"))




def validate_plays(df: DataFrame, season: int, partial: bool = False, expected: int | None = None) -> DataFrame:
    """One report row. ``partial`` turns shortfalls, and only those, into warnings."""
    missing = [c for c in C.PLAY_REQUIRED if c not in df.columns]
    if missing:
        return _stopped(df, "pbp", season, missing)
    return _plays_report(df, F.lit(season), [], partial, expected)


def validate_all(df: DataFrame, season_on_file: str, partial: bool = False, expected: DataFrame | None = None) -> DataFrame:
    """One report row for each season on file, from one grouped pass; ``season_on_file`` names
    the column that says under which season a row is stored. ``expected`` has that column and
    ``want``, the season's contests (none: no limit); without it, the rule for full seasons holds."""
    missing = [c for c in C.PLAY_REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return _plays_report(df, F.col(season_on_file), [season_on_file], partial, expected)


def _plays_report(df: DataFrame, season: Column, by: list[str], partial: bool, expected: int | DataFrame | None) -> DataFrame:
    real = F.col("play_type").isin(*C.SCORING_PLAY_TYPES)
    fg = F.col("play_type") == "field_goal"
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    # per contest first: a partial aggregate, so a heavy contest is combined map-side
    per_game = df.groupBy(*by, "game_id").agg(
        F.count(F.lit(1)).alias("n_plays"), count(F.col("season") != season).alias("wrong"),
        count(real).alias("real"), count(real & F.col("epa").isNull()).alias("no_epa"),
        count(real & F.col("posteam").isNull()).alias("no_side"), count(F.col("fumble") == 1).alias("fumbles"),
        count(F.col("spread_line").isNull()).alias("no_spread"), count(fg).alias("fgs"),
        count(fg & F.col("kick_distance").isNull()).alias("no_dist"))
    sums = ["n_plays", "wrong", "real", "no_epa", "no_side", "fumbles", "no_spread", "fgs", "no_dist"]
    short, long = F.col("n_plays") < C.MIN_PLAYS_PER_GAME, F.col("n_plays") > C.MAX_PLAYS_PER_GAME
    worst = F.struct("n_plays", "game_id")
    total = per_game.groupBy(*by).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], F.count(F.lit(1)).alias("n_games"),
        F.count_if(short).alias("short"), F.count_if(long).alias("long"),
        F.min(F.when(short, worst)).alias("shortest"), F.max(F.when(long, worst)).alias("longest"))
    if isinstance(expected, DataFrame):
        total = total.join(expected.select(*by, "want"), by, "left")
    else:
        total = total.withColumn("want", expected_games(season) if expected is None else F.lit(expected))
    n, rows = F.col("n_games"), F.col("n_plays")
    less = n < F.col("want")
    off = (n != F.col("want"))
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.col("real").cast("double")) > 0.01
    empty = rows == 0
    short_text = _fmt(f"too short: %d contests under {C.MIN_PLAYS_PER_GAME} plays (the least is %s, %d)", F.col("short"),
                      F.col("shortest.game_id"), F.col("shortest.n_plays"))
    live = F.lit(partial)
    some = ~empty
    errors = _messages(
        (empty, F.lit("zero rows returned")),
        (some & (F.col("wrong") > 0), _fmt("season other than %d on %d of %d rows", season, F.col("wrong"), rows)),
        (some & off & ~(live & less), _fmt("%d games, expected %d", n, F.col("want"))),
        (some & (F.col("short") > 0) & ~live, short_text),
        (some & (F.col("long") > 0), _fmt(f"too long: %d contests over {C.MAX_PLAYS_PER_GAME} plays (the most is %s, %d)",
                                          F.col("long"), F.col("longest.game_id"), F.col("longest.n_plays"))),
        (some & (F.col("real") == 0), F.lit("not one row is a scored kind of play")),
        (some & share("no_epa"), _fmt("epa null: %d of the %d scored plays", F.col("no_epa"), F.col("real"))),
        (some & share("no_side"), _fmt("posteam null: %d of the %d scored plays", F.col("no_side"), F.col("real"))))
    warnings = _messages(
        (some & live & less, _fmt("season so far: %d games, a full one has %d", n, F.col("want"))),
        (some & live & (F.col("short") > 0), short_text),
        (some & (F.col("fumbles") == 0), F.lit("no fumbles in any row, which no season has: look at the fumble columns")),
        (some & (F.try_divide(F.col("no_spread").cast("double"), rows.cast("double")) > 0.02),
         _fmt("spread_line missing: %d of %d rows", F.col("no_spread"), rows)),
        (some & (F.col("no_dist") > 0), _fmt("kick_distance missing: %d of %d field goals tried", F.col("no_dist"), F.col("fgs"))))
    return total.select(F.lit("pbp").alias("dataset"), season.cast("int").alias("season"), rows.alias("n_rows"), n.alias("n_games"),
                        errors.alias("errors"), warnings.alias("warnings"))


def worst_games(df: DataFrame, longest: bool = False, limit: int = 3) -> DataFrame:
    """The shortest (or longest) contests outside the sanity band."""
    per = df.groupBy("game_id").agg(F.count(F.lit(1)).alias("n_plays"))
    if longest:
        return per.filter(F.col("n_plays") > C.MAX_PLAYS_PER_GAME).orderBy(F.desc("n_plays"), "game_id").limit(limit)
    return per.filter(F.col("n_plays") < C.MIN_PLAYS_PER_GAME).orderBy("n_plays", "game_id").limit(limit)


def validate_charting(df: DataFrame, season: int, expected: int | None = None) -> DataFrame:
    missing = [c for c in C.CHARTING_REQUIRED if c not in df.columns]
    if missing:
        return _stopped(df, "ftn", season, missing)
    return _charting_report(df, F.lit(season), [], F.lit(expected) if expected is not None else None)


def validate_all_charting(df: DataFrame, season_on_file: str, expected: Column | None = None) -> DataFrame:
    """One report row for each season on file, from one grouped pass; ``expected`` may be an
    expression over the season's ``n_games``."""
    missing = [c for c in C.CHARTING_REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return _charting_report(df, F.col(season_on_file), [season_on_file], expected)


def _charting_report(df: DataFrame, season: Column, by: list[str], expected: Column | None) -> DataFrame:
    keys = df.groupBy(*by, "nflverse_game_id", "nflverse_play_id").agg(F.count(F.lit(1)).alias("c"))
    per = keys.groupBy(*by, "nflverse_game_id").agg(F.sum("c").alias("rows"), F.count_if(F.col("c") > 1).alias("dup"))
    total = per.groupBy(*by).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_games"),
                    F.coalesce(F.sum("dup"), F.lit(0)).alias("dup"))
    total = total.withColumn("want", expected if expected is not None else expected_games(season))
    n, want, some = F.col("n_games"), F.col("want"), F.col("n_rows") > 0
    few = n < want * F.lit(0.95)
    errors = _messages(
        (~some, F.lit("zero rows returned")),
        (some & (n > want), _fmt("charted games exceed played games: %d against %d", n, want)),
        (some & few, _fmt("charting covers too little: %d of about %d games", n, want)),
        (some & (F.col("dup") > 0), _fmt("duplicate keys: %d plays are charted more than once", F.col("dup"))))
    warnings = _messages((some & (n < want) & ~few, _fmt("charting is short: %d of %d games", n, want)))
    return total.select(F.lit("ftn").alias("dataset"), season.cast("int").alias("season"), "n_rows", "n_games",
                        errors.alias("errors"), warnings.alias("warnings"))


def weights_report(weights: DataFrame) -> DataFrame:
    """Each pinned field of the weights artifact, whether it holds at three decimals."""
    d = C.PIN_DECIMALS
    fields = {
        "columns": F.col("columns") == F.array(*[F.lit(c) for c in C.WEIGHT_COLUMNS]),
        **{name: F.round(F.get("mean", F.lit(i)), d) == F.lit(C.WEIGHTS_PIN[i]) for i, name in enumerate(C.WEIGHT_COLUMNS)},
        "margin_sd": F.round("margin_sd", d) == F.lit(C.MARGIN_SD_PIN),
        "sigma_once": F.col("sigma_once") == F.lit(C.SIGMA_OF_RECORD),
        "n_draws": F.col("n_draws") == C.DRAWS_OF_RECORD,
        "seed": F.col("seed") == C.SEED_OF_RECORD,
        "arm": F.col("arm") == C.ARM_OF_RECORD,
    }
    rows = [F.struct(F.lit(k).alias("field"), F.coalesce(v, F.lit(False)).cast("int").alias("ok")) for k, v in fields.items()]
    return weights.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def pinned(measured: DataFrame, pins: dict[str, float], decimals: int = C.PIN_DECIMALS) -> DataFrame:
    """Each measured field of a one-row frame beside its pin, and whether they agree at ``decimals``."""
    rows = [F.struct(F.lit(k).alias("field"), F.col(k).alias("measured"), F.lit(float(v)).alias("pinned"),
                     F.coalesce(F.round(k, decimals) == F.lit(float(v)), F.lit(False)).cast("int").alias("ok")) for k, v in pins.items()]
    return measured.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def non_positive_yards(frame: DataFrame, limit: int = 5) -> DataFrame:
    bad = (F.col("yards_for") <= 0) | (F.col("yards_against") <= 0)
    return frame.filter(bad).select("game_id", "posteam", "yards_for", "yards_against").orderBy("game_id", "posteam").limit(limit)


def missing_sides(games: DataFrame, production: DataFrame) -> DataFrame:
    """Contest sides without a production row."""
    sides = games.select("game_id", F.explode(F.array("home", "away")).alias("posteam"))
    return sides.join(production.select("game_id", "posteam"), ["game_id", "posteam"], "left_anti")


def fold_partition(rows: DataFrame, unit: str, fold: str) -> DataFrame:
    """Units that sit in more than one fold, or in none."""
    return rows.groupBy(unit).agg(F.count_distinct(fold).alias("folds")).filter("folds <> 1")


def frame_guard(rows: DataFrame, measures: dict[str, tuple[Column, float, float]]) -> DataFrame:
    """Measured values beside what is expected, within a tolerance."""
    one = rows.agg(*[m.cast("double").alias(k) for k, (m, _, _) in measures.items()])
    cells = [F.struct(F.lit(k).alias("measure"), F.col(k).alias("value"), F.lit(float(e)).alias("expected"),
                      (F.abs(F.col(k) - F.lit(float(e))) <= F.lit(float(tol))).cast("int").alias("ok"))
             for k, (_, e, tol) in measures.items()]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def era_violations(games: DataFrame) -> DataFrame:
    """Contests before a move that carry the modern code on a side."""
    from contestry.functions.columns import era_code

    sides = games.select("game_id", "season", F.explode(F.array("home_team", "away_team")).alias("code"))
    return sides.withColumn("era", era_code("code")).filter(F.col("code") != F.col("era"))


def ledger_checks(ledger: DataFrame, population: DataFrame, component: str) -> DataFrame:
    """Duplicate plays, rows lost from the population, and the expected-count identity."""
    keys = ["game_id", "play_id"]
    rows = ledger.filter(F.col("component") == component)
    per = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    lost = population.select(*keys).join(rows.select(*keys), keys, "left_anti")
    sums = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("expected").alias("expected"), F.sum("actual").alias("actual"))
    return sums.select(
        F.lit(component).alias("component"), "rows", "expected", "actual",
        per.agg(F.count_if(F.col("c") > 1)).scalar().alias("duplicates"),
        lost.agg(F.count(F.lit(1))).scalar().alias("lost"))


def partition_residual(before: DataFrame, after: DataFrame, key: str, parts: list[str], total: str, line: float = 1e-9) -> DataFrame:
    """How far the parts are from summing to the total, before and after a change, and whether
    neither is further than ``line``: a flag, because a rounded report cannot show 1e-9."""
    def gap(df, name):
        s = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
        return df.select(key, F.abs(s - F.col(total)).alias(name))
    return gap(before, "before").join(gap(after, "after"), key).agg(
        F.count(F.lit(1)).alias("rows"), F.max("before").alias("max_before"), F.max("after").alias("max_after"),
        (F.greatest(F.max("before"), F.max("after")) <= line).cast("int").alias("holds"))


def played_guard(games: DataFrame, expected_seasons) -> DataFrame:
    seasons = games.agg(
        F.count(F.lit(1)).alias("games"), F.sort_array(F.collect_set("season")).alias("s"))
    return seasons.select("games", F.size("s").alias("seasons"), F.concat_ws(",", "s").alias("season_list"),
                          (F.col("s") == F.array(*[F.lit(x) for x in expected_seasons])).cast("int").alias("ok"))
