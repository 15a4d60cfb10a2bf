"""Scores of a season that is named, over the stored seasons that a score rests on."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry import constants as C
from contestry.operators import draws as D
from contestry.operators.features import finals, team_games_of_record
from contestry.sources import seasons as S


def seasons_for(season: int) -> list[int]:
    """The baseline seasons and the asked one."""
    return sorted({*C.BASELINE_SEASONS, int(season)})


def season_frames(spark: SparkSession, root: str, season: int, baseline: Iterable[int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plays, finals and frame of record of the baseline seasons and the asked one, for many scorings.
    A season that is not on file is an error naming it."""
    seasons = sorted({*baseline, int(season)}) if baseline is not None else seasons_for(season)
    plays = S.load_filtered(spark, root, seasons)
    scores = finals(S.load_schedule(spark, root), seasons)
    return plays, scores, team_games_of_record(plays, scores)


def score_season(spark: SparkSession, root: str, season: int, game_ids: list[str] | None = None, weights: dict | None = None, *,
                 n_draws: int = C.DRAWS_OF_RECORD, seed: int = C.SEED_OF_RECORD, baseline: Iterable[int] | None = None,
                 frames: tuple[DataFrame, DataFrame, DataFrame] | None = None, with_draws: bool = False) -> DataFrame:
    """One score row per contest: those asked for, in the order of asking, or every final of the season.

    ``weights`` is the stored artifact (:func:`contestry.sources.seasons.load_weights`), by default the
    record's; ``frames`` reuses :func:`season_frames`. ``with_draws`` adds ``margin_draws``, the
    contest's deserved margins, one number a draw.
    """
    plays, scores, frame = frames if frames is not None else season_frames(spark, root, season, baseline)
    if game_ids is None:
        asked = scores.filter(F.col("season") == int(season)).join(frame.select("game_id").distinct(), "game_id", "left_semi").select("game_id")
    else:
        asked = list(game_ids)
    # the draws come with the scores: joined to them later, plays and frame would be read and planned twice
    return D.score_games(plays, scores, asked, n_draws, seed, weights, frame=frame, with_draws=with_draws)
