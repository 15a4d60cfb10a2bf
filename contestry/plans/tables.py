"""Lazily built inputs for the registered queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.functions import plays as P
from contestry.operators import draws, drives, features, ledger, placement
from contestry.session import cut_lineage
from contestry.sources import adapter, play_store


class Tables:
    """The play-shaped tables over one directory; nothing is read until it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def pbp(self) -> DataFrame:
        return play_store.read_plays(self.spark, self.sf_dir)

    @cached_property
    def schedule(self) -> DataFrame:
        return play_store.read_schedule(self.spark, self.sf_dir)

    @cached_property
    def charting(self) -> DataFrame:
        return adapter.charting_view(self.pbp)

    @cached_property
    def plays(self) -> DataFrame:
        return P.filtered_plays(self.pbp)

    @cached_property
    def scores(self) -> DataFrame:
        return features.finals(self.schedule)

    @cached_property
    def frame(self) -> DataFrame:
        return features.team_games_of_record(self.plays, self.scores)

    @cached_property
    def deserved(self) -> DataFrame:
        """The deterministic half of the score table."""
        return draws.plug_in_table(self.frame, self.scores)

    @cached_property
    def games(self) -> DataFrame:
        """Schedule with the home margin (``result``), null where not played."""
        return self.schedule.withColumn("margin", (F.col("home_score") - F.col("away_score")).cast("double"))

    @cached_property
    def results(self) -> DataFrame:
        return self.games.withColumn("result", F.col("margin"))

    @cached_property
    def ledger(self) -> DataFrame:
        """An artifact of its own, read by many reports: written once per query."""
        return cut_lineage(ledger.full_ledger(self.pbp))

    @cached_property
    def strict(self) -> DataFrame:
        return cut_lineage(ledger.strict_ledger(self.pbp))

    @cached_property
    def edition_a(self) -> DataFrame:
        return ledger.edition(self.strict, self.games)

    @cached_property
    def edition_b(self) -> DataFrame:
        return ledger.edition(self.ledger, self.games)

    @cached_property
    def drives(self) -> DataFrame:
        return drives.drive_table(self.pbp)

    @cached_property
    def luck_drives(self) -> DataFrame:
        return ledger.luck_drives(ledger.with_drive_key(self.ledger, self.pbp))

    @cached_property
    def priced(self) -> DataFrame:
        return placement.priced_plays(self.pbp, self.ledger, self.games.filter("margin is not null"))

    @cached_property
    def cells(self) -> DataFrame:
        return placement.cell_table(self.priced)
