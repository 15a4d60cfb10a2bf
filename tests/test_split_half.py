"""Halves dealt where an entity's units lie against halves ranked in pieces."""

from __future__ import annotations

import random

from contestry.operators import resample as RS


def test_halves_of_small_and_large_entities(spark, monkeypatch):
    r = random.Random(4)
    rows = [(f"e{k % 7}", f"u{k}", r.choice([None, r.gauss(k % 7, 3)]), r.choice([None, 1, 2, 3])) for k in range(300)]
    frame = spark.createDataFrame(rows, "entity string, unit string, y double, n int").repartition(3)
    values = {"pooled": ("y", "n"), "averaged": ("y", None)}

    def told(held):
        out = RS.split_half(frame, "entity", "unit", values, 60, min_units=3, held=held).collect()
        return {row.split: (round(row.pooled, 9), round(row.averaged, 9), row.entities) for row in out}

    in_pieces = told(0)
    assert len(in_pieces) == 60
    exploded = []
    plain = RS.dealt_halves
    monkeypatch.setattr(RS, "dealt_halves", lambda *of: exploded.append(of[0].count()) or plain(*of))
    assert told(1000) == in_pieces
    assert told(42) == in_pieces
    assert exploded == [0, 258]  # six of the seven entities have 43 units, one has 42
