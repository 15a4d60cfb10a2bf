"""Reply chains that bite their own tail."""

from __future__ import annotations

from contestry.llm import chat


def test_messages_on_or_under_a_cycle_give_no_path(spark):
    rows = [("r", None), ("a", "r"), ("b", "a"), ("c", "r"), ("x", "z"), ("y", "x"), ("z", "y"), ("tail", "x"), ("end", "tail"), ("self", "self"), ("under", "self"), ("lost", "absent")]
    paths = chat.reply_paths(spark.createDataFrame(rows, "id string, parent string")).collect()
    got = {}
    for p in paths:
        got.setdefault(p.leaf, []).append((p.depth, p.id))
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == {"b": ["r", "a", "b"], "c": ["r", "c"], "lost": ["lost"]}


def test_only_cycles(spark):
    assert chat.reply_paths(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent string")).collect() == []
