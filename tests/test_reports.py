"""Scenarios, grids and row counts in cases that tables don't hold."""

from __future__ import annotations

import pytest

from tidemark.operators import reports


def test_scenarios_of_a_small_book(spark):
    w = spark.createDataFrame([("x", "a", 0.5), ("x", "b", 0.5), ("x", "c", 0.2), ("y", "n", 1.0)], "book string, sym string, weight double")
    closes = spark.createDataFrame([("a", "2024-01-01", 10.0), ("a", "2024-01-05", 8.0), ("b", "2024-01-05", 8.0)], "sym string, d string, close double").selectExpr("sym", "cast(d AS date) AS d", "close")
    index = closes.where("sym = 'a'").select("d", "close")
    betas = spark.createDataFrame([("a", 2.0), ("b", 0.5), ("c", None)], "sym string, beta double")
    got = {(r["book"], r["scenario"]): r for r in reports.scenarios(w, closes, index, betas, [("w", "2024-01-01", "2024-01-05"), ("gone", "2023-01-01", "2023-01-05")], "book", "sym").collect()}
    assert got["x", "w"]["portfolio"] == pytest.approx(0.5 * -0.2 + 0.5 * 0.5 * -0.2) and got["x", "w"]["proxies"] == 1 and got["x", "w"]["missing"] == ["c"]
    assert got["x", "gone"]["portfolio"] == 0 and got["x", "gone"]["missing"] == ["a", "b", "c"] and got["x", "gone"]["index"] is None
    assert got["x", "gap"]["portfolio"] == pytest.approx(-0.15) and got["x", "gap"]["lines"] == 1
    assert got["x", "circuit"]["portfolio"] == pytest.approx(0.5 * -0.3 + 0.5 * -0.1) and got["x", "circuit"]["missing"] == ["c"] and got["y", "circuit"]["missing"] == ["n"]


def test_moves_go_to_the_nearest_value_of_their_side():
    assert reports.moves({"a": [1.0, 1.1, 1.5]}) == [("a", 0, 1, 1), ("a", 1, 0, 0), ("a", 1, 2, 1), ("a", 2, 1, 0)]
    assert reports.moves({"a": [-2.0, 0.0, 3.0]}) == [("a", 0, 1, 0), ("a", 2, 1, 0)]
    assert reports.moves({"a": [5.0]}) == []


def test_verdicts_of_lonely_and_losing_cells(spark):
    rows = [("one", 0, 0, "scored", 2.0), ("lonely", 0, 0, "scored", 9.0), ("lonely", 3, 3, "scored", 1.0), ("lonely", 3, 2, "scored", 1.0), ("loss", 0, 0, "scored", -1.0), ("loss", 0, 1, "scored", 0.5), ("ruin", 1, 1, "scored", 2.0), ("ruin", 1, 0, "bankrupt", None), ("open", 0, 0, "open", None)]
    cells = spark.createDataFrame(rows, "e string, a int, b int, outcome string, score double")
    v = {(r["e"], r["a"], r["b"]): r for r in reports.plateau_verdicts(cells, ["e"], {"a": [1.0, 2.0, 3.0, 4.0], "b": [1.0, 2.0, 3.0, 4.0]}).collect()}
    said = {k: (r["verdict"], r["neighbor_mean"]) for k, r in v.items()}
    assert said["one", 0, 0] == ("recommended", None)
    assert said["lonely", 0, 0] == ("scored", None) and said["lonely", 3, 2] == ("recommended", 1.0)
    assert said["loss", 0, 0] == ("scored", 0.5) and said["loss", 0, 1] == ("peak", -1.0)
    assert said["ruin", 1, 1] == ("peak", 0.0) and v["ruin", 1, 1]["sensitivity"] == 1.0 and v["ruin", 1, 1]["moved"] == "b:0"
    assert said["ruin", 1, 0] == ("failed", None) and said["open", 0, 0] == ("unscored", None)


def test_row_counts_of_new_and_lost_tables(spark):
    now = spark.createDataFrame([("a", 10, 8, 1, 1), ("new", 1, 1, 0, 0), (None, 4, 4, 0, 0)], "t string, n_in long, n_out long, n_dedup long, n_reject long")
    before = spark.createDataFrame([("a", 5, 5, 0, 0), ("gone", 1, 1, 0, 0), (None, 1, 2, 0, 0)], now.schema)
    assert {r["t"]: r["verdict"] for r in reports.row_count_changes(now, before, "t").collect()} == {"a": "pass", "new": "skip", "gone": "missing", None: "fail"}
