from __future__ import annotations

from datetime import datetime

import pytest

from parley.operators.references import orphan_report, reference_states
from parley.operators.skew import hot_keys, salted_join

T = datetime


def _states(child, parent, match, **kw):
    return {r["id"]: r["ref_state"] for r in reference_states(child, parent, [("a", "x"), ("b", "y")], match, **kw).collect()}


@pytest.fixture(scope="module")
def tables(spark):
    child = spark.createDataFrame([(1, 1, 1), (2, 1, 9), (3, 1, None), (4, 9, None), (5, None, None), (6, None, 2), (6, None, 2)], "id int, a int, b int")
    parent = spark.createDataFrame([(1, 1, "p"), (1, 1, "q"), (2, 2, "r"), (None, 9, "s")], "x int, y int, id string")  # a clashing name
    return child, parent


@pytest.mark.parametrize(
    ("match", "want"),
    [
        ("simple", {1: "ok", 2: "absent", 3: "unset", 4: "unset", 5: "unset", 6: "unset"}),
        ("partial", {1: "ok", 2: "absent", 3: "ok", 4: "absent", 5: "unset", 6: "ok"}),
        ("full", {1: "ok", 2: "absent", 3: "mixed", 4: "mixed", 5: "unset", 6: "mixed"}),
    ],
)
def test_null_masks(tables, match, want):
    assert _states(*tables, match) == want
    assert reference_states(*tables, [("a", "x"), ("b", "y")], match).count() == 7  # repeated rows stay


def test_empty_parents_and_children(spark, tables):
    child, parent = tables
    assert _states(child, parent.limit(0), "simple")[1] == "absent"
    assert reference_states(child.limit(0), parent, [("a", "x")]).count() == 0


def test_late(spark):
    child = spark.createDataFrame([(1, 1, T(2024, 1, 1)), (2, 1, T(2024, 1, 3)), (3, 1, None), (4, 1, T(2024, 1, 2))], "id int, a int, t timestamp")
    parent = spark.createDataFrame([(1, T(2024, 1, 2)), (1, T(2024, 1, 9))], "x int, t timestamp")
    got = {r["id"]: r["ref_state"] for r in reference_states(child, parent, [("a", "x")], "simple", "t", "t").collect()}
    assert got == {1: "late", 2: "ok", 3: "ok", 4: "ok"}


def test_report(spark):
    rows = spark.createDataFrame([("2024-01", "absent"), ("2024-01", "absent"), ("2024-02", "ok")], "m string, ref_state string")
    assert [tuple(r) for r in orphan_report(rows, "t", "m").collect()] == [("t", "2024-01", "absent", 2)]


def test_unknown_match(tables):
    with pytest.raises(ValueError, match="match"):
        reference_states(*tables, [("a", "x")], "other")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_a_join(spark, how):
    left = spark.createDataFrame([(1, i) for i in range(300)] + [(k, k) for k in range(2, 40)] + [(None, 0)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (None, "d")], "k int, w string")
    assert [r[0] for r in hot_keys(left, ["k"], 0.1).collect()] == [1]
    got = sorted(map(repr, salted_join(left, right, ["k"], how, salts=4, share=0.1).collect()))
    assert got == sorted(map(repr, left.join(right, "k", how).collect()))


def test_no_hot_keys_in_an_empty_table(spark):
    assert hot_keys(spark.createDataFrame([], "k int"), ["k"]).count() == 0
