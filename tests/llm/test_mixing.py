from __future__ import annotations

import os

import numpy as np
import pytest

from parley.llm import mixing


def test_pivotal_keeps_the_sum_and_expectations():
    p = np.array([0.2, 0.7, 0.5, 0.9, 0.4, 0.3])
    runs = np.array([mixing.pivotal(p, (i,)) for i in range(4000)])
    assert np.allclose(runs.sum(axis=1), p.sum())
    assert ((runs < 1e-9) | (runs > 1 - 1e-9)).all()  # the sum is whole
    assert np.allclose(runs.mean(axis=0), p, atol=0.03)
    left = mixing.pivotal(np.array([0.5, 0.25, 0.5]), (1,))
    assert left.sum() == pytest.approx(1.25) and ((left > 0) & (left < 1)).sum() == 1
    assert len(mixing.pivotal(np.zeros(0), (1,))) == 0


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "a" if i % 3 else "b", int(rng.integers(50, 400))) for i in range(3000)] + [(9001, "extra", 10), (9002, None, 10), (9003, "a", 0)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.4, 2), ("b", 0.5, 3), ("gone", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    return sizes, targets


@pytest.mark.parametrize("group", [2048, 16])
def test_shares_and_caps(mixed, group):
    sizes, targets = mixed
    plans = mixing.plan(sizes, targets)
    drawn = mixing.draws(sizes, plans, group=group)
    rows = {r["source"]: r for r in mixing.report(drawn, sizes, plans).collect()}
    assert rows["a"]["actual_share"] == pytest.approx(0.4 / 0.9, abs=0.005) and rows["b"]["actual_share"] == pytest.approx(0.5 / 0.9, abs=0.005)
    assert rows["a"]["most_copies"] <= 2 and rows["b"]["most_copies"] <= 3 and rows["gone"]["copies"] == 0 and rows["extra"]["target_share"] is None and None in rows
    assert drawn.groupBy("doc_id").count().where("count > 1").count() == 0
    for p in plans:
        if p["source"] in ("a", "b"):  # the number of copies is kept to within one
            n = sizes.where(f"source = '{p['source']}' and tokens > 0").count()
            assert abs(rows[p["source"]]["copies"] - p["copies"] * n) <= 1 + 1e-6
    again = mixing.draws(sizes, plans, group=group)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, drawn.collect()))


def test_a_smaller_total(mixed):
    sizes, targets = mixed
    drawn = mixing.draws(sizes, mixing.plan(sizes, targets, total=20_000))
    assert drawn.selectExpr("sum(tokens * copies)").collect()[0][0] == pytest.approx(20_000, rel=0.05)


def test_empty_tables(mixed):
    sizes, targets = mixed
    assert mixing.draws(sizes.limit(0), mixing.plan(sizes.limit(0), targets)).count() == 0
    plans = mixing.plan(sizes, targets.limit(0))
    assert plans == [] and mixing.draws(sizes, plans).count() == 0


@pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer here")
def test_token_sizes(spark):
    docs = spark.createDataFrame([(1, "two words", " Team-Lists "), (1, "two words", "TEAM_LISTS"), (2, None, None), (3, "", "x")], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["source"], r["tokens"]) for r in mixing.token_sizes(docs).collect()}
    assert got == {1: ("team_lists", 2), 2: (None, 0), 3: ("x", 0)}
