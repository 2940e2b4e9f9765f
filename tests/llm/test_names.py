from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parley.llm import names

ROSTER = [(1, "person", "Patricia Lumsen"), (2, "person", "Olga Harron"), (3, "person", "Olga Melakquist"), (4, "person", "Bjarne Bremønt"), (5, "organisation", "Wenarner Systems Transport plc"), (6, "organisation", "Ralolavik Ceramics Inc."), (5, "organisation", "Wenarner Systems Transport plc")]


def _distance(a, b):
    """Unrestricted Damerau-Levenshtein by the plain recurrence."""
    far = len(a) + len(b)
    last, D = {}, {(-1, -1): far}
    for i in range(len(a) + 1):
        D[i, -1], D[i, 0] = far, i
    for j in range(len(b) + 1):
        D[-1, j], D[0, j] = far, j
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), match
            cost = a[i - 1] != b[j - 1]
            if not cost:
                match = j
            D[i, j] = min(D[i - 1, j - 1] + cost, D[i, j - 1] + 1, D[i - 1, j] + 1, D[k - 1, m - 1] + i - k - 1 + 1 + j - m - 1)
        last[a[i - 1]] = i
    return D[len(a), len(b)]


def test_distances():
    r = random.Random(2)
    pairs = [("".join(r.choices("abc ", k=r.randrange(1, 9))), "".join(r.choices("abc ", k=r.randrange(1, 9)))) for _ in range(400)]
    a, na = names.coded([x for x, _ in pairs])
    b, nb = names.coded([y for _, y in pairs])
    assert names.distances(a, na, b, nb).tolist() == [_distance(x, y) for x, y in pairs]


def test_join_within_radius_matches_brute_force():
    r = random.Random(6)
    forms = ["".join(r.choices("abcde", k=r.randrange(6, 12))) for _ in range(120)]
    queries = list({"".join(c for c in f if r.random() > 0.1) or "a" for f in forms} | {"".join(r.choices("abcde", k=8)) for _ in range(60)})
    pivots = names.pivots_of(forms, 6)
    vq, vf = names._to_pivots(queries, pivots), names._to_pivots(forms, pivots)
    most = np.array([r.choice([0, 1, 2]) for _ in forms])
    got = set()
    for c in range(len(pivots)):  # cell by cell
        q = [k for k in range(len(queries)) if vq[k].argmin() == c]
        f = [k for k in range(len(forms)) if vf[k][c] <= vf[k].min() + 2 * most[k]]
        out = names.within(pd.DataFrame({"name": [queries[k] for k in q], "v": [vq[k].tobytes() for k in q]}), pd.DataFrame({"form": [forms[k] for k in f], "entity_id": f, "most": most[f], "v": [vf[k].tobytes() for k in f]}))
        got |= set(zip(out["name"], out["entity_id"], out["d"], strict=True))
    want = {(q, k, _distance(q, f)) for q in queries for k, f in enumerate(forms) if _distance(q, f) <= most[k]}
    assert got == want and want


@pytest.mark.parametrize(
    ("typed", "want"),
    [
        ("Lumsen, Patricia", 1), ("P. Lumsen", 1), ("patricia.lumsen", 1), ("Pat Lumsen", 1), ("PATRICIA LUMSEN (ext.)", 1), ("Ptricia Lumsne", 1), ("Patricia Lumsen, PMO", 1), ("plumsen", 1), ("Patricia", 1),
        ("Olga", None), ("Olga H.", 2), ("Olga Harron", None), ("harron_olga", 2), ("Bjarne Bremont", 4), ("WST plc", 5), ("Systems Wenarner", 5), ("The Wenarner Systems", 5), ("ralolavik ceramics", 6), ("Unclear", None), ("", None), (None, None), ("John Smith", None),
    ],
)
def test_variants(linked_variants, typed, want):
    assert linked_variants.get(typed) == want


@pytest.fixture(scope="module")
def linked_variants(spark):
    cases = [m for m in test_variants.pytestmark if m.name == "parametrize"][0].args[1]
    typed = [t for t, _ in cases]
    rows = spark.createDataFrame([("t", i, t, "x") for i, t in enumerate(typed)] + [("t", 0, typed[0], "x")], "tbl string, row_id long, typed string, full_name string")
    out = names.linked(rows, spark.createDataFrame(ROSTER, "entity_id long, entity_kind string, full_name string")).collect()
    assert len({r["row_id"] for r in out}) == len(out)
    return {typed[r["row_id"]]: r["entity_id"] for r in out}


def test_other_scripts_and_split_cells(spark):
    roster = spark.createDataFrame([(1, "person", "Иван Петров"), (2, "person", "Мария Соколова"), (3, "person", "Anna Berg"), (4, "organisation", "東京 電力")], "entity_id long, entity_kind string, full_name string")
    rows = spark.createDataFrame([("t", 1, "Петров, Иван"), ("t", 2, "мария соколва"), ("t", 3, "BERG, Anna"), ("t", 4, "電力 東京"), ("t", 5, "東京"), ("t", 6, "Иван Петров")], "tbl string, row_id long, typed string")
    want = {(1, 1), (2, 2), (3, 3), (4, 4)}
    exact = roster.select(F.col("full_name").alias("typed"))
    for task in (4000, 2):
        got = names.resolved(rows.select("typed").join(exact, "typed", "left_anti"), roster, task=task).join(rows, "typed")
        assert want <= {(r["row_id"], r["entity_id"]) for r in got.collect()}


def test_empty_sides(spark):
    none, roster = spark.createDataFrame([], "tbl string, row_id long, typed string"), spark.createDataFrame(ROSTER, "entity_id long, entity_kind string, full_name string")
    assert names.linked(none, roster).count() == 0
    assert names.linked(spark.createDataFrame([("t", 1, "Olga H.")], none.schema), roster.limit(0)).count() == 0
