from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from parley.llm import neardup
from parley.llm.sketch import bands, mix, sketches


def _sets(values):
    flat = np.concatenate([np.array(sorted(v), np.uint64) for v in values]) if values else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum([len(v) for v in values])])


@pytest.mark.parametrize("shared", [0, 20, 60, 100])
def test_sketches_estimate_jaccard(shared):
    t, hits = 64, []
    for seed in range(60):
        base = mix(np.arange(200, dtype=np.uint64) + np.uint64(1000 * seed))
        a, b = base[:100], np.concatenate([base[100 - shared : 100], base[100 : 200 - shared]])
        s = sketches(*_sets([set(a.tolist()), set(b.tolist())]), t, seed)
        hits.append((s[0] == s[1]).mean())
    want = shared / (200 - shared)
    assert np.mean(hits) == pytest.approx(want, abs=0.04)


def test_every_coordinate_fills_even_for_one_element():
    s = sketches(*_sets([{7}, {7}, {8}, set()]), 160)
    greatest = np.iinfo(np.uint64).max
    assert (s[:3] != greatest).all() and (s[3] == greatest).all()
    assert (s[0] == s[1]).all() and not (s[0] == s[2]).any()
    assert (bands(s, 5)[0] == bands(s, 5)[1]).all() and len(set(bands(s, 5)[0].tolist())) == 32


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(900)]
    rows, key = [], 0
    for _ in range(60):
        words = r.sample(vocabulary, r.choice([3, 8, 20, 40]))
        for _ in range(r.choice([1, 1, 2, 4])):
            edited = list(words)
            for _ in range(r.choice([0, 1, 2, 5])):
                edited[r.randrange(len(edited))] = r.choice(vocabulary)
            r.shuffle(edited)
            key += 1
            rows.append((r.choice(["x", "y"]), key, " ".join(edited).title() + "!"))
    rows += [("x", 900, None), ("x", 901, ""), ("x", 902, "?!"), ("x", 903, "common"), ("x", 904, "Common."), ("y", 905, "common"), rows[0], rows[0], ("x", 906, "long " * 50_000)]
    return rows, spark.createDataFrame([(*x, "clash") for x in rows], "tbl string, key long, text string, node string")


def _brute(rows, threshold):
    sets = {(t, k): neardup.words(x) for t, k, x in rows if x and neardup.words(x)}
    return {(t, a, b) for (t, a), (u, b) in combinations(sorted(sets), 2) if t == u and a != b and len(sets[t, a] & sets[u, b]) >= threshold * len(sets[t, a] | sets[u, b]) - 1e-9}


def test_pairs_match_brute_force(texts):
    rows, df = texts
    got = {tuple(r) for r in neardup.similar_pairs(df, 0.7).collect()}
    want = _brute(rows, 0.7)
    assert got <= want and len(want - got) <= 0.03 * len(want)
    assert ("x", 903, 904) in got


def test_links_and_classes(texts):
    rows, df = texts
    links = neardup.similar_sets(df, 0.7)
    assert links.where("node_a >= node_b or similarity < 0.7").count() == 0
    member = {(r["tbl"], r["key"]): r["node"] for r in neardup.members(df).collect()}
    classes = {r["node"]: r["class_id"] for r in neardup.components(links).collect()}
    for t, a, b in {tuple(r) for r in neardup.similar_pairs(df, 0.7).collect()}:
        x, y = member[t, a], member[t, b]
        assert classes.get(x, x) == classes.get(y, y)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "node_a long, node_b long")
    got = {r["node"]: r["class_id"] for r in neardup.components(links).collect()}
    assert {got[i] for i in range(201)} == {0} and got[501] == 500


def test_nothing_from_nothing(spark):
    empty = spark.createDataFrame([], "tbl string, key long, text string")
    assert neardup.similar_pairs(empty).count() == 0 and neardup.similar_sets(empty).count() == 0 and neardup.members(empty).count() == 0


@pytest.mark.parametrize("own", [(10, 10), (9, 10)])
def test_pairs_of_a_template_in_a_third_of_the_rows(spark, own):
    r = random.Random(9)
    form, rows = [f"form{i}" for i in range(50 if own == (10, 10) else 45)], []
    for k in range(120):
        words = form + [f"own{k}x{i}" for i in range(own[k // 3 % 2])] if k % 3 == 0 else [f"w{r.randrange(5000)}" for _ in range(60)]
        r.shuffle(words)
        rows.append(("x", k, " ".join(words)))
    want = _brute(rows, 0.7)
    df = spark.createDataFrame(rows, "tbl string, key long, text string")
    got = {tuple(x) for x in neardup.similar_pairs(df, 0.7).collect()}
    assert len(want) >= 580 and got <= want and len(want - got) <= 0.02 * len(want)
    assert neardup.similar_sets(df, 0.7).count() == len(got)


def test_parities_never_part_sets_by_more_than_they_differ():
    r = np.random.default_rng(3)
    sets = [set(r.choice(mix(np.arange(300, dtype=np.uint64)), size).tolist()) for size in r.integers(1, 200, 60)]
    values, bounds = _sets(sets)
    longs = neardup.parities(values, bounds)
    for i, j in combinations(range(60), 2):
        assert np.bitwise_count((longs[i] ^ longs[j]) & neardup._MASK).sum() <= len(sets[i] ^ sets[j])
        assert int(longs[i, 1]) >> 56 == len(sets[i])


def test_words_in_arrow_are_those_of_the_expression():
    texts = ["Héllo wörld_x ²3 Ⅷ a-b A-B", "", None, "ÄÖ äö", "ǅ ß STRASSE", "日本 語1"]
    for some in (texts, [*texts, "DİYARBAKIR x"], [None], []):  # a letter that lower case breaks up
        hashes = neardup._Hashes()
        base, codes, offsets = neardup.word_sets(pa.array(some, pa.string()), hashes)
        got = [base[codes[i:j]].tolist() for i, j in zip(offsets, offsets[1:], strict=False)]
        assert got == [sorted(h for w in neardup.words(t) for h in hashes[w]) if t else [] for t in some]


def test_packed_entries_come_back():
    r = np.random.default_rng(5)
    node, parity, band = r.integers(-(2**60), 2**60, 50), r.integers(0, 2**60, (50, 2)).astype(np.uint64), r.integers(-(2**63), 2**63 - 1, (50, 32))
    got = set()
    for part, data in neardup._packed_entries(node, parity, band, 7):
        got |= {(part, b, n, *p) for b, n, p in zip(*(e.tolist() for e in neardup._entries(data)), strict=True)}
    flat = band.view(np.uint64)
    assert got == {(int(flat[i, j] % np.uint64(7)), int(flat[i, j] >> np.uint64(24)) & 0xFFFFFFFFFF, int(node[i]), *parity[i].tolist()) for i in range(50) for j in range(32)}


def test_large_buckets_and_copies_are_worked_on_in_blocks(spark):
    r = random.Random(2)
    form = [f"form{i}" for i in range(40)]
    rows = [("x", k, " ".join(form + [f"own{k}"] * (k % 4 > 0))) for k in range(60)] + [("y", k, " ".join(form)) for k in range(9)] + [("x", 99, " ".join(r.sample(form, 6)))]
    df = spark.createDataFrame(rows, "tbl string, key long, text string").repartition(3)
    want = _brute(rows, 0.7)
    assert {tuple(x) for x in neardup.similar_pairs(df, 0.7, block=4).collect()} == want
    links = neardup.similar_sets(df, 0.7, block=4)
    assert links.count() == 46 * 45 // 2 and links.distinct().count() == links.count()
