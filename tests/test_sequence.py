from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import gate, sequence
from parley.operators.sequence import asof_join, islands, last_value_before, streaks


def test_islands_and_streaks(spark):
    rows = [("m", i, v) for i, v in enumerate(["a", "a", None, None, "b", "a"])]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "p string, i int, v string")
    assert [r["run"] for r in islands(df, "v", ["p"], ["i"], "run").orderBy("i").collect()] == [1, 1, 2, 2, 3, 4]
    assert [r["streak"] for r in streaks(df, "v", ["p"], ["i"]).orderBy("i").collect()] == [1, 2, 1, 2, 1, 1]
    assert [r["was"] for r in last_value_before(df, "v", ["p"], ["i"], "was").orderBy("i").collect()] == [None, "a", "a", "a", "a", "b"]
    assert islands(df.limit(0), "v", ["p"], ["i"], "run").count() == 0


def test_asof_join(spark):
    left = spark.createDataFrame([(1, 5), (2, 1), (3, 9), (4, None)], "id int, t int").withColumn("k", F.lit("x"))
    right = spark.createDataFrame([("x", 2, 20), ("x", 5, 50), ("x", 5, 51), ("y", 1, 1), ("x", None, 99)], "k string, at int, v int")
    got = {r["id"]: r["v"] for r in asof_join(left, right, ["k"], "t", "at", "v").collect()}
    assert got == {1: 51, 2: None, 3: 51, 4: None}


def test_text_functions(spark):
    df = spark.createDataFrame([("The -budgets_ were  finalizing; um, um the the API!", "two hundred point five"), ("", ""), (None, None)], "t string, n string")
    r = df.select(T.tokens(F.col("t")).alias("k"), T.tokens(F.col("t"), stem=True).alias("s"), T.without_stutter(F.col("t")).alias("c"), T.spoken_number(F.split("n", " ")).alias("v")).collect()
    assert r[0]["k"] == ["budgets", "finalizing", "um", "um", "api"]
    assert r[0]["s"] == ["budget", "finalize", "um", "um", "api"]
    assert "um" not in r[0]["c"] and "the the" not in r[0]["c"]
    assert r[0]["v"] == 200.5
    assert r[1]["k"] == [] and r[2]["k"] is None and r[2]["v"] is None


def test_gate_golden(spark):
    turns = ["Is that a blocker?", "No.", "We decided to ship, but the relay is a blocker", "Oh great, another outage", "How was your weekend?", "Costs for the relay rose to $5,000", "hm", ""]
    df = spark.createDataFrame([("m", i, t) for i, t in enumerate(turns)], "m string, i int, t string")
    got = gate.classified(gate.clauses(df, "t"), "m", ["i", "clause_idx"]).orderBy("i", "clause_idx").collect()
    assert [r["category"] for r in got] == ["QUESTION", "NON_BLOCKING_ISSUE", "DECISION", "BLOCKER", "SARCASM", "CASUAL", "CURRENT_VALUE", "OTHER"]
    a = gate.audit(gate.classified(gate.clauses(df, "t"), "m", ["i", "clause_idx"]), "m").collect()[0]
    assert a["total"] == 8 and a["kept"] + a["discarded"] == 8 and a["retention_pct"] == 62.5


@pytest.mark.parametrize("width", [4096, 3, 1])
def test_numbered_neighbours_and_machine_in_chunks(spark, width):
    r = random.Random(1)
    rows = [(k, t, i, r.randrange(1, 5)) for k in (1, 2) for i, t in enumerate(sorted(r.sample(range(60), 23)))]
    df = spark.createDataFrame(rows, "k long, t int, i int, takes int").repartition(3)
    placed = sequence.numbered(df, ["k"], ["t"], "pos", width)
    near = sequence.neighbours(placed, ["k"], "pos", {"p2": ("t", -2), "n1": ("t", 1), "n3": ("t", 3)}, max(width, 3))
    step = F.array(F.col("takes") - 1, F.lit(0), F.lit(1), F.lit(2))
    got = {(x["k"], x["t"]): x for x in sequence.machine(near, ["k"], "pos", 4, step, "skip", width=width).collect()}
    assert len(got) == len(rows)
    for k in (1, 2):
        own = [x for x in rows if x[0] == k]
        skip = 0
        for i, (_, t, _, takes) in enumerate(own):
            x = got[k, t]
            at = lambda j: own[j][1] if 0 <= j < len(own) else None  # noqa: E731, B023
            assert (x["pos"], x["p2"], x["n1"], x["n3"], x["skip"]) == (i + 1, at(i - 2), at(i + 1), at(i + 3), skip)
            skip = skip - 1 if skip else takes - 1


#: clause before, clause, category, kept, confidence: one for each rule, and pairs of neighbouring rules that both match.
GATE_CASES = [
    ("Is the pump blocking launch?", "Nope.", "NON_BLOCKING_ISSUE", True, 0.95), ("Is it a blocker?", "It is!", "BLOCKER", True, 0.95), ("What is the target?", "42%", "TARGET", True, 0.95),
    ("What is the price?", "$1,200", "CURRENT_VALUE", True, 0.95), ("And how many?", "about 12 gb", "PROFESSIONAL_FACT", True, 0.92), ("Who owns the boiler?", "Ingrid does", "OWNER_ASSIGNMENT", True, 0.95),
    ("Anything else then?", "Friday", "DEADLINE", True, 0.92), ("Shall we close it?", "Confirmed.", "DECISION", True, 0.95), (None, "Confirmed.", "OTHER", False, 0.5),
    (None, "That manager is totally useless", "BADMOUTHING", False, 0.95), (None, "Oh great, another one of those", "SARCASM", False, 0.95), (None, "This noise is driving us crazy", "EMOTIONAL_VENTING", False, 0.9),
    (None, "I heard a rumor that they sold it", "GOSSIP", False, 0.9), (None, "Nice weather over there", "CASUAL", False, 0.9), (None, "Give me one second", "SPEAKER_ADMIN", False, 0.9),
    (None, "Do you like pizza?", "CASUAL", False, 0.95), (None, "What is the boss talking about?", "GOSSIP", False, 0.85), (None, "How far is the harbour", "QUESTION", True, 0.85),
    (None, "Maybe we should wait a little", "PROPOSAL", False, 0.9), (None, "In my personal opinion it rains", "PERSONAL_OPINION", False, 0.85), (None, "Once it rains we fix it", "CONDITIONAL_ACTION", True, 0.95),
    (None, "The leak does not block anybody", "NON_BLOCKING_ISSUE", True, 0.95), (None, "We cannot proceed until it dries", "BLOCKER", True, 0.95), (None, "The garden is out of scope", "SCOPE_CHANGE", True, 0.95),
    (None, "We decided to sell it", "DECISION", True, 0.95), (None, "Olga will write to them", "CONFIRMED_ACTION", True, 0.95), (None, "Update our list of keys", "CONFIRMED_ACTION", True, 0.95),
    (None, "The funding is $40,000", "CURRENT_VALUE", True, 0.98), (None, "The target is 30 percent", "TARGET", True, 0.95), (None, "It was 30 percent", "HISTORICAL_VALUE", True, 0.95),
    (None, "It shows 30 percent", "CURRENT_VALUE", True, 0.95), (None, "The roof is on track", "PROFESSIONAL_FACT", True, 0.95), (None, "A sensor hums", "PROFESSIONAL_FACT", True, 0.85), (None, "Hm hm", "OTHER", False, 0.5),
    (None, "We decided to keep it out of scope", "SCOPE_CHANGE", True, 0.95), (None, "If it rains Olga will fix it, a hard blocker", "CONDITIONAL_ACTION", True, 0.95), (None, "Rapid growth", "PROFESSIONAL_FACT", True, 0.85),
]


def test_gate_cases(spark):
    rows = [(i, k, x) for i, (prev, clause, *_) in enumerate(GATE_CASES) for k, x in enumerate([prev, clause]) if x is not None]
    df = spark.createDataFrame([(f"m{i}", k, 0, x) for i, k, x in rows], "m string, i int, clause_idx int, clause string")
    got = {(r["m"], r["clause"]): (r["category"], r["is_retained"], r["confidence"]) for r in gate.classified(df, "m", ["i", "clause_idx"]).collect()}
    for i, (_, clause, category, kept, confidence) in enumerate(GATE_CASES):
        assert got[f"m{i}", clause] == (category, kept, confidence), clause


def test_spoken_numbers_within_sentences(spark):
    from parley.plans import rules

    df = rules.txt_spoken(spark, "/root/testdata/sf0.001")
    texts = [r["text"] for r in df.collect()]
    ends = [("12 people came", "twelve"), ("about $205", "hundred"), ("99% of them", "ninety"), ("1200 units", "thousand")]
    for end, word in ends:
        assert any(x.endswith(end) for x in texts) and not any(word in x for x in texts)


def test_meeting_state_of_a_dialogue(spark, tmp_path):
    """Results of a written dialogue, derived by hand from the order of the steps."""
    from parley.plans import state

    said = ["The budget is $40,000 for the report.", "Actually the latest budget is $45,000 for the report.", "Can you send the audit report by 5 pm?", "Yes, I will", "How long is the server test?", "Two days for the server",
            "Olga, review the vendor contract tomorrow", "We should move the dashboard to phase two, the report agrees.", "The branch is deployed and the test is delayed", "I disagree", "The server is failing because of the old certificate"]
    rows = [(1, i, i, ["A", "B"][i % 2], t) for i, t in enumerate(said)]
    spark.createDataFrame(rows, "meeting_id long, turn_idx int, stmt_id long, speaker string, clean_text string").write.parquet(f"{tmp_path}/statements.parquet")
    lines, state.DIALOGUE = state.DIALOGUE, (("A", ""),)
    try:
        got = {(r["kind"], r["text"], r["owner"], r["status"]) for r in state.QUERIES["fold_final"](spark, str(tmp_path)).collect()}
    finally:
        state.DIALOGUE = lines
    assert ("correction", "$45,000 (revised from earlier $40,000)", None, "$40,000") in got and ("fact", "Confirmed at $45,000", None, "METRIC") in got
    assert not any(k == "fact" and "$40,000" in t for k, t, _, _ in got)
    assert ("action", "Send the audit report", "B", "CONFIRMED") in got
    assert ("action", "Review the vendor contract", "Olga", "CONFIRMED") in got
    assert any(k == "issue" and s == "confirmed" and o == "the old certificate" for k, _, o, s in got)
    assert not any(k == "decision" for k, *_ in got)
