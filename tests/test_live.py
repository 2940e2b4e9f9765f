"""Streams give what their batch twins give; folds give what plain loops give."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from parley.functions import signal
from parley.streaming import live


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    r = random.Random(3)
    at, rows = datetime(2024, 1, 1), []
    for i in range(400):
        at += timedelta(minutes=r.choice([1, 2, 5, 20, 45]))
        rows.append((i, at, r.randrange(4), r.choice("ab"), float(r.randrange(9))))
    path = str(tmp_path_factory.mktemp("events"))
    rows.sort(key=lambda x: x[1])
    # a late sentinel moves the watermark past all windows
    rows += [(1000 + u, at + timedelta(days=9), u, "z", 0.0) for u in range(5)]
    for k in range(0, len(rows), 150):
        spark.createDataFrame(rows[k : k + 150], live.EVENT).coalesce(1).write.mode("append").parquet(path)
    return path


def _drain(df, spark, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive
    return spark.table(name)


def test_windows_and_sessions(spark, events, tmp_path):
    batch = spark.read.parquet(events)
    cut = datetime(2024, 1, 1)
    last = batch.where("event_type <> 'z'").agg({"ts": "max"}).collect()[0][0]
    stream = live.events_stream(spark, events, files=50)
    got = {tuple(r) for r in _drain(live.tumbling(stream, delay="1 hour"), spark, "t_win", tmp_path / "a").collect()}
    want = {tuple(r) for r in live.tumbling(batch).where("event_type <> 'z'").collect()}
    assert got == want and cut < last
    got = {tuple(r) for r in _drain(live.sessions(stream, delay="1 hour"), spark, "t_ses", tmp_path / "b").collect()}
    assert got == {tuple(r) for r in live.sessions(batch.where("event_type <> 'z'")).collect()}


def test_keyed_state_closes_runs(spark, events, tmp_path):
    got = {tuple(r) for r in _drain(live.closed_runs(live.events_stream(spark, events, files=50), 1800, "1 hour"), spark, "t_run", tmp_path / "c").collect()}
    assert got == {tuple(r) for r in live.sessions(spark.read.parquet(events).where("event_type <> 'z'")).collect()}


def test_batches_written_again_replace_themselves(spark, tmp_path):
    write = live.append_to(str(tmp_path / "out"))
    df = spark.range(3)
    write(df, 0)
    write(df, 0)
    write(df, 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_voice_states(spark):
    r = random.Random(5)
    active = [r.random() < 0.6 for _ in range(200)]
    df = spark.createDataFrame([(1, i, a) for i, a in enumerate(active)], "device_id int, seq long, active boolean")
    on, run, want = 0, 0, []
    for a in active:
        run = run + 1 if bool(a) != bool(on) else 0
        if run >= (3 if not on else 12):
            on, run = 1 - on, 0
        want.append("SPEECH" if on else "SILENCE")
    assert [x["state"] for x in live.voice_states(df).orderBy("seq").collect()] == want


def test_segments(spark):
    speech = [1, 1, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0] + [1] * 110 + [0] * 6
    df = spark.createDataFrame([(1, i, 1600, bool(s)) for i, s in enumerate(speech)], "device_id int, seq long, n_samples int, is_speech boolean")
    got = [(r["start"], r["length"]) for r in live.segments(df).orderBy("start").collect()]
    assert got[0] == (0, 8 * 1600)  # the bridged pause and three trailing chunks
    assert got[1] == (16000, 4 * 1600)
    assert got[2][1] == 160_000  # the cap
    assert live.segments(df.limit(0)).count() == 0


def test_clusters(spark):
    voices = [(100, 1000), (105, 1010), (200, 1000), (None, None), (101, 1000), (300, 900)]
    df = spark.createDataFrame([("s", i, None if f is None else float(f), None if c is None else float(c)) for i, (f, c) in enumerate(voices)], "session_id string, turn long, f0 double, centroid double")
    assert [r["cluster"] for r in live.clustered(df).orderBy("turn").collect()] == [1, 1, 2, 1, 1, 3]


def test_kernels():
    t = np.arange(16000) / 16000
    tone = np.sin(2 * np.pi * 220 * t)
    assert signal.pitch(tone[:1600]) == pytest.approx(220, rel=0.02)
    assert np.isnan(signal.pitch(np.zeros(1600)))
    assert signal.flatness(tone[:512]) < 0.05 < signal.flatness(np.random.default_rng(0).normal(size=512))
    assert signal.centroid(tone) == pytest.approx(220, rel=0.05)
    m = signal.mfcc(tone)
    assert m.shape == (98, 13) and abs(m.mean()) < 1e-9 and signal.mfcc(tone[:100]).shape == (0, 13)
    x = np.random.default_rng(1).normal(size=(30, 5))
    assert signal.dtw(x, x) == pytest.approx(0, abs=1e-9)
    assert signal.dtw(x, np.repeat(x, 2, axis=0)) == pytest.approx(0, abs=1e-9)
    assert signal.dtw(x, x[:0]) == float("inf")
    y = np.random.default_rng(2).normal(size=(40, 5))
    cost, D = signal.local_cost(x, y), np.full((31, 41), np.inf)
    D[0, 0] = 0
    for i in range(1, 31):
        for j in range(1, 41):
            if abs(j - round(i * 40 / 30)) <= 15:
                D[i, j] = cost[i - 1, j - 1] + min(D[i - 1, j - 1], D[i - 1, j], D[i, j - 1])
    assert signal.dtw(x, y) == pytest.approx(D[30, 40] / 70)
    assert len(signal.resampled(tone, 16000, 8000)) == 8000


def test_keyword_within_a_longer_segment():
    r = np.random.default_rng(2)
    word = r.normal(size=(12, 5))
    segment = np.concatenate([r.normal(size=(20, 5)), word, r.normal(size=(17, 5))])
    other = r.normal(size=(12, 5))
    assert signal.spotted(segment, word) < 0.3 < signal.spotted(segment, other)
    assert signal.spotted(word, word) == signal.dtw(word, word) and signal.spotted(np.zeros((0, 5)), word) == float("inf")
