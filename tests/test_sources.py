from __future__ import annotations

import io
import wave

import numpy as np
import pytest

from parley.functions import signal
from parley.operators import scoring
from parley.sources import store, transcripts


def test_parsed_turns(spark):
    text = "opening words\n[00:12] **Olga:** Hello  there .\nand more\n[SPEAKER_01]: (00:15) Yes!!\n\n**Olga:** ...\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc long, t string")
    got = [tuple(r) for r in transcripts.parsed_turns(df, "doc", "t").orderBy("doc", "turn_no").collect()]
    assert got == [(1, 1, "Speaker", "opening words"), (1, 2, "Olga", "Hello there. and more"), (1, 3, "SPEAKER01", "Yes!")]


def test_word_sentences(spark):
    rows = [("u", "so", 0.0, 0.2), ("far", 0, 0, 0)][:1] + [("u", "far", 0.3, 0.5), ("u", "next", 1.0, 1.2)]
    got = [tuple(r) for r in transcripts.word_sentences(spark.createDataFrame(rows, "utt_id string, word string, start double, end double")).orderBy("sentence_no").collect()]
    assert got == [("u", 0, "So far."), ("u", 1, "Next.")]


def test_audio_and_templates(spark, tmp_path):
    t = np.arange(8000) / 8000
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as f:
        f.setparams((2, 2, 8000, 0, "NONE", ""))
        x = (np.sin(2 * np.pi * 200 * t) * 20000).astype("<i2")
        f.writeframes(np.stack([x, x], axis=1).tobytes())
    (tmp_path / "a.wav").write_bytes(buffer.getvalue())
    (tmp_path / "b.wav").write_bytes(b"no audio")
    got = {r["path"][-5:]: r["samples"] for r in transcripts.audio_files(spark, str(tmp_path)).collect()}
    assert got["b.wav"] is None and len(got["a.wav"]) == 16000
    assert signal.pitch(got["a.wav"][:1600]) == pytest.approx(200, rel=0.03)
    for word, shape in (("stop", (6, 13)), ("go", (6, 5))):
        (tmp_path / f"keyword={word}").mkdir()
        np.save(tmp_path / f"keyword={word}" / "1.npy", np.zeros(shape))
    assert [r["keyword"] for r in transcripts.templates(spark, str(tmp_path)).collect()] == ["stop"]


def test_store(spark, tmp_path):
    items = spark.createDataFrame([(1, "fact", "text", "Olga", 0.9, ["a", "b"]), (1, "fact", None, None, None, None)], "meeting_id long, category string, content string, speaker string, confidence double, keywords array<string>")
    path = str(tmp_path / "items")
    store.append_items(items, path)
    store.append_items(items, path)
    rows = store.read_items(spark, path).orderBy("content").collect()
    assert len(rows) == 2 and rows[1]["keywords"] == ["a", "b"] and rows[0]["keywords"] is None and rows[0]["id"] > 0
    store.write_reports(spark.createDataFrame([(7, "one\ntwo")], "meeting_id long, report string"), str(tmp_path / "reports"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "reports")).select("value").collect()) == ["one", "two"]


def test_models_survive_storage(spark, tmp_path):
    words = spark.createDataFrame([(1, "x", "a"), (1, "x", "b"), (2, "y", "b"), (2, "y", "c")], "doc long, label string, token string")
    model = scoring.naive_bayes(words, "label", "token", "doc")
    store.save_model(model, str(tmp_path / "nb"))
    p = scoring.nb_probabilities(words, store.load_model(spark, str(tmp_path / "nb")), "label", "token", "doc").collect()
    assert {(r["doc"], r["label"]) for r in p if r["p"] > 0.5} == {(1, "x"), (2, "y")}
    assert sum(r["p"] for r in p if r["doc"] == 1) == pytest.approx(1)


def test_transcripts_without_names_are_cut_into_sentences(spark):
    rows = [(1, "the pump is loud. It leaks\nsince May! Hm"), (2, "Olga - the pump is loud.\n(Sven) So it is.\n[Rhys]: (01:02) Indeed")]
    got = [tuple(r) for r in transcripts.parsed_turns(spark.createDataFrame(rows, "doc long, t string"), "doc", "t").orderBy("doc", "turn_no").collect()]
    assert got == [(1, 1, "Speaker", "The pump is loud."), (1, 2, "Speaker", "It leaks since May!"), (2, 1, "Olga", "the pump is loud."), (2, 2, "Sven", "So it is."), (2, 3, "Rhys", "Indeed")]
