"""Pasted transcripts to speaker turns, audio files to samples, and keyword templates to feature frames."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import signal
from parley.functions.text import TIME_MARKS, restored, speaker_label, without_markup

_NAME = r"[A-Za-z0-9][A-Za-z0-9_ .\-]{0,24}?"
#: A line with a label: the name alone or in marks (stars, underscores, brackets), then what ends it, then what was said.
LABEL = rf"^[\[(]?[*_]{{0,2}}({_NAME})[*_]{{0,2}}[\])]?\s*(?:[*_]{{0,2}}:[*_]{{0,2}}|(?<=[\])])| - )\s*(.*)$"


def parsed_turns(transcripts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, turn_no, speaker, utterance) of transcripts of several lines.

    Time marks are taken off each line; a line with a label starts a turn, one without goes on with it, and lines before
    any label belong to 'Speaker'. Turns without words are left out and turns are numbered from 1. Null texts give none.
    A transcript in which nobody is named, so that all would be one turn, is cut into its sentences of over three characters.
    """
    lines = transcripts.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    bare = F.col("line")
    for mark in TIME_MARKS:
        bare = F.regexp_replace(bare, mark, "")
    lines = lines.withColumn("line", F.trim(bare)).where("line <> ''")
    label = F.regexp_extract("line", LABEL, 1)
    lines = lines.select(key, "line_no", (label != "").alias("opens"), speaker_label(label).alias("label"), F.when(label != "", F.regexp_extract("line", LABEL, 2)).otherwise(F.col("line")).alias("said"))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("turn", F.sum(F.col("opens").cast("int")).over(w))
    turns = lines.groupBy(key, "turn").agg(F.max(F.when(F.col("opens"), F.col("label"))).alias("speaker"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "said"))), lambda x: x["said"]), " ").alias("said"))
    turns = turns.withColumn("utterance", without_markup(F.col("said"))).where("utterance rlike '[A-Za-z0-9]'")
    turns = turns.withColumn("named", F.max(F.col("speaker").isNotNull()).over(Window.partitionBy(key)))
    pieces = F.when(F.col("named"), F.array("utterance")).otherwise(restored(F.col("utterance")))
    turns = turns.select(key, "speaker", F.col("turn").alias("t"), F.posexplode(pieces).alias("p", "utterance")).withColumn("turn", F.struct("t", "p")).where("length(trim(utterance)) > 3 or speaker is not null")
    return turns.select(key, F.row_number().over(Window.partitionBy(key).orderBy("turn")).alias("turn_no"), F.coalesce("speaker", F.lit("Speaker")).alias("speaker"), "utterance")


def word_sentences(words: DataFrame, key: str = "utt_id", gap: float = 0.45) -> DataFrame:
    """(key, sentence_no, sentence) of recognised words (key, word, start, end): a pause longer than `gap` seconds ends a sentence."""
    w = Window.partitionBy(key).orderBy("start", "end")
    cut = (F.col("start") - F.lag("end").over(w)) > gap
    rows = words.withColumn("sentence_no", F.sum(F.coalesce(cut, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "word"))), lambda x: x["word"]), " ")
    return rows.groupBy(key, "sentence_no").agg(text.alias("t")).select(key, "sentence_no", F.concat(F.upper(F.substring("t", 1, 1)), F.col("t").substr(F.lit(2), F.length("t")), F.lit(".")).alias("sentence"))


def audio_files(spark: SparkSession, path: str, rate: int = signal.RATE) -> DataFrame:
    """(path, rate, samples) of the 16-bit WAV files under `path`: one channel, the mean of all, at `rate`. Files that can't be read have null samples."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for raw in pdf["content"]:
                try:
                    with wave.open(io.BytesIO(raw)) as f:
                        x = np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels()).mean(axis=1) / 32768
                        out.append(signal.resampled(x, f.getframerate(), rate).tolist())
                except (wave.Error, EOFError, ValueError):
                    out.append(None)
            yield pd.DataFrame({"path": pdf["path"], "rate": rate, "samples": out})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(read, "path string, rate int, samples array<double>")


def templates(spark: SparkSession, path: str) -> DataFrame:
    """(keyword, path, frames) of the .npy matrices under path/keyword=<word>/ that have 13 columns."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, kw, raw in zip(pdf["path"], pdf["keyword"], pdf["content"], strict=True):
                x = np.load(io.BytesIO(raw), allow_pickle=False)
                if x.ndim == 2 and x.shape[1] == signal.CEPSTRA:
                    rows.append((kw, p, x.astype(float).tolist()))
            yield pd.DataFrame(rows, columns=["keyword", "path", "frames"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    return files.select("path", F.col("keyword").cast("string"), "content").mapInPandas(read, "keyword string, path string, frames array<array<double>>")
