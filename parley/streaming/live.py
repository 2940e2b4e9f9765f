"""Live input on Structured Streaming, and the same results on stored rows.

The batch functions define what the streams compute; the streams are tested against them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parley.operators.sequence import machine, numbered, streamed

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"


def events_stream(spark: SparkSession, path: str, schema: str = EVENT, files: int = 1) -> DataFrame:
    """A stream of the Parquet files under `path`, `files` of them in each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str | None = None) -> DataFrame:
    """(start, event_type, n, total): counts and sums by event-time windows. delay: the watermark, for streams."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if delay:
        rows = rows.withWatermark("ts", delay)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str | None = None) -> DataFrame:
    """(user_id, start, n): activity of a user without a pause of `gap`."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if delay:
        rows = rows.withWatermark("ts", delay)
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), "n")


def first_deliveries(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The stream without events delivered again within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


ONSET, HANGOVER = 3, 12


def voice_states(frames: DataFrame, key: str = "device_id") -> DataFrame:
    """(key, seq, state): SPEECH from the third active frame in a row on, SILENCE after twelve inactive ones, of frames (key, seq, active).

    A finite machine: ONSET states count active frames in silence, HANGOVER more count inactive ones in speech. Long
    devices are run in chunks. A null `active` is inactive.
    """
    active = F.coalesce(F.col("active").cast("boolean"), F.lit(False))
    speech = list(range(ONSET, ONSET + HANGOVER))
    on = [*range(1, ONSET + 1), *[ONSET] * HANGOVER]  # after an active frame; the last silent state leads to speech
    off = [*[0] * ONSET, *[x + 1 for x in speech[:-1]], 0]
    step = F.when(active, F.array(*[F.lit(x) for x in on])).otherwise(F.array(*[F.lit(x) for x in off]))
    rows = numbered(frames.select(key, "seq", "active"), [key], ["seq"], "_pos").withColumn("_next", step)
    after = machine(rows, [key], "_pos", ONSET + HANGOVER, F.col("_next"), "_state")
    return after.select(key, F.col("seq").cast("bigint").alias("seq"), F.when(F.element_at("_next", F.col("_state") + 1) >= ONSET, "SPEECH").otherwise("SILENCE").alias("state"))


def segments(chunks: DataFrame, key: str = "device_id", gap: int = 5600, cap: int = 160_000, least: int = 4000) -> DataFrame:
    """(key, start, length): speech segments of chunks (key, seq, n_samples, is_speech), in samples.

    Pauses up to `gap` are bridged and belong to the segment, longer ones close it; it also closes at `cap`, and counts
    from `least` on. The last open segment is not given, as more may follow. A null is_speech is none.
    """

    def step(a: dict, row: tuple) -> list[tuple]:
        n, speech = row[2] or 0, bool(row[3])
        end = a["at"] + n
        paused = a["start"] is not None and not speech and end - a["spoke"] > gap
        if a["start"] is None and speech:
            a["start"], a["held"] = a["at"], 0
        if speech:
            a["spoke"] = end
        if a["start"] is not None and not paused:
            a["held"] += n
        out = []
        if a["start"] is not None and (paused or a["held"] >= cap):
            if a["held"] >= least:
                out.append((a["start"], a["held"]))
            a["start"], a["held"] = None, 0
        a["at"] = end
        return out

    rows = chunks.select(key, "seq", F.col("n_samples").cast("bigint").alias("n"), F.col("is_speech").cast("boolean").alias("speech"))
    kind = dict(chunks.dtypes)[key]
    return streamed(rows, key, ["seq"], f"{key} {kind}, start bigint, length bigint", lambda: {"at": 0, "start": None, "spoke": 0, "held": 0}, step)


def latest(frames: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key: what a ring buffer holds."""
    return frames.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")


def clustered(voices: DataFrame, key: str = "session_id", radius: float = 35.0, most: int = 6) -> DataFrame:
    """(key, turn, cluster): online clusters of voices (key, turn, f0, centroid), in order of their turns.

    A voice joins the nearest cluster within `radius`, or any nearest one once there are `most`, and pulls it by a fifth;
    else it founds one. Unvoiced turns (null f0) go to the first cluster. Distances are |f0| plus a hundredth of |centroid|.
    """

    def step(found: list[list[float]], row: tuple) -> list[tuple]:
        _, turn, f0, c = row
        if f0 is None:
            return [(turn, 1)]
        c = c or 0.0
        near = [abs(k[0] - f0) + 0.01 * abs(k[1] - c) for k in found]
        if near and (min(near) <= radius or len(found) >= most):
            at = near.index(min(near))
            found[at] = [0.8 * found[at][0] + 0.2 * f0, 0.8 * found[at][1] + 0.2 * c]
            return [(turn, at + 1)]
        found.append([f0, c])
        return [(turn, len(found))]

    rows = voices.select(key, F.col("turn").cast("bigint").alias("turn"), F.col("f0").cast("double").alias("f0"), F.col("centroid").cast("double").alias("centroid"))
    return streamed(rows, key, ["turn"], f"{key} {dict(voices.dtypes)[key]}, turn bigint, cluster int", list, step)


def _close(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, gap: float) -> Iterator[pd.DataFrame]:
    start, last, n = state.get if state.exists else (None, None, 0)
    out = []
    if state.hasTimedOut:
        out, n = [(key[0], pd.Timestamp(start, unit="us"), n)], 0
        state.remove()
    for pdf in frames:
        for t in sorted(pdf["ts"].astype("int64") // (1000 if pdf["ts"].dtype == "datetime64[ns]" else 1)):
            if n and t - last > gap * 1e6:
                out.append((key[0], pd.Timestamp(start, unit="us"), n))
                n = 0
            start, last, n = (t if not n else start), t, n + 1
    if n:
        state.update((int(start), int(last), int(n)))
        mark = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(int(last / 1000 + gap * 1000), mark + 1))
    yield pd.DataFrame(out, columns=["user_id", "start", "n"])


def closed_runs(events: DataFrame, gap_seconds: float = 1800, delay: str = "10 minutes") -> DataFrame:
    """A stream (user_id, start, n) of runs without a pause longer than the gap, by keyed state that a timer closes.

    For custom rules that session windows can't tell; with this rule it gives what sessions() gives.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    go = lambda key, frames, state: _close(key, frames, state, gap_seconds)
    return rows.groupBy("user_id").applyInPandasWithState(go, "user_id long, start timestamp, n long", "start long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def append_to(path: str):
    """A sink for foreachBatch: each micro-batch goes to its own folder, so a batch that is run again replaces itself."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write
