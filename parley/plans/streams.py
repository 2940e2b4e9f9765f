"""Queries on events as live frames, and on signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import signal
from parley.sources.tables import cut, table
from parley.streaming import live


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _events(spark, sf_dir).select(F.col("user_id").alias("device_id"), seq.cast("bigint").alias("seq"), "value", (F.col("value") > 20).alias("active"))


def str_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type."""
    return live.tumbling(_events(spark, sf_dir)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def str_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by six hours, every two hours."""
    return live.tumbling(_events(spark, sf_dir), "6 hours", "2 hours").groupBy("start").agg(F.sum("n").alias("n")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def str_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users without a pause of thirty minutes."""
    return live.sessions(_events(spark, sf_dir)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def str_voice_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in speech and in silence for each device."""
    return live.voice_states(_frames(spark, sf_dir)).groupBy("device_id", "state").agg(F.count("*").alias("n"))


def str_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech segments of each device, for chunks of 1600 samples."""
    return live.segments(_frames(spark, sf_dir).select("device_id", "seq", F.lit(1600).alias("n_samples"), F.col("active").alias("is_speech")))


def str_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five frames of each device."""
    return live.latest(_frames(spark, sf_dir), "device_id", "seq", 5).select("device_id", "seq", "value")


def str_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the online clusters of each device's values, read as voices."""
    v = _frames(spark, sf_dir).select(F.col("device_id").alias("session_id"), F.col("seq").alias("turn"), F.col("value").alias("f0"), (F.col("value") * 10).alias("centroid"))
    return live.clustered(v).groupBy("session_id", "cluster").agg(F.count("*").alias("n"))


def agg_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean square, share of frames above 1.35 times the mean, and noise threshold of each device."""
    m = F.avg("value").over(Window.partitionBy("device_id"))
    rows = _frames(spark, sf_dir).withColumn("m", m)
    return rows.groupBy("device_id").agg(F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms"), F.round(F.count_if(F.col("value") > 1.35 * F.col("m")) / F.count("*"), 6).alias("loud_share"), F.round(F.greatest(F.lit(1e-4), F.avg("value") + 3 * F.stddev_pop("value")), 6).alias("threshold"))


def agg_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings of the device's mean from frame to frame, as a share."""
    w = Window.partitionBy("device_id")
    rows = _frames(spark, sf_dir).withColumn("s", F.when(F.col("value") >= F.avg("value").over(w), 1).otherwise(-1))
    rows = rows.withColumn("d", F.abs(F.col("s") - F.lag("s").over(w.orderBy("seq"))) / 2)
    return rows.groupBy("device_id").agg(F.round(F.avg("d"), 6).alias("rate"))


def dsp_mfcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cepstra of the embeddings, read as signals that repeat: the coefficients of each frame."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", F.flatten(F.array_repeat("embedding", 16)).cast("array<double>").alias("x"))
    frames = e.select("vec_id", F.posexplode(signal.mfcc_of("x")).alias("frame", "c"))
    return frames.select("vec_id", "frame", F.array_join(F.transform("c", lambda x: F.round(x, 6).cast("string")), " ").alias("coefficients"))


def dsp_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitch, spectral centroid and flatness of each embedding, read as a signal."""
    e = table(spark, sf_dir, "embeddings", "vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return e.select("vec_id", signal.voice_of("x").alias("v")).select("vec_id", "v.*")


def dsp_spotting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords in each embedding, read as eight frames of eight values: the label of which one of three templates is nearest.

    Templates are the first four frames of a label's first three embeddings, so they are slid over the segments. The
    template table has a row for each label; it is repeated for the segments by a broadcast join of its checked size.
    """
    frames = lambda c, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(F.col(c).cast("array<double>"), i * 8 + 1, F.lit(8)))
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    ranked = e.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("k <= 3")
    templates = cut(ranked.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("k", frames("embedding", 4).alias("t")))).alias("ts")).select(F.col("label").alias("keyword"), F.col("ts.t").alias("templates"), F.lit(0).alias("one")))
    small = templates.count() <= KEYWORDS
    segments = e.select("vec_id", frames("embedding", 8).alias("f"), F.lit(0).alias("one"))
    met = segments.join(F.broadcast(templates) if small else templates, "one")  # beyond KEYWORDS a shuffled join of the blocks
    d = met.select("vec_id", "keyword", signal.spotted_of("f", "templates").alias("d"))
    best = d.groupBy("vec_id").agg(F.min_by("keyword", F.struct("d", "keyword")).alias("keyword"), F.min("d").alias("d"))
    return best.where("d <= 1.15").select("vec_id", "keyword", F.round("d", 6).alias("distance"), F.round(1 - F.col("d") / 1.15, 6).alias("confidence"))


#: Keywords up to which the templates are broadcast.
KEYWORDS = 10_000
_FR = "fr AS (SELECT user_id AS device_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, value, value > 20 AS active FROM events)"
QUERIES = {f.__name__: f for f in (str_tumbling, str_sliding, str_sessions, str_voice_states, str_segments, str_ring, str_clusters, agg_energy, agg_crossings, dsp_mfcc, dsp_voice, dsp_spotting)}
SQL = {
    "str_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "str_sliding": "SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 2 hours, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 2 hours, ts, TIMESTAMP '1970-01-01') - INTERVAL 2 hours, time_bucket(INTERVAL 2 hours, ts, TIMESTAMP '1970-01-01') - INTERVAL 4 hours]) AS s FROM events) GROUP BY 1",
    "str_sessions": "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 minutes)::INT AS s FROM events)) GROUP BY user_id, g",
    "str_voice_states": f"""WITH RECURSIVE {_FR}, f(device_id, seq, st, run) AS (
      SELECT device_id, seq, 0, active::INT FROM fr WHERE seq = 1
      UNION ALL SELECT device_id, seq, CASE WHEN r >= lim THEN 1 - st ELSE st END, CASE WHEN r >= lim THEN 0 ELSE r END FROM (SELECT fr.device_id, fr.seq, f.st, CASE WHEN (CASE WHEN f.st = 0 THEN fr.active ELSE NOT fr.active END) THEN f.run + 1 ELSE 0 END AS r, CASE WHEN f.st = 0 THEN 3 ELSE 12 END AS lim FROM f JOIN fr ON fr.device_id = f.device_id AND fr.seq = f.seq + 1))
      SELECT device_id, CASE st WHEN 1 THEN 'SPEECH' ELSE 'SILENCE' END AS state, count(*) AS n FROM f GROUP BY 1, 2""",
    "str_ring": f"WITH {_FR} SELECT device_id, seq, value FROM fr QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY seq DESC) <= 5",
    "agg_energy": f"WITH {_FR}, m AS (SELECT *, avg(value) OVER (PARTITION BY device_id) AS m FROM fr) SELECT device_id, round(sqrt(avg(value * value)), 6) AS rms, round(count(*) FILTER (value > 1.35 * m) / count(*), 6) AS loud_share, round(greatest(1e-4, avg(value) + 3 * stddev_pop(value)), 6) AS threshold FROM m GROUP BY 1",
    "agg_crossings": f"WITH {_FR}, s AS (SELECT *, CASE WHEN value >= avg(value) OVER (PARTITION BY device_id) THEN 1 ELSE -1 END AS s FROM fr), d AS (SELECT device_id, abs(s - lag(s) OVER (PARTITION BY device_id ORDER BY seq)) / 2 AS d FROM s) SELECT device_id, round(avg(d), 6) AS rate FROM d GROUP BY 1",
}
