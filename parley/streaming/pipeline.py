"""The live pipeline: utterances in micro-batches, gated, filtered by the privacy policy and stored; text that isn't kept reaches no table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.operators import gate as G
from parley.operators import scoring as S

#: Stored tables: what is kept, what waits for a person's answer, what was done with each utterance (without text), and sessions closed.
SCHEMAS = {
    "items": "batch bigint, meeting_id bigint, seq bigint, speaker string, category string, content string, confidence double",
    "pending": "batch bigint, meeting_id bigint, seq bigint, content string, confidence double",
    "audit": "batch bigint, meeting_id bigint, seq bigint, category string, action string, confidence double",
    "sessions": "meeting_id bigint, processed bigint, retained bigint, discarded bigint, pending bigint",
}
# The class of each of the gate's categories under the privacy policy.
PERSONAL = ("GOSSIP", "EMOTIONAL_VENTING", "BADMOUTHING", "SARCASM", "PERSONAL_OPINION")
CASUAL = ("CASUAL", "SPEAKER_ADMIN")


def created(spark: SparkSession, path: str) -> None:
    """The stored tables under `path`, made empty where they aren't there."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, schema in SCHEMAS.items():
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")):
            spark.createDataFrame([], schema).write.parquet(f"{path}/{name}")


def decided(utterances: DataFrame, mode: str = "BALANCED") -> DataFrame:
    """utterances (meeting_id, seq, speaker, text) with category, confidence, kept and the policy's action for each; by itself each, without context."""
    low = F.lower(F.trim("text"))
    g = G.gate(low, F.lit(None).cast("string"), F.size(F.split(F.trim("text"), r"\s+")))
    rows = utterances.where("trim(text) <> ''").select("meeting_id", "seq", "speaker", "text", g.alias("g")).select("*", "g.*").drop("g")
    label = F.when(F.col("category").isin(*PERSONAL), "personal").when(F.col("category").isin(*CASUAL), "casual").when(F.col("category") == "OTHER", "uncertain").otherwise("professional")
    return rows.withColumn("action", S.retention(label, F.col("confidence"), mode))


def stored(batch: DataFrame, number: int, path: str, mode: str = "BALANCED") -> None:
    """Writes one micro-batch: each table gets a folder for the batch, which a repeated batch replaces, so it counts once."""
    rows = decided(batch, mode).withColumn("batch", F.lit(number).cast("bigint")).persist()
    out = {
        "items": rows.where("action = 'RETAIN'").select("batch", "meeting_id", "seq", "speaker", "category", F.col("text").alias("content"), "confidence"),
        "pending": rows.where("action = 'ASK_USER'").select("batch", "meeting_id", "seq", F.col("text").alias("content"), "confidence"),
        "audit": rows.select("batch", "meeting_id", "seq", "category", "action", "confidence"),
    }
    for name, df in out.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/part-{number:012d}")
    rows.unpersist()


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table, all batches of it."""
    return spark.read.schema(SCHEMAS[name]).option("recursiveFileLookup", True).parquet(f"{path}/{name}")


def started(utterances: DataFrame, path: str, checkpoint: str, mode: str = "BALANCED") -> StreamingQuery:
    """The running pipeline over a stream of utterances; every micro-batch is decided and stored."""
    created(utterances.sparkSession, path)
    return utterances.writeStream.foreachBatch(lambda batch, number: stored(batch, number, path, mode)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closed(spark: SparkSession, path: str) -> DataFrame:
    """Ends the sessions: counters from the audit are stored, and text that still waits for an answer is wiped.

    Files are replaced by empty ones; copies in memory or in shuffle files of the cluster can't be promised away.
    """
    count = lambda a: F.count_if(F.col("action") == a)
    sums = read(spark, path, "audit").groupBy("meeting_id").agg(F.count("*").alias("processed"), count("RETAIN").alias("retained"), count("DELETE").alias("discarded"), count("ASK_USER").alias("pending"))
    sums.write.mode("overwrite").parquet(f"{path}/sessions")
    spark.createDataFrame([], SCHEMAS["pending"]).write.mode("overwrite").parquet(f"{path}/pending")
    return spark.read.schema(SCHEMAS["sessions"]).parquet(f"{path}/sessions")
