"""The stored tables: written by appending, never in place; counters and the newest version are derived when read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = "id bigint, meeting_id bigint, category string, content string, speaker string, confidence double, keywords_json string"


def row_id(*columns: str) -> Column:
    """A positive id from the contents of a row, the same whenever the row is written again."""
    return F.xxhash64(*columns).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def append_items(items: DataFrame, path: str) -> None:
    """Append items (meeting_id, category, content, speaker, confidence, keywords array); keywords are stored as JSON."""
    rows = items.select(row_id("meeting_id", "category", "content", "speaker").alias("id"), "meeting_id", "category", "content", "speaker", "confidence", F.to_json("keywords").alias("keywords_json"))
    rows.write.mode("append").parquet(path)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Stored items with their keywords as arrays; an item stored twice comes once."""
    rows = spark.read.schema(ITEMS).parquet(path).dropDuplicates(["id"])
    return rows.withColumn("keywords", F.from_json("keywords_json", "array<string>")).drop("keywords_json")


def save_model(model: tuple[DataFrame, DataFrame], path: str) -> None:
    """A naive Bayes model as two tables."""
    model[0].write.mode("overwrite").parquet(f"{path}/priors")
    model[1].write.mode("overwrite").parquet(f"{path}/likelihoods")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/priors"), spark.read.parquet(f"{path}/likelihoods")


def write_reports(reports: DataFrame, path: str, key: str = "meeting_id", text: str = "report") -> None:
    """One folder for each key with its report as text lines."""
    reports.select(key, F.explode(F.split(text, "\n")).alias("value")).write.mode("overwrite").partitionBy(key).text(path)
