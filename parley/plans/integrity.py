"""Queries on references between the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.references import MATCHES, orphan_report, reference_states
from parley.sources.tables import table

CHILDREN = {"meeting_items": "item_ts", "meeting_summaries": "generated_at"}


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    meetings = table(spark, sf_dir, "meetings", "id", "loaded_at")
    parts = []
    for name, at in CHILDREN.items():
        rows = table(spark, sf_dir, name, "id", "meeting_id", at, "loaded_at").where(F.col("meeting_id").isNotNull())
        # deliveries of one row differ only in loaded_at; the first counts
        rows = rows.groupBy("id", "meeting_id", F.date_format(at, "yyyy-MM").alias("year_month")).agg(F.min("loaded_at").alias("loaded_at"))
        parts.append(reference_states(rows, meetings, [("meeting_id", "id")], "simple", "loaded_at", "loaded_at").select(F.lit(name).alias("tbl"), F.col("id").alias("row_id"), "year_month", "ref_state"))
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of meeting_items and meeting_summaries whose meeting is absent or was loaded only after them."""
    return _states(spark, sf_dir).where(F.col("ref_state").isin("absent", "late")).distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table and month."""
    states = _states(spark, sf_dir)
    return orphan_report(states.where("tbl = 'meeting_items'"), "meeting_items", "year_month").unionByName(orphan_report(states.where("tbl = 'meeting_summaries'"), "meeting_summaries", "year_month"))


def p2_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of two columns, either of which may be null: (meeting, speaker) of meeting_items to those of statements, by each match rule."""
    rows = table(spark, sf_dir, "meeting_items", "id", "meeting_id", "speaker").distinct()
    said = table(spark, sf_dir, "statements", "meeting_id", "speaker")
    on = [("meeting_id", "meeting_id"), ("speaker", "speaker")]
    parts = [reference_states(rows, said, on, match).groupBy("ref_state").agg(F.count("*").alias("n")).select(F.lit(match).alias("match"), "ref_state", "n") for match in MATCHES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_SQL = """
WITH first_meeting AS (SELECT id, min(loaded_at) AS seen FROM meetings GROUP BY id),
rows_ AS (
  SELECT 'meeting_items' AS tbl, id AS row_id, meeting_id, strftime(item_ts, '%Y-%m') AS year_month, min(loaded_at) AS seen
  FROM meeting_items WHERE meeting_id IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT 'meeting_summaries', id, meeting_id, strftime(generated_at, '%Y-%m'), min(loaded_at)
  FROM meeting_summaries WHERE meeting_id IS NOT NULL GROUP BY ALL),
found AS (
  SELECT DISTINCT tbl, row_id, year_month, CASE WHEN m.id IS NULL THEN 'absent' ELSE 'late' END AS ref_state
  FROM rows_ LEFT JOIN first_meeting m ON m.id = rows_.meeting_id
  WHERE m.id IS NULL OR m.seen > rows_.seen)
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p2_composite": p2_composite}
SQL = {
    "p2_found": _SQL + "SELECT tbl, row_id, year_month, ref_state FROM found",
    "p2_report": _SQL + "SELECT tbl, year_month, ref_state, count(*) AS n_rows FROM found GROUP BY ALL",
    "p2_composite": """WITH c AS (SELECT DISTINCT id, meeting_id, speaker FROM meeting_items), k AS (SELECT *, EXISTS (SELECT 1 FROM statements s WHERE s.meeting_id = c.meeting_id AND s.speaker = c.speaker) AS both_,
      meeting_id IN (SELECT meeting_id FROM statements WHERE meeting_id IS NOT NULL) AS by_meeting, speaker IN (SELECT speaker FROM statements WHERE speaker IS NOT NULL) AS by_speaker FROM c),
      m AS (SELECT unnest(['simple', 'partial', 'full']) AS match, * FROM k)
      SELECT match, CASE WHEN meeting_id IS NULL AND speaker IS NULL THEN 'unset' WHEN meeting_id IS NOT NULL AND speaker IS NOT NULL THEN CASE WHEN both_ THEN 'ok' ELSE 'absent' END WHEN match = 'simple' THEN 'unset' WHEN match = 'full' THEN 'mixed'
      WHEN meeting_id IS NOT NULL THEN CASE WHEN by_meeting THEN 'ok' ELSE 'absent' END WHEN by_speaker THEN 'ok' ELSE 'absent' END AS ref_state, count(*) AS n FROM m GROUP BY ALL""",
}
