"""Queries of this subpackage, and DuckDB statements for those that SQL can express in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import leaks, mixing, names, neardup, pii, spam, turns
from parley.operators.skew import salted_join
from parley.sources.tables import table


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "meeting_items", "id", "content").select(F.lit("meeting_items").alias("tbl"), F.col("id").alias("key"), F.col("content").alias("text"))
    found = table(spark, sf_dir, "intelligence_items", "item_id", "content").select(F.lit("intelligence_items").alias("tbl"), F.col("item_id").alias("key"), F.col("content").alias("text"))
    return items.unionByName(found)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of one table whose contents share at least 0.7 of their distinct words."""
    return neardup.similar_pairs(_contents(spark, sf_dir), 0.7)


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record with text: its class of near-duplicates, and its number of links to other texts."""
    texts = _contents(spark, sf_dir)
    links = neardup.cut(neardup.similar_sets(texts, 0.7))
    ends = links.select(F.col("node_a").alias("node")).unionByName(links.select(F.col("node_b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    known = salted_join(neardup.members(texts), neardup.components(links).join(ends, "node"), ["node"], "left")
    return known.select("tbl", F.col("key").alias("row_id"), F.coalesce("class_id", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


#: Table, key and text of the fields that mention private details.
PII_FIELDS = (("meeting_items", "id", "content"), ("statements", "stmt_id", "raw_text"), ("intelligence_items", "item_id", "evidence_turn"))


def _pii_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t, key, text).where(F.col(text).isNotNull()).select(F.lit(t).alias("tbl"), F.col(key).alias("row_id"), F.col(text).alias("text")) for t, key, text in PII_FIELDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private details in three fields: kind and piece as written."""
    return pii.find_pii(_pii_texts(spark, sf_dir)).distinct()


def p3_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three fields with placeholders in place of private details."""
    return pii.masked(_pii_texts(spark, sf_dir)).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered turns of each meeting, with their speaker's full name and clean words."""
    rows = table(spark, sf_dir, "statements", "meeting_id", "turn_idx", "stmt_id", "speaker", "raw_text")
    return turns.turns(rows, table(spark, sf_dir, "roster", "entity_kind", "full_name"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of which a text part holds 12 consecutive words of a test item."""
    return leaks.find_leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "item_text"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items that leaked, with the number of documents that reveal them."""
    found = p6_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return found.join(table(spark, sf_dir, "eval_items", "item_id", "suite").distinct(), "item_id", "left").select("item_id", "suite", "n_docs")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose speaker or owner means one roster entry but is written otherwise."""
    fields = (("meeting_items", "id", "speaker"), ("intelligence_items", "item_id", "target_owner"), ("task_nodes", "node_id", "owner"))
    parts = [table(spark, sf_dir, t, key, name).select(F.lit(t).alias("tbl"), F.col(key).alias("row_id"), F.col(name).alias("typed")) for t, key, name in fields]
    return names.linked(parts[0].unionByName(parts[1]).unionByName(parts[2]), table(spark, sf_dir, "roster", "entity_id", "entity_kind", "full_name"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[dict], DataFrame]:
    sizes = mixing.cut(mixing.token_sizes(table(spark, sf_dir, "documents", "doc_id", "text", "source")))
    plans = mixing.plan(sizes, table(spark, sf_dir, "mix_targets"))
    return sizes, plans, mixing.draws(sizes, plans)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the mix that each source gets, beside its target."""
    sizes, plans, drawn = _mix(spark, sf_dir)
    return mixing.report(drawn, sizes, plans)


def p7_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    return _mix(spark, sf_dir)[2]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that are lists of keywords, links or product tags."""
    return spam.stuffed(table(spark, sf_dir, "documents", "doc_id", "text"))


def p8_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List density and share of replicated phrases of the messages that look like lists."""
    return spam.evidence(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", F.round("density", 6).alias("density"), F.round("stitched", 6).alias("stitched"), F.round("replicated", 6).alias("replicated"), "hosts")


QUERIES = {
    f.__name__: f for f in (p1_found, p1_classes, p3_found, p3_masked, p4_found, p5_found, p6_found, p6_report, p7_shares, p7_draws, p8_found, p8_evidence)
}
#: None of these can be told in SQL at the size of whole tables; tests compare them with brute force on small fixtures.
SQL: dict[str, str] = {}
