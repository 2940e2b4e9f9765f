"""Joins whose keys may be very unevenly spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, keys: list[str], share: float = 1 / 64) -> DataFrame:
    """Keys that hold more than `share` of the rows of `df`.

    There can be no more than 1/share of them, whatever the input, so the result may be broadcast.
    Counts are combined on the map side; null keys never count, as they join nothing.
    """
    counts = df.dropna(subset=keys).groupBy(*keys).count()
    total = counts.agg(F.sum("count"))
    return counts.where(F.col("count") > total.scalar() * share).select(*keys)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", salts: int = 32, share: float = 1 / 64, salt_by: Column | None = None) -> DataFrame:
    """Equi-join in which the left rows of hot keys are spread over `salts` tasks and the right rows of only those keys are repeated.

    left, right: joined on equal columns `keys`; other column names must not clash.
    how: inner, left, left_semi or left_anti. Left rows with a null key behave as in a plain join.
    salt_by: expression over left columns that decides a row's salt; a hash of the whole row if absent.
    """
    hot = F.broadcast(hot_keys(left, keys, share).withColumn("_hot", F.lit(True)))
    spread = salt_by if salt_by is not None else F.xxhash64(*[F.col(c) for c, t in left.dtypes if not t.startswith("map")])
    a = left.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.hash(spread), F.lit(salts))).otherwise(F.lit(0))).drop("_hot")
    b = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")
