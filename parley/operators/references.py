"""References to records that do not exist, for keys of one or more columns."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.skew import salted_join

MATCHES = ("simple", "partial", "full")


def reference_states(child: DataFrame, parent: DataFrame, on: list[tuple[str, str]], match: str = "simple", child_time: str | None = None, parent_time: str | None = None) -> DataFrame:
    """The rows of `child` with a column `ref_state`: 'ok', 'absent', 'late', 'unset' or 'mixed'.

    on: pairs (child column, parent column). match, as in SQL's MATCH clause, decides on keys with nulls:
      simple: a key with any null is 'unset';
      partial: the non-null columns must agree with some parent; a key of nulls only is 'unset';
      full: a key of nulls only is 'unset', one with some nulls is 'mixed', which breaks the constraint.
    child_time, parent_time: with both, 'late' is a reference whose parents all came after it; a null time is never late.

    The rows are grouped by null mask; each mask meets the parents, one row per distinct key, on its non-null columns
    only. The parent side is grouped before the join, and hot keys of the child are salted. Repeated child rows stay
    repeated; repeated parents count once; an empty parent table makes every set key absent. Further columns of the
    parent are not read, so their names may clash with the child's.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    timed = child_time is not None and parent_time is not None
    mine = [c for c, _ in on]
    out: DataFrame | None = None
    for mask in product((True, False), repeat=len(on)):  # True: this column is set
        where = F.lit(True)
        for (c, _), is_set in zip(on, mask, strict=True):
            where = where & (F.col(c).isNotNull() if is_set else F.col(c).isNull())
        rows = child.where(where)
        if not any(mask) or (not all(mask) and match == "simple"):
            part = rows.withColumn("ref_state", F.lit("unset"))
        elif not all(mask) and match == "full":
            part = rows.withColumn("ref_state", F.lit("mixed"))
        else:
            pairs = [p for p, is_set in zip(on, mask, strict=True) if is_set]
            keys = [f"_k{i}" for i in range(len(pairs))]
            first = F.min(parent_time) if timed else F.lit(None).cast("timestamp")
            heads = parent.dropna(subset=[p for _, p in pairs]).groupBy(*[F.col(p).alias(k) for k, (_, p) in zip(keys, pairs, strict=True)]).agg(first.alias("_first"), F.lit(True).alias("_there"))
            for k, (c, _) in zip(keys, pairs, strict=True):
                rows = rows.withColumn(k, F.col(c))
            joined = salted_join(rows, heads, keys, "left")
            late = (F.col("_first") > F.col(child_time)) if timed else F.lit(False)
            part = joined.withColumn("ref_state", F.when(F.col("_there").isNull(), "absent").when(late, "late").otherwise("ok")).drop(*keys, "_first", "_there")
        part = part.select(*child.columns, "ref_state")
        out = part if out is None else out.unionByName(part)
    assert out is not None, f"no key columns: {mine}"
    return out


def orphan_report(states: DataFrame, table: str, period: str) -> DataFrame:
    """Rows per table, period and state, for states other than 'ok'."""
    return states.where(F.col("ref_state") != "ok").groupBy(F.lit(table).alias("tbl"), F.col(period).alias("year_month"), "ref_state").agg(F.count("*").alias("n_rows"))
