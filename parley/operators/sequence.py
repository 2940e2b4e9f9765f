"""Operators on ordered rows: runs, streaks, carried values and as-of joins, each by one exchange on the partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a partition that are worked on together; longer partitions are cut into chunks.
CHUNK = 4096


def islands(df: DataFrame, value: str, partition: list[str], order: list[str], name: str) -> DataFrame:
    """df with the number, from 1, of the run of equal neighbouring values that a row is in. Nulls are equal to each other."""
    w = Window.partitionBy(*partition).orderBy(*order)
    starts = F.row_number().over(w).eqNullSafe(1) | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return df.withColumn("_s", starts.cast("int")).withColumn(name, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def streaks(df: DataFrame, value: str, partition: list[str], order: list[str], name: str = "streak") -> DataFrame:
    """df with a row's place, from 1, in its run of equal values."""
    rows = islands(df, value, partition, order, "_run")
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*partition, "_run").orderBy(*order))).drop("_run")


def last_value_before(df: DataFrame, value: str, partition: list[str], order: list[str], name: str) -> DataFrame:
    """df with the last value, nulls aside, of the rows before; null if there is none."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str) -> DataFrame:
    """left with `value` of the last right row of the same keys at or before left_time; null if there is none.

    Both sides are merged and sorted once by key and time, so the rows of a key are never multiplied. Of right rows at
    one time the greatest value counts. Left rows with a null time get null.
    """
    a = left.withColumn("_t", F.col(left_time)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1))
    b = right.where(F.col(right_time).isNotNull()).groupBy(*keys, F.col(right_time).alias("_t")).agg(F.max(value).alias("_v")).withColumn("_side", F.lit(0))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*left.columns, F.when(F.col("_t").isNotNull(), F.col(value)).alias(value))


def numbered(df: DataFrame, partition: list[str], order: list[str], name: str = "pos", width: int = CHUNK) -> DataFrame:
    """df with the place of each row in its partition, from 1, by `order`, whose first column is a number.

    A partition is cut at multiples of `width` of that column; the sizes of the pieces give where each begins, so no
    task sorts a whole partition. Nulls in the first column stand first.
    """
    piece = [*partition, "_piece"]
    rows = df.withColumn("_piece", F.coalesce(F.floor(F.col(order[0]) / width), F.lit(-(2**62))))
    sizes = rows.groupBy(*piece).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*partition).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(piece)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(piece)]
    placed = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*piece).orderBy(*order)))
    return placed.join(starts, same).withColumn(name, F.col("_r") + F.col("_start")).select(*df.columns, name)


def neighbours(df: DataFrame, partition: list[str], pos: str, wanted: dict[str, tuple[str, int]], width: int = CHUNK) -> DataFrame:
    """df with columns of the rows near by: wanted gives for a new column the old one and how many places on (or, below 0, back) it stands.

    pos: places from 1, without gaps. Chunks of `width` places, which must be at least the distances asked for, overlap by
    as many rows, so a long partition is spread over tasks.
    """
    back, on = max(0, -min(o for _, o in wanted.values())), max(0, max(o for _, o in wanted.values()))
    place, chunk = (F.col(pos) - 1) % width, F.floor((F.col(pos) - 1) / width)
    where = F.array_compact(F.array(chunk, F.when((place < on) & (chunk > 0), chunk - 1), F.when(place >= width - back, chunk + 1)))
    rows = df.withColumn("_own", chunk).withColumn("_chunk", F.explode(where))
    w = Window.partitionBy(*partition, "_chunk").orderBy(pos)
    out = rows.select("*", *[(F.lead(c, o) if o > 0 else F.lag(c, -o)).over(w).alias(n) for n, (c, o) in wanted.items()])
    return out.where("_own = _chunk").drop("_own", "_chunk")


def machine(df: DataFrame, partition: list[str], pos: str, states: int, step: Column, name: str = "state", start: int = 0, width: int = 256) -> DataFrame:
    """df with the state, from 0 to states - 1, in which a finite machine is before each row.

    step: a Column with an array, for each row: the state that follows each state. Such steps combine, so each chunk of
    `width` places is reduced to one array of states, these are folded in order for each partition, and then each chunk
    is run from its first state: a long partition is spread over tasks, and an array never holds more than a chunk.
    """
    rows = df.withColumn("_step", step).withColumn("_chunk", F.floor((F.col(pos) - 1) / width))
    keys = [*partition, "_chunk"]
    chunks = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("_step").alias("s")))).alias("_rows"))
    same = F.array(*[F.lit(i) for i in range(states)])
    whole = chunks.withColumn("_end", F.aggregate("_rows", same, lambda a, r: F.transform(a, lambda x: F.element_at(r["s"], (x + 1).cast("int")))))
    line = whole.groupBy(*partition).agg(F.array_sort(F.collect_list(F.struct(F.col("_chunk").alias("c"), F.col("_end").alias("e")))).alias("_line"))
    zero = F.struct(F.lit(start).alias("x"), F.array().cast("array<struct<_chunk:bigint,_first:int>>").alias("out"))
    walked = F.aggregate("_line", zero, lambda a, r: F.struct(F.element_at(r["e"], (a["x"] + 1).cast("int")).alias("x"), F.concat(a["out"], F.array(F.struct(r["c"].alias("_chunk"), a["x"].cast("int").alias("_first")))).alias("out")), lambda a: a["out"])
    firsts = line.select(*partition, F.explode(walked).alias("f")).select(*partition, "f.*")
    zero = F.struct(F.col("_first").alias("x"), F.array().cast("array<struct<p:bigint,x:int>>").alias("out"))
    run = F.aggregate("_rows", zero, lambda a, r: F.struct(F.element_at(r["s"], (a["x"] + 1).cast("int")).alias("x"), F.concat(a["out"], F.array(F.struct(r["p"].cast("bigint").alias("p"), a["x"].alias("x")))).alias("out")), lambda a: a["out"])
    states_at = chunks.join(firsts, keys).select(*partition, F.explode(run).alias("r")).select(*partition, F.col("r.p").alias(pos), F.col("r.x").alias(name))
    return df.join(states_at, [*partition, pos])


def streamed(df: DataFrame, key: str, order: list[str], schema: str, start: Callable[[], Any], step: Callable[[Any, tuple], list[tuple]]) -> DataFrame:
    """Rows of `schema`, whose first column is the key: what `step` gives for each row of df in order, as tuples without the key.

    For recurrences whose state isn't finite. Each key's rows pass as a sorted stream, which spills; a task keeps the
    state of one key alone, so a key of any length takes linear time and constant memory, but its own task.
    step: called with the state, a mutable object made by start() for each key, and the row as a tuple.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    at = df.columns.index(key)
    types = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(types)
        now, state, begun = None, None, False
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or row[at] != now:
                    now, state, begun = row[at], start(), True
                out += [(now, *x) for x in step(state, row)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], arrow.field(i).type) for i in range(len(names))], names=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
