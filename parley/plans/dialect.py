"""One statement for two engines: the few functions that Spark and DuckDB name or write differently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Spark:
    """Spark SQL. Patterns must not hold a quote; lit() writes it as a code."""

    @staticmethod
    def lit(pattern: str) -> str:
        return "r'" + pattern.replace("'", r"\x27") + "'"

    def has(self, text: str, pattern: str) -> str:
        return f"({text} rlike {self.lit(pattern)})"

    def get(self, text: str, pattern: str, group: int = 1) -> str:
        """The first match, '' if there is none."""
        return f"regexp_extract({text}, {self.lit(pattern)}, {group})"

    def sub(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, {self.lit(pattern)}, {self.lit(by)})"

    def found(self, text: str, pattern: str) -> str:
        """All matches, as an array."""
        return f"regexp_extract_all({text}, {self.lit(pattern)}, 0)"

    def parts(self, text: str, pattern: str) -> str:
        return f"split({text}, {self.lit(pattern)})"

    def size(self, array: str) -> str:
        return f"size({array})"

    def each(self, array: str, name: str, value: str) -> str:
        return f"transform({array}, {name} -> {value})"

    def keep(self, array: str, name: str, test: str) -> str:
        return f"filter({array}, {name} -> {test})"

    def exploded(self, columns: str, array: str, place: str, value: str, source: str) -> str:
        """The rows of source once for each element of array, with its place from 0."""
        return f"SELECT {columns}, {place}, {value} FROM (SELECT {columns}, {array} AS _a FROM {source}) LATERAL VIEW posexplode(_a) e AS {place}, {value}"

    def joined(self, value: str, by: str, order: str) -> str:
        """Values of a group in order, in one string."""
        return f"listagg({value}, '{by}') WITHIN GROUP (ORDER BY {order})"

    def values(self, rows: list[tuple], names: str) -> str:
        cell = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else f"{v}e0" if isinstance(v, float) else str(v)
        return "(SELECT * FROM VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f" AS v({names}))"


class Duck(Spark):
    """DuckDB."""

    @staticmethod
    def lit(pattern: str) -> str:
        return "'" + pattern.replace("'", r"\x27") + "'"

    def has(self, text: str, pattern: str) -> str:
        return f"regexp_matches({text}, {self.lit(pattern)})"

    def sub(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, {self.lit(pattern)}, {self.lit(by.replace('$', chr(92)))}, 'g')"

    def found(self, text: str, pattern: str) -> str:
        return f"regexp_extract_all({text}, {self.lit(pattern)})"

    def parts(self, text: str, pattern: str) -> str:
        return f"string_split_regex({text}, {self.lit(pattern)})"

    def size(self, array: str) -> str:
        return f"len({array})::INT"

    def each(self, array: str, name: str, value: str) -> str:
        return f"list_transform({array}, lambda {name}: {value})"

    def keep(self, array: str, name: str, test: str) -> str:
        return f"list_filter({array}, lambda {name}: {test})"

    def exploded(self, columns: str, array: str, place: str, value: str, source: str) -> str:
        return f"SELECT {columns}, unnest(range(len(_a)))::INT AS {place}, unnest(_a) AS {value} FROM (SELECT {columns}, {array} AS _a FROM {source})"

    def joined(self, value: str, by: str, order: str) -> str:
        return f"string_agg({value}, '{by}' ORDER BY {order})"

    def values(self, rows: list[tuple], names: str) -> str:
        cell = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}e0" if isinstance(v, float) else str(v)
        return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS v({names}))"


SPARK, DUCK = Spark(), Duck()


def sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """A Spark statement in which @name stands for a frame."""
    text = text.replace("{", "{{").replace("}", "}}")
    for name in frames:
        text = text.replace("@" + name, "{" + name + "}")
    return spark.sql(text, **frames)
