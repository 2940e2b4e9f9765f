"""Ordered rules as data: the first that matches decides. One list, rendered as a Column or as SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A category for texts, in lower case, in which `pattern`, and `also`, are found. `prev` must also be found in the text before; `most` words at most."""

    category: str
    pattern: str
    confidence: float
    retained: bool
    prev: str = ""
    most: int = 0
    also: str = ""


def word(alternatives: str) -> str:
    """A pattern that finds any of the alternatives as whole words, guarded so that every dialect reads it alike."""
    return rf"(?:^|[^a-z0-9_])(?:{alternatives})(?:$|[^a-z0-9_])"


def cascade(rules: list[Rule], text: Column, prev: Column, words: Column, other: Rule) -> Column:
    """A struct (category, confidence, is_retained): that of the first rule that matches, else of `other`. Null texts match none."""

    def outcome(r: Rule) -> Column:
        return F.struct(F.lit(r.category).alias("category"), F.lit(r.confidence).alias("confidence"), F.lit(r.retained).alias("is_retained"))

    out = None
    for r in rules:
        found = text.rlike(r.pattern)
        if r.also:
            found = found & text.rlike(r.also)
        if r.prev:
            found = found & prev.rlike(r.prev)
        if r.most:
            found = found & (words <= r.most)
        out = F.when(found, outcome(r)) if out is None else out.when(found, outcome(r))
    return outcome(other) if out is None else out.otherwise(outcome(other))


def cascade_sql(rules: list[Rule], text: str, prev: str, words: str, other: Rule, field: str) -> str:
    """The same cascade as a SQL CASE for one field: category, confidence or is_retained."""

    def value(r: Rule) -> str:
        v = {"category": r.category, "confidence": r.confidence, "is_retained": r.retained}[field]
        return f"'{v}'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else str(v)

    q = lambda p: "'" + p.replace("'", "''") + "'"
    lines = []
    for r in rules:
        cond = f"regexp_matches({text}, {q(r.pattern)})"
        if r.also:
            cond += f" AND regexp_matches({text}, {q(r.also)})"
        if r.prev:
            cond += f" AND coalesce(regexp_matches({prev}, {q(r.prev)}), FALSE)"
        if r.most:
            cond += f" AND {words} <= {r.most}"
        lines.append(f"WHEN {cond} THEN {value(r)}")
    return "CASE " + "\n".join(lines) + f" ELSE {value(other)} END"
