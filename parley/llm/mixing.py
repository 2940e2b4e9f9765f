"""Mixing sources to target shares of the total token size, with a cap on repeats.

Every document of a source gets the same expected number of copies, as many as the source's target needs. The whole part
is taken; the fractional parts are rounded by the pivotal method: two documents' fractions are paired, and mass moves
at random from one to the other until one is whole. Pairs are made within bounded groups, and the one fraction that a
group leaves goes on to a group of the next level, up a reduction tree; so the number of copies of a source is kept to
within one, and documents paired are of like size, which keeps the tokens close too.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.sources.tables import cut

#: Ranks of a public tokenizer, and the pattern that splits texts for it (a fixed value).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fractions in a group of the reduction tree.
GROUP = 2048
#: Targets are a short list made by hand.
MAX_SOURCES = 100_000


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of documents (doc_id, text, source): sizes of whole texts; 0 for null and empty ones.

    A source's name is compared in lower case, with blanks cut off and hyphens as underscores; null stays null. A
    document delivered twice counts once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])

    name = F.regexp_replace(F.lower(F.trim("source")), r"[-\s]+", "_").alias("source")
    sized = documents.select("doc_id", name, "text").mapInArrow(run, "doc_id long, source string, tokens long")
    return sized.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens"))


def plan(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> list[dict]:
    """For each target: source, target_share, max_repeats, docs, tokens and copies, the expected copies of a document.

    Targets whose source has no tokens can't be met; the others keep their proportions and share the whole. The size of
    the mix is the greatest at which no source exceeds its cap, or `total` if that is less. Null targets are left out.
    """
    goal = targets.where("source is not null and target_share > 0").select("source", "target_share", "max_repeats").distinct()
    totals = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    rows = [r.asDict() for r in goal.join(totals, "source", "left").orderBy("source").limit(MAX_SOURCES + 1).collect()]
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    there = [r for r in rows if r["tokens"] and r["max_repeats"]]
    share = sum(r["target_share"] for r in there)
    most = min((r["tokens"] * r["max_repeats"] * share / r["target_share"] for r in there), default=0.0)
    size = most if total is None else min(float(total), most)
    for r in rows:
        r["docs"], r["tokens"] = r["docs"] or 0, r["tokens"] or 0
        r["copies"] = min(float(r["max_repeats"]), size * r["target_share"] / share / r["tokens"]) if r in there else 0.0
    return rows


def _uniform(*key: object) -> float:
    return xxhash.xxh64_intdigest("|".join(map(str, key))) / 2**64


def pivotal(p: np.ndarray, seed: tuple) -> np.ndarray:
    """Fractions in (0, 1) to 0, 1 and at most one fraction that is left, by pairs in order; their sum and each one's expectation are kept."""
    out = p.astype(float).copy()
    if not len(out):
        return out
    rng = np.random.default_rng(xxhash.xxh64_intdigest("|".join(map(str, seed))))
    draws = rng.random(len(out))
    i, a = 0, out[0]
    for j in range(1, len(out)):
        b = out[j]
        if a < 1e-9 or a > 1 - 1e-9:  # already whole
            out[i], i, a = round(a), j, b
            continue
        s = a + b
        if s < 1:
            if draws[j] < a / s:
                out[j], a = 0.0, s
            else:
                out[i], i, a = 0.0, j, s
        elif draws[j] < (1 - b) / (2 - s):
            out[i], i, a = 1.0, j, s - 1
        else:
            out[j], a = 1.0, s - 1
    out[i] = round(a) if a < 1e-9 or a > 1 - 1e-9 else a
    return out


def _settle(seed: int, level: int):
    def settle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id"], ignore_index=True)
        pdf["p"] = pivotal(pdf["p"].to_numpy(), (seed, level, *key))
        return pdf[pdf["p"] > 0]

    return settle


def draws(sizes: DataFrame, plans: list[dict], seed: int = 17, group: int = GROUP) -> DataFrame:
    """(doc_id, source, tokens, copies): how often each document is used; those used never are left out.

    Random numbers are drawn from the seed and the place in the tree, so a task that runs again gives the same.
    """
    spark = sizes.sparkSession
    goals = spark.createDataFrame([(r["source"], int(r["copies"]), float(r["copies"] - int(r["copies"])), max(1, r["docs"] // group)) for r in plans if r["copies"] > 0], "source string, whole int, part double, n long")
    rows = sizes.where("tokens > 0").join(F.broadcast(goals), "source")  # as many rows as there are targets
    rows = rows.withColumn("place", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("n"))).withColumn("p", F.col("part")).drop("part", "n")
    rows = cut(rows)
    whole = rows.select("doc_id", "source", "tokens", F.col("whole").alias("copies"))
    open_, ones, level, n = rows.where("p > 0").select("doc_id", "source", "tokens", "place", "p"), None, 0, max([1, *(r["docs"] // group for r in plans)])
    while True:
        done = cut(open_.groupBy("source", "place").applyInPandas(_settle(seed, level), open_.schema))
        now = done.where("p = 1").select("doc_id", "source", "tokens", F.lit(1).alias("copies"))
        ones = now if ones is None else ones.unionByName(now)
        open_ = done.where("p < 1").withColumn("place", F.floor(F.col("place") / group).cast("long"))
        if n <= 1:
            break
        n, level = -(-n // group), level + 1
    # the one fraction left of each source
    rest = open_.where(F.pmod(F.xxhash64(F.lit(seed), F.lit("rest"), "doc_id"), F.lit(1_000_000)) < F.col("p") * 1_000_000).select("doc_id", "source", "tokens", F.lit(1).alias("copies"))
    return whole.unionByName(ones).unionByName(rest).groupBy("doc_id", "source", "tokens").agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")


def report(drawn: DataFrame, sizes: DataFrame, plans: list[dict]) -> DataFrame:
    """A row for each target and each source without one: what was there, what was drawn, the target and the actual share."""
    spark = drawn.sparkSession
    goals = spark.createDataFrame([(r["source"], float(r["target_share"]), int(r["max_repeats"])) for r in plans], "source string, target_share double, max_repeats int")
    there = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    used = drawn.groupBy("source").agg(F.count("*").alias("docs_used"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens_drawn"))
    rows = there.join(goals, "source", "full").join(used, "source", "left")
    total = used.agg(F.sum("tokens_drawn"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select("source", "target_share", "max_repeats", zero("docs"), zero("tokens"), zero("docs_used"), zero("copies"), zero("most_copies"), zero("tokens_drawn"), F.round(F.coalesce(F.col("tokens_drawn") / total.scalar(), F.lit(0.0)), 6).alias("actual_share"))
