"""Evaluation texts leaking into a corpus: a BM25 index of the test items, searched by every passage of the corpus.

The weight of a word in an item is divided by the least score that RUN consecutive words of the item can have. So each
passage that holds such a run scores at least 1 against the item, whatever the item: the search loses nothing. Passages
overlap by RUN - 1 words, so every run lies within one. The search is block-max WAND over batches of passages: greatest
weights over all items drop passages, greatest weights in blocks of items, kept with the postings, drop blocks, and only
the postings of what is left are scored. The index is sparse: postings by word, in the order of items.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import mail
from parley.sources.tables import cut

RUN = 12
PASSAGE = 60
BLOCK = 16
#: Items in one index, and indexes searched in one pass over the corpus; more items make several passes.
SLICE, AT_ONCE = 5_000, 16
K1, B = 1.2, 0.75

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at `starts`, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Index:
    """A BM25 index of items, as lists of words. Items of fewer than `run` words can't leak and aren't indexed."""

    FIELDS = ("ids", "flat", "begins", "term_max", "block_at", "block_no", "block_max", "post_at", "post_item", "post_weight")

    def __init__(self, items: list[tuple[int, list[str]]], run: int = RUN):
        items = [(i, w) for i, w in items if len(w) >= run]
        self.run, n = run, len(items)
        self.terms: dict[str, int] = {}
        codes = [np.array([self.terms.setdefault(x, len(self.terms)) for x in w], np.int32) for _, w in items]
        m = len(self.terms)
        self.ids, self.begins = np.array([i for i, _ in items], np.int64), _starts(np.array([len(c) for c in codes], np.int64))
        self.flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        df = np.bincount(np.concatenate([np.unique(c) for c in codes]), minlength=m) if codes else np.zeros(m)
        idf, mean = np.log1p((n - df + 0.5) / (df + 0.5)), np.diff(self.begins).mean() if n else 1
        term, item, weight = [], [], []
        for k, c in enumerate(codes):
            at, tf = np.unique(c, return_counts=True)
            score = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(c) / mean))
            of = dict(zip(at.tolist(), score.tolist(), strict=True))
            least = min(sum(of[t] for t in set(c[j : j + run].tolist())) for j in range(len(c) - run + 1))
            term.append(at)
            item.append(np.full(len(at), k))
            weight.append(score / least)
        term, item, weight = (np.concatenate(x) if x else np.zeros(0) for x in (term, item, weight))
        order = np.lexsort((item, term))
        term, item = term[order].astype(np.int64), item[order].astype(np.int64)
        self.post_item, self.post_weight = item.astype(np.int32), weight[order].astype(np.float32)
        key = term * (n // BLOCK + 1) + item // BLOCK  # a block of a word's postings
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        self.block_no, self.block_max = (item[heads] // BLOCK).astype(np.int32), np.maximum.reduceat(self.post_weight, heads) if len(heads) else self.post_weight
        self.post_at = np.append(heads, len(item)).astype(np.int64)  # of each block of a word
        self.block_at = np.searchsorted(term[heads], np.arange(m + 2)).astype(np.int64)  # of each word; the last word is any other
        self.term_max = np.append(np.maximum.reduceat(self.post_weight, np.searchsorted(term, np.arange(m))) if m else [], 0).astype(np.float32)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, run=self.run, terms=np.frombuffer("\n".join(self.terms).encode(), np.uint8), **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Index:
        self = cls.__new__(cls)
        with np.load(io.BytesIO(data), allow_pickle=False) as x:
            words = x["terms"].tobytes().decode()
            self.run, self.terms = int(x["run"]), {w: i for i, w in enumerate(words.split("\n"))} if words else {}
            for f in cls.FIELDS:
                setattr(self, f, x[f])
        return self

    def code(self, tokens: list[str]) -> np.ndarray:
        get, other = self.terms.get, len(self.terms)
        return np.fromiter((get(t, other) for t in tokens), np.int64, len(tokens))

    def runs(self, k: int) -> set[bytes]:
        """All runs of an item, as bytes of their codes."""
        data = self.flat[self.begins[k] : self.begins[k + 1]].astype(np.int64).tobytes()
        return {data[i : i + 8 * self.run] for i in range(0, len(data) - 8 * self.run + 1, 8)}

    def search(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item): all that score at least 1. A passage is codes[start:end]; its words count once."""
        other, least = len(self.terms), 1 - 1e-4
        bound = np.concatenate([[0], np.cumsum(self.term_max[codes], dtype=np.float64)])
        live = np.flatnonzero(bound[ends] - bound[starts] >= least)
        none = np.zeros(0, np.int64)
        if not len(live):
            return none, none
        sizes = (ends - starts)[live]
        row, flat = np.repeat(np.arange(len(live)), sizes), codes[_ranges(starts[live], sizes)]
        pairs = np.unique(row[flat < other] * np.int64(other + 1) + flat[flat < other])  # distinct words of each passage
        row, term = pairs // (other + 1), pairs % (other + 1)
        fit = np.bincount(row, self.term_max[term], len(live)) >= least
        row, term = row[fit[row]], term[fit[row]]
        found_p, found_i = [none], [none]
        blocks = int(self.block_no.max(initial=0)) + 1
        bounds = np.searchsorted(row, np.arange(0, len(live) + 2000, 2000))
        for lo, hi in zip(bounds, bounds[1:], strict=False):  # some passages at a time
            r, t = row[lo:hi], term[lo:hi]
            many = self.block_at[t + 1] - self.block_at[t]
            at = _ranges(self.block_at[t], many)
            key = np.repeat(r, many) * blocks + self.block_no[at]
            order = np.argsort(key, kind="stable")
            heads = np.flatnonzero(np.diff(key[order], prepend=-1))
            if not len(heads):
                continue
            good = np.zeros(len(key), bool)
            good[np.repeat(np.add.reduceat(self.block_max[at[order]], heads) >= least, np.diff(heads, append=len(order)))] = True
            use = order[good]  # blocks whose bounds add up to enough
            posts = self.post_at[at[use] + 1] - self.post_at[at[use]]
            each = _ranges(self.post_at[at[use]], posts)
            pair = np.repeat(key[use] // blocks, posts) * np.int64(len(self.ids)) + self.post_item[each]
            order = np.argsort(pair, kind="stable")
            heads = np.flatnonzero(np.diff(pair[order], prepend=-1))
            if len(heads):
                hit = pair[order[heads]][np.add.reduceat(self.post_weight[each[order]], heads) >= least]
                found_p.append(live[hit // len(self.ids)])
                found_i.append(hit % len(self.ids))
        return np.concatenate(found_p), np.concatenate(found_i)


def leaks_in(texts: list[list[str]], index: Index, passage: int = PASSAGE) -> set[tuple[int, int]]:
    """(number of the text, item id) for texts, as lists of words, that hold `index.run` consecutive words of an item."""
    step = passage - index.run + 1
    flat: list[str] = []
    owner, starts, ends = [], [], []
    for k, w in enumerate(texts):
        base = len(flat)
        flat += w
        for s in range(0, max(1, len(w) - index.run + 1), step):
            if len(w) >= index.run:
                owner.append(k)
                starts.append(base + s)
                ends.append(base + min(len(w), s + passage))
    if not starts:
        return set()
    codes = index.code(flat)
    p, items = index.search(codes, np.array(starts), np.array(ends))
    out: set[tuple[int, int]] = set()
    runs: dict[int, set[bytes]] = {}
    for a, i in zip(p.tolist(), items.tolist(), strict=True):
        key = (owner[a], int(index.ids[i]))
        if key not in out:
            if i not in runs:
                runs[i] = index.runs(i)
            data = codes[starts[a] : ends[a]].tobytes()
            if any(data[j : j + 8 * index.run] in runs[i] for j in range(0, len(data) - 8 * index.run + 1, 8)):
                out.add(key)
    return out


def message_words(message: str | None) -> list[list[str]]:
    """The words of each text part of a raw message."""
    return [words(mail.plain(p.text) if p.kind == "html" else p.text) for p in mail.parts(message)]


def indexes(items: DataFrame, run: int = RUN, size: int = SLICE) -> DataFrame:
    """(slice, data): the indexes of items (item_id, item_text), of about `size` each, made by tasks and kept in the shared folder.

    Items are spread by a hash of their text, so one item's copies under several ids lie together. Null texts are left out.
    """
    rows = items.where(F.col("item_text").isNotNull()).select("item_id", "item_text").distinct()
    slices = max(1, -(-rows.count() // size))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        index = Index([(int(i), words(t)) for i, t in zip(pdf["item_id"], pdf["item_text"], strict=True)], run)
        return pd.DataFrame({"slice": [int(pdf["slice"].iloc[0])], "data": [index.to_bytes()]})

    return cut(rows.withColumn("slice", F.pmod(F.xxhash64("item_text"), F.lit(slices)).cast("int")).groupBy("slice").applyInPandas(build, "slice int, data binary"))


def find_leaks(documents: DataFrame, items: DataFrame, run: int = RUN, size: int = SLICE, at_once: int = AT_ONCE) -> DataFrame:
    """(doc_id, item_id): documents (doc_id, text) of which a text part holds `run` consecutive words of an item (item_id, item_text).

    Null and empty texts hold none, and null items are in none. Long texts are searched whole, in passages. A pass over
    the documents, in which each is decoded once, searches `at_once` indexes of `size` items, whose bytes are broadcast;
    the driver holds those of one pass. There is no shuffle of documents; the last drops repeated rows. Two forms of a
    message (plain and HTML) are searched separately.
    """
    built = indexes(items, run, size)
    numbers = sorted(r[0] for r in built.select("slice").collect())
    found: DataFrame | None = None
    for lo in range(0, max(1, len(numbers)), at_once):
        data = [bytes(r[0]) for r in built.where(F.col("slice").isin(numbers[lo : lo + at_once])).orderBy("slice").select("data").collect()]
        part = _searched(documents, data)
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def _searched(documents: DataFrame, data: list[bytes]) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(data)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Index.from_bytes(d) for d in shared.value]
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for lo in range(0, len(ids), 1000):
                owner, lists = [], []
                for k in range(lo, min(lo + 1000, len(ids))):
                    for w in message_words(texts[k]):
                        owner.append(ids[k])
                        lists.append(w)
                pairs = sorted({(owner[k], i) for index in own for k, i in leaks_in(lists, index)})
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["doc_id", "item_id"])

    return documents.select("doc_id", "text").mapInArrow(go, "doc_id long, item_id long")
