"""Keyword-stuffed and link-list messages.

Two kinds of evidence are joined. List density: the share of a message's own words that stand in links, tags, product
codes or runs without any function word, as only lists have them. Phrases: five-word shingles, in which links, tags and
numbers are masked, are counted over all messages by the distinct hosts that have them; a message is stitched from the
shingles that another host has too, or that it repeats itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import mail
from parley.operators.skew import salted_join
from parley.sources.tables import cut

SHINGLE = 5
#: A run of words without function words counts as a list from this length on.
RUN = 7
#: Shares above which a message is flagged. Lists are often made for one message, so phrases that it repeats itself count
#: as replicated too, and fewer than half of them need be.
DENSITY, REPLICATED = 0.5, 0.2

# Function words of English, German, French and Spanish; hardly a sentence has none in seven words.
FUNCTION = set(
    """a an the and or but if then of to in on at by for with from as is are was were be been has have had do does did will would can
could should may must not no nor so than that this these those it its he she we you they i us them our your their his her my me who which what
when where while because since until after before into onto about over under there here also both each every yet up out one
der die das den dem des ein eine einen einem einer und oder aber wenn von zu im in am an auf bei für mit aus als ist sind war waren wird werden
hat haben muss müssen kann nicht kein so dass diese dieser dieses es er sie wir ihr ich mir uns euch noch bis nach vor weil da auch heute
le la les un une des du de et ou mais si dans sur par pour avec est sont était sera a ont doit ne que qui ce cette ces il elle nous vous ils je
au aux en plus avant après parce personne reste encore
el los las uno una unos unas y o pero si del al por para con sin es son era está están ser ha han debe no que quien este esta estos lo se nos
su sus hasta antes después porque ya todavía""".split()
)
_LINK = re.compile(r"(?i)(?:https?://|www\.)\S+")
_TAGS = re.compile(r"(?<!\S)#\w[\w-]*")
_CODE = re.compile(r"(?<!\S)(?:[A-Z]{2,}[A-Z-]*-?\d+|-?\d+(?:[.,]\d+)?%?)(?!\S)")
_WORD = re.compile(r"\x00\w+\x00|[^\W_]+")
_ATTRIBUTION = re.compile(
    r"(?i)^(?:on\b.{4,120}\bwrote|am\b.{4,120}\bschrieb\b.{0,80}|le\b.{4,120}\ba écrit|el\b.{4,120}\bescribió\b.{0,80}|.{3,120}(?:wrote on|schrieb am|a écrit le|escribió el)\b.{4,40}|.{3,120}\bwrote)\s*:\s*$"
)
_ORIGINAL = re.compile(r"(?i)^\s*-{2,}\s*(?:original message|forwarded message|ursprüngliche nachricht|message d'origine|mensaje original)\s*-{2,}\s*$")
_RULE = re.compile(r"^\s*_{8,}\s*$")


def own_text(message: str | None) -> str:
    """A message's own text: decoded, without headers, quoted mail, signature, disclaimer and attachments. None and '' have none.

    Of alternatives the first counts, which is the plain one; forwarded and quoted originals and what follows them end it.
    """
    out = []
    for part in mail.parts(message):
        if part.attached or part.other:
            continue
        text = mail.plain(part.text, True) if part.kind == "html" else part.text
        kept, signed = [], False
        for line in text.split("\n"):
            bare = line.strip()
            if _ORIGINAL.match(line):
                break
            if bare.startswith(">") or _ATTRIBUTION.match(bare):
                signed = False if bare.startswith(">") is False else signed
                continue
            if _RULE.match(line):
                break
            if line.rstrip("\r") in ("-- ", "--"):
                signed = True
            if not signed:
                kept.append(line)
        out.append("\n".join(kept))
    return "\n".join(out)


def words_of(text: str) -> list[str]:
    """Words of a text, lower-cased; links, tags and codes are one masked word each."""
    text = _LINK.sub(" \x00link\x00 ", text)
    text = _TAGS.sub(" \x00tag\x00 ", text)
    text = _CODE.sub(" \x00code\x00 ", text)
    return [w.lower() if w[0] != "\x00" else w for w in _WORD.findall(text)]


def density(words: list[str]) -> float:
    """The share of words in lists: masked ones, and runs of at least RUN without a function word between them."""
    if not words:
        return 0.0
    listed = run = 0
    for w in [*words, "the"]:
        if w in FUNCTION:
            if run >= RUN:
                listed += run
            run = 0
        else:
            run += 1
    masked = sum(1 for w in words if w == "\x00link\x00" or w == "\x00tag\x00")
    return max(listed, masked) / len(words)


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def shingles(words: list[str]) -> list[int]:
    """Hashes of all runs of five words; of a shorter text, of the whole."""
    if len(words) < SHINGLE:
        return [_hash(" ".join(words))] if words else []
    return [_hash(" ".join(words[i : i + SHINGLE])) for i in range(len(words) - SHINGLE + 1)]


_PAIR = np.dtype([("shingle", "<i8"), ("host", "<i4")])
_OWN = np.dtype([("doc", "<i8"), ("shingle", "<i8"), ("density", "<f8"), ("times", "<i4"), ("total", "<i4")])


def _phrases(at_least: float):
    """Batches of messages to (pairs, own): the distinct shingles and hosts of all of them, and the shingles of those whose list density exceeds `at_least`, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for lo in range(0, len(texts), 1000):
                pairs, own = set(), []
                for doc, text in zip(docs[lo : lo + 1000], texts[lo : lo + 1000], strict=True):
                    words = words_of(own_text(text))
                    if not words:
                        continue
                    found, host, share = shingles(words), _hash(mail.sender(text)) & 0x7FFFFFFF, density(words)
                    pairs.update((s, host) for s in found)
                    if share > at_least:
                        own += [(doc, s, share, n, len(found)) for s, n in Counter(found).items()]
                yield pa.RecordBatch.from_arrays([pa.array([np.array(list(pairs), _PAIR).tobytes()], pa.binary()), pa.array([np.array(own, _OWN).tobytes()], pa.binary())], names=["pairs", "own"])

    return run


def _unpacked(column: str, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(column).to_pylist():
                rows = np.frombuffer(data, kind)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[c])) for c in kind.names], names=list(kind.names))

    return run


def evidence(documents: DataFrame, at_least: float = DENSITY) -> DataFrame:
    """(doc_id, density, stitched, replicated, hosts) of the messages whose list density exceeds `at_least`.

    `stitched` is the share of their shingles that more than one host has, `replicated` that of those which another host
    has or the message itself has again, `hosts` the greatest number of hosts of one of its shingles. Hosts are 32-bit hashes of
    the senders' addresses, counted exactly over all messages: pairs of shingle and host are made distinct in each
    thousand messages, then in two steps, so a phrase that everybody uses is spread by its hosts. Messages are decoded
    once and their phrases kept packed in a checkpoint. Null and empty texts, and those without words, have no evidence.
    """
    packed = cut(documents.select("doc_id", "text").mapInArrow(_phrases(at_least), "pairs binary, own binary"))
    hosts = packed.select("pairs").mapInArrow(_unpacked("pairs", _PAIR), "shingle long, host int").groupBy("shingle", "host").agg(F.lit(1).alias("one")).groupBy("shingle").agg(F.count("*").alias("hosts"))
    own = packed.select("own").mapInArrow(_unpacked("own", _OWN), "doc long, shingle long, density double, times int, total int")
    met = salted_join(own, hosts, ["shingle"], "inner")
    part = lambda c: (F.sum(F.when(c, F.col("times")).otherwise(0)) / F.max("total"))
    return met.groupBy(F.col("doc").alias("doc_id")).agg(F.max("density").alias("density"), part(F.col("hosts") > 1).alias("stitched"), part((F.col("hosts") > 1) | (F.col("times") > 1)).alias("replicated"), F.max("hosts").alias("hosts"))


def stuffed(documents: DataFrame, at_least: float = DENSITY, replicated: float = REPLICATED) -> DataFrame:
    """(doc_id): messages (doc_id, text) more than `at_least` of which is lists, and more than `replicated` of whose phrases occur elsewhere or again."""
    return evidence(documents, at_least).where(F.col("replicated") > replicated).select("doc_id").distinct()
