"""Near-duplicate records: distinct-word sets whose Jaccard similarity reaches a threshold."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.sketch import bands, placed
from parley.operators.skew import salted_join
from parley.sources.tables import cut

ROWS, BANDS = 5, 32
#: Bytes of a word's hash that the check compares, and of a band's that name a bucket within a partition.
HASH, TAIL = 5, 5
#: Buckets and copies are worked on where they lie up to this size; larger ones are cut into blocks of it, whose pairs are spread over tasks.
BLOCK = 4096
#: Classes that a partition remembers so as not to sketch them twice, and words of which it keeps hashes; beyond that it starts anew.
SEEN, VOCABULARY = 500_000, 200_000

_WORD = re.compile(r"[^\W_]+")
_PARITIES, _TOP = 120, np.uint64(56)
_MASK = np.array([(1 << 64) - 1, (1 << 56) - 1], np.uint64)


def words(text: str) -> set[str]:
    """The distinct words of a text: maximal runs of letters and digits, lower-cased."""
    return set(_WORD.findall(text.lower()))


class _Hashes(dict):
    """Pieces of text to the hashes of their words; a bounded cache."""

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > VOCABULARY:
            self.clear()
        h = self[piece] = tuple(map(xxhash.xxh3_64_intdigest, _WORD.findall(piece.lower())))
        return h


def word_sets(texts: pa.Array, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, codes, offsets): the set of text k is base[codes[offsets[k]:offsets[k + 1]]], 64-bit hashes of its distinct words, ascending.

    Pieces between blanks are split off and told apart in Arrow, so each piece of a batch is taken apart once. Null texts have none.
    """
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = pc.dictionary_encode(parts.flatten())
    each = [hashes[p] for p in flat.dictionary.to_pylist()]
    many = np.array([len(x) for x in each], np.int64)
    base, code = np.unique(np.array([h for x in each for h in x], np.uint64), return_inverse=True)
    first = np.cumsum(many) - many
    at = flat.indices.to_numpy()
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy())
    times = many[at]
    if (times != 1).any():  # pieces of no or several words
        row = np.repeat(row, times)
        ends = np.cumsum(times)
        place = np.repeat(first[at] - (ends - times), times) + np.arange(ends[-1] if len(ends) else 0)
    else:
        place = first[at]
    key = row << 32 | code[place]
    key.sort()
    key = key[np.diff(key, prepend=-1) != 0]
    return base, key & 0xFFFFFFFF, np.searchsorted(key >> 32, np.arange(len(texts) + 1))


def _seed(tbl: str | None) -> int:
    return xxhash.xxh3_64_intdigest("\n" + str(tbl))


def nodes(tbl: pa.Array, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class of each word set within its table: a 64-bit hash of its words' hashes in order. n distinct sets make a false class with a chance of n**2 / 2**65."""
    data, at, names = values.tobytes(), (offsets * 8).tolist(), tbl.to_pylist()
    seeds = {t: _seed(t) for t in set(names)}
    return np.array([xxhash.xxh3_64_intdigest(data[i:j], seeds[t]) for t, i, j in zip(names, at, at[1:], strict=False)], np.uint64).view(np.int64)


def _cut_hashes(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Sets as binary: the lowest HASH bytes of each hash."""
    data = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH].tobytes()
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * HASH).astype(np.int32)), pa.py_buffer(data)])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for b in batches:
        base, codes, offsets = word_sets(b.column("text"), hashes)
        values = base[codes]
        some = pa.array(np.diff(offsets) > 0)
        out = [b.column("tbl"), b.column("key"), pa.array(nodes(b.column("tbl"), values, offsets)), _cut_hashes(values, offsets)]
        yield pa.RecordBatch.from_arrays(out, names=["tbl", "key", "node", "packed"]).filter(some)


def members(texts: DataFrame) -> DataFrame:
    """(tbl, key, node): the class of equal word sets of each record of texts (tbl, key, text).

    Texts that are null or without words have none; rows delivered twice come out once. Other columns aren't read.
    """
    return texts.select("tbl", "key", "text").mapInArrow(_records, "tbl string, key long, node long, packed binary").select("tbl", "key", "node").distinct()


def parities(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two longs for each set of hashes: the parity of the number of its elements in each of 120 classes, and its size, at most 255, in the last byte.

    Sets whose parities differ in d places differ in at least d elements. Sets must not be empty.
    """
    place = (values >> np.uint64(8)) % np.uint64(_PARITIES)
    bit = np.uint64(1) << (place & np.uint64(63))
    out = np.stack([np.bitwise_xor.reduceat(np.where(place >> np.uint64(6) == half, bit, np.uint64(0)), offsets[:-1]) for half in (0, 1)], axis=1)
    out[:, 1] |= np.minimum(np.diff(offsets), 255).astype(np.uint64) << _TOP
    return out


def _packed_entries(node: np.ndarray, parity: np.ndarray, band: np.ndarray, count: int) -> Iterator[tuple[int, bytes]]:
    """(part, data) for each partition that the bands [n, m] of n sets go to: its sets once, and the tails of their bands there."""
    n, m = band.shape
    flat = band.ravel().view(np.uint64)
    part = (flat % np.uint64(count)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    where, tail = order // m, (flat[order] >> np.uint64(24)).astype("<u8")
    heads = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(order)], strict=True):
        first = np.flatnonzero(np.diff(where[a:b], prepend=-1))
        own = where[a:b][first]
        times = np.diff(first, append=b - a).astype(np.uint8)
        yield int(part[order[a]]), np.int64(len(own)).tobytes() + node[own].tobytes() + parity[own].tobytes() + times.tobytes() + tail[a:b].view(np.uint8).reshape(-1, 8)[:, :TAIL].tobytes()


def _entries(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(band, node, parity) of packed entries."""
    n = int(np.frombuffer(data, np.int64, 1)[0])
    node, parity, times = np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.uint64, 2 * n, 8 + 8 * n).reshape(-1, 2), np.frombuffer(data, np.uint8, n, 8 + 24 * n)
    tails = np.frombuffer(data, np.uint8, -1, 8 + 25 * n).reshape(-1, TAIL)
    band = np.zeros((len(tails), 8), np.uint8)
    band[:, :TAIL] = tails
    return band.view(np.uint64).ravel(), np.repeat(node, times), np.repeat(parity, times, axis=0)


def _banded(rows: int, count: int, parts: int):
    """Batches of texts to (part, data): packed entries. A class is sketched once for each task, from all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        hashes = _Hashes()
        for b in batches:
            base, codes, offsets = word_sets(b.column("text"), hashes)
            node = nodes(b.column("tbl"), base[codes], offsets)
            sizes = np.diff(offsets)
            fresh = [k for k, x in enumerate(node.tolist()) if sizes[k] and x not in seen and not (len(seen) < SEEN and seen.add(x))]
            if not fresh:
                continue
            sizes = sizes[fresh]
            ends = np.cumsum(sizes)
            codes = codes[np.repeat(offsets[fresh] - (ends - sizes), sizes) + np.arange(ends[-1])]
            offsets = np.concatenate([[0], ends])
            salt = np.array([_seed(t) for t in b.column("tbl").take(pa.array(fresh)).to_pylist()], np.uint64).view(np.int64)
            band = bands(placed(base, codes, offsets, rows * count), rows) ^ salt[:, None]
            out = list(_packed_entries(node[fresh], parities(base[codes], offsets), band, parts))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["part", "data"])

    return run


def _fitting(node: np.ndarray, parity: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the sets at x and y are two whose sizes and parities allow the threshold.

    Sets of n words in all that reach it differ in at most n (1 - threshold) / (1 + threshold) of them, so in no more parities.
    """
    a, b = parity[x], parity[y]
    size = (a[:, 1] >> _TOP).astype(np.int64), (b[:, 1] >> _TOP).astype(np.int64)
    low, high = np.minimum(*size), np.maximum(*size)
    apart = np.bitwise_count((a ^ b) & _MASK).sum(axis=1)
    return (node[x] != node[y]) & ((high == 255) | (low >= high * threshold - 1e-9) & (apart <= (low + high) * ((1 - threshold) / (1 + threshold)) + 1e-6))


def _ordered(node: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(node[x], node[y]), np.maximum(node[x], node[y])


_WORK = "node_a long, node_b long, a binary, b binary"


def _pairs(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.nulls(len(left), pa.binary()), pa.nulls(len(left), pa.binary())], names=["node_a", "node_b", "a", "b"])


def _work(blocks: list[bytes]) -> pa.RecordBatch:
    """The last block with each block before, and with itself."""
    n = len(blocks)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(blocks, pa.binary()), pa.array(blocks[-1:] * n, pa.binary())], names=["node_a", "node_b", "a", "b"])


def _bucket_pairs(threshold: float, block: int):
    """The packed entries of a partition to the pairs of its buckets that fit; of buckets over `block`, to pairs of blocks of (node, parity)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [_entries(d) for b in batches for d in b.column("data").to_pylist()]
        if not got:
            return
        band, node, parity = (np.concatenate([e[k] for e in got]) for k in range(3))
        del got
        order = np.argsort(band, kind="stable")
        band, node, parity = band[order], node[order], parity[order]
        heads = np.flatnonzero(np.diff(band, prepend=~band[:1]))
        sizes = np.diff(heads, append=len(band))
        small = np.ones(len(band), bool)
        for k in np.flatnonzero(sizes > block).tolist():
            own, first = np.unique(node[heads[k] : heads[k] + sizes[k]], return_index=True)
            small[heads[k] : heads[k] + sizes[k]] = False
            blocks: list[bytes] = []
            for i in range(0, len(own), block):
                blocks.append(own[i : i + block].tobytes() + parity[heads[k] + first[i : i + block]].tobytes())
                yield _work(blocks)
        band, node, parity = band[small], node[small], parity[small]
        at, k = np.arange(len(band)), 1
        while len(at):
            at = at[: np.searchsorted(at, len(band) - k)]
            at = at[band[at] == band[at + k]]
            fit = at[_fitting(node, parity, at, at + k, threshold)]
            if len(fit):
                yield _pairs(*_ordered(node, fit, fit + k))
            k += 1

    return run


def _compared(threshold: float):
    """Pairs of nodes as they are, and pairs of blocks of (node, parity) to the pairs of their nodes that fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ready = batch.filter(pc.is_valid(batch.column("node_a")))
            yield ready.select(["node_a", "node_b"])
            blocks = batch.filter(pc.is_null(batch.column("node_a")))
            for a, b in zip(blocks.column("a").to_pylist(), blocks.column("b").to_pylist(), strict=True):
                n, m = len(a) // 24, len(b) // 24
                node = np.concatenate([np.frombuffer(a, np.int64, n), np.frombuffer(b, np.int64, m)])
                parity = np.concatenate([np.frombuffer(a, np.uint64, -1, 8 * n), np.frombuffer(b, np.uint64, -1, 8 * m)]).reshape(-1, 2)
                for lo in range(0, n, 64):
                    x, y = np.divmod(np.arange(min(64, n - lo) * m), m)
                    x, y = x + lo, y + n
                    if a == b:
                        x, y = x[y - n > x], y[y - n > x]
                    fit = _fitting(node, parity, x, y, threshold)
                    if fit.any():
                        left, right = _ordered(node, x[fit], y[fit])
                        yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names=["node_a", "node_b"])

    return run


def _spread(work: DataFrame, key: str) -> DataFrame:
    """Work spread over tasks: pairs by `key`, pairs of blocks each by itself."""
    return work.repartition(F.coalesce(key, F.xxhash64("a", "b")))


def candidates(texts: DataFrame, threshold: float = 0.7, rows: int = ROWS, count: int = BANDS, block: int = BLOCK) -> DataFrame:
    """(node_a, node_b), node_a < node_b: different classes of one table that share a bucket and whose sizes and parities allow the threshold.

    The sketches take all words of a set, so the chance of missing a pair of similarity s is (1 - s**rows)**count
    whatever the frequencies of its words; `rows` coordinates make a band and name a bucket. Texts that share only
    common words meet in buckets too; their parities, which never part a pair that reaches the threshold, tell most of
    these from near copies, up to about 200 words. Entries go to their partition packed, a set once for all its bands
    there. A bucket over `block` is compared in pairs of blocks, spread over tasks; nothing is capped. A task that holds
    such a bucket keeps 24 bytes for each of its sets.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    banded = texts.select("tbl", "key", "text").mapInArrow(_banded(rows, count, parts), "part int, data binary").repartitionById(parts, "part")
    found = _spread(banded.mapInArrow(_bucket_pairs(threshold, block), _WORK), "node_a")
    return found.mapInArrow(_compared(threshold), "node_a long, node_b long").distinct()


def _never_null(names: str) -> T.StructType:
    """Fields that are never null, so joins on them add no filter and their exchanges can be shared."""
    kinds = {"tbl": T.StringType(), "packed": T.BinaryType()}
    return T.StructType([T.StructField(c, kinds.get(c, T.LongType()), False) for c in names.split()])


def records(texts: DataFrame) -> DataFrame:
    """(tbl, key, node, packed) of texts (tbl, key, text), spread by node: the word set of each record, packed."""
    return texts.select("tbl", "key", "text").mapInArrow(_records, _never_null("tbl key node packed")).repartition("node")


def _distinct_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for b in _records(batches):
        fresh = [k for k, x in enumerate(b.column("node").to_pylist()) if x not in seen and not (len(seen) < SEEN and seen.add(x))]
        yield b.select(["node", "packed"]).take(pa.array(fresh, pa.int64()))


def _checked(threshold: float, names: list[str]):
    """Batches with two packed sets a and b to the rows that reach the threshold: the columns `names` and their similarity.

    Where there are tables tbl_a and tbl_b, they must agree. Words are shared that have equal hashes of HASH bytes; all
    pairs of a batch are compared in one sort.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, keys = np.zeros(batch.num_rows, np.int64), []
            for c in ("a", "b"):
                x = batch.column(c)
                n = pc.binary_length(x).to_numpy().astype(np.int64) // HASH
                wide = np.zeros((int(n.sum()), 8), np.uint8)
                wide[:, :HASH] = np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, HASH)
                total += n
                keys.append(wide.view("<u8").ravel() | np.repeat(np.arange(len(n), dtype=np.uint64) << np.uint64(8 * HASH), n))
            key = np.sort(np.concatenate(keys))
            both = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(8 * HASH)).astype(np.int64), minlength=batch.num_rows)
            either = total - both
            fit = both >= threshold * either - 1e-9
            if "tbl_b" in batch.schema.names:
                fit &= pc.equal(batch.column("tbl_a"), batch.column("tbl_b")).to_numpy(zero_copy_only=False).astype(bool)
            at = pa.array(np.flatnonzero(fit))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in names] + [pa.array((both / np.maximum(either, 1))[fit])], names=[*names, "similarity"])

    return run


_COPIES = "tbl string, ka long, kb long, a binary, b binary"


def _copies(size: int):
    """Batches of records, sorted by class, table, set and key, to the pairs of keys whose sets are equal; of more than `size` keys, to pairs of blocks of keys."""
    names = [x.split()[0] for x in _COPIES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended() -> Iterator[pa.RecordBatch]:
            if blocks and keys:
                blocks.append(np.array(keys, np.int64).tobytes())
                yield work()
            elif len(keys) > 1:
                own = np.array(keys, np.int64)
                for i in range(0, len(own), 512):
                    x, y = np.divmod(np.arange(min(512, len(own) - i) * len(own)), len(own))
                    later = y > x + i
                    n = int(later.sum())
                    yield pa.RecordBatch.from_arrays([pa.array([now[1]] * n, pa.string()), pa.array(own[x[later] + i]), pa.array(own[y[later]]), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=names)

        def work() -> pa.RecordBatch:
            n = len(blocks)
            return pa.RecordBatch.from_arrays([pa.array([now[1]] * n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(blocks, pa.binary()), pa.array(blocks[-1:] * n, pa.binary())], names=names)

        now: list = [None]
        keys: list[int] = []
        blocks: list[bytes] = []
        for batch in batches:
            for key, *at in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "tbl", "packed")), strict=True):
                if at != now:
                    yield from ended()
                    now, keys, blocks = at, [key], []
                elif not keys or key != keys[-1]:
                    keys.append(key)
                    if len(keys) > size:
                        blocks.append(np.array(keys[:-1], np.int64).tobytes())
                        yield work()
                        keys = keys[-1:]
        yield from ended()

    return run


def _crossed_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of keys as they are, and pairs of blocks of keys to all pairs of their keys."""
    for batch in batches:
        yield batch.filter(pc.is_valid(batch.column("ka"))).select(["tbl", "ka", "kb"])
        blocks = batch.filter(pc.is_null(batch.column("ka")))
        for tbl, a, b in zip(*(blocks.column(c).to_pylist() for c in ("tbl", "a", "b")), strict=True):
            left, right = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
            for i in range(0, len(left), 64):
                x, y = np.divmod(np.arange(min(64, len(left) - i) * len(right)), len(right))
                keep = y > x + i if a == b else slice(None)
                x, y = left[x[keep] + i], right[y[keep]]
                yield pa.RecordBatch.from_arrays([pa.array([tbl] * len(x), pa.string()), pa.array(x), pa.array(y)], names=["tbl", "ka", "kb"])


def similar_sets(texts: DataFrame, threshold: float = 0.7, block: int = BLOCK) -> DataFrame:
    """(node_a, node_b, similarity), node_a < node_b: different classes of word sets of one table at least `threshold` alike.

    texts: (tbl, key, text). Candidates are checked on all their words by 40-bit hashes: two sets of n and m words agree
    falsely in one with a chance of n m / 2**40. A copy is dropped where it is read, so hot classes have few rows. An
    empty table gives no rows.
    """
    sets = texts.select("tbl", "key", "text").mapInArrow(_distinct_sets, _never_null("node packed")).repartition("node").groupBy("node").agg(F.min("packed").alias("packed"))
    both = candidates(texts, threshold, block=block).join(sets.select(F.col("node").alias("node_a"), F.col("packed").alias("a")), "node_a")
    both = both.join(sets.select(F.col("node").alias("node_b"), F.col("packed").alias("b")), "node_b").select("node_a", "node_b", "a", "b")
    return both.mapInArrow(_checked(threshold, ["node_a", "node_b"]), "node_a long, node_b long, similarity double")


def similar_pairs(texts: DataFrame, threshold: float = 0.7, block: int = BLOCK) -> DataFrame:
    """(tbl, id_a, id_b), id_a < id_b: all pairs of records of one table whose word sets are at least `threshold` alike.

    As similar_sets, with the keys of each class in place of the class, and the pairs within a class added, in blocks
    where it is large; so the rows grow with the square of the copies of a text, which is what this form asks for. Keys
    with several texts count once.
    """
    every = records(texts)
    side = lambda x: every.select(F.col("tbl").alias(f"tbl_{x}"), F.col("key").alias(f"k{x}"), F.col("node").alias(f"node_{x}"), F.col("packed").alias(x))
    # every column of both sides is used, so that all three readers share one exchange of the records
    both = candidates(texts, threshold, block=block).join(side("a"), "node_a").join(side("b"), "node_b").where("ka <> kb").select("tbl_a", "tbl_b", "ka", "kb", "a", "b")
    linked = both.mapInArrow(_checked(threshold, ["tbl_a", "ka", "kb"]), "tbl_a string, ka long, kb long, similarity double").select(F.col("tbl_a").alias("tbl"), "ka", "kb")
    same = _spread(every.sortWithinPartitions("node", "tbl", "packed", "key").mapInArrow(_copies(block), _COPIES), "ka").mapInArrow(_crossed_keys, "tbl string, ka long, kb long")
    pairs = linked.unionByName(same)
    return pairs.select("tbl", F.least("ka", "kb").alias("id_a"), F.greatest("ka", "kb").alias("id_b")).distinct()


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, class_id): connected components of the nodes in links (node_a, node_b); class_id is the least node of each.

    Each round every node takes the least label among its own and its neighbours', then the label of its label
    (pointer jumping), so long chains need few rounds; each round is a checkpoint in the shared folder. Neighbours'
    labels are combined on the map side; hubs, and the label of a giant component, are salted.
    """
    edges = cut(links.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).unionByName(links.select(F.col("node_b").alias("a"), F.col("node_a").alias("b"))).distinct())
    labels = cut(edges.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    for _ in range(rounds):
        near = salted_join(edges, labels.withColumnRenamed("node", "b"), ["b"], "inner").groupBy("a").agg(F.min("label").alias("near"))
        nxt = cut(labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("label")))
        jump = nxt.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = cut(salted_join(nxt, jump, ["label"], "left").select("node", F.least("label", F.coalesce("root", "label")).alias("new")))
        moved = new.join(labels, "node").where("new <> label").limit(1).count()
        labels = new.select("node", F.col("new").alias("label"))
        if not moved:
            return labels.select("node", F.col("label").alias("class_id"))
    raise RuntimeError(f"no fixed point after {rounds} rounds")
