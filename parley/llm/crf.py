"""A linear-chain conditional random field over token features, in numpy.

A token's score for a label is the sum of the weights of its own features and of its neighbours' within WINDOW places.
Training maximises the penalised likelihood of a small labelled table by Adam over forward-backward expectations;
decoding is Viterbi over batches of sentences. Distinct tokens are looked up once, so long texts cost table gathers.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from parley.sources.tables import checkpoint_dir

WINDOW = 3
#: Decoding works on at most so many sentences at once, and so many places when all are padded to the longest; a longer sentence goes alone.
SENTENCES, PLACES = 4000, 400_000


class Crf:
    """labels: label 0 is the outside label. features: token to its features, strings."""

    def __init__(self, labels: list[str], features: Callable[[str], Iterable[str]], window: int = WINDOW):
        self.labels, self.features, self.window = labels, features, window
        self.index: dict[str, int] = {}
        self.types: dict[str, int] = {}

    def fit(self, sentences: list[list[tuple[str, str]]], steps: int = 120, penalty: float = 0.02, rate: float = 0.12, least: int = 2) -> Crf:
        """Learn from sentences of (token, label). Features of fewer than `least` distinct tokens' occurrences are dropped."""
        counts: dict[str, int] = {}
        cache: dict[str, list[str]] = {}
        for s in sentences:
            for tok, _ in s:
                feats = cache.setdefault(tok, list(self.features(tok)))
                for f in feats:
                    counts[f] = counts.get(f, 0) + 1
        self.index = {f: i for i, f in enumerate(sorted(f for f, c in counts.items() if c >= least))}
        kinds = {t: i for i, t in enumerate(cache)}
        lists = [[self.index[f] for f in cache[t] if f in self.index] for t in kinds] + [[len(self.index)]]  # the last token is beyond the sentence
        lens = np.array([len(x) for x in lists])
        flat, owner = np.concatenate([np.array(x, int) for x in lists]), np.repeat(np.arange(len(lists)), lens)
        by_feature = np.argsort(flat, kind="stable")
        feature_starts = np.flatnonzero(np.diff(flat[by_feature], prepend=-1))
        some = np.flatnonzero(lens)
        starts = (np.cumsum(lens) - lens)[some]
        K, O = len(self.labels), 2 * self.window + 1
        code = {x: i for i, x in enumerate(self.labels)}
        n, T = len(sentences), max(map(len, sentences))
        X = np.full((n, T + 2 * self.window), len(kinds))
        Y, mask = np.zeros((n, T), int), np.zeros((n, T), bool)
        for r, s in enumerate(sentences):
            for t, (tok, lab) in enumerate(s):
                X[r, t + self.window], Y[r, t], mask[r, t] = kinds[tok], code[lab], True
        W, A = np.zeros((len(self.index) + 1, O * K), np.float32), np.zeros((K, K), np.float32)
        moments = [np.zeros_like(W), np.zeros_like(W), np.zeros_like(A), np.zeros_like(A)]
        gold = np.eye(K, dtype=np.float32)[Y] * mask[..., None]
        gold_pairs = np.einsum("ntk,ntl->kl", gold[:, :-1], gold[:, 1:])
        seen = [X[:, o : o + T][mask] for o in range(O)]
        order = [np.argsort(x, kind="stable") for x in seen]
        heads = [np.flatnonzero(np.diff(x[i], prepend=-1)) for x, i in zip(seen, order, strict=True)]
        for step in range(1, steps + 1):
            scores = np.zeros((len(lists), O * K), np.float32)
            scores[some] = np.add.reduceat(W[flat], starts)
            scores = scores.reshape(-1, O, K)
            E = sum(scores[X[:, o : o + T], o] for o in range(O))
            P, pairs = _expect(E, A, mask)
            d = (gold - P).astype(np.float32)
            G, d = np.zeros((len(lists), O, K), np.float32), d[mask]
            for o in range(O):
                G[seen[o][order[o][heads[o]]], o] = np.add.reduceat(d[order[o]], heads[o])
            back = np.zeros_like(W)
            back[flat[by_feature[feature_starts]]] = np.add.reduceat(G.reshape(len(lists), -1)[owner[by_feature]], feature_starts)
            grads = (back - penalty * W, gold_pairs - pairs - penalty * A)
            for k, (w, g) in enumerate(((W, grads[0]), (A, grads[1]))):
                m, v = moments[2 * k], moments[2 * k + 1]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        self.weights, self.trans = W.reshape(-1, O, K), A
        self._start()
        return self

    def _start(self) -> None:
        self.types = {}
        self.table = np.zeros((1024, 2 * self.window + 1, len(self.labels)), np.float32)
        self.table[0] = self.weights[-1]  # type 0: beyond the sentence
        self.used = 1
        away = self.trans.max(axis=0)
        # an all-outside path wins if no token gains more by another label than leaving and returning can pay
        self.slack = float(max(0.0, 2 * (max(self.trans.max(), away.max()) - self.trans[0, 0])))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("types", "table", "used")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, weights=self.weights, trans=self.trans, index=np.frombuffer(json.dumps(list(self.index)).encode(), np.uint8))
        return out.getvalue()

    def from_bytes(self, data: bytes) -> Crf:
        with np.load(io.BytesIO(data), allow_pickle=False) as x:
            self.weights, self.trans = x["weights"], x["trans"]
            self.index = {f: i for i, f in enumerate(json.loads(x["index"].tobytes()))}
        self._start()
        return self

    def code(self, tokens: list[str]) -> np.ndarray:
        """Numbers of the tokens in the table of scores; new ones are added."""
        if self.used > 400_000:
            self._start()
        types, new = self.types, []
        for t in set(tokens):
            if t not in types:
                types[t] = self.used + len(new)
                new.append(t)
        if new:
            while self.used + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for k, t in enumerate(new):
                at = [self.index[f] for f in self.features(t) if f in self.index]
                self.table[self.used + k] = self.weights[at].sum(axis=0) if at else 0
            self.used += len(new)
        return np.fromiter((types[t] for t in tokens), np.int64, len(tokens))

    def decode(self, tokens: list[str], sizes: np.ndarray) -> np.ndarray:
        """Labels, as numbers, of the tokens of consecutive sentences of the given sizes: the best paths."""
        n = len(tokens)
        out = np.zeros(n, np.int8)
        if not n:
            return out
        sizes = np.asarray(sizes, np.int64)
        sizes = sizes[sizes > 0]
        w, ends = self.window, np.cumsum(sizes)
        starts = ends - sizes
        padded = np.zeros(n + w * (len(sizes) + 1), np.int64)
        place = np.arange(n) + w * (np.repeat(np.arange(len(sizes)), sizes) + 1)
        padded[place] = self.code(tokens)
        E = self.table[padded[place - w], 0]
        for o in range(1, 2 * w + 1):
            E += self.table[padded[place - w + o], o]
        gain = E[:, 1:].max(axis=1) - E[:, 0]
        work = np.flatnonzero(np.maximum.reduceat(gain, starts) + self.slack > 0)
        work = work[np.argsort(sizes[work], kind="stable")]
        for some in _groups(work, sizes[work]):
            T = int(sizes[some].max())
            at = starts[some][:, None] + np.arange(T)
            inside = np.arange(T) < sizes[some][:, None]
            e = E[np.where(inside, at, 0)]
            best, back = e[:, 0].copy(), np.zeros((T, len(some), e.shape[2]), np.int8)
            for t in range(1, T):
                s = best[:, :, None] + self.trans
                back[t] = s.argmax(axis=1)
                nxt = s.max(axis=1) + e[:, t]
                best = np.where(inside[:, t, None], nxt, best)
                back[t][~inside[:, t]] = np.arange(e.shape[2])
            lab = best.argmax(axis=1)
            rows = np.arange(len(some))
            for t in range(T - 1, -1, -1):
                out[at[inside[:, t], t]] = lab[inside[:, t]]
                lab = back[t, rows, lab]
        return out


def _groups(work: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of work, whose sizes ascend, within SENTENCES and PLACES."""
    k = 0
    while k < len(work):
        padded = sizes[k : k + SENTENCES] * np.arange(1, len(sizes[k : k + SENTENCES]) + 1)
        n = max(1, int(np.searchsorted(padded, PLACES, side="right")))
        yield work[k : k + n]
        k += n


def _expect(E: np.ndarray, A: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal probabilities of labels, and expected counts of neighbouring labels."""
    n, T, K = E.shape
    M = np.exp(A)
    e = np.exp(E - E.max(axis=2, keepdims=True))
    f, scale = np.zeros_like(e), np.ones((n, T), np.float32)
    f[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, T):
        x = (f[:, t - 1] @ M) * e[:, t]
        scale[:, t] = x.sum(axis=1)
        f[:, t] = np.where(mask[:, t, None], x / scale[:, t, None], f[:, t - 1])
    b = np.ones_like(e)
    for t in range(T - 2, -1, -1):
        x = (e[:, t + 1] * b[:, t + 1]) @ M.T / scale[:, t + 1, None]
        b[:, t] = np.where(mask[:, t + 1, None], x, 1)
    P = f * b
    P = P / P.sum(axis=2, keepdims=True) * mask[..., None]
    both = mask[:, 1:]
    pairs = np.einsum("ntk,ntl->kl", f[:, :-1] * both[..., None], e[:, 1:] * b[:, 1:] / scale[:, 1:, None]) * M
    return P, pairs


_TRAINED: dict[str, Crf] = {}


def stored(spark: SparkSession, name: str, field: Crf, table: Callable[[], list[list[tuple[str, str]]]], steps: int) -> Crf:
    """The field trained on `table`, kept in this process and, as one row, in the folder that stages share.

    The folder's name tells what the field was trained from: labels, sentences with their features, and steps. A copy
    that can't be read is trained anew and written again.
    """
    sentences = table()
    words = sorted({t for s in sentences for t, _ in s})
    key = f"{name}-{xxhash.xxh3_64_hexdigest(json.dumps([field.labels, field.window, steps, sentences, [list(field.features(w)) for w in words]]))}"
    if key not in _TRAINED:
        path = f"{checkpoint_dir(spark)}/../models/{key}"
        try:
            _TRAINED[key] = field.from_bytes(bytes(spark.read.schema("model binary").parquet(path).first()["model"]))
        except (AnalysisException, TypeError, ValueError, OSError):
            _TRAINED[key] = field.fit(sentences, steps=steps)
            spark.createDataFrame([(_TRAINED[key].to_bytes(),)], "model binary").write.mode("overwrite").parquet(path)
    return _TRAINED[key]
