"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = (
    "log_bytes",
    "log_words",
    "word_mean",
    "word_dev",
    "upper",
    "lower",
    "digit",
    "space",
    "stop",
    "bang",
    "bar",
    "odd",
    "quote",
    "high",
    "distinct",
    "top_word",
    "same_word",
    "capital",
    "lines",
    "line_mean",
    "same_line",
    "entropy",
    "short_word",
    "long_word",
    "ended",
)
_CLASS = np.zeros((256, 9))
for _k, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), (32, 9, 10, 11, 12, 13), b".,;:?", b"!", b"|", b"#$%&*<>{}[]=+~^_\\/@", b"\"'`()")):
    _CLASS[list(_chars), _k] = 1


def text_features(text: str) -> np.ndarray:
    """Numbers that describe a whole text; all zero for one without words."""
    out = np.zeros(len(FEATURES))
    words = text.split()
    if not words:
        return out
    data = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(data, minlength=256).astype(float)
    share = counts / len(data)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x]
    kinds = share @ _CLASS
    out[0], out[1] = np.log1p(len(data)), np.log1p(len(words))
    out[2], out[3] = sizes.mean(), sizes.std()
    out[4:13] = kinds
    out[13] = share[128:].sum()
    # how many of so many words are new falls with the length in any text, so it is measured against the length
    out[14] = np.log(len(seen) + 1) / np.log(len(words) + 1)
    out[15] = max(seen.values()) / len(words)
    out[16] = sum(map(str.__eq__, words, words[1:])) / len(words)
    out[17] = sum(w[0].isupper() for w in words) / len(words)
    out[18], out[19] = np.log1p(len(lines)), np.log1p(len(text) / max(1, len(lines)))
    out[20] = 1 - len(set(lines)) / max(1, len(lines))
    used = share[share > 0]
    out[21] = -(used * np.log2(used)).sum()
    out[22], out[23] = (sizes <= 3).mean(), (sizes >= 12).mean()
    out[24] = sum(w[-1] in ".!?" for w in words) / len(words)
    return out


def feature_rows(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in ``keep`` and ``x array<double>``, the features of every whole text."""
    kinds = dict(documents.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                x = np.array([text_features(t or "") for t in part.column(0).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(1 + i) for i in range(len(keep))), lists], names=[*keep, "x"])

    return documents.select("text", *keep).mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keep), "x array<double>"]))


def best_splits(grad: np.ndarray, hess: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Values of a shallow tree over ordered bins: the leaf that each bin falls into, grown best first."""
    value = np.zeros(len(grad))
    parts = [(0, len(grad))]

    def gain(lo: int, hi: int):
        g, h = np.cumsum(grad[lo:hi]), np.cumsum(hess[lo:hi])
        if hi - lo < 2:
            return 0.0, lo
        left_g, left_h, right_h = g[:-1], h[:-1], h[-1] - h[:-1]
        ok = (left_h >= least) & (right_h >= least)
        if not ok.any():
            return 0.0, lo
        score = np.where(ok, left_g**2 / (left_h + 1) + (g[-1] - left_g) ** 2 / (right_h + 1) - g[-1] ** 2 / (h[-1] + 1), -1)
        at = int(score.argmax())
        return float(score[at]), lo + at + 1

    while len(parts) < leaves:
        found = [(*gain(*p), p) for p in parts]
        score, at, p = max(found)
        if score <= 1e-9:
            break
        parts.remove(p)
        parts += [(p[0], at), (at, p[1])]
    for lo, hi in parts:
        value[lo:hi] = grad[lo:hi].sum() / (hess[lo:hi].sum() + 1)
    return value


class AdditiveModel:
    """Log odds as a sum of lookup tables, one for each feature and for each chosen pair of features."""

    def __init__(self, bins: int = 32, pair_bins: int = 8, pairs: int = 6, rounds: int = 120, pair_rounds: int = 60, rate: float = 0.15, leaves: int = 3, least: float = 1.0):
        self.bins, self.pair_bins, self.n_pairs, self.rounds, self.pair_rounds = bins, pair_bins, pairs, rounds, pair_rounds
        self.rate, self.leaves, self.least = rate, leaves, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        """Cyclic boosting: every round visits every feature once and adds a small tree to its table."""
        cut = lambda n: [np.unique(np.quantile(c, np.linspace(0, 1, n + 1)[1:-1])) for c in x.T] if len(x) else [np.zeros(0)] * x.shape[1]
        self.cuts, self.pair_cuts = cut(self.bins), cut(self.pair_bins)
        rate = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(rate / (1 - rate)))
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs, self.pair_tables = [], []
        b = self._bin(x, self.cuts)
        odds = np.full(len(y), self.base)
        for _ in range(self.rounds if len(y) else 0):
            for f, table in enumerate(self.tables):
                if len(table) < 2:
                    continue
                p = 1 / (1 + np.exp(-odds))
                step = self.rate * best_splits(np.bincount(b[f], y - p, len(table)), np.bincount(b[f], p * (1 - p), len(table)), self.leaves, self.least)
                table += step
                odds += step[b[f]]
        if not len(y):
            return self
        c = self._bin(x, self.pair_cuts)
        p = 1 / (1 + np.exp(-odds))
        gains = []
        for f in range(len(c)):
            for g in range(f):
                k = c[f] * self.pair_bins + c[g]
                grad, hess = np.bincount(k, y - p), np.bincount(k, p * (1 - p))
                gains.append((float((grad**2 / (hess + 5)).sum()), f, g))
        self.pairs = [(f, g) for _, f, g in sorted(gains, reverse=True)[: self.n_pairs]]
        self.pair_tables = [np.zeros((self.pair_bins, self.pair_bins)) for _ in self.pairs]
        for _ in range(self.pair_rounds):
            for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
                p = 1 / (1 + np.exp(-odds))
                k = c[f] * self.pair_bins + c[g]
                grad = np.bincount(k, y - p, table.size).reshape(table.shape)
                hess = np.bincount(k, p * (1 - p), table.size).reshape(table.shape)
                step = self.rate * self._pair_tree(grad, hess)
                table += step
                odds += step.ravel()[k]
        return self

    def _pair_tree(self, grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
        """The better of two trees that split first on one feature and then, on either side, on the other."""
        best, score = np.zeros_like(grad), 0.0
        for turn in (False, True):
            g, h = (grad.T, hess.T) if turn else (grad, hess)
            for at in range(1, len(g)):
                value = np.concatenate([np.repeat(best_splits(g[s].sum(0), h[s].sum(0), 2, self.least)[None], n, 0) for s, n in ((slice(0, at), at), (slice(at, None), len(g) - at))])
                gain = (value * g - 0.5 * value * value * (h + 1 / g.size)).sum()
                if gain > score:
                    best, score = value.T if turn else value, gain
        return best

    @staticmethod
    def _bin(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, col, side="right") for c, col in zip(cuts, x.T, strict=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities: each feature's and pair's bin adds its table's entry."""
        odds = np.full(len(x), self.base)
        for b, table in zip(self._bin(x, self.cuts), self.tables, strict=True):
            odds += table[b]
        if self.pairs:
            c = self._bin(x, self.pair_cuts)
            for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
                odds += table[c[f], c[g]]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def train(documents: DataFrame, labels: DataFrame, rows: int = 20_000) -> AdditiveModel:
    """Fit on the features of at most ``rows`` labelled documents outside the held-out fifth."""
    from .common import labelled_sample

    found = feature_rows(labelled_sample(documents, labels, "quality", rows), ["doc_id", "y"]).select("doc_id", "y", "x").toArrow()
    x, y, ids = np.array(found["x"].to_pylist()).reshape(-1, len(FEATURES)), found["y"].to_numpy().astype(float), found["doc_id"].to_numpy()
    order = np.lexsort((x[:, 0], y, ids)) if len(y) else np.zeros(0, int)
    return AdditiveModel().fit(x[order], y[order])


def score_quality(documents: DataFrame, model: AdditiveModel, threshold: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, score double, predicted int`` and the columns in ``keep``, a row a row of the input.

    Whole texts are scored, with nothing but the text as input; null texts count as empty, and a
    text without words has the score of all features zero. ``predicted`` is 1 from ``threshold`` on.
    """
    kinds = dict(documents.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                s = model.score(np.array([text_features(t or "") for t in part.column(1).to_pylist()]))
                out = {"doc_id": part.column(0), "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))}
                yield pa.RecordBatch.from_pydict(out | {k: part.column(2 + i) for i, k in enumerate(keep)})

    schema = ", ".join(["doc_id long", "score double", "predicted int", *(f"`{k}` {kinds[k]}" for k in keep)])
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), *keep)
    return rows.mapInArrow(run, schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """A score for every document, by a model that has not seen the held-out fifth."""
    from .common import held_out, table

    documents = table(spark, sf_dir, "documents")
    scored = score_quality(documents, train(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
