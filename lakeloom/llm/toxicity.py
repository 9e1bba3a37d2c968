"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, in numpy.

A step of the network is a word with the number of times that it follows itself. Its input joins a word embedding,
looked up by a hash of the lower-cased word, a character embedding, the mean of hashed embeddings of
the word's runs of three and five bytes, and the logarithm of that number; so inputs depend on the
step alone and each distinct one is looked up once a batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import chain, groupby, islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, STRIDE = 48, 24
BUCKET_BITS, WIDTH, HIDDEN = 14, 8, 12
BUCKETS = 1 << BUCKET_BITS
#: Words that are looked at together when scoring; long texts are cut into windows before.
BLOCK_WORDS = 60_000


def windows_of(n: int) -> range:
    """First words of the overlapping windows over ``n`` words; at least one, and each word is in one."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def mixed(x: np.ndarray) -> np.ndarray:
    """Buckets of 32-bit hashes."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return ((x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def word_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of distinct steps' words, buckets of the grams of all words in one row, and where each word's begin.

    Grams are the runs of three and of five bytes of the word between two marks.
    """
    data = [b"<" + (w.partition("\t")[0] if "\t" in w else w).encode() + b">" for w in words]
    size = np.fromiter(map(len, data), np.int64, len(data))
    raw = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    ends = np.cumsum(size)
    starts = ends - size
    owner = np.repeat(np.arange(len(data)), size)
    h = raw * np.uint32(0x9E3779B1)
    three = h[:-2] ^ (h[1:-1] * np.uint32(0x85EBCA77)) ^ (h[2:] * np.uint32(0xC2B2AE3D))
    five = (three[:-2] * np.uint32(0x27D4EB2F)) ^ (three[2:] * np.uint32(0x165667B1) + np.uint32(5))
    in3, in5 = owner[:-2] == owner[2:], owner[:-4] == owner[4:]
    gram = np.concatenate((mixed(three[in3]), mixed(five[in5])))
    of = np.concatenate((owner[:-2][in3], owner[:-4][in5]))
    gram = gram[np.argsort(of, kind="stable")]
    at = np.searchsorted(np.sort(of), np.arange(len(data)))
    place = (np.arange(len(raw)) - np.repeat(starts, size)).astype(np.uint32)
    word = np.add.reduceat(h * ((place * np.uint32(0x9E3779B9)) ^ np.uint32(0x5BD1E995) | np.uint32(1)), starts, dtype=np.uint32)
    return mixed(word), gram, at


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"word": rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32), "char": rng.normal(0, 0.3, (BUCKETS, WIDTH)).astype(np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": n(2 * WIDTH + 1, 3 * HIDDEN), f"u{d}": n(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"a": n(2 * HIDDEN, HIDDEN), "v": n(HIDDEN, 1)[:, 0], "o": n(2 * HIDDEN, 1)[:, 0], "k": np.zeros(1, np.float32)}
        self.scale, self.shift = 1.0, 0.0
        self.seed = seed

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        key, tri, at = word_keys(words)
        count = np.diff(np.append(at, len(tri)))
        # no slice is empty: a word has a byte at least, and with its two marks a run of three
        chars = np.add.reduceat(self.p["char"][tri], at, axis=0) / count[:, None]
        times = np.zeros((len(words), 1))
        again = [k for k, w in enumerate(words) if "\t" in w]
        times[again, 0] = np.log2([float(words[k].partition("\t")[2]) for k in again])
        return np.hstack((self.p["word"][key], chars, times)).astype(np.float32), (key, tri, at, count)

    def gru(self, x: np.ndarray, mask: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        """Hidden states for projected inputs (steps, rows, 3 * HIDDEN); masked steps keep the state."""
        u, h, h2 = self.p[f"u{d}"], np.zeros((x.shape[1], HIDDEN), np.float32), 2 * HIDDEN
        out = np.empty((*x.shape[:2], HIDDEN), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            hu = h @ u
            zr = sigmoid(x[t, :, :h2] + hu[:, :h2])
            z, r = zr[:, :HIDDEN] * mask[t][:, None], zr[:, HIDDEN:]
            new = np.tanh(x[t, :, h2:] + r * hu[:, h2:])
            if trace is not None:
                trace.append((t, h, hu[:, h2:], z, r, new))
            h = h + z * (new - h)
            out[t] = h
        return out

    def forward(self, v: np.ndarray, index: np.ndarray, mask: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """Logits of windows: ``index`` (steps, rows) points into the distinct words' inputs ``v``."""
        hs = []
        for d in "fb":
            steps = [] if trace is not None else None
            x = (v @ self.p[f"w{d}"] + self.p[f"c{d}"])[index]
            hs.append(self.gru(x, mask, d, steps))
            if trace is not None:
                trace[d] = steps
        h = np.concatenate(hs, axis=2)
        q = np.tanh(h @ self.p["a"])
        e = np.where(mask > 0, q @ self.p["v"], np.float32(-1e9))
        w = np.exp(e - e.max(axis=0))
        w *= mask
        w /= np.maximum(w.sum(axis=0), 1e-9)
        c = (w[:, :, None] * h).sum(axis=0)
        if trace is not None:
            trace |= {"h": h, "q": q, "w": w, "c": c}
        return c @ self.p["o"] + self.p["k"][0]

    def gradients(self, words: list[str], index: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted cross entropy of a batch, by hand-written back-propagation through time."""
        p, trace, g = self.p, {}, {}
        v, (key, tri, at, count) = self.inputs(words)
        logit = self.forward(v, index, mask, trace)
        dl = ((sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
        h, q, w, c = trace["h"], trace["q"], trace["w"], trace["c"]
        g["o"], g["k"] = c.T @ dl, dl.sum(keepdims=True)
        dc = dl[:, None] * p["o"]
        dw = (h * dc).sum(axis=2)
        de = w * (dw - (w * dw).sum(axis=0))
        dq = de[:, :, None] * p["v"] * (1 - q * q)
        g["v"] = np.tensordot(de, q, 2)
        g["a"] = np.tensordot(h, dq, ([0, 1], [0, 1]))
        dh_all = w[:, :, None] * dc + dq @ p["a"].T
        dv = np.zeros_like(v)
        for k, d in enumerate("fb"):
            u, dh = p[f"u{d}"], np.zeros((index.shape[1], HIDDEN), np.float32)
            du, dx = np.zeros_like(u), np.zeros((*index.shape, 3 * HIDDEN), np.float32)
            for t, before, hn, z, r, new in reversed(trace[d]):
                dh = dh + dh_all[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                m = mask[t][:, None]
                dn = dh * z * (1 - new * new)
                raw = np.where(m > 0, z, 0)
                dz = dh * (new - before) * raw * (1 - raw)
                dr = dn * hn * r * (1 - r)
                dhu = np.hstack((dz, dr, dn * r))
                dx[t] = np.hstack((dz, dr, dn))
                du += before.T @ dhu
                dh = dh * (1 - z) + dhu @ u.T
            flat = dx.reshape(-1, 3 * HIDDEN)
            by_word = np.zeros((len(v), 3 * HIDDEN), np.float32)
            np.add.at(by_word, index.ravel(), flat)
            g[f"u{d}"], g[f"c{d}"], g[f"w{d}"] = du, flat.sum(axis=0), v.T @ by_word
            dv += by_word @ p[f"w{d}"].T
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], key, dv[:, :WIDTH])
        np.add.at(g["char"], tri, np.repeat(dv[:, WIDTH : 2 * WIDTH] / count[:, None], count, axis=0))
        return g

    def score_words(self, docs: list[list[str]]) -> np.ndarray:
        """The highest logit among all windows of each document; ``nan`` for one without words."""
        out = np.full(len(docs), np.nan, np.float32)
        for owner, words, index, mask in blocks(docs):
            v, _ = self.inputs(words)
            np.fmax.at(out, owner, self.forward(v, index, mask))
        return out

    def probabilities(self, docs: list[list[str]]) -> np.ndarray:
        """Calibrated scores; a document without words gets that of the lowest logit, 0."""
        logit = self.score_words(docs).astype(float)
        return np.where(np.isnan(logit), 0.0, 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -30, 30))))


def blocks(docs: list[list[str]]) -> Iterator[tuple[np.ndarray, list[str], np.ndarray, np.ndarray]]:
    """Windows of many documents in blocks: owners, distinct words, word indexes and masks (steps, rows)."""
    parts, size = [], 0
    for i, words in enumerate(docs):
        for a in windows_of(len(words)) if words else ():
            part = words[a : a + WINDOW]
            parts.append((i, part))
            size += len(part)
            if size >= BLOCK_WORDS:
                yield block(parts)
                parts, size = [], 0
    if parts:
        yield block(parts)


def block(parts: list[tuple[int, list[str]]]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    flat = list(chain.from_iterable(p for _, p in parts))
    known = {w: k for k, w in enumerate(dict.fromkeys(flat))}
    size = np.fromiter((len(p) for _, p in parts), np.int64, len(parts))
    steps = int(size.max())
    mask = np.arange(steps)[None] < size[:, None]
    index = np.zeros(mask.shape, np.int64)
    index[mask] = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
    return np.array([i for i, _ in parts]), list(known), np.ascontiguousarray(index.T), np.ascontiguousarray(mask.T, np.float32)


def split_words(text: str | None) -> list[str]:
    """Steps of a text: its lower-cased words, one that follows itself with a tab and how often it stands there."""
    words = (text or "").lower().split()
    if not any(map(eq, words, islice(words, 1, None))):
        return words
    runs = ((w, len(list(same))) for w, same in groupby(words))
    return [w if n == 1 else f"{w}\t{n}" for w, n in runs]


def telling(docs: list[list[str]], y: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """How much buckets of words and of grams prefer documents of class 1, in standard errors, and the best of a word's.

    Buckets of fewer than ``least`` documents are ``nan``: too rare to tell anything.
    """
    words = list(dict.fromkeys(chain.from_iterable(docs)))
    key, gram, at = word_keys(words)
    number, end = {w: k for k, w in enumerate(words)}, np.append(at, len(gram))
    by_word, by_gram = np.zeros((2, BUCKETS)), np.zeros((2, BUCKETS))
    for d, c in zip(docs, y.astype(int), strict=True):
        own = list({number[w] for w in d})
        by_word[c, np.unique(key[own])] += 1
        by_gram[c, np.unique(np.concatenate([gram[end[k] : end[k + 1]] for k in own]))] += 1
    n1, n0 = y.sum(), len(y) - y.sum()

    def z(c: np.ndarray) -> np.ndarray:
        q = (c[0] + c[1] + 0.5) / (n0 + n1 + 1)
        return np.where(c.sum(axis=0) < least, np.nan, (c[1] / n1 - c[0] / n0) / np.sqrt(q * (1 - q) * (1 / n1 + 1 / n0)))

    z_word, z_gram = z(by_word), z(by_gram)
    best = np.nan_to_num(np.fmax(z_word[key], np.fmax.reduceat(z_gram[gram], at)))
    return z_word, z_gram, dict(zip(words, best.tolist(), strict=True))


def fit(docs: list[list[str]], y: np.ndarray, rounds: int = 3, steps: int = 130, batch: int = 256, least: int = 3, seed: int = 7) -> Network:
    """Train on one window a positive document, the one that tells most, and on several of each negative.

    Labels belong to documents, windows have none. The first round picks windows by their most
    telling word, later rounds by the network's own scores; negatives add their hardest windows, and
    those of earlier rounds stay.
    """
    net, rng = Network(seed), np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():
        net.p["o"][:] = 0
        net.p["k"][:] = 4.0 if len(y) and y.min() == 1 else -4.0
        return net
    keep = [k for k, d in enumerate(docs) if d]
    docs, y = [docs[k] for k in keep], y[keep]
    all_windows = [[d[a : a + WINDOW] for a in windows_of(len(d))] for d in docs]
    z_word, z_gram, hint = telling(docs, y, least)
    # the first coordinate of the embeddings starts from how much a bucket tells, the others at random;
    # rare buckets stay zero, or the network would learn its windows by heart
    common = {}
    for name, z in (("word", z_word), ("char", z_gram)):
        net.p[name][:, 0] = np.clip(np.nan_to_num(z) / 4, -1, 2)
        common[name] = np.isfinite(z)[:, None].astype(np.float32)
        net.p[name] *= common[name]
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step, hard = 0, []
    for turn in range(rounds):
        chosen, target = list(hard), [0.0] * len(hard)
        if turn == 0:
            marks = [np.array([max(hint[w] for w in part) for part in ws]) for ws in all_windows]
        else:
            flat = [part for ws in all_windows for part in ws]
            logit = net.score_words(flat)
            cut = np.cumsum([len(ws) for ws in all_windows])[:-1]
            marks = np.split(logit, cut)
        for ws, mark, label in zip(all_windows, marks, y, strict=True):
            best = int(np.argmax(mark))
            picks = {best} if label else {best, *rng.integers(0, len(ws), 2).tolist()}
            if not label:
                hard.append(ws[best])
            chosen += [ws[k] for k in sorted(picks)]
            target += [label] * len(picks)
        target = np.array(target, np.float32)
        weight = np.where(target > 0, len(target) / (2 * max(1, target.sum())), len(target) / (2 * max(1, (1 - target).sum()))).astype(np.float32)
        for _ in range(max(3, -(-steps * batch // len(target)))):
            order = rng.permutation(len(target))
            for a in range(0, len(order), batch):
                rows = order[a : a + batch]
                _, words, index, mask = block([(0, chosen[k]) for k in rows])
                grads = net.gradients(words, index, mask, target[rows], weight[rows])
                step += 1
                for k, grad in grads.items():
                    m, s = moment[k]
                    m += 0.1 * (grad - m)
                    s += 0.005 * (grad * grad - s)
                    net.p[k] -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.995**step)) + 1e-6)).astype(np.float32)
    # scores of whole documents, at their own rate of positives
    logit = net.score_words(docs).astype(float)
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        ga, gb = ((p - y) * logit).sum() + 0.1 * (a - 1), (p - y).sum()
        haa, hab, hbb = (w * logit * logit).sum() + 0.1, (w * logit).sum(), w.sum() + 1e-3
        det = haa * hbb - hab * hab
        a, b = a - 0.5 * (hbb * ga - hab * gb) / det, b - 0.5 * (haa * gb - hab * ga) / det
    net.scale, net.shift = (float(a), float(b)) if np.isfinite([a, b]).all() and a > 0 else (1.0, 0.0)
    return net


def train(documents: DataFrame, labels: DataFrame, rows: int = 1500) -> Network:
    """Train on at most ``rows`` labelled documents of each class outside the held-out fifth.

    One task trains, so that the driver gets the network's tables of fixed sizes and no text.
    """
    from .common import labelled_sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sorted(chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches))
        known: dict[str, str] = {}  # a step that many documents have is held once
        docs = [[known.setdefault(w, w) for w in split_words(t)] for _, _, t in order]
        net = fit(docs, np.array([y for _, y, _ in order], np.float32))
        yield pa.RecordBatch.from_pydict({"net": pa.array([pickle.dumps(net)], pa.binary())})

    found = labelled_sample(documents, labels, "toxic", rows, per_class=True).select("doc_id", "y", "text")
    sent = found.coalesce(1).mapInArrow(run, "net binary").first()
    return pickle.loads(sent["net"]) if sent else fit([], np.empty(0, np.float32))


def score_toxicity(documents: DataFrame, net: Network, threshold: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, score double, predicted int`` and the columns in ``keep``, a row a row of the input.

    Every overlapping window of 48 steps (words, each with the times it follows itself) of the whole text is scored,
    with nothing but the text as input, and the highest counts. Null texts count as empty; texts without words score 0.
    """
    kinds = dict(documents.dtypes)
    sent = documents.sparkSession.sparkContext.broadcast(net)  # under 1 MB: its tables have fixed sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                s = net.probabilities([split_words(t) for t in part.column(1).to_pylist()])
                out = {"doc_id": part.column(0), "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))}
                yield pa.RecordBatch.from_pydict(out | {k: part.column(2 + i) for i, k in enumerate(keep)})

    schema = ", ".join(["doc_id long", "score double", "predicted int", *(f"`{k}` {kinds[k]}" for k in keep)])
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep).mapInArrow(run, schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """A score for every document, by a network that has not seen the held-out fifth."""
    from .common import held_out, table

    documents = table(spark, sf_dir, "documents")
    scored = score_toxicity(documents, train(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
