"""Numeric parts of the operators against direct formulas."""

import itertools
import random

import numpy as np

from lakeloom.llm import media, quality, simhash


def gain(g, h):
    return g * g / (h + 1)


def test_best_splits_against_all_splits():
    rng = np.random.default_rng(5)
    for n in (2, 3, 8, 20):
        grad, hess = rng.normal(size=n), rng.uniform(0.2, 2, n)
        cuts = [k for k in range(1, n) if hess[:k].sum() >= 1 and hess[k:].sum() >= 1]
        got = quality.best_splits(grad, hess, 2, 1.0)
        whole = np.full(n, grad.sum() / (hess.sum() + 1))
        best = max(((gain(grad[:k].sum(), hess[:k].sum()) + gain(grad[k:].sum(), hess[k:].sum()) - gain(grad.sum(), hess.sum()), k) for k in cuts), default=(0, 0))
        if best[0] <= 1e-9:
            assert np.allclose(got, whole)
        else:
            k = best[1]
            want = np.concatenate((np.full(k, grad[:k].sum() / (hess[:k].sum() + 1)), np.full(n - k, grad[k:].sum() / (hess[k:].sum() + 1))))
            assert np.allclose(got, want)
    assert np.allclose(quality.best_splits(np.ones(1), np.ones(1), 3, 1.0), 0.5)


def test_additive_model_adds_its_tables():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(800, 3))
    x[:, 2] = np.round(x[:, 2])
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # no single feature tells, a pair does
    model = quality.AdditiveModel(rounds=20, pair_rounds=40).fit(x, y)
    p = model.score(x)
    for row, score in itertools.islice(zip(x, p, strict=True), 40):
        odds = model.base + sum(t[int((c <= v).sum())] for t, c, v in zip(model.tables, model.cuts, row, strict=True))
        for (f, g), t in zip(model.pairs, model.pair_tables, strict=True):
            odds += t[int((model.pair_cuts[f] <= row[f]).sum()), int((model.pair_cuts[g] <= row[g]).sum())]
        assert np.isclose(score, 1 / (1 + np.exp(-odds)))
    assert {0, 1} in [set(q) for q in model.pairs] and ((p > 0.5) == y).mean() > 0.9
    flat = quality.AdditiveModel(rounds=20, pair_rounds=0).fit(x, y).score(x)
    assert ((flat > 0.5) == y).mean() < 0.75
    assert np.allclose(quality.AdditiveModel().fit(x[:0], y[:0]).score(x[:2]), 0.5)


def test_log_mel_against_the_formula():
    rate, window, hop, fft, bands = 8000, 200, 80, 256, 12
    filters = media.mel_filters(rate, fft, bands)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, mel(rate / 2), bands + 2)]
    for k, b in itertools.product(range(fft // 2 + 1), range(bands)):
        f, (lo, mid, hi) = k * rate / fft, edges[b : b + 3]
        want = max(0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid)))
        assert np.isclose(filters[k, b], want, atol=1e-9)
    x = np.random.default_rng(7).normal(size=500)
    mels, power = media.log_mel(x, window, hop, fft, filters)
    assert len(mels) == len(power) == 1 + -(-(500 - window) // hop)
    padded = np.concatenate((x, np.zeros(window)))
    for t in range(len(mels)):
        part = padded[t * hop : t * hop + window]
        spectrum = [abs(sum(part[n] * (0.5 - 0.5 * np.cos(2 * np.pi * n / (window - 1))) * np.exp(-2j * np.pi * k * n / fft) for n in range(window))) ** 2 for k in range(fft // 2 + 1)]
        assert np.allclose(mels[t], np.log(np.array(spectrum) @ filters + 1e-10), atol=1e-3) and np.isclose(power[t], (part**2).mean())


def test_shared_counts_and_forests():
    rng = random.Random(8)
    sets = [sorted(rng.sample(range(30), rng.randrange(1, 9))) for _ in range(25)]
    flat, sizes = np.array([v for s in sets for v in s]), np.array([len(s) for s in sets])
    every = np.arange(len(sets))
    for columns in (4096, 3):
        got = simhash.shared_counts(flat, np.repeat(every, sizes), every, every, columns)
        for a, b in itertools.product(every, every):
            if a != b:
                assert got[a, b] == len(set(sets[a]) & set(sets[b]))
    x, y = simhash.alike(sizes, flat, every, every, 0.4)
    want = {(a, b) for a, b in itertools.permutations(every.tolist(), 2) if len(set(sets[a]) & set(sets[b])) >= 0.4 * len(set(sets[a]) | set(sets[b])) - 1e-9}
    assert set(zip(x.tolist(), y.tolist())) == want
    assert simhash.connect(6, np.array([5, 3, 4]), np.array([3, 1, 0])).tolist() == [0, 1, 2, 1, 0, 1]
