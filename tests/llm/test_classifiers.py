"""The two classifiers against plain versions of their trees, tables and updates."""
from __future__ import annotations

import itertools
import math

import numpy as np

from tastemap.llm import quality, toxicity


def leaf(g, h):
    return g.sum() ** 2 / (h.sum() + quality.RIDGE)


def test_best_cut_is_the_best_of_all_cuts():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 9, 30):
        for _ in range(20):
            g, h = rng.normal(size=n), rng.random(n) + 0.1
            every = [(leaf(g[:k], h[:k]) + leaf(g[k:], h[k:]) - leaf(g, h), k) for k in range(1, n)]
            gain, at = quality._best_cut(g, h)
            if not every:
                assert (gain, at) == (0.0, 0)
                continue
            assert math.isclose(gain, max(every)[0], rel_tol=1e-9, abs_tol=1e-9)
            assert math.isclose(dict((k, v) for v, k in every)[at], gain, rel_tol=1e-9, abs_tol=1e-9)


def test_pair_tree_is_the_best_of_all_trees_of_its_shape():
    rng = np.random.default_rng(2)
    for shape in ((2, 2), (3, 4), (5, 2)):
        for _ in range(10):
            g, h = rng.normal(size=shape), rng.random(shape) + 0.1
            best = 0.0
            for a, b in ((g, h), (g.T, h.T)):
                for row in range(1, a.shape[0]):
                    top, low = (slice(0, row), slice(row, None))
                    for left, right in itertools.product(range(1, a.shape[1]), repeat=2):
                        parts = [leaf(a[top, :left], b[top, :left]), leaf(a[top, left:], b[top, left:]), leaf(a[low, :right], b[low, :right]), leaf(a[low, right:], b[low, right:])]
                        best = max(best, sum(parts) - leaf(a, b))
            gain, step = quality._pair_tree(g, h)
            assert math.isclose(gain, best, rel_tol=1e-9, abs_tol=1e-9)
            # The steps are the ridge solutions of their leaves: they lower the quadratic loss by half the gain.
            drop = -(g * step + 0.5 * h * step**2).sum() - 0.5 * quality.RIDGE * sum(v**2 for v in np.unique(step[step != 0]))
            assert math.isclose(drop, 0.5 * (gain + leaf(g, h)) if gain else 0, rel_tol=1e-6, abs_tol=1e-9)


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train_gam(x, y)
    assert model.pairs and np.mean((model.score(x) > 0.5) == y) > 0.9
    for row, found in zip(x[:50], model.score(x[:50])):
        total = model.base
        for value, cuts, table in zip(row, model.cuts, model.tables):
            total += table[sum(value >= c for c in cuts)]
        for a, b, table in model.pairs:
            total += table[sum(row[a] >= c for c in model.pair_cuts[a]), sum(row[b] >= c for c in model.pair_cuts[b])]
        assert math.isclose(found, 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def test_ftrl_follows_the_scalar_update():
    rng = np.random.default_rng(4)
    rows = [(int(rng.random() < 0.5), np.sort(rng.choice(60, rng.integers(1, 9), replace=False)).astype(np.int32)) for _ in range(300)]
    rows = [(int((5 in ids) or label and 7 in ids), ids) for label, ids in rows]
    model = toxicity.train_ftrl(rows, passes=3)
    z, n, bias = {}, {}, "bias"

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        shrink = 0.0 if i == bias else toxicity.L1
        if abs(zi) <= shrink:
            return 0.0
        return -(zi - math.copysign(shrink, zi)) / ((toxicity.BETA + math.sqrt(ni)) / toxicity.ALPHA + toxicity.L2)

    for label, ids in rows * 3:
        names = [*ids.tolist(), bias]
        w = [weight(i) for i in names]
        g = 1 / (1 + math.exp(-sum(w))) - label
        if abs(g) < 1e-4:
            continue
        for i, wi in zip(names, w):
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
            z[i] = z.get(i, 0.0) + g - sigma * wi
            n[i] = n.get(i, 0.0) + g * g
    want = {i: weight(i) for i in range(60) if weight(i)}
    assert set(model.ids.tolist()) == set(want) and 0 < len(want) < 60
    assert all(math.isclose(v, want[i], rel_tol=1e-6, abs_tol=1e-9) for i, v in zip(model.ids.tolist(), model.values.tolist()))
    assert math.isclose(model.bias, weight(bias), rel_tol=1e-6)
