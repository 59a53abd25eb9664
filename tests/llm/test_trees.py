"""Boosted trees and the isotonic curve against slow second versions; labels that calibrate are not learned from."""

import itertools

import numpy as np
import pytest

from quire.llm import toxicity as tox


def best_split(x, g, h, cuts, least, ridge):
    """(gain, feature, limit) by trying every limit of every feature."""
    found = (1e-6, None, None)
    for f, limits in enumerate(cuts):
        for c in limits:
            left = x[:, f] <= c
            if min(h[left].sum(), h[~left].sum()) < least / 4:
                continue
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + ridge) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + ridge)
            if gain > found[0] + 1e-12:
                found = (gain, f, c)
    return found


@pytest.mark.parametrize("seed", range(5))
def test_trees_take_the_best_splits(seed):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(300, 4)), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + r.normal(size=300) > 0.8).astype(float)
    rounds, depth, rate, least, ridge = 4, 2, 0.3, 2.0, 1.0
    features, limits, values, base = tox.boost(x, y, depth, rounds, rate, least, ridge)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, tox.BINS + 1)[1:-1])) for c in x.T]
    margin = np.full(300, base)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        parts = {0: np.ones(300, bool)}
        for node in range(2**depth - 1):
            mine = parts[node]
            gain, f, c = best_split(x[mine], g[mine], h[mine], cuts, least, ridge)
            if f is None:
                assert limits[k, node] == np.inf
                c, f = np.inf, 0
            else:
                left = x[mine, features[k, node]] <= limits[k, node]
                same = sum(g[mine][s].sum() ** 2 / (h[mine][s].sum() + ridge) for s in (left, ~left)) - g[mine].sum() ** 2 / (h[mine].sum() + ridge)
                assert np.isclose(same, gain)
                f, c = features[k, node], limits[k, node]  # of equal gains either may be taken
            parts[2 * node + 1], parts[2 * node + 2] = mine & (x[:, f] <= c), mine & (x[:, f] > c)
        for leaf in range(2**depth):
            mine = parts[2**depth - 1 + leaf]
            assert np.isclose(values[k, leaf], rate * g[mine].sum() / (h[mine].sum() + ridge))
            margin[mine] += values[k, leaf]
    model = tox.Trees(np.zeros(0, np.uint64), features, limits, values, base, np.zeros(1), np.zeros(1))
    assert np.allclose(model.margin(x), margin)


@pytest.mark.parametrize(("seed", "doubt"), itertools.product(range(5), (0.0, 2.0)))
def test_curve_is_the_closest_rising_one(seed, doubt):
    r = np.random.default_rng(seed)
    margin = np.round(r.normal(size=60), 1)
    y = (r.random(60) < 1 / (1 + np.exp(-2 * margin))).astype(float)
    xs, level = tox.isotonic(margin, y, doubt)
    assert (np.diff(level) >= 0).all()
    if doubt:
        plain = tox.isotonic(margin, y)[1]
        assert (abs(level - y.mean()) <= abs(plain - y.mean()) + 1e-12).all()
        return
    points = np.unique(margin)
    means = {(i, k): y[(margin >= points[i]) & (margin <= points[k])].mean() for i in range(len(points)) for k in range(i, len(points))}
    slow = [max(min(means[j, k] for k in range(i, len(points))) for j in range(i + 1)) for i in range(len(points))]
    assert np.allclose(np.interp(points, xs, level), slow)


def test_one_label_makes_no_alarm():
    margin, y = np.arange(50.0), np.zeros(50)
    y[-1] = 1
    assert tox.isotonic(margin, y)[1].max() == 1
    assert tox.isotonic(margin, y, tox.DOUBT)[1].max() < 0.5
    y[-8:] = 1
    assert tox.isotonic(margin, y, tox.DOUBT)[1].max() > 0.8


def test_words_of_one_part_are_not_learned_for_it(spark, monkeypatch):
    """Each call of `learned_words` but the first leaves one part out, and all are left out once."""
    seen, plain = [], tox.learned_words

    def noted(texts, *given):
        seen.append({r[0] for r in texts.select("fold").distinct().collect()})
        return plain(texts, *given)

    monkeypatch.setattr(tox, "learned_words", noted)
    rows = [(k, f"text {k} " + ("foul word here" if k % 3 == 0 else "quiet word there") + f" end {k * 7}") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)], "doc_id long, toxic int")
    model = tox.fit(docs, labels)
    assert seen[0] == set(range(tox.FOLDS)) and seen[1:] == [set(range(tox.FOLDS)) - {k} for k in range(tox.FOLDS)]
    assert len(model.lexicon) and model.curve_y.max() > 0.8
