"""The classifier's fit against a plain minimisation of its loss, and what the counterfactual penalty changes."""

from __future__ import annotations

import numpy as np

from rasterloom.llm import toxicity


def loss(w, rows, ridge, penalty):
    """The loss as it is defined, over dense rows: weighted logistic loss, squared score change to the counterfactual, ridge."""
    width = len(w) - 1
    dense = lambda k: np.array([[float(i in r[k]) for i in range(width)] for r in rows])
    x, s, y = dense(1), dense(2), np.array([r[0] for r in rows], "f8")
    share = y.mean()
    weight = np.where(y == 1, np.sqrt((1 - share) / share), 1.0)
    z, moved = x @ w[:-1] + w[-1], (x - s) @ w[:-1]
    value = (weight * (np.logaddexp(0, z) - y * z)).mean() + penalty * (moved**2).mean() + ridge * (w[:-1] ** 2).sum()
    grad = np.append(x.T @ (weight * (1 / (1 + np.exp(-z)) - y)) / len(y) + 2 * penalty * (x - s).T @ moved / len(y) + 2 * ridge * w[:-1], (weight * (1 / (1 + np.exp(-z)) - y)).mean())
    return value, grad


def rows_of(seed, n=400):
    """Features 0 to 9 are plain, 10 is an insult, 11 and 12 are terms of one group; toxic texts name 11 more often."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        toxic = rng.random() < 0.3
        plain = set(np.flatnonzero(rng.random(10) < 0.4).tolist())
        insult = {10} if rng.random() < (0.8 if toxic else 0.02) else set()
        term = {11} if rng.random() < (0.7 if toxic else 0.15) else {12} if rng.random() < 0.3 else set()
        swapped = {12} if term == {11} else {11} if term else {11 + int(rng.random() < 0.5)}
        rows.append((int(toxic), sorted(plain | insult | term), sorted(plain | insult | swapped)))
    return rows


def test_fit_against_plain_descent():
    rows = rows_of(1, 150)
    w = toxicity.fit(rows, 13, 1e-2, 0.5)
    best = np.zeros(14)
    for _ in range(6000):
        best -= 0.3 * loss(best, rows, 1e-2, 0.5)[1]
    found, least = loss(w, rows, 1e-2, 0.5)[0], loss(best, rows, 1e-2, 0.5)[0]
    assert least <= found <= least * 1.002 and np.abs(w - best).max() < 0.1


def test_penalty_makes_naming_a_group_neutral():
    rows, held = rows_of(2), rows_of(3)
    score = lambda w, features: 1 / (1 + np.exp(-(sum(w[i] for i in features) + w[-1])))
    moved, false_alarms, right = {}, {}, {}
    for penalty in (0.0, toxicity.COUNTERFACTUAL):
        w = toxicity.fit(rows, 13, penalty=penalty)
        moved[penalty] = np.mean([abs(score(w, r[1]) - score(w, r[2])) for r in held])
        false_alarms[penalty] = np.mean([score(w, r[1]) >= 0.5 for r in held if not r[0] and 11 in r[1] and 10 not in r[1]])
        right[penalty] = np.mean([(score(w, r[1]) >= 0.5) == r[0] for r in held])
    assert moved[toxicity.COUNTERFACTUAL] < 0.3 * moved[0.0]
    assert false_alarms[toxicity.COUNTERFACTUAL] <= false_alarms[0.0] and right[toxicity.COUNTERFACTUAL] > 0.85
