"""op3's Viterbi against the enumeration of every reading of small lattices; the spaced run's words against all segmentations."""

import itertools
import re

import numpy as np
import pytest

from geoloom.llm import toxicity


def runs(token):
    token = re.sub(r"(.)\1{3,}", r"\1\1\1", token, flags=re.DOTALL)
    return [(c, len(list(g))) for c, g in itertools.groupby(token)]


def cost_of(r, text, price):
    x = y = 0
    for c in text:
        z = r._letter(c)
        price += r.costs[x][y][z]
        x, y = y, z
    return price + r.costs[x][y][0]


@pytest.fixture(scope="module")
def restorer():
    return toxicity.Restorer(-np.log(np.random.default_rng(2).dirichlet(np.ones(toxicity.CLASSES) * 0.3, (toxicity.CLASSES, toxicity.CLASSES)) + 1e-6).astype(np.float32))


@pytest.mark.parametrize("literal", [False, True])
def test_every_reading(restorer, literal):
    rng = np.random.default_rng(3)
    for _ in range(150):
        token = "".join(rng.choice(list("abe10$|.(é"), rng.integers(1, 7)))
        best = {}
        for way in itertools.product(*[restorer._readings(c, n, literal) for c, n in runs(token)]):
            text, price = "".join(t for t, _ in way), sum(p for _, p in way)
            best[text] = min(best.get(text, 1e9), cost_of(restorer, text, price))
        got = restorer.decode(token, literal)
        assert best[got] <= min(best.values()) + 1e-6, token


def test_every_segmentation(restorer):
    rng = np.random.default_rng(4)
    for _ in range(40):
        signs = "".join(rng.choice(list("abe10$"), rng.integers(3, 7)))
        signs = re.sub(r"(.)\1{3,}", r"\1\1\1", signs)
        word = {}
        for a in range(len(signs)):
            for b in range(a + 1, len(signs) + 1):
                ways = [("".join(t for t, _ in way), sum(p for _, p in way)) for way in itertools.product(*[restorer._readings(c, n, False) for c, n in runs(signs[a:b])])]
                word[a, b] = min((cost_of(restorer, t, p), t) for t, p in ways)
        cuts = [[0, *c, len(signs)] for k in range(len(signs)) for c in itertools.combinations(range(1, len(signs)), k)]
        totals = [sum(word[a, b][0] + 1 for a, b in zip(c, c[1:])) for c in cuts]
        near = {word[a, b][1] for c, t in zip(cuts, totals) if t <= min(totals) + toxicity.NEAR - 1e-3 for a, b in zip(c, c[1:]) if b - a > 2}
        assert {w for w in near if w} <= restorer.spaced_words(" ".join(signs))
