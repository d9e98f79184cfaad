"""op10's wider candidates, the reliabilities that expectation maximisation finds, and masking of odd rows."""

import re

import numpy as np
import pytest

from geoloom.llm import pii


@pytest.mark.parametrize(("text", "span", "kind"), [
    ("to IBAN DE89370400440532013000 now", "DE89370400440532013000", "account"), ("my dob: 12.03.1984, ok", "12.03.1984", "birth"), ("she was born on 4 July 1976 in", "4 July 1976", "birth"), ("born on July 4, 1976 in", "July 4, 1976", "birth"),
    ("lives at 221 Baker Street, ok", "221 Baker Street", "address"), ("wohnt Hauptstraße 12 in", "Hauptstraße 12", "address"), ("au 14 rue de Rivoli ici", "14 rue de Rivoli", "address"),
    ("x" * 300 + ".b (at) gmail (dot) com", "x" * 300 + ".b (at) gmail (dot) com", "contact"), ("password: hunter22x", "hunter22x", "secret"), ("account no. 12345678901 there", "12345678901", "account"),
    ("a " + "k" * 5000 + "1 b", "k" * 5000 + "1", "secret"), (f"{'w' * 200}_token=abc123def", "abc123def", "secret"),
])
def test_candidates(text, span, kind):
    assert [(text[a:b], k) for a, b, k, _ in pii.candidates(text)] == [(span, kind)]


def test_keys_against_a_plain_pattern():
    rng = np.random.default_rng(1)
    plain = re.compile(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{16,}={0,2}")
    for _ in range(400):
        text = "".join(rng.choice(list("ab1_ ="), rng.integers(0, 300), p=[0.3, 0.3, 0.2, 0.1, 0.05, 0.05]))
        assert [m.span() for name, m in pii._near_digits(text) if name == "key"] == [m.span() for m in plain.finditer(text)], text


def test_reliabilities_are_found():
    rng = np.random.default_rng(7)
    true = rng.random(20000) < 0.3
    rates = [(0.9, 0.05), (0.6, 0.1), (0.75, 0.3), (0.5, 0.02)]  # how often each labeler says yes of yes and of no
    votes = {}
    for y in true:
        v = tuple(int(np.where(rng.random() < 0.2, 0, np.where(rng.random() < r[0 if y else 1], 1, -1))) for r in rates)
        votes[v] = votes.get(v, 0) + 1
    posterior, found = pii.estimate(votes, trust=0.0)
    for k, (yes, no) in enumerate(rates):
        assert abs(found[1, k, 2] - 0.8 * yes) < 0.05 and abs(found[0, k, 2] - 0.8 * no) < 0.05
    # A single reliable yes outvotes two weak ones: reliabilities, not counts, decide.
    assert posterior[1, -1, 0, 0] > posterior[-1, 0, 1, -1]


def test_classifier_may_outvote_the_majority():
    one = "1,0,-1,-1|secret/a/x"  # majority against, but its features are those of sure ones
    patterns = {"1,1,1,1|secret/a/x": 500, "-1,0,-1,-1|secret/b/y": 500, one: 5}
    assert one in pii.train(patterns) and "-1,0,-1,-1|secret/b/y" not in pii.train(patterns) and pii.train({}) == set()


def test_masks_odd_rows(spark):
    rows = [(None, None, None, "s"), (1, "", 0, "s"), (2, "a@b.cc and +1 (017) 555-7713", None, "t"), (2, "a@b.cc and +1 (017) 555-7713", None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = [tuple(r) for r in pii.mask_pii(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, None, None, "s"), (1, "", 0, "s"), *[(2, "[EMAIL] and [PHONE]", 19, "t")] * 2], key=str)
    assert pii.mask_pii(docs.where("false")).count() == 0 and pii.mask_pii(docs).columns == docs.columns
    assert sorted(r.n_spans for r in pii.find_pii(docs).collect()) == [0, 0, 2, 2]
