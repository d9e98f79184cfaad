"""op6 parses long texts as wholes, whatever the segments."""

import numpy as np

from geoloom.llm import language_id


def greedy(train, text):
    n, at = 1, 0
    for k in range(len(text)):
        if text[at : k + 1] not in train:
            n, at = n + 1, (k if text[k] in train else k + 1)
    return n


def test_segments_are_joined():
    rng = np.random.default_rng(5)
    letters = np.array(list("abcde "))
    draw = lambda n, p: " ".join("".join(rng.choice(letters, n, p=p)).split())
    samples = {"x": draw(400, [0.4, 0.2, 0.1, 0.1, 0.0, 0.2]), "y": draw(300, [0.1, 0.2, 0.2, 0.2, 0.1, 0.2]), "z": "ab" * 90}
    texts = [draw(int(n), [0.3, 0.2, 0.1, 0.1, 0.1, 0.2]) + tail for n in (5, 700, 7000, 3000) for tail in ("", "f", " a")] + ["ab" * 4000, "a" * 9000, "ba " * 3000, "f" * 5000, samples["z"] * 50]
    parser = language_id.CrossParser(samples)
    want = np.array([[greedy(samples[x], " ".join(t.split())) for t in texts] for x in parser.languages])
    was = language_id.SEGMENT
    try:
        for language_id.SEGMENT in (2048, 64, 7, 10**6):
            assert (parser.phrases([" ".join(t.split()) for t in texts]) == want).all()
    finally:
        language_id.SEGMENT = was
