"""op6 knows every letter of its samples and languages with long rows alone."""

import numpy as np

from geoloom.llm import language_id


def test_large_alphabets():
    rng = np.random.default_rng(1)
    make = lambda low, n: "".join(chr(low + int(k)) for k in rng.integers(0, n, 3000))
    samples = {"a": "plain words " * 300, "han": make(0x4E00, 400), "han2": make(0x5E00, 400), "greek": "λόγος και " * 300, "gothic": make(0x10330, 26)}
    parser = language_id.CrossParser(samples)
    for language, text in samples.items():
        assert parser.languages[parser.phrases([text[500:900]])[:, 0].argmin()] == language
        assert parser.phrases([text[500:900].strip()])[parser.languages.index(language), 0] == 1


def test_language_with_long_rows_alone(spark):
    rows = [(k, "short words of one kind " * 5, "en") for k in range(20)] + [(100 + k, "λέξεις άλλης γλώσσας " * 4000, "el") for k in range(20)] + [(200, "", "el"), (201, "λέξεις άλλης", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language_id.identify_language(docs).collect()}[201] == "el"
