"""op3 decodes every odd token: long ones, those without a letter, and spaced runs word by word."""

import pytest

from geoloom.llm import runtime, toxicity


@pytest.fixture(scope="module")
def restorer(spark):
    return toxicity.Restorer(toxicity.character_model(runtime.table(spark, "/root/testdata/sf0.1", "documents").limit(2000)))


def found(restorer, text):
    whole, spaced = toxicity._tokens(text)
    return {w for t in whole for w in restorer.words(t)} | {w for s in spaced for w in restorer.spaced_words(s)}


@pytest.mark.parametrize("text, word", [
    ("stu" + "u" * 90 + "pid", "stupid"), ("@$$", "ass"), ("455", "ass"), ("a s s", "ass"), ('"m o r o n" he said', "moron"), ("(i d i o t)", "idiot"), ("m o r o n.", "moron"),
    ("you are a m o r o n", "moron"), ("y o u i d i o t", "idiot"), ("such a s t u p i d man", "stupid"),
])
def test_readings(restorer, text, word):
    assert word in found(restorer, text), found(restorer, text)
