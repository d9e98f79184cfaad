"""op7 finds edited copies whatever the frequency of their 3-grams."""

from geoloom.llm import decontamination


def test_spread_variant_beside_one_exact_copy(spark):
    item = [f"word{k}" for k in range(40)]
    variant = " ".join(w if k % 4 != 3 else f"other{k}" for k, w in enumerate(item))
    rows = [(0, " ".join(item)), *((n, f"doc{n} says {variant} at the end") for n in range(1, 120))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontamination.find_leaks(docs, benchmark).collect()}
    assert set(got) == set(range(120)) and got[0] == 1 and all(0.5 < got[n] < 0.7 for n in range(1, 120))
