import numpy as np

from veilspark.llm import decontaminate


def test_edited_copies_beside_many_exact_ones(spark):
    """Exact copies raise the counts of all n-grams that an edited copy keeps."""
    rng = np.random.default_rng(11)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    item = [f"i{x}" for x in range(40)]
    edited = [w if i % 4 else f"outra{i}" for i, w in enumerate(item)]
    rows = [(i, " ".join(words(20) + item + words(20))) for i in range(20)] + [(100 + i, " ".join(words(9) + edited + words(9))) for i in range(5)]
    rows += [(200, " ".join(words(60) + item[:8] + words(60)))]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.leaks(docs, bench).collect()} == {*range(20), *range(100, 105)}


def test_short_items(spark):
    """Items of one and two words leak where their whole sequence stands."""
    bench = spark.createDataFrame([(1, "resposta azul"), (2, "東京都庁"), (3, "")], "item_id long, text string")
    rows = [(1, "a resposta, azul!"), (2, "azul resposta"), (3, "em 東京都庁 hoje"), (4, "em 東京 hoje"), (5, None), (6, "Resposta azul")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert found == {(1, 1), (6, 1), (3, 2)}
