"""Rows without doc_id, repeated rows and rows that share a doc_id, in each stage that chooses rows."""

from collections import Counter

from veilspark.llm import decontaminate, exact_dedup, simhash_dedup

A, B, C = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
ROWS = [(None, A), (None, B), (None, B), (1, A), (1, A), (1, C), (2, C), (7, "outra coisa"), (7, "outra coisa")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string")


def rows_of(df):
    assert df.columns == ["doc_id", "text", "source"]
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_exact_and_near_copies_keep_one_row_of_each_group(spark):
    want = Counter([(None, B), (1, A), (1, C), (7, "outra coisa")])
    assert rows_of(exact_dedup.kept_documents(table(spark, ROWS))) == want
    assert rows_of(simhash_dedup.one_of_each(table(spark, ROWS))) == want


def test_a_row_whose_own_text_lost_goes(spark):
    rows = [(1, "a b"), (1, "c d e"), (0, "cd e"), (0, "ab x")]
    assert rows_of(exact_dedup.kept_documents(table(spark, rows))) == Counter([(1, "a b"), (1, "c d e"), (0, "ab x")])
    assert rows_of(exact_dedup.kept_documents(table(spark, [(2, "a"), (1, "a"), (2, "b")]))) == Counter([(1, "a"), (2, "b")])


def test_leaks_go_by_row(spark):
    bench = spark.createDataFrame([(1, A)], "item_id long, text string")
    assert rows_of(decontaminate.clean_documents(table(spark, ROWS), bench)) == Counter(
        [(None, B), (None, B), (1, C), (2, C), (7, "outra coisa"), (7, "outra coisa")]
    )
