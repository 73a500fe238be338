import time

import pytest
from pyspark.sql import functions as F

from veilspark.functions import detectors as dt
from veilspark.operators import redact as rd
from veilspark.sources import narratives as nv


def test_one_small_file_keeps_all_tasks_busy(spark, tmp_path):
    spark.range(30_000).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    sizes = [n for n in nv.narratives(spark, str(tmp_path)).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) >= 4 and sum(sizes) == 30_000 and max(sizes) < 15_000


def test_guard_is_tried_only_where_the_word_stands(spark):
    text = "[NOME_1] Ana e [NOME_2] eNOMEe nome, " + "A_LONG_LINE_OF_CAPITALS " * 40_000
    df = spark.createDataFrame([(text, ["nome", "Ana", "line"])], "t string, e array<string>")
    one = df.select(rd.redacted(F.col("t"), {"nomes": F.col("e")}).alias("x"))
    one.first()
    began = time.time()
    got = one.first().x
    assert time.time() - began < 3
    assert got.text.startswith("[NOME_1] [NOME_2] e [NOME_2] eNOMEe [NOME_1], A_LONG_") and got["count"] == 40_002


def test_plain_forms_equal_unicode_forms_on_ascii():
    for d in dt.DETECTORS:
        assert d.java.replace("U", "", 1).replace("(?)", "") == d.plain


ASCII_OR_NOT = ("IPL nº 12345/6", "autos n. 55555", "ıp 123456", "Kelvin RE: 12345", "RE\t12345", "lei 11.343/2006 AB12345", "art. 157 1234567", "ﬁm  \x1c", "\x1c \x1f", None)


@pytest.mark.parametrize("extra", ["", " é"])
def test_ascii_and_other_texts_are_found_alike(spark, extra):
    """A text keeps its labels when a letter beyond ASCII follows."""
    df = spark.createDataFrame([(i, None if t is None else t + extra) for i, t in enumerate(ASCII_OR_NOT)], "seq int, text string")
    got = {r.seq: sorted(r.captures) for r in dt.stage1(df).collect()}
    assert got == {0: ["PROCESSO"], 1: ["PROCESSO"], 2: ["PROCESSO"], 3: ["CODIGO"], 4: ["CODIGO"], 5: ["CODIGO"], 6: [], 7: [], 8: [], 9: []}
