import pytest
from pyspark.sql import functions as F

from veilspark.functions import detectors as dt
from veilspark.functions import textnorm as tn

CASES = {
    "Aparelho IMEI 990000862471854 e carros QWE-1A23, RTY4321": "Aparelho [IMEI] e carros [PLACA], [PLACA]",
    "Bia: (21) 91234-5678; RG 12.345.678-X; apoio M54321; art. 33 da norma.": "Bia: [TELEFONE]; [RG]; apoio [VIATURA]; art. 33 da norma.",
    "Marco 7° 5' 3.25\" N / 120°59′8”E fim": "Marco [COORDENADA] / [COORDENADA] fim",
    "roubo 2023": "rou[BO]",
    "vip 12345": "v[PROCESSO]",
    "protocolo policial": "[PROTOCOLO]",
    "CNH 12345678901": "CNH [CPF]",
    "data 12345678 fim": "data [CEP] fim",
    "empresa 12.345.678/0001-22": "empresa [CPF]",
    "+7 (812) 555-0199": "+7 (812) 555-0199",
    "OFÍCIO nº 123/2020-ABC": "[OFICIO]",
    "lei 11.343/2006, art. 5, § 2 da lei 9.099/1995 lacre 1234567": "lei 11.343/2006, art. 5, § 2 da lei 9.099/1995 lacre [CODIGO]",
    "telefone 11 98888-7777 (11) 3333-4444": "[TELEFONE]",
    "a   b": "a b",
    "ꙮ e ꝏ e 1234567": "ꙮ e ꝏ e [CODIGO]",
    "": "",
    "  \n": "",
}


def test_chain(spark):
    rows = [(i, t) for i, t in enumerate([*CASES, None])]
    got = {r.seq: r for r in dt.stage1(spark.createDataFrame(rows, "seq long, text string")).collect()}
    for i, (_, want) in enumerate(CASES.items()):
        assert got[i].stage1_text == want
    assert got[len(CASES)].stage1_text == "" and got[len(CASES)].captures == {}
    assert got[0].captures == {"IMEI": ["IMEI 990000862471854"], "PLACA": ["QWE-1A23", "RTY4321"]}


def test_redact_column_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "fone 11 98888-7777", "y")], "__row long, note string, other string")
    out = dt.redact_column(df, "note").orderBy("__row").collect()
    assert [tuple(r) for r in out] == [(1, None, "x", ""), (2, "fone 11 98888-7777", "y", "[TELEFONE]")]


@pytest.mark.parametrize("text,norm", [(" São Páulo, nº 1_ª ", "saopaulono1_a"), ("", ""), ("ÀÉÎõü-Ç", "aeiouc")])
def test_normalized(spark, text, norm):
    row = spark.range(1).select(tn.normalized(F.lit(text)).alias("a"), tn.normalized_exact(F.lit(text)).alias("b")).first()
    assert row.a == row.b == norm


def test_parse_answer(spark):
    rows = [('<think>{x}</think>```json\n{"nomes": ["Ana ", 3, ""], "locais": "Vila A", "vulgos": {"a": 1}}```',), ("none",), ("{bad",), (None,)]
    got = [r.p for r in spark.createDataFrame(rows, "a string").select(tn.parse_answer(F.col("a")).alias("p")).collect()]
    assert got[0].asDict() == {"nomes": ["Ana"], "locais": ["Vila A"], "estabelecimentos": [], "vulgos": []}
    assert got[1:] == [None, None, None]


def test_chunks_hold_everything(spark):
    text = "Frase um. " * 30 + "x" * 1000 + ". Fim! Outra? Sim."
    got = spark.createDataFrame([(text,), ("abc",)], "t string").select(tn.chunks(F.col("t")).alias("c")).collect()
    assert max(map(len, got[0].c)) <= 450 and "".join(got[0].c).replace(" ", "") == text.replace(" ", "")
    assert got[1].c == ["abc"]
