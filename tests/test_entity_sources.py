import time

import pytest
from pyspark.sql import functions as F

from veilspark.jobs import anonymize as job
from veilspark.operators import entities as ent
from veilspark.operators import utility as ut
from veilspark.functions import detectors as dt

TERMS = [("nomes", "Ana Lima"), ("nomes", "ana"), ("locais", "São João"), ("locais", "Rua das Flores"), ("vulgos", "Zé"), ("nomes", " "), ("nomes", None), ("estabelecimentos", "Ana Lima")]
TEXTS = ["Ana Lima foi a SAO JOAO, Rua das Flores", "ana  lima viu o ze", "Rua das  Flores; Ana.Lima", "", None, "Banana limao", "ana Ana ANA Lima"]


def rows_of(df):
    return sorted([(r.seq, r.stage1_text, *[tuple(r[c]) for c in ent.CATS]) for r in df.collect()], key=repr)


@pytest.fixture
def texts(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, "outro texto com Ana"), (None, "sem chave, Zé"), (None, "sem chave, São João"), (0, TEXTS[0])]
    return spark.createDataFrame(rows, "seq long, stage1_text string")


def test_trie_and_join_agree_by_row(spark, texts, monkeypatch):
    terms = spark.createDataFrame(TERMS, "category string, term string")
    trie, hits = rows_of(ent.source_gazetteer(texts, terms)), sorted(map(tuple, ent.gazetteer_hits(texts, terms, "stage1_text").collect()), key=repr)
    monkeypatch.setattr(ent, "TRIE_TERMS", 0)
    assert rows_of(ent.source_gazetteer(texts, terms)) == trie
    assert sorted(map(tuple, ent.gazetteer_hits(texts, terms, "stage1_text").collect()), key=repr) == hits
    assert {h[1] for h in hits} == set(ent.CATS)
    by_row = {(r[0], r[1]): r[2:] for r in trie}
    assert by_row[0, TEXTS[0]] == (("Ana", "Ana Lima"), ("SAO JOAO", "Rua das Flores"), ("Ana Lima",), ())
    assert by_row[1, TEXTS[1]] == (("ana",), (), (), ("ze",))
    # Rows of one key, or of none, keep what is theirs.
    assert by_row[1, "outro texto com Ana"] == (("Ana",), (), (), ())
    assert by_row[None, "sem chave, Zé"] == ((), (), (), ("Zé",)) and by_row[None, "sem chave, São João"] == ((), ("São João",), (), ())
    assert by_row[4, None] == by_row[5, TEXTS[5]] == ((), (), (), ())
    assert len(trie) == len(TEXTS) + 4


def test_no_terms(spark, texts):
    none = spark.createDataFrame([], "category string, term string")
    assert all(r[2:] == ((), (), (), ()) for r in rows_of(ent.source_gazetteer(texts, none)))


@pytest.mark.parametrize("most", [0, 200_000])
def test_time_is_linear(spark, monkeypatch, most):
    monkeypatch.setattr(ent, "TRIE_TERMS", most)
    terms = spark.createDataFrame(TERMS, "category string, term string")
    took = []
    for n in (8_000, 64_000):
        df = spark.createDataFrame([(1, "Ana Lima mora longe " * (n // 4))], "seq long, stage1_text string")
        began = time.time()
        assert ent.source_gazetteer(df, terms).select(F.size("nomes")).first()[0] == n // 2
        took.append(time.time() - began)
    assert took[1] < 20 + 2 * took[0]


def test_model_by_row_and_by_chunk(spark):
    def load():
        return lambda texts: [{"nomes": [w for w in t.replace(".", " ").split() if w.startswith("P")], "prompt_tokens": len(t.split()), "completion_tokens": 1, "latency_s": 0.5} for t in texts]

    long = " ".join(f"Frase {i} sobre Pessoa{i}." for i in range(60))
    rows = [(1, "Paulo saiu."), (1, "Pedro ficou."), (None, "Penha."), (2, ""), (3, None), (4, long), (4, long)]
    df = spark.createDataFrame(rows, "seq long, stage1_text string")
    whole = rows_of(ent.source_model(df, load))
    cut = ent.source_model(df, load, limit=100)
    assert rows_of(cut) == whole and len(whole) == len(rows)
    costs = {(r.seq, r.stage1_text): (r.latency_s, r.prompt_tokens, r.completion_tokens) for r in cut.collect()}
    assert costs[1, "Paulo saiu."] == (0.5, 2, 1) and costs[3, None] == (0.0, 0, 0)
    blocks = costs[4, long][2]
    assert blocks > 10 and costs[4, long] == (0.5 * blocks, 240, blocks)


def test_costs_pass_through_the_job(spark):
    load = lambda: lambda texts: [{"nomes": ["Paulo"], "prompt_tokens": 7, "completion_tokens": 2, "latency_s": 0.25} for _ in texts]
    model = lambda df: ent.source_model(df, load)
    long = "Z" * 60 + " Paulo"
    df = spark.createDataFrame([("a", "Paulo saiu"), ("b", " "), ("c", None), ("d", long)], "seq string, text string")
    for preset, calls in (("model", 1), ("union", 2), ("chained_ab", 2)):
        out = job.anonymize(df, job.PRESETS[preset](a=model, b=model)).withColumn("config", F.lit("x"))
        rows = {r.seq: r for r in out.collect()}
        assert rows["a"].status == "ok" and "Paulo" not in rows["a"].redacted
        assert rows["a"].prompt_tokens == 7 * calls and rows["b"].status == rows["c"].status == "vazio" and rows["b"].prompt_tokens == 0
        mean = job.mean_costs(out).first()
        assert (mean.n, mean.mean_prompt, mean.mean_completion, mean.mean_latency) == (4, 3.5 * calls, 1.0 * calls, 0.125 * calls)


def test_fallback_keeps_the_detectors_text(spark):
    name = "Fulano " + "de Tal " * 12
    df = spark.createDataFrame([("a", f"{name.strip()} x"), ("b", "Fulano veio")], "seq string, text string")
    source = lambda d: d.select("*", *[(F.array(F.regexp_extract("stage1_text", "^Fulano.*[lo](?= |$)", 0)) if c == "nomes" else ent.no_entities()).alias(c) for c in ent.CATS])
    rows = {r.seq: r for r in job.anonymize(df, source).collect()}
    assert rows["a"].status == "fallback_estagio1" and rows["a"].redacted == f"{name.strip()} x" and rows["a"].nomes == [] and rows["a"].replaced == 0
    assert rows["b"].status == "ok" and rows["b"].replaced == 1


def test_replay_equals_a_full_run(spark):
    plate = tuple(d for d in dt.DETECTORS if d.label == "PLACA")
    old = tuple(d for d in dt.DETECTORS if d not in plate)
    rows = [("1", "carro XQZ-1234 e fone (11) 91234-5678"), ("1", "carro ABC-9876"), (None, "placa XYZ-1111"), ("2", "nada"), ("3", None), ("1", "carro ABC-9876")]
    df = spark.createDataFrame(rows, "seq string, text string").withColumn("status", F.lit("kept"))
    stored = dt.stage1(df, detectors=old)
    show = lambda x: sorted([(r.seq, r.text, sorted(r.captures.items()), r.status) for r in x.collect()], key=repr)
    assert show(ut.replayed(stored, old, dt.DETECTORS)) == show(dt.stage1(df)) != show(stored)
    turned = tuple(reversed(dt.DETECTORS))
    assert show(ut.replayed(dt.stage1(df), dt.DETECTORS, turned)) == show(dt.stage1(df, detectors=turned))


@pytest.mark.parametrize("trie_terms", [0, 200_000])
def test_gazetteer_as_second_source_and_nested(spark, monkeypatch, trie_terms):
    monkeypatch.setattr(ent, "TRIE_TERMS", trie_terms)
    terms = spark.createDataFrame([("nomes", "Ana Lima"), ("vulgos", "Lampiao")], "category string, term string")
    other = spark.createDataFrame([("nomes", "Carlos Reis"), ("nomes", "Ana Lima")], "category string, term string")
    more = spark.createDataFrame([("nomes", "Rui Melo")], "category string, term string")
    a, b, c = (lambda df, t=t: ent.source_gazetteer(df, t) for t in (other, terms, more))
    df = spark.createDataFrame([(1, "Ana Lima e Carlos Reis com Lampiao e Rui Melo"), (2, None)], "seq long, stage1_text string")
    for source in (job.chained(a, b), job.union(a, b)):
        got = source(df)
        assert got.columns == ["seq", "stage1_text", *ent.CATS]
        found = {r.seq: (r.stage1_text, sorted(r.nomes), r.vulgos) for r in got.collect()}
        assert found == {1: ("Ana Lima e Carlos Reis com Lampiao e Rui Melo", ["Ana Lima", "Carlos Reis"], ["Lampiao"]), 2: (None, [], [])}
    for source in (job.chained(a, job.chained(b, c)), job.union(a, job.chained(b, c)), job.chained(job.union(a, b), c)):
        assert sorted({r.seq: r.nomes for r in source(df).collect()}[1]) == ["Ana Lima", "Carlos Reis", "Rui Melo"]
