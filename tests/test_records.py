from pyspark.sql import functions as F

from veilspark.jobs import anonymize as job
from veilspark.operators import bootstrap as bs
from veilspark.operators import entities as ent
from veilspark.operators import redact as rd
from veilspark.operators import score as sc
from veilspark.sources import io

LISTS = "nomes array<string>, locais array<string>, estabelecimentos array<string>, vulgos array<string>"


def test_filters_and_removed(spark):
    df = spark.createDataFrame([(1, ["Ana Souza", "Autor 1", "meu primo", "[CEP]"], ["Vila A", "rua", "centro"], ["Honda", "Bar X"], ["dona", "Tigre"])], "seq long, " + LISTS)
    r = ent.filter_entities(df, "removed").first()
    assert (r.nomes, r.locais, r.estabelecimentos, r.vulgos, r.removed) == (["Ana Souza"], ["Vila A"], ["Bar X"], ["Tigre"], 7)


def test_redaction(spark):
    text = "Ana Souza viu ANA e a.b* [PLACA]; Anabela ficou"
    df = spark.createDataFrame([(1, text, ["ANA", "Ana Souza", "a.b*", "PLACA"], [], [], [])], "seq long, t string, " + LISTS)
    r = rd.redact(df, "t", "out", "n").first()
    assert r.out == "[NOME_2] viu [NOME_1] e [NOME_3] [PLACA]; Anabela ficou" and r.n == 3
    again = rd.redact(df.withColumn("t", F.lit("[NOME_1] [PLACA]")), "t", "out", "n").first()
    assert again.out == "[NOME_1] [PLACA]" and again.n == 0


def test_union_keeps_first_spelling(spark):
    row = spark.range(1).select(ent.united(F.array(F.lit("José"), F.lit("-")), F.array(F.lit("jose"), F.lit("Ana"))).alias("u")).first()
    assert row.u == ["José", "Ana"]


def test_scores_and_properties(spark):
    gold = spark.createDataFrame([("1", "Ana; Bia", "Rua X", "IML 12345; 1.234", None, None, None, None, None)], "seq string, " + ", ".join(f"{c} string" for _, _, c in sc.TYPES))
    out = spark.createDataFrame([("c", "1", {"CODIGO": ["IML 12345"], "CPF": ["1.234", "99"]}, ["Ana", "Zoe"], [], [], [])], "config string, seq string, captures map<string,array<string>>, " + LISTS)
    pairs = sc.matched(out, sc.gold_arrays(gold))
    s = {r.tipo: r for r in sc.record_stats(pairs).collect()}
    assert (s["nome"].tp, s["nome"].fn, s["nome"].fp, s["nome"].leak) == (1, 1, 1, 1)
    assert (s["documento"].tp, s["documento"].fn, s["documento"].fp, s["documento"].gold) == (1, 0, 1, 1)
    assert all(r.tp + r.fn == r.gold and r.leak <= r.fn for r in s.values()) and len(s) == 8
    r = sc.institutional_removed(pairs).first()
    assert (r.total, r.removed) == (1, 1)


def test_known_rates(spark):
    """Counts of a published run give its published rates."""
    rows = [("r", "nome", 0, 502, 0, 500, 502), ("r", "local", 200, 529, 61, 528, 729), ("r", "documento", 17, 48, 1, 0, 65), ("r", "placa", 42, 3, 0, 3, 45),
            ("r", "telefone", 11, 0, 41, 0, 11), ("r", "email", 1, 0, 4, 0, 1), ("r", "viatura", 5, 0, 0, 0, 5), ("r", "vulgo", 0, 1, 0, 1, 1)]
    r = sc.summary(spark.createDataFrame(rows, "config string, tipo string, tp long, fn long, fp long, leak long, gold long")).first()
    assert (round(r.micro_recall, 4), round(r.micro_precision, 4), round(r.micro_f1, 4), round(r.macro_f1, 4), round(r.macro_safety, 4)) == (0.2031, 0.7206, 0.3169, 0.4327, 0.6516)


def test_weights_do_not_depend_on_partitions(spark):
    stats = spark.createDataFrame([("c", str(i), "nome", i % 2, 1, 0, i % 3, 2) for i in range(50)], "config string, seq string, tipo string, tp int, fn int, fp int, leak int, gold int")
    a, b = (sorted(map(tuple, bs.replicate_sums(stats.repartition(n), 20).collect())) for n in (1, 7))
    assert a == b and len(a) == 20


def test_pipeline_status_resume_and_files(spark, tmp_path):
    df = spark.createDataFrame([("1", "compareceu Ana Souza fone 11 98888-7777"), ("2", None)], "seq string, text string")
    model = lambda: lambda texts: [{"nomes": ["Ana Souza"]} if "Ana" in t else {} for t in texts]
    out = job.anonymize(df, lambda x: ent.source_model(x, model))
    got = {r.seq: r for r in out.collect()}
    assert got["1"].redacted == "compareceu [NOME_1] [TELEFONE]" and got["2"].status == "vazio"
    for csv in (False, True):
        path = str(tmp_path / f"out{csv}")
        io.write_outputs(out, path, "m", csv)
        back = {r.seq: r for r in io.read_outputs(spark, path, csv).collect()}
        assert back["1"].captures == {"TELEFONE": ["fone 11 98888-7777"]} and back["1"].nomes == ["Ana Souza"] and back["1"].config == "m"
    assert [r.seq for r in job.pending(df, df.where("seq = '1'")).collect()] == ["2"]


def test_stream(spark, tmp_path):
    from veilspark.streaming.redact_stream import run_available

    src, sink, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    spark.createDataFrame([(1, "CEP 01310-100")], "seq long, text string").write.parquet(src)
    run_available(spark, src, "seq long, text string", sink, cp).awaitTermination()
    assert [r.stage1_text for r in spark.read.parquet(sink).collect()] == ["CEP [CEP]"]


def test_config_tags():
    assert io.config_tag("regex_only", model="m:1") == "regex_only" and io.config_tag("ner", backend="b") == "ner_b"
    assert io.config_tag("encadeado", model="m:8b", order="ab") == "encadeado_m-8b_ab" and io.config_tag("llm") == "llm"
