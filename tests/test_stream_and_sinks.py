import os

from pyspark.sql import functions as F

from veilspark.jobs import anonymize as job
from veilspark.operators import entities as ent
from veilspark.operators import score as sc
from veilspark.sources import io
from veilspark.streaming.redact_stream import run_available

SCHEMA = "seq string, text string"


def texts(spark, first, last):
    return spark.range(first, last).select(F.col("id").cast("string").alias("seq"), F.concat(F.lit("Ana Lima, CPF 123.456.789-09, placa XQZ-1234, caso "), "id").alias("text"))


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    folder, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "log"))
    terms = spark.createDataFrame([("nomes", "Ana Lima")], "category string, term string")
    mentions = spark.createDataFrame([("3", "vulgos", 0, "caso")], "seq string, category string, idx int, entity string")
    source = job.union(lambda df: ent.source_gazetteer(df, terms), lambda df: ent.source_stored(df, mentions))
    texts(spark, 0, 40).repartition(4).write.mode("append").parquet(folder)
    # One file a batch, stopped after the first batches: the next call goes on behind them.
    q = run_available(spark, folder, SCHEMA, sink, checkpoint, source, files=1)
    while q.isActive and not q.recentProgress:
        q.awaitTermination(1)
    q.stop()
    texts(spark, 40, 50).coalesce(1).write.mode("append").parquet(folder)
    for _ in range(2):
        q = run_available(spark, folder, SCHEMA, sink, checkpoint, source, files=1)
        assert q.awaitTermination(120) and q.exception() is None
    columns = ["seq", "text", "redacted", "status", "replaced", *ent.CATS]
    batch = job.anonymize(texts(spark, 0, 50), source)
    show = lambda df: sorted(map(str, df.select(columns).collect()))
    assert show(spark.read.parquet(sink)) == show(batch)
    assert batch.where("seq = '3'").first().vulgos == ["caso"]


def test_batches_written_again(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "config string, n int")
    for batch in ("x", "y", "x"):
        io.write_table(rows, path, batch)
    assert sorted(map(tuple, spark.read.parquet(path).select("config", "n", "batch").collect())) == [("a", 1, "x"), ("a", 1, "y"), ("b", 2, "x"), ("b", 2, "y")]


def test_tables_of_differing_headers(spark, tmp_path):
    for name, text in {
        "one_por_tipo.csv": "tipo,tp,fn\nnome,1,2\n", "two_por_tipo.csv": "﻿fn,extra,tipo\n4,x,\"a,\nb\"\nbad,y,z\n", "three.csv": "tipo,config\nlocal,own\n", "empty.csv": "",
    }.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = io.read_frozen(spark, f"{tmp_path}/*.csv", "tipo string, tp long, fn long")
    assert sorted(map(tuple, got.select("config", "tipo", "tp", "fn").collect()), key=repr) == sorted(
        [("one", "nome", 1, 2), ("two", "a,\nb", None, 4), ("two", "z", None, None), ("three", "local", None, None)], key=repr
    )


def test_latest_annotation(spark):
    rows = [("1", 1, "Ana", "x"), ("1", 2, "Bia", "x"), ("2", None, "Eva", "x"), ("2", 0, "Lia", "x"), (None, 1, "Rui", "x")]
    df = spark.createDataFrame(rows, "seq string, v int, nomes string, other string")
    assert {(r.seq, r.nomes) for r in sc.latest(df, "seq", "v").collect()} == {("1", "Bia"), ("2", "Lia"), (None, "Rui")}
    assert sc.latest(df, "seq", "v").columns == df.columns


def test_corpus_by_configured_names(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Seq,"Texto Livre"\n1,"a\nb"\n', encoding="utf-8")
    got = io.read_corpus(spark, os.path.join(tmp_path, "c.csv"), {"seq": "Seq", "text": "Texto Livre"})
    assert [tuple(r) for r in got.collect()] == [("1", "a\nb")]
