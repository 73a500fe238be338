from pyspark.sql import functions as F

from veilspark.operators import score as sc

CATS = [c for c, _, _ in sc.CATEGORIES]


def test_versions_of_a_record_score_like_separate_outputs(spark):
    rows = [(1, {"CPF": ["1-2"], "DATA": ["x"]}, ["Ana Sá"], ["Ana Sá", "Bia", "Bia"]), (2, {}, [], ["Nada", ""]), (3, {"PLACA": ["ABC"]}, ["Caio"], [])]
    records = spark.createDataFrame(rows, "seq long, captures map<string,array<string>>, a array<string>, b array<string>")
    none = F.array().cast("array<string>")
    versions = {k: {c: F.col(k) if c == "nomes" else none for c in CATS} for k in ("a", "b")}
    gold = spark.createDataFrame(
        [("1", [("nome", "Ana Sá", "anasa"), ("documento", "1-2", "12"), ("nome", "Bia", "bia")]), ("2", []), ("3", [("vulgo", "Caio", "caio"), ("placa", "ABD", "abd")])],
        "seq string, gold array<struct<tipo:string,orig:string,norm:string>>",
    )
    one_by_one = None
    for k, v in versions.items():
        part = sc.matched(records.select(F.lit(k).alias("config"), "seq", "captures", *[e.alias(c) for c, e in v.items()]), gold)
        one_by_one = part if one_by_one is None else one_by_one.unionByName(part)
    got, want = (sorted(map(tuple, sc.record_stats(x).collect())) for x in (sc.matched_versions(records, versions, gold), one_by_one))
    assert got == want and len(got) == 2 * 3 * len(sc.TIPOS)
    found = {(c, s, t): rest for c, s, t, *rest in got if any(rest)}  # tp, fn, fp, leak, gold
    assert found[("a", "1", "nome")] == [1, 1, 0, 1, 2] and found[("b", "1", "nome")] == [2, 0, 0, 0, 2]
    assert found[("b", "2", "nome")] == [0, 0, 1, 0, 0] and ("a", "2", "nome") not in found
    assert found[("a", "3", "vulgo")] == [0, 1, 0, 0, 1] and found[("b", "3", "vulgo")] == [0, 1, 0, 1, 1]
