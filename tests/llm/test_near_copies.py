import itertools
from collections import Counter

import numpy as np

import corpus_pipeline
from veilspark.llm import near_copies


def brute(texts):
    """Root of each text by comparing all pairs."""
    def cut(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} - {()})

    sets, up = [cut(t) for t in texts], list(range(len(texts)))
    find = lambda x: x if up[x] == x else find(up[x])
    pairs = 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a == b or len(a & b) >= 0.8 * len(a | b):
            pairs += a != b
            up[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))], pairs


def test_stage_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = []
    for g in range(40):
        base = [f"g{g}w{x}" for x in rng.integers(0, 500, 200)]
        texts.append(" ".join(base))
        for edits in (1, 3, 4, 6, 9, 20):
            copy = list(base)
            for at in rng.integers(0, 200, edits):
                copy[at] = f"n{rng.integers(1 << 30)}"
            texts.append(" ".join(copy))
    texts += ["curto texto", "Curto  TEXTO", "", None, "um dois tres"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, "sem copia nenhuma"), (5, "outro texto do mesmo id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    roots, pairs = brute([t for _, t in rows])
    assert pairs > 150
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    want = Counter(rows[i] for i in set(roots))
    assert got == want


def test_recall_of_the_bands():
    """Recall of the bands at and above the threshold, on shingle sets made to measure."""
    rng = np.random.default_rng(4)
    hit = Counter()
    for similarity in (0.8, 0.9):
        for _ in range(150):
            n = 400
            both = int(round(2 * n * similarity / (1 + similarity)))
            x = np.unique(rng.integers(0, 1 << 63, 2 * n, np.uint64))
            a, b = np.sort(x[:n]), np.sort(x[n - both : 2 * n - both])
            hit[similarity] += bool((near_copies.bands(a) == near_copies.bands(b)).any())
    assert hit[0.8] >= 148 and hit[0.9] == 150


def test_fingerprints_link_before_bands(spark, monkeypatch):
    """The nearest copies are linked by SimHash alone, and a pair that it finds is no link unless the sets are similar."""
    from veilspark.llm.minhash_dedup import shingles

    words = [f"w{x}" for x in np.random.default_rng(8).integers(0, 10_000, 3000)]
    texts = [" ".join(words), " ".join([*words, "fim"]), " ".join(words[::-1])]
    monkeypatch.setattr(near_copies, "bands", lambda found: np.zeros(0, np.int64))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in near_copies.one_of_each(docs).collect()} == {0, 2}
    rows = docs.withColumnRenamed("doc_id", near_copies.ROW)
    got = {r.row: r for r in near_copies.signatures(rows).collect()}
    assert [got[i].fp for i in range(3)] == [near_copies.of_set(shingles(t.encode(), 5)) for t in texts]
    monkeypatch.setattr(near_copies, "of_set", lambda found: 7)
    assert {r.doc_id for r in near_copies.one_of_each(docs).collect()} == {0, 2}


def test_texts_stay_in_place(spark, monkeypatch):
    """Rows that stay are found by the few that go: no text is shuffled or sorted; with many that go, the rows are the same."""
    from veilspark.llm import common, exact_dedup

    base = [f"w{x}" for x in np.random.default_rng(5).integers(0, 10_000, 400)]
    texts = [" ".join(base), " ".join([*base, "fim"]), " ".join(base[::-1]), None, "um dois", " UM  dois", "um dois"]
    docs = spark.createDataFrame([(i if i != 2 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    plans, written, limit, most = [], [], "spark.sql.autoBroadcastJoinThreshold", common.FEW
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    for module in (common, exact_dedup, near_copies):
        monkeypatch.setattr(module, "materialize", lambda df, f=common.materialize: written.append(df) or f(df))
    for stage, want in ((near_copies.one_of_each, {0, None, 3, 4}), (exact_dedup.kept_documents, {0, 1, None, 3, 4, 5})):
        for few in (most, 0):
            monkeypatch.setattr(common, "FEW", few)
            out = stage(docs)
            assert {r.doc_id for r in out.collect()} == want and out.count() == len(want)
            plans.append([x._jdf.queryExecution().executedPlan().toString() for x in (out, *(w for w in written if "text" in w.columns))])
            written.clear()
    spark.conf.set(limit, before)
    for at in (0, 2):
        assert "BroadcastHashJoin" in plans[at][0] and not any("hashpartitioning" in p for p in plans[at])


def test_batches_are_short(spark):
    """Whole texts reach Python in batches of about 2 MB, all of them."""
    from veilspark.llm.common import map_batches

    seen = spark.range(0, 40, 1, 1).selectExpr("id", "repeat('abcdefgh', 32768) as text")
    got = map_batches(seen, lambda b: iter([{"n": [b.num_rows]}]), "n long").agg({"n": "sum"}).first()[0]
    assert got == 40
    assert seen.mapInArrow(lambda batches: (b.slice(0, 1).select(["id"]) for b in batches), "id long").count() >= 4


def test_workers_forget_other_stages(spark):
    """A worker keeps its caches within a stage, and begins another one without those of any operator."""
    from veilspark.llm import bpe, common, minhash_dedup, toxicity

    caches = [bpe._CACHE, minhash_dedup._words, toxicity._SCORERS]
    common.turn_to("one")
    for x in caches:
        x["x"] = 1
    common.turn_to("one")
    assert all(x.get("x") == 1 for x in caches)
    common.turn_to("two")
    assert not any(caches)
    texts = spark.createDataFrame([("a b c",)] * 4, "text string").coalesce(1)

    def words(batch):
        m = minhash_dedup
        before = len(m._words)
        m.shingles(b"a b c")
        yield {"n": [before]}

    assert {r.n for _ in range(3) for r in common.map_batches(texts, words, "n long").collect()} == {0}
