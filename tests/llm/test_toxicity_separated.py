import numpy as np

from veilspark.llm import toxicity


def test_fully_separated_insults(spark):
    rng = np.random.default_rng(5)
    common = [f"palavra{c}" for c in "abcdefghijklmnopqrst"] + ["guarda-chuva", "1-2-3-4", "bem_te_vi"]
    texts = [" ".join(rng.choice(common, 30).tolist() + (list(rng.permutation(["idiota", "imbecil"])) if i % 4 == 0 else [])) for i in range(240)]
    model = toxicity.fit([t.encode() for t in texts], [int(i % 4 == 0) for i in range(240)])
    probes = ["palavraa i-d-i-o-t-a palavrab i*m*b*e*c*i*l", "i_d_i_o_t_a i.m.b.e.c.i.l", "i - d - i - o - t - a im--be--cil", " ".join(common), "b-o-m d_i_a"]
    docs = spark.createDataFrame(list(enumerate(probes)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert min(got[0], got[1], got[2]) > 0.5 and max(got[3], got[4]) < 0.3
