"""Cutting in arrays, rank tables and the fold over bounds, each against a plain version."""

import base64
import random

import pyarrow as pa
from pyspark.sql import functions as F

from veilspark.llm import bpe

PIECES = [bytes([b]) for b in range(256)] + [b"ab", b"ba", b"aa", b"aab", b"abab", b"xaab", b"bb", b"aaaa", b"abb", b"\xc3\xa9"]
RANKS = {p: i for i, p in enumerate(PIECES)}


def merged(word):
    parts = [word[i : i + 1] for i in range(len(word))]
    while pairs := [(RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in RANKS]:
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [RANKS[p] for p in parts]


def test_arrays_cut_like_the_pattern():
    rng, cut = random.Random(3), bpe.splitter(bpe.CONTRACTED)
    some = [*"abstmdrevlL'''   \n\t\r\x1c\x0b\x8512²½!?.-éñ日𝒜", "'s", "'re", "'ll", "'ve", " '", " ", "é"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(14))) for _ in range(20_000)] + ["", "'", "'l", "l", " ", "  x", "x  "]
    pieces, ends = cut.cut(pa.array(["before", *texts]).slice(1))
    pieces, ends = pieces.to_pylist(), [0, *ends.tolist()]
    assert len(pieces) == ends[-1]
    for text, a, b in zip(texts, ends, ends[1:]):
        assert pieces[a:b] == cut.findall(text)
    assert cut.cut(pa.array([], pa.string()))[0].to_pylist() == []


def test_fold_over_bounds(spark):
    rng = random.Random(5)
    words = [bytes(rng.choice(b"aabbx\xc3\xa9") for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    words += [b"a", b"q", b"ab", b"qw", b"a" * 500, b"ab" * 150 + b"x", b"q" * 300]
    tables = bpe.rank_tables(words, bpe.prefixes(RANKS))
    assert len(tables[words.index(b"q" * 300)]) == 301 + 299  # linear in a long word
    rows = spark.createDataFrame(list(enumerate(tables.to_pylist())), "i long, t array<int>")
    got = {r.i: r.ids for r in rows.select("i", bpe.fold_word(F.col("t")).alias("ids")).collect()}
    assert all(got[i] == merged(w) for i, w in enumerate(words))
    assert len(bpe.rank_tables([], bpe.prefixes(RANKS))) == 0


def test_no_plan_holds_the_rank_file(spark, tmp_path):
    words = {f"w{i}".encode() for i in range(20_000)} - RANKS.keys()
    path = tmp_path / "r.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(p) + b" %d" % i for i, p in enumerate([*PIECES, *sorted(words, key=lambda w: (len(w), w))])))
    docs = spark.createDataFrame([(1, "w19999 aab xyz"), (2, "xyz"), (3, None)], "doc_id long, text string")
    out = bpe.encode(docs, str(path), bpe.CONTRACTED)
    assert len(out._jdf.queryExecution().toString()) < 50_000
    assert {r.doc_id: len(r.ids) for r in out.collect()} == {1: 12, 2: 3, 3: 0}


def test_python_works_once_in_a_task(spark, tmp_path, monkeypatch):
    path = tmp_path / "r.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(p) + b" %d" % i for i, p in enumerate(PIECES)))
    docs = spark.createDataFrame([(i, f"abba xaab{i} ababx" * i) for i in range(40)] + [(40, None), (None, "abba")], "doc_id long, text string")
    plans, write = [], bpe.materialize
    functions = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("MapInArrow")

    def materialize(df, *args):
        plans.append(functions(df))
        return write(df, *args)

    monkeypatch.setattr(bpe, "materialize", materialize)
    out = bpe.digests(docs, str(path), bpe.CONTRACTED)
    assert max([*plans, functions(out)]) == 1
    want = {i: sum(len(merged(w.encode())) for w in bpe.splitter(bpe.CONTRACTED).findall(t)) for i, t in docs.fillna("").collect()}
    assert {r.doc_id: r.n_tokens for r in out.collect()} == want
