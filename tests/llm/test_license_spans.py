"""Template spans against a plain version; both plans; base columns against a plain version."""

import re

import numpy as np

from veilspark.llm import license_scan as ls


def plain_spans(text, templates, k=ls.K):
    w = [x for x in re.split(ls.NOT_WORD, (text or "").lower()) if x]
    out = set()
    for t, (label, words) in enumerate(templates):
        tw = words.split(" ")
        votes = {}
        for i in range(len(w) - k + 1):
            for a in range(len(tw) - k + 1):
                if w[i : i + k] == tw[a : a + k]:
                    votes.setdefault(i - a, set()).add((a, i))
        group, last = [], None
        for d in [*sorted(votes), None]:
            if group and (d is None or d - last > ls.SHIFT):
                ats, pos = {a for a, _ in group}, [i for _, i in group]
                n = len({x for a in ats for x in range(a, a + k)})
                grams = len(tw) - k + 1
                if len(ats) >= ls.COVERAGE * grams and n >= ls.WORDS * len(tw) and len(ats) >= ls.DENSITY * (max(pos) - min(pos) + 1):
                    out.add((t, label, min(pos), max(pos) + k - 1, round(len(ats) / grams, 9)))
                group = []
            if d is not None:
                group += votes[d]
                last = d
    return out


def test_spans_and_base_equal_plain(spark):
    rng = np.random.default_rng(1)
    texts = [None, "", "cc by", "x, All Rights  Reserved. cc-by!"]
    for i in range(60):
        w = [f"w{x}" for x in rng.integers(0, 50, 20)]
        for _ in range(2):
            t = ls.TEMPLATES[rng.integers(0, len(ls.TEMPLATES))][1].split(" ")
            for _ in range(rng.integers(0, 4)):
                at = int(rng.integers(0, len(t)))
                t = t[:at] + [["neu"], [], ["neu", t[at]]][rng.integers(0, 3)] + t[at + 1 :]
            w += t + [f"w{x}" for x in rng.integers(0, 50, 5)]
        texts.append(" ".join(w).title())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(i, *s) for i, t in enumerate(texts) for s in plain_spans(t, ls.TEMPLATES)}
    for most in (100_000, 0):
        got = {(r.doc_id, r.template, r.label, r.first_word, r.last_word, round(r.coverage, 9)) for r in ls.template_spans(docs, broadcast_grams=most).collect()}
        assert got == want
    assert len(want) > 40
    base = {r.doc_id: r for r in ls.scan(docs).collect()}
    for i, t in enumerate(texts):
        w = [x for x in re.split(ls.NOT_WORD, (t or "").lower()) if x]
        places = [(j, label) for p, label in ls.PHRASES for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        starts = [j for j, _ in places]
        assert (base[i].n_words, base[i].n_base) == (len(w), len(places))
        assert (base[i].first_word, base[i].last_word) == (min(starts, default=None), max(starts, default=None))
        assert base[i].base_labels == ",".join(sorted({x for _, x in places}))
