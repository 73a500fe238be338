"""The template tree against a plain Python version."""

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from veilspark.llm import url_filter as uf


def plain(urls):
    """{(host, path): (template, purity)} by recursion over lists."""
    count = defaultdict(lambda: [0, 0, 0])
    for host, path, bad in urls:
        for i, x in enumerate((1, bad is not None, bad or 0)):
            count[host, path][i] += x
    total = np.sum(list(count.values()), axis=0)
    prior = total[2] / total[1] if total[1] else 0.0
    smooth = lambda c, up: (c[2] + uf.PRIOR * (up + prior) / 2) / (c[1] + uf.PRIOR)
    out = {}

    def name(seg, c, kids):
        n, lab, bad = np.sum(list(kids.values()), axis=0)
        rest = lab - c[1]
        if n < uf.LEAST:
            return "**"
        if len(kids) >= uf.LEAST_FAN and (len(kids) * uf.SPREAD > n or len(kids) > uf.FANOUT) and c[0] * uf.SPREAD <= n:
            return "*"
        if c[1] >= uf.LEAST and rest >= uf.LEAST:
            bound = math.sqrt(0.5 * math.log(2 / uf.ALPHA)) * (1 / math.sqrt(c[1]) + 1 / math.sqrt(rest))
            if abs(c[2] / c[1] - (bad - c[2]) / rest) < bound:
                return "~"
        return seg

    def grow(rows, template, up):
        kids = defaultdict(lambda: np.zeros(3, int))
        for key, segs, c in rows:
            kids[segs[0]] += c
        groups = defaultdict(list)
        for key, segs, c in rows:
            groups[name(segs[0], kids[segs[0]], kids)].append((key, segs[1:], c))
        for n, some in groups.items():
            own = smooth(np.sum([c for _, _, c in some], axis=0), up)
            deeper = []
            for key, segs, c in some:
                if n == "**" or not segs:
                    out[key] = (f"{template}/{n}", round(own, 9))
                else:
                    deeper.append((key, segs, c))
            if deeper:
                grow(deeper, f"{template}/{n}", own)

    for host in {h for h, _ in count}:
        rows = [((h, p), p.removeprefix("/").split("/"), np.array(c)) for (h, p), c in count.items() if h == host]
        grow(rows, "", smooth(np.sum([c for _, _, c in rows], axis=0), prior))
    return out


def test_tree_equals_plain_python(spark):
    rng = np.random.default_rng(7)
    urls = []
    for i in range(1200):
        host = ["a.org", "b.net", "c.com"][min(2, rng.integers(0, 5))]
        kind = rng.choice(["ads", "news", "wiki", "blog"])
        path = f"/{kind}/{rng.integers(0, 60)}" + f"/p{rng.integers(0, 3)}" * int(rng.integers(0, 3)) + "/" * int(rng.integers(0, 2))
        urls.append((host, path, None if rng.random() < 0.5 else int(rng.random() < {"ads": 0.97, "blog": 0.5}.get(kind, 0.05))))
    urls += [("deep.org", "/x" * 40, 1)] * 6 + [("", "", None)] * 3 + [("few.org", "/a/b", 1)]
    got = {(r.host, r.path): (r.template, round(r.purity, 9)) for r in uf.templates(spark.createDataFrame(urls, "host string, path string, bad int")).collect()}
    want = plain(urls)
    assert got == want
    names = " ".join(t for t, _ in got.values())
    assert "/*" in names and "/~" in names and "/**" in names and got["deep.org", "/x" * 40][0] == "/x" * 40
    assert len({p for _, p in got.values()}) > 10


def test_repeated_rows_and_unlabelled_hosts(spark):
    rows = [(i % 3, f"http://spam.org/ads/{i}", 1) for i in range(40)] + [(9, "http://spam.org/ads/new", None), (9, "http://spam.org/ads/new", None), (10, "http://other.org/x", None)]
    got = uf.judge(spark.createDataFrame(rows, "page_id long, url string, y int"), (), F.col("y")).where("page_id >= 9").collect()
    assert sorted((r.page_id, r.verdict) for r in got) == [(9, "block"), (9, "block"), (10, "block")]  # all labels are bad
    half = rows + [(20 + i, f"http://ok.org/n/{i}", 0) for i in range(40)]
    got = uf.judge(spark.createDataFrame(half, "page_id long, url string, y int"), (), F.col("y")).where("page_id in (9, 10)").collect()
    assert sorted((r.page_id, r.verdict) for r in got) == [(9, "block"), (9, "block"), (10, "allow")]
