"""Pages on which density alone must decide, densities by brute force, and broken pages."""

import math
import time

import numpy as np
import pytest

from veilspark.llm import html_extract as hx

PARA = "<p>" + "texto corrido e longo " * 20 + "</p>"
WANT = ("texto corrido e longo " * 20).strip()


def test_density_decides_without_names():
    links = "".join(f"<li><a href='{i}'>item {i}</a></li>" for i in range(30))
    page = f"<body><div><ul>{links}</ul></div><div><div><h1>Oi</h1>{PARA}{PARA}</div><div><ul>{links}</ul></div></div><div><span>fim</span></div></body>"
    assert hx.article_text(page) == f"Oi\n{WANT}\n{WANT}"


def test_sections_and_headings_join_the_core():
    links = "".join(f"<a href='{i}'>item {i}</a> " for i in range(30))
    page = f"<body><div>{links}</div><div><h1>Oi</h1><div>{PARA * 3}</div><div>{PARA * 2}</div></div><div>{links}</div></body>"
    assert hx.article_text(page) == "\n".join(["Oi", *[WANT] * 5])


def test_densities_equal_brute_force():
    rng = np.random.default_rng(3)

    def random_html(depth):
        inner = "".join(random_html(depth - 1) for _ in range(rng.integers(0, 4))) if depth else ""
        tag = rng.choice(["div", "section", "a", "b"])
        return f"<{tag}>{'x' * int(rng.integers(0, 9))}{inner}{'y' * int(rng.integers(0, 9))}</{tag}>"

    def count(n):
        """(characters, tags, link characters, link tags) of a node by recursion."""
        c = [sum(len(x.strip()) for x in n.inside if isinstance(x, str)), 0, 0, 0]
        for x in n.inside:
            if isinstance(x, hx.Node):
                a = count(x)
                c = [c[0] + a[0], c[1] + a[1] + 1, c[2] + a[2], c[3] + a[3]]
        return [c[0], c[1], c[0], c[3] + 1] if n.tag == "a" else c

    for _ in range(30):
        root = hx.parse(f"<body>{random_html(4)}{random_html(3)}</body>")
        nodes, share = hx.measure(root)
        body = count(next(n for n in nodes if n.tag == "body"))
        assert share == body[2] / max(1, body[0])
        for n in nodes:
            c, t, lc, lt = count(n)
            t, lt = max(1, t), max(1, lt)
            want = c / t
            base = math.log(math.log(c / max(1, c - lc) * lc + share * c + math.e))
            if base > 0 and c:
                want *= max(0, math.log(max(1, c / max(1, lc) * t / lt)) / base)
            assert n.density == pytest.approx(want)
            assert n.total == pytest.approx(sum(x.density for x in n.inside if isinstance(x, hx.Node)))


@pytest.mark.parametrize("part", ["<a b", '<a b="', "<b>", "<div>", "<li>", "</x><b>", "<i><header></header>", "<p '", "<!--", "&amp", "<script>"])
def test_broken_pages_of_a_megabyte(part):
    began = time.time()
    hx.article_text(part * (1_000_000 // len(part)))
    assert time.time() - began < 30


def test_rows(spark):
    rows = [(1, None, "<p>um</p>"), (1, None, "<p>um</p>"), (None, "u", None), (2, "u", "")]
    got = hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text) for r in got) == [(0, "u", ""), (1, "", "um"), (1, "", "um"), (2, "u", "")]
