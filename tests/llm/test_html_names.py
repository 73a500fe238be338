import pytest

from veilspark.llm import html_extract

TEXT = "<p>" + "texto corrido " * 40 + "</p>"
WANT = ("texto corrido " * 40).strip()


@pytest.mark.parametrize("wrapper", [
    "<div class='content has-sidebar'>{}</div>", "<div class='no-sidebar'>{}</div>", "<article class='post comments-open'>{}</article>",
    "<article class='category-social'>{}</article>", "<div class='sidebar'>{}</div>", "<article class='related'>{}</article>",
    "<div class='banner'><main>{}</main></div>",
])
def test_names_never_cut_the_article(wrapper):
    page = "<body><div class='menu'><a href=1>a</a></div>" + wrapper.format(f"<div class='entry-header'><h1>Oi</h1></div>{TEXT}") + "<div class='site-footer'>fim</div></body>"
    assert html_extract.article_text(page) == f"Oi\n{WANT}"


def test_named_parts_are_cut():
    parts = "".join(f"<div class='{c}'><p>fora daqui</p></div>" for c in ("ad", "cookie-notice", "x related-posts", "social_links", "share-buttons"))
    long = "<div id='comments'><article class='comment'>" + TEXT * 3 + "</article></div>"
    assert html_extract.article_text(f"<body><article>{TEXT}{parts}</article>{long}</body>") == WANT
    assert html_extract.article_text(f"<body><div>{TEXT}{parts}</div></body>") == WANT


def test_sources_and_header_names_in_the_article_stay():
    links = "".join(f"<li><a href='{i}'>fonte {i}</a></li>" for i in range(4))
    page = f"<body><article><div class='header'><h1>Oi</h1></div>{TEXT}<ul>{links}</ul></article></body>"
    assert html_extract.article_text(page) == f"Oi\n{WANT}\nfonte 0\nfonte 1\nfonte 2\nfonte 3"
