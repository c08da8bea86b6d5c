import re
import time
from html.parser import HTMLParser
from pathlib import Path

import pytest

from tidewatch.llm import html

LONG = "The house is on the hill and it was built by the people of the town for all who came to see the river in the north."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain words only", ""),
        (f"<p>{LONG}</p><p>Short end.</p>", f"{LONG}\n\nShort end."),
        (f"<nav><ul><li><a href='/x'>{LONG}</a></li></ul></nav><article><h1>Title &amp; more</h1><p>One<br>two  &nbsp; three</p><p><b>x<br><p>y</article><footer>{LONG}</footer>", "Title & more\n\nOne two three\n\nx\n\ny"),
        (f"<div class='ad'>{LONG}</div><div id=\"main-content\"><h2>Head</h2><p>{LONG}</p></div><div class='reader comments'><p>{LONG}</p></div>", f"Head\n\n{LONG}"),
        (f"<script>var t='<p>{LONG}</p>';</script><style>p{{}}</style><!-- <p>{LONG}</p> --><article>a &lt;b&gt; &#233;&eacute</article>", "a <b> éé"),
        (f"<header><p>{LONG}</p></header><main><p>{LONG}</p><form><p>{LONG}</p></form><aside>{LONG}</aside></main>", LONG),
        (f"<article><header><h1>T</h1><p>by me</p></header><p>a</p><section class='comments'><p>{LONG}</p></section><p>b</p></article>", "T\n\na\n\nb"),
        (f"<body><p>{LONG}</p><p>Home</p><div><a href='/'>{LONG}</a></div>", LONG),
    ],
)
def test_main_text(page, want):
    assert "\n\n".join(html.main_text(page)) == want


def test_broken_markup_does_not_break():
    for page in ("<", "<p", "<!--", "<script>", "a<b>c</", "<article><p title='>'>x</p>", "</div></article>", "<" * 2000, "<p>" * 3000 + "x"):
        html.main_text(page)
    assert html.main_text("<article><p title='>'>x</p>") == ["x"]


def test_query_over_a_table(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "k"), (1, "u", f"<article><p>{LONG}</p></article>", "k"), (None, None, None, "k"), (3, "v", "", "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted(html.extracted(pages).collect(), key=lambda r: r.page_id or 0)
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in out] == [(None, None, "", 0), (1, "u", LONG, len(LONG)), (1, "u", LONG, len(LONG)), (3, "v", "", 0)]
    assert html.extracted(pages.limit(0)).count() == 0


class Articles(HTMLParser):
    """A second reader of pages whose main text is what their article elements hold."""

    def __init__(self):
        super().__init__()
        self.blocks, self.text, self.inside, self.raw = [], "", 0, 0

    def cut(self):
        if self.inside and self.text.split():
            self.blocks.append(" ".join(self.text.split()))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "h2", "li", "div", "article"):
            self.cut()
        self.inside += tag == "article"
        self.text += " " * (tag == "br")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "h2", "li", "div", "article"):
            self.cut()
        self.inside -= tag == "article"

    def handle_data(self, data):
        self.text += data


FOLDER = Path("/root/testdata/sf0.01/pages.parquet")


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
def test_against_a_second_reader():
    import pyarrow.parquet as pq

    pages = pq.read_table(FOLDER, columns=["html"]).column(0).to_pylist()
    known = blocks = same = words = 0
    for page in pages:
        reader = Articles()
        reader.feed(re.sub(r"(?s)<(script|style|title)>.*?</\1>", "", page or ""))
        assert html.main_text(page) == reader.blocks
        found = html.blocks_of(page or "")
        known += sum(told for b, (_, told) in zip(found, html.labels_of(found), strict=True) if b.place > 0)
        blocks += sum(b.place > 0 for b in found)
        bare = re.sub(r"</?(article|nav|footer|div)[^>]*>", "<hr>", page or "")  # what the rule says without such tags
        kept = html.main_text(bare)
        same += sum(len(b) for b in kept if b in reader.blocks)
        words += sum(map(len, {*kept, *reader.blocks}))
    assert known > 0.5 * blocks and same > 0.8 * words


def test_languages_without_known_stop_words_and_misleading_names():
    for text in ("Дом стоит на холме, и его построили люди города для всех, кто приходил на север смотреть на реку. " * 3, "家は丘の上にあります。" * 30):
        text = text.strip()
        assert html.main_text(f"<nav><a href='/'>x</a></nav><div><h2>a</h2><p>{text}</p></div><footer>y</footer>")[-1] == text
    assert html.main_text(f"<article><div class='side-by-side'><p>{LONG}</p></div><p>a <math><mi>x</mi></math> b</p></article>") == [LONG, "a x b"]
    assert html.main_text(f"<div class='social-history'><p>{LONG}</p></div><div class='comment-list'><p>{LONG}</p></div>") == [LONG]
    assert html.main_text(f"""<article><p title="5' tall>{LONG}</p></article>""") == [LONG]
    assert html.main_text(f"<article><ul><li><a href=x>{LONG}</a></li><li><a href=y>More</a></li></ul><p>{LONG}</p></article>") == [LONG]


@pytest.mark.parametrize("page", ["<a " * 500_000, "<div>" * 100_000 + "</p>" * 100_000, "<p x='" * 200_000, "<script>" * 200_000, "</" * 500_000, "word " * 500_000])
def test_long_and_hostile_pages_take_linear_time(page):
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 30
