"""Whole pages against a brute-force reading of their article element, and what decides."""

import re
from html.parser import HTMLParser

import pytest
from conftest import SF

from marlstone.llm import html_extraction
from marlstone.llm.html_extraction import main_text
from marlstone.llm.queries import QUERIES

BLOCK = set("p h1 h2 h3 h4 h5 h6 div ul ol li article section table tr td".split())


class Article(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in BLOCK:
            self.blocks.append("")
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in BLOCK:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def article(page):
    own = Article()
    own.feed(page)
    own.close()
    return "\n\n".join(t for t in (re.sub(r"\s+", " ", b).strip() for b in own.blocks) if t)


def test_registered_query_against_article_elements(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()
    wanted = sorted((p.page_id, p.url, t := article(p.html), len(t)) for p in pages)
    assert sorted(tuple(r) for r in QUERIES["op1_tag_path_ratios"](spark, SF).collect()) == wanted


def test_paths_decide(spark, monkeypatch):
    pages = [r.html for r in spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/pages.parquet").select("html").collect()]
    wanted = [article(x) for x in pages]
    assert [main_text(x) for x in pages] == wanted
    # an article need not say that it is one
    assert [main_text(re.sub("<(/?)article>", r"<\1div>", x)) for x in pages] == wanted
    monkeypatch.setattr(html_extraction, "content_paths", lambda blocks: {path for path, *_ in blocks})
    assert sum(main_text(x) != t for x, t in zip(pages, wanted, strict=True)) > 0.9 * len(pages)


PARTS = [f"Paragraph {k} is long enough, with words; and marks." for k in range(6)]
BODY, TEXT = "".join(f"<p>{x}</p>" for x in PARTS), "\n\n".join(PARTS)


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<article><h1>T</h1>{BODY}<div class="story social-history"><p>In the old days, people; met here.</p></div></article>', f"T\n\n{TEXT}\n\nIn the old days, people; met here."),
        (f'<article>{BODY}<div class="notice-of-intent">Short.</div></article>', f"{TEXT}\n\nShort."),
        (f"<main><article><h2>A</h2>{BODY}</article><article><h2>B</h2><p>Short second one, with a mark.</p></article></main>", f"A\n\n{TEXT}\n\nB\n\nShort second one, with a mark."),
        (f'<article><h1>T</h1>{BODY}</article><section id="comments"><h3>Said</h3><p>I agree with all of this, thanks a lot; really.</p></section>', f"T\n\n{TEXT}"),
        (f'<article><h1>T</h1>{BODY}<div class="comment-list"><p>I agree with this, thanks.</p></div></article>', f"T\n\n{TEXT}"),
        (f"<article><h1>T</h1>{BODY}<div class=tools><a href=x>Share it</a> <a href=y>Mail</a></div></article>", f"T\n\n{TEXT}"),
        (f"<article>{BODY}<div class=tbl><table><tr><td>1<td>2<tr><td>3</table></div></article>", f"{TEXT}\n\n1\n\n2\n\n3"),
        (f"<article>{BODY}<ul><li>one<li>two</ul><blockquote><p>Be.</p></blockquote><figure><figcaption>Fig 1</figcaption></figure></article>", f"{TEXT}\n\none\n\ntwo\n\nBe.\n\nFig 1"),
        (f"<article><p title=don't>A first one, long enough to count here.</p>{BODY}</article>", f"A first one, long enough to count here.\n\n{TEXT}"),
        (f'<body><div class="cookie-banner"><p>We use cookies to give you the best experience, of course.</p></div><div id=content>{BODY}</div></body>', TEXT),
        (f'<div class=wrap><div class="main-col">{BODY}</div><div class="sidebar"><h4>News</h4><p>Other news, here, and there.</p></div></div>', TEXT),
        (f'<body><div class="widget">{BODY}</div></body>', TEXT),
        (f"<body><header><h1>Site</h1><p>Some claim of it.</p></header><article><header><h1>T</h1></header>{BODY}</article></body>", f"T\n\n{TEXT}"),
        (f"<body><div>First line, long; yes.<br>Second line of it.<p>{PARTS[0]}</p>tail text</div></body>", f"First line, long; yes. Second line of it.\n\n{PARTS[0]}\n\ntail text"),
        (f"<article>{BODY}<div hidden><p>Not shown, ever; really not shown at all.</p></div></article>", TEXT),
        ("<p>a &#" + "9" * 5000 + "; b &#65; &#00000000000000066; &#xD800; &#x110000; &#x" + "F" * 40 + "; &amp;amp; c, long enough</p>", "a � b A B � � � &amp; c, long enough"),
        ("<nav><a href=/>Home</a></nav>", ""),
        ("x" * 200_000, "x" * 200_000),
    ],
)
def test_parts_of_pages(page, text):
    assert main_text(page) == text


def test_clashing_columns_and_repeated_rows(spark):
    from pyspark.sql import functions as F

    at = spark.createDataFrame([(1, "u", f"<article>{BODY}</article>")] * 2 + [(None, None, None)], "page_id long, url string, html string").withColumns({"text": F.lit("t"), "n_chars": F.lit(9)})
    got = sorted((tuple(r) for r in html_extraction.extract(at).collect()), key=str)
    assert got == [(1, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT)), (None, None, "", 0)]
