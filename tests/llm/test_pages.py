"""Main text of pages: hostile pages, containers, names and languages, and a plain version over the given pages."""

import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern.llm import html

TEXT = "The cat sat on the mat and it was not in the house of the man who was there with us on that day. " * 3
BODY = TEXT.strip()
JAPANESE = "日本語の文章はこのように書かれています。とても長い文です。猫がマットの上に座っていました。" * 4
RUSSIAN = ("Кошка сидела на ковре, и это было не в доме человека. Он был с нами в тот день, когда шёл дождь. " * 4).strip()


@pytest.mark.parametrize(
    "page",
    [
        "<b>" * 20_000 + "</i>" * 20_000, "<div>" * 20_000 + "</span>" * 20_000, "<article><p>x y</p></article>" * 6000, "<svg>" * 20_000, "<p " + "a " * 200_000,
        "<p " + '"' * 200_001, "<!--" * 100_000, "<div>" * 50_000 + "x" + "</div>" * 50_000, "<li>" * 50_000, "<a>" * 30_000 + "</p>" * 30_000, "<b><p></b>" * 20_000,
        "&" * 200_000, "<table><tr><td>" * 10_000 + "</table>" * 10, f"<div class='{'a-' * 100_000}'>x", "<svg><math><object>" * 10_000, "<p class=x>a" * 30_000, "<header><nav>" * 20_000,
    ],
    ids=range(17),
)
def test_hostile_pages(page):
    began = time.perf_counter()
    assert isinstance(html.main_text(page), str)
    assert time.perf_counter() - began < 1


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div class=story><p>{TEXT}</p><p>{TEXT}</p></div><article class=teaser><h3><a href=x>Read this</a></h3><p>Read this</p></article>", f"{BODY}\n\n{BODY}"),
        (f"<article><p>{TEXT}</p></article><article class=card><h3>Next</h3><p>Some more to read</p></article>", BODY),
        (f"<main><div class=lead>{TEXT}</div><article><p>A short one</p></article></main><div>Not so in here</div>", f"{BODY}\n\nA short one"),
        (f"<main><p>By us and the others who are in it</p><article><p>{TEXT}</p></article></main>", BODY),
        (f"<article><p>{TEXT}</p><div class='survey-results'><p>Forty said yes.</p></div><p class='share-price'>The share was at 3.</p></article>", f"{BODY}\n\nForty said yes.\n\nThe share was at 3."),
        (f"<article><p>{TEXT}</p><div class='banner'><p>{TEXT}</p><form>Your name</form></div><div class=share>Share it</div></article>", f"{BODY}\n\n{BODY}"),
        (f"<article><p>{TEXT}</p><div class='related-posts'><p>Of the same</p></div><div id=commentList><p>{TEXT}</p></div><div class='cookie-consent-banner'>{TEXT}</div></article>", BODY),
        (f"<nav>x</nav><div><h1>T</h1><p>{JAPANESE}</p><p>{JAPANESE}</p></div><footer>{JAPANESE}</footer>", f"T\n\n{JAPANESE}\n\n{JAPANESE}"),
        (f"<div class=menu>x</div><div><p>{RUSSIAN}</p><p>{RUSSIAN}</p></div><div id=sidebar>{RUSSIAN}</div>", f"{RUSSIAN}\n\n{RUSSIAN}"),
        (f"<div><p>{RUSSIAN.replace('.', '')}</p></div>", ""),
        (f"<article><p>a&lt;b&gt; &amp;amp; &#x41;&nbsp;&copy;</p><p>{TEXT}</p></article>", f"a<b> &amp; A ©\n\n{BODY}"),
    ],
)
def test_containers_names_and_languages(page, want):
    assert html.main_text(page) == want


class Plain(HTMLParser):
    """Text of the article by a standard parser: blocks begin and end at P and H1 tags, and no part has a name."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def plainly(page):
    parser = Plain()
    parser.feed(page)
    parser.close()
    return "\n\n".join(t for t in (" ".join(b.split()) for b in parser.blocks) if t)


def test_given_pages_against_a_standard_parser():
    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()
    assert len(rows) == 250
    for page in rows:
        assert html.main_text(page) == plainly(page)


def test_columns_that_clash(spark):
    pages = spark.createDataFrame([(1, "u", f"<article><p>{TEXT}</p></article>"), (1, "u", f"<article><p>{TEXT}</p></article>"), (None, None, None)], "page_id long, url string, html string")
    wide = pages.select("*", F.lit(1).alias("text"), F.lit(2).alias("n_chars"), F.lit("z").alias("row"))
    assert sorted(map(str, html.extract(wide).collect())) == sorted(map(str, html.extract(pages).collect()))
