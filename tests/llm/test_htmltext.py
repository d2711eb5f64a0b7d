"""Extraction against the texts that pages were made of."""

from __future__ import annotations

import html
import random

import pytest
from pyspark.sql import functions as F

from shortlist.llm.htmltext import main_lines, main_text


def text(page):
    return "\n".join(main_lines(page))


def para(rng, low=5, high=40):
    return " ".join("".join(rng.choices("abcde<&é\"", k=rng.randint(1, 8))) for _ in range(rng.randint(low, high)))


def page(rng, paragraphs, wrap):
    body = "".join(f"<p class=x>{html.escape(p)}</p>" if rng.random() < 0.7 else f"{html.escape(p)}<br>" for p in paragraphs)
    ad = '<div class="ad box">Buy <b>now</b>! Only today and only here in our large shop.</div>'
    return (
        "<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var t='</p>';</script></head><body>"
        "<header><h2>Site name and slogan</h2></header><nav><ul><li><a href='/a'>A</a></li><li><a href=/b>B</a></ul></nav>"
        "<!-- <p>not text</p> --><div id='cookie-notice'><p>We use cookies on this site, please do accept them.</p></div>"
        f"{ad}<form action=x><label>Mail</label><input name=q><select><option>1<option>2</select></form>"
        + wrap.format(body[: len(body)] + ad)
        + "<aside class='sidebar'><p>Other news that are long enough to look like text.</p></aside>"
        "<section id=comments><article class='comment'><p>First! What a fine text this is, thank you.</p></article></section>"
        "<footer>&copy; 2020 Site. All rights reserved, and so on and on.</footer></body></html>"
    )


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><div>{}</div></main>", "<div class='content'>{}</div>"])
def test_pages_give_back_their_paragraphs(wrap):
    rng = random.Random(len(wrap))
    for _ in range(40):
        paragraphs = [para(rng, 30, 60), *(para(rng) for _ in range(rng.randint(0, 8)))]
        assert text(page(rng, paragraphs, wrap)) == "\n".join(paragraphs)


def test_short_articles_and_headings_are_kept():
    assert text("<body><nav><a>x</a></nav><article><h1>A</h1><p><b>A.<br><p>B</article><footer>f</footer>") == "A\nA.\nB"
    assert text("<body><article><h1>A</h1><p>one<p>two<aside>no</aside><p>three") == "A\none\ntwo\nthree"


def test_character_references_and_space():
    assert text("<article><p> a&nbsp;&lt;b&gt;\n\t c&#233;&#x65; &am &amp d</p></article>") == "a <b> cée &am & d"


def test_odd_pages():
    assert text(None) == text("") == text("<html></html>") == text("<script>x") == text("<!-- open") == ""
    assert text("plain words") == "plain words"
    assert text("a < b and 3<4") == "a < b and 3<4"
    assert text("<div><p>x</div></div></p>y") == "x\ny"
    assert text("<article><p>" + "long " * 50000 + "</p></article>") == ("long " * 50000).strip()
    assert text("<b>" * 20000 + "deep") == "deep"


def test_column(spark):
    rows = [(1, "<article>a</article>", 1), (1, "<article>a</article>", 1), (None, None, None), (3, "", 2)]
    df = spark.createDataFrame(rows, "page_id long, html string, text long")
    got = df.select("page_id", main_text(F.col("html")).alias("m")).collect()
    assert [(r.page_id, r.m.text, r.m.n_lines) for r in got] == [(1, "a", 1), (1, "a", 1), (None, "", 0), (3, "", 0)]
    assert df.limit(0).select(main_text(F.col("html"))).collect() == []
