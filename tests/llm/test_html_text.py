"""Main text of invented pages, site templates, and edge cases."""

import pytest
from gleanery.llm import html_text as H

PAGES = [
    ("<div>a<b>b</b> c<p>d &amp; e<ul><li>x<li>y</ul></div>", "ab c\n\nd & e\n\nx\n\ny"),
    ('<p>one<div class="cookie-notice">no</div>two', "one\n\ntwo"),
    ('<script>if(a<b)"</p>"</script>hi <!-- x > y -->there', "hi there"),
    ("a < b and c > d", "a < b and c > d"),
    ("<main>m<aside>s</aside> n</main> out", "m\n\nn"),
    ('<article>A<article class="comment">c</article></article>', "A"),
    ('<p>x<span class="ad">adv</span>y</p>', "xy"),
    ("<nav><ul><li>Home</ul></nav><article><h1 class='page-header'>T</h1><p>one\n two<br>three</article><footer>f</footer>", "T\n\none two three"),
    ("<form>q<input></form><p title='a>b'>t&nbsp;u &#x41;&lt;</p>", "t\xa0u A<"),
    ("<style>p{}</style><title>no</title><body>yes</body>", "yes"),
    ("<p>unclosed <b>bold<p>next <script>never ends", "unclosed bold\n\nnext"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_text(page, text):
    assert H.extract(page) == text


def pages():
    rows = []
    for i in range(12):
        strip = "<div><div>Our site</div><p>Read on</p></div>"
        rows.append((i, f"http://a.com/{i}", f"{strip}<div><p>Story {i}</p><p>Common</p></div>"))
        rows.append((100 + i, f"http://b.com/{i}", f"<div>Our site</div><article><p>Common</p><section><div>Box</div></section><p>Own {i}</p></article>"))
    return [*rows, (200, "http://c.com/", "<div>Our site</div>"), (201, None, None), (202, "http://c.com/", ""), (202, "http://c.com/", "")]


@pytest.mark.parametrize("joined", [False, True])
def test_templates_go_and_articles_stay(spark, monkeypatch, joined):
    if joined:
        monkeypatch.setattr(H, "BROADCAST_TEMPLATES", 0)
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").repartition(3)
    got = sorted((r.page_id, r.text) for r in H.extract_main_text(df).collect())
    want = [(i, f"Story {i}") for i in range(12)] + [(100 + i, f"Common\n\nOwn {i}") for i in range(12)]
    assert got == sorted([*want, (200, "Our site"), (201, ""), (202, ""), (202, "")])


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string, host string")
    assert H.extract_main_text(df).columns == ["page_id", "url", "html", "host", "text"]
    assert H.extract_main_text(df).count() == 0
