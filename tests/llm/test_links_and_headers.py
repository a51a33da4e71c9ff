"""Links resolved against their page; headers of articles; long pages."""

import pytest
from gleanery.llm import html_text, url_filters
from pyspark.sql import functions as F

BASE = "http://a.com/d/e/f?q=1#z"
LINKS = {
    "g": "http://a.com/d/e/g", "./g": "http://a.com/d/e/g", "../g": "http://a.com/d/g", "../../../g": "http://a.com/g", "..": "http://a.com/d/", ".": "http://a.com/d/e/", "/x/./y/../z": "http://a.com/x/z",
    "?y": "http://a.com/d/e/f?y", "g?u=../h": "http://a.com/d/e/g?u=../h", "#s": "http://a.com/d/e/f?q=1", "": "http://a.com/d/e/f?q=1", "//b.com/p": "http://b.com/p", "https://b.com/p#f": "https://b.com/p",
    "?to=http://b.com/": "http://a.com/d/e/f?to=http://b.com/", "mailto:me@b.com": None, "javascript:go()": None, "tel:1": None, "...": "http://a.com/d/e/...", "g/": "http://a.com/d/e/g/",
}


def test_links(spark):
    df = spark.createDataFrame([(h, BASE) for h in LINKS], "h string, b string")
    assert {r.h: r.u for r in df.select("h", url_filters.resolve(F.col("h"), F.col("b")).alias("u")).collect()} == LINKS
    df = spark.createDataFrame([("x", "http://a.com"), ("?x", "http://a.com"), ("x", None)], "h string, b string")
    assert [r.u for r in df.select(url_filters.resolve(F.col("h"), F.col("b")).alias("u")).collect()] == ["http://a.com/x", "http://a.com?x", None]


def test_relative_and_dead_links_in_the_alias_graph(spark):
    pages = [(1, "http://a.com/d/p", "<link rel=canonical href='../q?z=1'>"), (2, "http://a.com/q?z=1", ""), (3, "http://b.com/", "<link rel=canonical href='mailto:x@bad.net'>"), (4, "http://c.com/x", "<link rel=canonical href='#top'>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rules = url_filters.rule_table(spark, [("a.com/q", "block"), ("bad.net", "block")])
    assert {r.page_id: r.verdict for r in url_filters.judge_urls(df, rules).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_two_rules_of_one_length(spark):
    df = spark.createDataFrame([(1, "http://x.a.com/p/q", None)], "page_id long, url string, html string")
    for action in ("allow", "block"):
        rules = url_filters.rule_table(spark, [("a.com/p/", action), ("a.com/p/", action), ("com/p/q", "block")])
        r = url_filters.judge_urls(df, rules).first()
        assert (r.rule, r.verdict) == ("a.com/p/", action)


def text(spark, *pages):
    df = spark.createDataFrame([(i, f"http://h{i}.com/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_text.extract_main_text(df).orderBy("page_id").collect()]


CASES = [
    ("<article><header><h1>Title</h1></header><p>b</p></article>", "Title\n\nb"),
    ("<header><h1>Site</h1></header><article><header><div><h2>Title</h2><nav>menu</nav></div></header><p>b</p></article><footer>f</footer>", "Title\n\nb"),
    ("<article><header>by me, <a>share</a></header><p>b</p></article>", "b"),
    ("<article><header role=banner><h1>T</h1></header><p>b</p></article>", "b"),
    ("<main><header><h1>Site</h1></header><p>b</p></main>", "b"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_headers(spark, page, want):
    assert text(spark, page) == [want]


def test_a_very_long_page(spark):
    words = " ".join(f"w{i}" for i in range(200_000))
    assert text(spark, f"<article><h1>T</h1><p>{words}</p></article>") == [f"T\n\n{words}"]
