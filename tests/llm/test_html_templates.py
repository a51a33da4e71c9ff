"""Templates of large hosts, below main, and pages nested deeply."""

from gleanery.llm import html_text as H


def test_deeply_nested_page():
    page = "<div>a" * 5000 + "<p>in" + "</div>" * 5000
    assert H.extract(page, {1}).split("\n\n") == ["a"] * 5000 + ["in"]


def test_a_section_s_box_and_a_list_below_main_go(spark):
    rows = [(i, f"http://a.com/{i}", ("<div>Box</div>" if i < 20 else "") + f"<p>Own {i}</p>") for i in range(400)]
    rows += [(1000 + i, f"http://b.com/{i}", f"<main><ul><li>Home</li></ul><p>Notice</p><p>Own {i}</p></main>") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in H.extract_main_text(df).collect()}
    assert got == {i: f"Own {i % 1000}" for i, _, _ in rows}
