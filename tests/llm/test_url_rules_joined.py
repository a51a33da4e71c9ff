"""Rules that are joined by shuffle judge as those that are broadcast."""

from gleanery.llm import url_filters


def test_shuffled_rules(spark, monkeypatch):
    rows = [(i, f"http://{s}{h}.com/{p}/{i}", None) for i, (s, h, p) in enumerate((s, h, p) for s in ("", "a.", "x.a.") for h in "bcd" for p in ("en", "de"))]
    df = spark.createDataFrame([*rows, (99, None, None), (99, None, None)], "page_id long, url string, html string")
    rules = url_filters.rule_table(spark, [("b.com/", "block"), ("a.b.com/en", "allow"), ("x.a.c.com/de/", "block"), ("com/en", "block")])
    want = sorted(map(str, url_filters.judge_urls(df, rules).collect()))
    monkeypatch.setattr(url_filters, "BROADCAST_RULES", 0)
    got = url_filters.judge_urls(df, rules)
    assert sorted(map(str, got.collect())) == want and len({r.verdict for r in got.collect()}) == 2
