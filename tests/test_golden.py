"""Literal expectations: abstention-aware metrics, ranking, exact tests, keys, thresholds, groups and guards."""

import random

import pytest
from gleanery.functions import numbers, pages, replies, texts, urls
from gleanery.operators import corpus, evidence, learning, metrics, paired, ranking
from gleanery.operators.graph import connected_components
from pyspark.sql import functions as F


def rows(spark, label, verdict, score=None):
    score = score or [None] * len(label)
    names = {"p": "phishing", "b": "benign", "i": "inconclusive"}
    data = [("x", i, names[a], names[b], s) for i, (a, b, s) in enumerate(zip(label, verdict, score))]
    return spark.createDataFrame(data, "arm string, case_id long, label string, verdict string, score double")


def test_confusion_with_abstentions(spark):
    c = metrics.forced(metrics.rates(metrics.confusion(rows(spark, "ppbbpb", "pbbpii"), ["arm"]))).first()
    assert (c.tp, c.fn, c.tn, c.fp, c.abstained_bad + c.abstained_good) == (1, 1, 1, 1, 2)
    assert c.coverage == pytest.approx(4 / 6) and c.precision == 0.5
    assert c.forced_recall == pytest.approx(1 / 3) and c.forced_fpr == pytest.approx(2 / 3) and c.forced_accuracy == pytest.approx(2 / 6)


def test_only_abstentions_leave_rates_undefined(spark):
    c = metrics.forced(metrics.rates(metrics.confusion(rows(spark, "pb", "ii"), ["arm"]))).first()
    assert c.coverage == 0 and c.risk is None and c.precision is None and c.forced_accuracy == 0


def test_published_counts(spark):
    counts = spark.createDataFrame([(1000, 435, 41, 459, 65, 0, 0)], "n long, tp long, fp long, tn long, fn long, abstained_bad long, abstained_good long")
    c = metrics.forced(metrics.rates(counts)).first()
    assert (round(c.forced_f1, 4), round(c.forced_accuracy, 3), round(c.forced_precision, 4), round(c.forced_fpr, 3)) == (0.8914, 0.894, 0.9139, 0.082)


def test_average_precision_and_auc(spark):
    d = rows(spark, "pbp", "ppp", [0.9, 0.8, 0.1])
    assert ranking.average_precision(d, ["arm"]).first().ap == pytest.approx((1 + 2 / 3) / 2)
    assert ranking.average_precision(rows(spark, "pb", "pp", [0.9, None]), ["arm"]).first().ap is None
    assert ranking.roc_auc(rows(spark, "pbpb", "pppp", [0.9, 0.9, 0.5, 0.1]), ["arm"]).first().auc == pytest.approx(0.625)


def test_lowest_threshold_may_lie_below_scores_that_miss_the_target(spark):
    d = rows(spark, "bppp", "pppp", [0.9, 0.8, 0.7, 0.6])
    t = ranking.threshold_at_precision(d, ["arm"], 0.75).first()
    assert (t.threshold, t.recall) == (0.6, 1.0)


def test_mcnemar(spark):
    d = spark.createDataFrame([(10, 0), (0, 0), (62, 73), (55, 88)], "b long, c long")
    p = [r.p for r in d.select("b", paired.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()]
    assert p[0] < 0.01 and p[1] == 1
    assert (round(p[2], 4), round(p[3], 4)) == (0.3895, 0.0072)


def test_holm(spark):
    d = spark.createDataFrame([(0.01,), (0.04,), (0.03,)], "p double")
    assert [round(r.p_holm, 6) for r in ranking.holm(d, "p").orderBy("p").collect()] == [0.03, 0.06, 0.06]


def test_identical_arms_differ_by_nothing(spark):
    d = rows(spark, "pbpbpb" * 5, "pbbbpp" * 5)
    pairs = paired.pair(d.unionByName(d.withColumn("arm", F.lit("y"))), "x", "y")
    out = paired.interval(paired.bootstrap_f1(pairs, 20)).first()
    assert (out.low, out.high) == (0, 0)


def test_urls(spark):
    d = spark.createDataFrame([("HTTPS://Example.COM:443/a/#frag",), ("http://a.b.example.co.uk/x?q=1",), ("https://evil.github.io",), ("nonsense",), (None,)], "url string")
    suffixes = spark.createDataFrame([("com",), ("uk",), ("co.uk",), ("io",)], "suffix string")
    d = urls.registrable(d.withColumn("host", urls.host_of(F.col("url"))), "host", suffixes)
    got = {r.url: (r.norm, r.registrable, r.site) for r in d.select("url", urls.normalize_url(F.col("url")).alias("norm"), "registrable", urls.site_key(F.col("host"), F.col("registrable")).alias("site")).collect()}
    assert got["HTTPS://Example.COM:443/a/#frag"][0] == "https://example.com/a"
    assert got["http://a.b.example.co.uk/x?q=1"][1] == "example.co.uk"
    assert got["https://evil.github.io"][2] == "evil.github.io"
    assert got["nonsense"][0] == "nonsense" and got[None][1] == ""


def test_certificate_names(spark):
    d = spark.createDataFrame([("a.x.com", "*.x.com"), ("b.a.x.com", "*.x.com"), ("a.x.com", "x.com"), ("x.com", "x.com"), ("k.web.app", "*.web.app")], "h string, n string")
    assert [r.k for r in d.select(urls.cover_kind(F.col("h"), F.col("n")).alias("k")).collect()] == ["wildcard", None, None, "exact", "wildcard"]
    assert [r.k for r in d.select(urls.certificate_scope(F.col("h"), F.col("n"), F.lit("web.app")).alias("k")).collect()] == ["own_wildcard", None, None, "host", "platform_wildcard"]


def test_page_and_text_functions(spark):
    kit = "<html><body>" + "<div><p>{}</p></div>" * 20 + "</body></html>"
    d = spark.createDataFrame([(kit.replace("{}", "one"),), (kit.replace("{}", "two words"),), ("<p>a<script>x</script> b</p>",)], "html string")
    keys = d.select(pages.skeleton_key(F.col("html")).alias("k"), pages.visible_text(F.col("html")).alias("t"), pages.truncate_html(F.col("html"), 20).alias("c")).collect()
    assert keys[0].k == keys[1].k and keys[2].k is None and keys[2].t == "a b"
    assert keys[2].c == "<p>a<script>[cut]"
    t = spark.createDataFrame([("Pay at http://x.io/1 now, mail a.b@c.com 123",), ("pay at www.other.net NOW mail zz@y.org 9",)], "t string")
    a, b = t.select(texts.template_key(F.col("t"))).collect()
    assert a == b
    q = t.select(texts.span_locator(F.lit("f"), F.col("t"), F.lit("now")).alias("l"), "t").withColumn("q", texts.resolve_span(F.col("l"), F.col("t")))
    assert [r.q for r in q.collect()] == ["now", None]
    assert t.select(texts.resolve_span(F.lit("f@5:900"), F.col("t"))).first()[0] is None


def test_replies(spark):
    d = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('so {"a": 2} ok',), ("no json",), (None,)], "r string")
    assert [r[0] for r in d.select(F.try_variant_get(replies.json_object(F.col("r")), "$.a", "int")).collect()] == [1, 2, None, None]
    said = {
        "I say PHISHING": "phishing", "It mimics a legitimate page: PHISHING": "phishing", "LEGITIMATE, not PHISHING": "inconclusive", "PHISHING" + " " * 80 + "LEGITIMATE": "phishing",
        "PHISHING" + " " * 70 + "LEGITIMATE": "inconclusive", "PHISHING or PHISHING": "phishing", "**legitimate** it is": "benign", "nothing": "inconclusive", "so legitimate": "inconclusive",
        "<thought>PHISHING</thought>LEGITIMATE": "benign", "Final: LEGITIMATE though PHISHING": "inconclusive",
    }
    d = spark.createDataFrame([(r,) for r in said], "r string")
    assert {r.r: r.v for r in d.select("r", replies.free_text_label(F.col("r")).alias("v")).collect()} == said
    marked = {"Final: [legitimate] though PHISHING": "benign", "final PHISHING, LEGITIMATE": "phishing", "PHISHING": "phishing"}
    d = spark.createDataFrame([(r,) for r in marked], "r string")
    assert {r.r: r.v for r in d.select("r", replies.free_text_label(F.col("r"), "Final").alias("v")).collect()} == marked


def test_cascade_notes_and_conclusion(spark):
    d = spark.createDataFrame([(None, None), (None, "benign"), ("benign", None), ("phishing", "benign"), ("benign", "phishing")], "a string, b string")
    assert [r[0] for r in d.select(replies.cascade(F.col("a"), F.col("b"))).collect()] == [None, "benign", "benign", "phishing", "phishing"]
    d = spark.createDataFrame([("scope=host ; n=3; empty=",), ("",), (None,)], "t string")
    assert [r[0] for r in d.select(replies.notes(F.col("t"))).collect()] == [{"scope": "host", "n": "3", "empty": ""}, {"": None}, None]
    every = (True, False, None)
    rows = [(s, o, c, g) for s in every for o in every for c in every for g in every]
    d = spark.createDataFrame(rows, "s boolean, o boolean, c boolean, g boolean")
    for r in d.select("*", numbers.conclusion(*(F.col(x) for x in "socg")).alias("v")).collect():
        bad, good = bool(r.s and r.o), bool(r.c and r.g)
        assert r.v == ("insufficient" if bad == good else "phishing" if bad else "benign")


def test_band_is_total(spark):
    for top, breadth, opposition, want in [(3, 2, 0, "decisive"), (3, 1, 0, "strong"), (2, 2, 0, "strong"), (2, 1, 0, "suggestive"), (1, 5, 0, "thin"), (3, 4, 1, "thin"), (None, 0, 0, "none")]:
        got = spark.range(1).select(evidence.band(F.lit(top).cast("int"), F.lit(breadth), F.lit(opposition))).first()[0]
        assert got == want


def test_greedy_dedup_is_the_sequential_rule(spark):
    r = random.Random(3)
    data = [(i, r.choice([None, *range(12)]), r.choice([None, *range(12)])) for i in range(60)]
    one, two, kept = set(), set(), []
    for i, a, b in data:
        if (a is None or a not in one) and (b is None or b not in two):
            kept.append(i)
            one |= {a} - {None}
            two |= {b} - {None}
    df = spark.createDataFrame(data, "i int, a int, b int")
    assert sorted(x.i for x in corpus.greedy_dedup(df, ("a", "b"), ["i"]).collect()) == kept


@pytest.mark.parametrize("seed", [1, 2])
def test_components_on_random_graphs(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 3), (4, 4)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {x: find(x) for x in root}


def test_groups_of_several_keys(spark):
    d = spark.createDataFrame([("1", "a", "x"), ("2", "a", "y"), ("3", "b", "y"), ("4", "c", None), ("5", None, None)], "row string, site string, skel string")
    got = {r.row: r.grp for r in corpus.campaign_groups(d, "row", ["site", "skel"]).collect()}
    assert got == {"1": "row:1", "2": "row:1", "3": "row:1", "4": "row:4", "5": "row:5"}


def test_logistic_matches_a_plain_solver(spark):
    import numpy as np

    r = np.random.default_rng(1)
    x, lam = r.normal(size=(80, 2)), 0.05
    y = (x[:, 0] - x[:, 1] + r.normal(size=80) > 0).astype(float)
    w = np.zeros(3)
    for _ in range(60):  # Newton steps on the mean loss with lam / 2 |w|^2, intercept free
        z = np.c_[x, np.ones(80)]
        p = 1 / (1 + np.exp(-z @ w))
        g = z.T @ (p - y) / 80 + lam * np.r_[w[:2], 0]
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / 80 + lam * np.diag([1, 1, 0]), g)
    df = learning.assemble(spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, y double"), ["a", "b"])
    m = learning.logistic(df, lam)
    assert np.allclose([*m.coefficients, m.intercept], w, atol=1e-4)


def test_numbers(spark):
    d = spark.createDataFrame([(0.0,), (0.5,), (None,)], "p double")
    got = d.select(numbers.platt(F.col("p"), 1.0, 0.0).alias("s"), numbers.band_verdict(F.col("p"), 0.1).alias("v"), numbers.forced_verdict(F.lit("inconclusive"), F.col("p"))[1].alias("o")).collect()
    assert [round(r.s, 6) if r.s is not None else None for r in got] == [0.01, 0.5, None]
    assert [r.v for r in got] == ["benign", "inconclusive", "inconclusive"] and [r.o for r in got] == ["score", "score", "default"]


def test_models_can_be_applied_after_components(spark):
    connected_components(spark.createDataFrame([(1, 2), (2, 3)], "a int, b int"), "a", "b").count()
    df = learning.assemble(spark.createDataFrame([(float(i), float(i % 3 == 0)) for i in range(12)], "a double, y double"), ["a"])
    assert learning.probability(learning.logistic(df, 0.1), df).count() == 12
