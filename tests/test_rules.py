"""Guards, triggers, records, as-of joins, swaps, exact tests and page shortening, on literal rows and against brute force."""

import math
import random

import pytest
from gleanery.functions import pages as P
from gleanery.functions import texts
from gleanery.operators import corpus, evidence, guards, metrics, paired, ranking, records, triggers
from gleanery.operators.asof import as_of
from pyspark.sql import functions as F

LEDGER = [
    ("decision", "a", 0, "c1", "phishing", None, "m"), ("decision", "a", 0, "c1", "benign", "o1", "m"), ("record", "a", 0, "c1", None, None, "m"), ("decision", "a", 1, "c1", "benign", None, "m"),
]


def ledger(spark, *more):
    return spark.createDataFrame([*LEDGER, *more], "kind string, arm string, repeat int, case_id string, verdict string, parent_object_id string, model_id string")


def test_child_decisions_are_ignored_and_repeats_kept_apart(spark):
    d = guards.parent_decisions(ledger(spark))
    assert sorted((r.repeat, r.verdict) for r in d.collect()) == [(0, "phishing"), (1, "benign")]
    guards.require_unique(d, ["arm", "repeat", "case_id"])
    guards.require_domain(d, "verdict", ("phishing", "benign"))
    guards.require_one(d, ["arm", "repeat"], ["model_id"])


@pytest.mark.parametrize("row", [("decision", "a", 0, "c1", "benign", None, "m"), ("decision", "a", 0, "c2", "odd", None, "m"), ("decision", "a", 0, "c2", None, None, "m"), ("decision", "a", 0, "c2", "benign", None, "n")])
def test_guards_refuse(spark, row):
    d = guards.parent_decisions(ledger(spark, row))
    with pytest.raises(guards.Refused):
        guards.require_unique(d, ["arm", "repeat", "case_id"])
        guards.require_domain(d, "verdict", ("phishing", "benign"))
        guards.require_one(d, ["arm", "repeat"], ["model_id"])


def test_split_guard_refuses_rows_of_other_splits_and_unlisted_ones(spark):
    m = spark.createDataFrame([(1, "dev"), (2, "test")], "case_id int, split string")
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "case_id int")
    assert guards.require_split(rows(1, 1), m, "dev").count() == 2
    for bad in (2, 3):
        with pytest.raises(guards.Refused):
            guards.require_split(rows(1, bad), m, "dev")


def test_unnamed_and_stand_in_models(spark):
    d = spark.createDataFrame([(None,), (" ",), ("FAKE-model ",), ("model-7b",)], "model_id string")
    assert [r[0] for r in d.select(guards.unnamed_models(d, ["fake-model"])).collect()] == [True, True, True, False]


def test_manifest_is_not_extended_by_a_split_it_has(spark):
    m = spark.createDataFrame([(1, "dev")], "case_id int, split string")
    assert corpus.extend_manifest(m, m.withColumn("split", F.lit("x"))).count() == 2
    with pytest.raises(ValueError):
        corpus.extend_manifest(m, m)


def page(**k):
    row = {"page_id": 1, "url": "https://shop.evil.com/paypal/x", "html": "<title>T</title>", "dom": "<title>T</title>", "page_content": None, "redirect_chain": None, "ct": None, "message_body": None, "screenshot": None}
    return {**row, **k}


def evidence_rows(spark, *rows):
    d = spark.createDataFrame([{**r, "registrable": "evil.com"} for r in rows], ", ".join(f"{k} {'int' if k == 'page_id' else 'string'}" for k in [*page(), "registrable"]))
    return d, spark.createDataFrame([("com",), ("org",), ("net",)], "suffix string")


def test_shared_entity(spark):
    d, _ = evidence_rows(spark, page(page_content="Your PayPal login"), page(page_id=2, page_content="paypals shop-x"), page(page_id=3, html="<title>paypal</title>", dom="x"))
    got = sorted((r.page_id, r.b, r.detail) for r in triggers.shared_entity(d, "registrable").collect())
    assert got == [(1, "page_content", "paypal"), (3, "html", "paypal")]  # shop is generic


def test_host_mismatch(spark):
    d, s = evidence_rows(
        spark, page(redirect_chain="https://a.com then https://www.other.org/x"), page(page_id=2, redirect_chain="https://x.evil.com/"), page(page_id=3, ct="a=1; queried_name=CDN.net; b"),
        page(page_id=4, message_body="http://a.net http://b.org"), page(page_id=5, message_body="http://x.evil.com"),
    )
    got = sorted((r.page_id, r.a, r.b, r.detail) for r in triggers.host_mismatch(d, s).collect())
    assert got == [
        (1, "url", "redirect_chain", "evil.com->other.org"), (3, "url", "ct", "evil.com!=cdn.net"), (4, "message_body", "message_body", "a.net,b.org"), (4, "message_body", "url", "evil.com"),
    ]


def test_cross_origin(spark):
    html = '<form action="https://x.org/a"></form><form action="/own"></form><noscript><iframe src="https://n.net/"></iframe></noscript><iframe src="//f.net/x"></iframe><meta http-equiv=refresh content="0;url=https://www.evil.com/">'
    d, s = evidence_rows(spark, page(html=html, dom=html.replace("x.org", "evil.com").replace("f.net", "evil.com")))
    assert [(r.a, r.detail) for r in triggers.cross_origin(d, s).collect()] == [("html", "form:x.org,iframe:f.net")]


def test_populated_vs_empty(spark):
    long = "<p>" + "word " * 20
    d, _ = evidence_rows(spark, page(html=long, dom="<p>x"), page(page_id=2, html=long, dom=long, page_content="short", screenshot="s"), page(page_id=3, html="<form></form>", dom="<p>", page_content=""))
    got = sorted((r.page_id, r.a, r.b) for r in triggers.populated_vs_empty(d).collect())
    assert got == [(1, "html", "dom"), (2, "screenshot", "page_content"), (3, "html", "page_content")]


RECORD = "case_id int, agent string, fields array<string>, required array<string>, tools array<string>, obtained array<string>, status string, verdict string, examined array<string>, declared array<string>, used array<string>, refs array<bigint>"


def record(spark, **k):
    r = {"case_id": 1, "agent": "x", "fields": ["url", "html"], "required": ["html"], "tools": ["t"], "obtained": ["url", "html"], "status": "ran", "verdict": "phishing", "examined": ["url"], "declared": ["url"], "used": ["t"], "refs": [1]}
    return spark.createDataFrame([{**r, **k}], RECORD)


@pytest.mark.parametrize(
    ("change", "failed"),
    [
        ({}, []), ({"status": "no_data"}, ["schema_valid"]), ({"status": "no_data", "verdict": None}, []), ({"declared": ["dns"], "obtained": ["url", "dns"]}, ["scope_valid"]), ({"declared": ["html"], "obtained": ["url"]}, ["locators_resolve"]),
        ({"examined": ["dns"]}, ["basis_valid"]), ({"used": ["t", "u"]}, ["tool_valid"]), ({"declared": [], "used": [], "refs": []}, []), ({"declared": ["dns"], "used": ["u"]}, ["scope_valid", "tool_valid", "locators_resolve"]),
    ],
)
def test_record_validity(spark, change, failed):
    r = records.validated(record(spark, **change)).first()
    assert r.failed == failed and (r.status == "error") == bool(failed) and (not failed or r.verdict is None)


def test_status_needs_a_required_field_that_can_be_read(spark):
    arrays = [(["html"], ["url", "html"], [], "ran"), (["shot"], ["url", "shot"], ["shot"], "no_data"), (["html"], ["url"], [], "no_data"), (["html"], [], [], "no_data")]
    d = spark.createDataFrame(arrays, "r array<string>, o array<string>, u array<string>, want string")
    assert all(x.want == x.got for x in d.withColumn("got", records.analysis_status(F.col("r"), F.col("o"), F.col("u"))).collect())


def test_revisions_must_cite_and_stay_in_scope(spark):
    base = record(spark)
    for new, ok in (({}, True), ({"cited": []}, False), ({"refs": []}, False), ({"declared": ["dns"]}, False), ({"used": ["u"]}, False)):
        p = {"case_id": 1, "agent": "x", "declared": ["html"], "used": ["t"], "refs": [7], "cited": [9], **new}
        proposed = spark.createDataFrame([p], "case_id int, agent string, declared array<string>, used array<string>, refs array<bigint>, cited array<bigint>")
        r = records.revised(base, proposed).first()
        assert r.accepted == ok and r.final == ([7] if ok else [1])


def test_stopping_error(spark):
    rows = [(1, "ran", "phishing"), (1, "ran", None), (1, "skipped", None), (2, "skipped", None), (3, "ran", "benign")]
    r = spark.createDataFrame(rows, "case_id int, status string, verdict string")
    issues = spark.createDataFrame([(1,), (3,)], "case_id int")
    assert {x.case_id: x.stopping_error for x in records.stopping_error(r, issues).collect()} == {1: 0.75, 2: 1.0, 3: 0.25}


def test_dispatch_goes_on_after_a_refusal(spark):
    d = spark.createDataFrame([(1, 0, 6), (1, 1, 5), (1, 2, 3), (1, 3, 1)], "case_id int, pos long, cost int")
    assert [(r.pos, r.spent, r.status) for r in evidence.dispatch_in_order(d, 9).orderBy("pos").collect()] == [(0, 6, "dispatched"), (1, 6, "not_dispatched"), (2, 9, "dispatched"), (3, 9, "not_dispatched")]
    p = d.select("case_id", F.lit(0).alias("stage"), F.lit("f").alias("field"), (F.col("pos") + 1).alias("attempt"), "cost")
    assert [r.status for r in evidence.acquire(p, 11).orderBy("attempt").collect()] == ["attempted", "retried", "refused", "refused"]


def test_as_of_against_brute_force(spark):
    r = random.Random(3)
    day = lambda: f"20{r.randrange(20, 24)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}" if r.random() > 0.05 else None
    key = lambda: r.choice([None, 1, 2, 3])
    left, right = [(i, key(), day()) for i in range(200)], [(key(), day(), r.randrange(1000)) for _ in range(90)]
    want = {}
    for i, k, t in left:
        seen = [(u, v) for h, u, v in right if h is not None and h == k and u is not None and t is not None and u <= t]
        want[i] = max(seen)[1] if seen else None
    a = spark.createDataFrame(left, "i int, k int, t string").withColumn("t", F.col("t").cast("date"))
    b = spark.createDataFrame(right, "k int, t string, v int").withColumn("t", F.col("t").cast("date"))
    assert {x.i: x.v for x in as_of(a, b, "k", "t", "v").collect()} == want


def test_swap_takes_the_group_alone(spark):
    rows = [(i, "ab"[i % 2], f"g{i % 3}", f"x{i}" if i % 5 else None, f"y{i}", f"u{i}") for i in range(60)]
    d = spark.createDataFrame(rows, "case_id int, label string, grp string, x string, y string, url string")
    got = corpus.swap_fields(d, ["x", "y"], ["grp"], "s").collect()
    by = {r[0]: r for r in rows}
    assert {r.case_id for r in got} == {r[0] for r in rows if r[3]}
    for r in got:
        base, donor = by[r.case_id], by[r.donor]
        assert base[1] != donor[1] and base[2] == donor[2] and (r.x, r.y, r.url, r.label) == (donor[3], donor[4], base[5], base[1])
    assert len({r.donor for r in got}) > 10


@pytest.mark.parametrize(("b", "c"), [(0, 0), (10, 0), (62, 73), (55, 88), (1, 1), (3, 4), (400, 520), (5000, 5200), (123456, 124321)])
def test_mcnemar_is_exact(spark, b, c):
    n, k = b + c, min(b, c)
    if n < 2000:
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
    else:
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
        want = min(1.0, 2 * math.fsum(map(math.exp, logs)))
    assert spark.range(1).select(paired.mcnemar(F.lit(b), F.lit(c))).first()[0] == pytest.approx(want, rel=1e-8)


@pytest.mark.parametrize("joined", [False, True])
def test_resamples_draw_every_case_as_often_as_any(spark, monkeypatch, joined):
    if joined:
        monkeypatch.setattr(paired, "BROADCAST_CASES", 0)
    d = spark.createDataFrame([(i, i) for i in range(50)], "case_id int, v int")
    t = paired.resample(d, 40)
    assert {r.n for r in t.groupBy("b").agg(F.sum("k").alias("n")).collect()} == {50}
    often = {r.v: r.n for r in t.groupBy("v").agg(F.sum("k").alias("n")).collect()}
    assert len(often) == 50 and 15 < min(often.values()) and max(often.values()) < 80


def test_adoption_prefers_the_cheapest_of_the_tied(spark):
    rows = [("ref", 0.80, 0.9, 5.0), ("a", 0.86, 0.90, 9.0), ("b", 0.857, 0.895, 3.0), ("c", 0.87, 0.80, 1.0), ("d", 0.83, 0.95, 0.5)]
    d = spark.createDataFrame(rows, "name string, f1 double, precision double, cost double")
    got = {r.name: (r.eligible, r.tied, r.chosen) for r in paired.adopt(d, "ref", 0.01, 0.01, 0.005).collect()}
    assert got == {"ref": (False, False, False), "a": (True, True, False), "b": (True, True, True), "c": (False, False, False), "d": (True, False, False)}
    assert [r.name for r in paired.adopt(d.where("name in ('ref', 'c')"), "ref", 0.01, 0.01, 0.005).where("chosen").collect()] == ["ref"]


def test_citations_recovery_and_agents(spark):
    d = spark.createDataFrame([("full", 1, "p", "p", 4, 1), ("full", 2, "b", "p", 0, 0), ("x", 1, "p", "b", 2, 2), ("x", 2, "b", "b", 3, 0)], "arm string, case_id int, label string, verdict string, returned int, dropped int")
    got = {r.arm: (r.unsupported, r.changed, r.changed_right, r.changed_wrong) for r in metrics.citation_support(d, "full").collect()}
    assert got == {"full": (0.25, 0, 0, 0), "x": (0.4, 2, 1, 1)}
    m = spark.createDataFrame([({"u": 0.9, "v": None}, 1), ({"u": 0.1, "v": 0.5}, 0), ({"u": 0.1}, 1)], "s map<string, double>, y int")
    got = {r.agent: (r.ran, round(r.returned, 4), r.auc) for r in ranking.agent_auc(m, "s", "y").collect()}
    assert got == {"u": (3, 1.0, 0.75), "v": (2, 0.5, None), "mean": (5, 0.75, 0.75)}
    t = spark.createDataFrame([(0.1, False), (0.2, False), (0.3, True), (0.4, False)], "score double, error boolean")
    assert ranking.largest_threshold(t, [0.15, 0.25, 0.35, 0.9], 0.3).first()[:] == (0.9, True)
    assert ranking.largest_threshold(t, [0.35], 0.1).first()[:] == (0.35, False)


def test_pages_are_shortened_from_the_middle(spark):
    html = "<html><head><title>T</title><style>s</style></head><body><!-- c --><custom><p>" + "</p><p>".join(f"line {i} of text" for i in range(60)) + f"</p></custom><p> </p><a href='{'x' * 300}'>end</a></body></html>"
    d = spark.createDataFrame([(html,), ("<p>short</p><script>x</script>",)], "h string")
    one, two = (r[0] for r in d.select(P.simplify_html(F.col("h"), 100)).collect())
    assert two == "<p>short</p> "
    assert len(one) <= 400 and one.startswith("<html><head><title>T</title>") and one.endswith(f"<a href='{'x' * 100}'>end</a></body></html>")
    assert "custom" not in one and "line 0 " in one and "line 59 " in one and "line 30 " not in one
    pieces = d.select(P.chunk_html(F.col("h"), 50)).first()[0]
    assert "".join(pieces) == html and all(p.endswith(">") for p in pieces) and all(len(p) <= 50 or p.count(">") == 1 for p in pieces)


def test_forms_are_part_of_the_skeleton(spark):
    kit = "<html><body>" + "<div><p>x</p></div>" * 20 + "<form><input type={}><input></form></body></html>"
    d = spark.createDataFrame([(kit.replace("{}", t),) for t in ("password", "Password", "email")], "h string")
    a, b, c = (r[0] for r in d.select(P.skeleton_key(F.col("h"))).collect())
    assert a == b != c and a is not None


def test_character_references_are_decoded(spark):
    d = spark.createDataFrame([("<p>a &amp; b &lt;c&gt; &amp;lt; &copy;&nbsp;d</p>",)], "h string")
    assert d.select(P.visible_text(F.col("h"))).first()[0] == "a & b <c> &lt; © d"


def test_numbered_spans_and_dates(spark):
    d = spark.createDataFrame([("a.b a.b a.b",)], "t string")
    at = [d.select(texts.span_locator_at(F.lit("f"), F.col("t"), F.lit("a.b"), F.lit(n))).first()[0] for n in (1, 3, 4)]
    assert at == ["f@0:3#1", "f@8:11#3", None]
    d = spark.createDataFrame([("x_20240229_y", "Thu, 29 Feb 2024 23:30:00 -0200"), ("x_20230229", "soon"), ("x_123456789", None)], "f string, m string")
    got = [(str(r[0]), str(r[1])) for r in d.select(texts.folder_date(F.col("f")), texts.mail_date(F.col("m"))).collect()]
    assert got == [("2024-02-29", "2024-03-01"), ("None", "None"), ("None", "None")]
