"""Attempts under conditions, audits of cases and figures per condition, on literal cases."""

import pytest
from gleanery.operators import acquisition as A

FIELDS = ("url", "html", "dom", "page_content", "screenshot", "ct")


def captured(spark, states, captures="split"):
    return spark.createDataFrame([(c, captures, f, s) for c, row in states.items() for f, s in row.items()], "case_id long, captures string, field string, state string")


def whole(**other):
    return dict.fromkeys(FIELDS, "ok") | other


def conditions(spark, *names):
    return A.condition_table(spark, tuple(c for c in A.CONDITIONS if c[0] in names))


def made(spark, states, name, budget=100):
    rows = A.attempts(captured(spark, states), conditions(spark, name), budget).orderBy("case_id", "stage", "field", "attempt").collect()
    return [(r.case_id, r.field, r.attempt, r.outcome) for r in rows]


def test_only_transient_failures_are_tried_again_up_to_the_limit(spark):
    states = {1: whole(dom="failed", ct="absent", page_content="inapplicable")}
    two = [(1, "url", 1, "obtained"), (1, "dom", 1, "transient"), (1, "dom", 2, "failed"), (1, "html", 1, "transient"), (1, "html", 2, "obtained"), (1, "screenshot", 1, "transient"), (1, "screenshot", 2, "obtained"), (1, "ct", 1, "not_captured")]
    assert made(spark, states, "transient_browser_recoverable") == two
    assert made(spark, states, "transient_browser_no_retry") == [r if r[3] != "failed" else None for r in two if r[2] == 1]
    assert made(spark, states, "base") == [(1, "url", 1, "obtained"), (1, "dom", 1, "failed"), (1, "html", 1, "obtained"), (1, "screenshot", 1, "obtained"), (1, "ct", 1, "not_captured")]


def test_the_budget_ends_a_case_whatever_is_left(spark):
    assert [r[1:3] for r in made(spark, {1: whole()}, "transient_browser_recoverable", 4)] == [("url", 1), ("dom", 1), ("dom", 2), ("html", 1)]
    a = A.audit(captured(spark, {1: whole()}), conditions(spark, "transient_browser_recoverable"), 4).first()
    assert (a.obtained, a.gaps, a.recovered, a.attempts) == (["dom", "url"], ["html"], ["dom"], 4)  # what was never asked for is no gap
    none = A.audit(captured(spark, {1: whole()}), conditions(spark, "base"), 0).first()
    assert (none.applicable, none.ready, none.analysable, none.ceiling, none.verdict_possible, none.gaps, none.attempts) == (4, 0, 0, 0.0, False, [], 0)


def test_withheld_is_never_inapplicable_nor_transient(spark):
    assert [r[3] for r in made(spark, {1: {"html": "ok", "dom": "inapplicable"}}, "cum3_+html_no_browser")] == ["withheld"]


def test_audit_of_a_case(spark):
    a = A.audit(captured(spark, {1: whole(page_content="absent"), 2: {"url": "ok"}}), conditions(spark, "base"), 100)
    got = {r.case_id: r for r in a.collect()}
    # a screenshot makes the content agent ready, but a text model cannot read it, so not analysable
    assert (got[1].applicable, got[1].ready, got[1].analysable, got[1].ceiling) == (4, 4, 3, 0.75)
    assert (got[1].readable, got[1].gaps, got[1].verdict_possible) == (["ct", "dom", "html", "url"], ["page_content"], True)
    assert (got[2].ceiling, got[2].readable, got[2].verdict_possible) == (1.0, ["url"], False)


def test_figures_of_the_conditions(spark):
    states = {i: whole(ct="absent") for i in range(4)}
    both = captured(spark, states).unionByName(captured(spark, {0: whole()}, "conflict"))
    got = {r.condition: r for r in A.by_condition(A.audit(both, A.condition_table(spark), 100)).collect()}
    assert set(got) == {c[0] for c in A.CONDITIONS} and got["conflict_swaps"].cases == 1 and got["base"].cases == 4
    assert (got["transient_browser_no_retry"].recovery_rate, got["transient_browser_no_retry"].transient_failures) == (0.0, 16)
    assert (got["transient_browser_recoverable"].recovery_rate, got["transient_browser_recoverable"].recovered) == (1.0, 16)
    assert got["base"].recovery_rate is None and got["transient_browser_recoverable"].mean_attempts == 10
    only_url = got["cum4_+network_url_only"]
    assert (only_url.mean_readable, only_url.verdict_possible, only_url.lost_vs_base, only_url.ceiling_below_half) == (1.0, 0.0, 4, 4)
    assert got["no_dom"].mean_gaps == pytest.approx(3) and got["base"].forced_abstention == 0
