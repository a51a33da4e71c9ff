"""Covering certificates against plain loops: many names, wildcards, repeats of a serial number, and the fifty latest."""

import datetime as dt
import random

from gleanery.functions import records, urls
from gleanery.operators import certificates
from pyspark.sql import functions as F

SCHEMA = "serial string, issuer string, common_name string, names string, not_before timestamp, not_after timestamp, host string, day int"
DAY = dt.date(2024, 1, 10)


def summed(spark, hosts, certs):
    h = spark.createDataFrame(hosts, "case_id long, host string, day date")
    c = spark.createDataFrame([(*c, "clash", 1) for c in certs], SCHEMA)
    return certificates.summary(h, c, "case_id")


def run(spark, hosts, certs):
    return {r.case_id: r for r in summed(spark, hosts, certs).collect()}


def cert(serial, names, day, hour=0, common=None, issuer="CA"):
    begun = None if day is None else dt.datetime(2024, 1, day, hour)
    return serial, issuer, common, names, begun, begun and begun + dt.timedelta(90)


def brute(host, day, certs):
    bare = host.lower().rstrip(".")
    labels = bare.split(".")
    wide = "*." + ".".join(labels[1:]) if len(labels) >= 3 else None
    best = {}
    for serial, issuer, common, names, begun, _ in certs:
        every = {n.strip().lower() for n in (names or "").split()} | {(common or "").strip().lower()}
        covers = "exact" if bare in every else "wildcard" if wide and wide in every else None
        if covers and begun and begun.date() <= day:
            key = serial or ("none", issuer, common, names, begun)
            best[key] = min(best.get(key, ("z",)), (covers, begun, names or "", serial))
    return best


def test_many_names_and_hosts(spark):
    rng = random.Random(5)
    hosts = ["a.example.com", "b.example.com", "example.com", "com", "x.a.example.com", "B.Example.com."]
    names = [*hosts[:5], "*.example.com", "*.a.example.com", "*.com", "*.x.a.example.com", "other.net"]
    certs = [cert(rng.choice([None, f"s{rng.randint(0, 150)}"]), "\n".join(rng.sample(names, rng.randint(0, 4))).upper() if i % 2 else None, rng.randint(1, 14), i % 24, rng.choice([None, *names])) for i in range(400)]
    got = run(spark, [(i, h, DAY) for i, h in enumerate(hosts)], certs)
    for i, h in enumerate(hosts):
        want = brute(h, DAY, certs)
        kinds = [v[0] for v in want.values()]
        assert (got[i].n_before, got[i].n_exact, got[i].n_wildcard) == (len(want), kinds.count("exact"), kinds.count("wildcard")), h
        assert got[i].first_not_before == min((v[1] for v in want.values()), default=None)
        latest = sorted(v[1] for v in want.values())[-50:]
        assert [c.not_before for c in got[i].certificates or []] == latest and (not latest or got[i].last.not_before == latest[-1])
    assert got[0].n_wildcard > 0 and got[2].n_wildcard == 0 and got[3].n_wildcard == 0  # no wildcard under three labels


def test_observation_day_serials_and_nothing(spark):
    certs = [cert("1", "*.b.com", 10, 23), cert("1", "a.b.com", 10, 23), cert("2", "a.b.com", 11), cert("3", "a.b.com", None), cert(None, "a.b.com", 9), cert(None, "a.b.com", 9)]
    got = run(spark, [(1, "a.b.com", DAY), (2, "c.d.com", DAY), (3, None, DAY), (4, "a.b.com", None)], certs)
    assert [(c.serial, c.covers) for c in got[1].certificates] == [(None, "exact"), ("1", "exact")]
    assert (got[1].status, got[1].reason) == ("obtained", None)
    for i in (2, 3, 4):
        assert (got[i].n_before, got[i].status, got[i].reason, got[i].last) == (0, "unavailable", "no_covering_cert_valid_before_observation", None)
    assert run(spark, [(1, "a.b.com", DAY)], [])[1].n_before == 0


def test_names_that_can_cover(spark):
    d = spark.createDataFrame([("example.com", "*.com"), ("a.example.com", "*.example.com"), ("a.example.com", " A.Example.Com "), ("b.a.example.com", "*.example.com"), ("localhost", "localhost"), (None, "x")], "h string, n string")
    assert [r.k for r in d.select(urls.cover_kind(F.col("h"), F.col("n")).alias("k")).collect()] == [None, "wildcard", "exact", None, "exact", None]


def test_summary_text(spark):
    d = summed(spark, [(1, "shop.web.app", DAY)], [cert("1", "*.web.app\n  web.app", 2, issuer="C=US, O=X"), cert("2", "*.web.app", 8)])
    row = {c: F.col(c) for c in ("host", "day", "n_before", "n_exact", "n_wildcard", "first_not_before")}
    scope = certificates.scope(F.col("n_exact"), F.col("n_before"), F.col("host"), F.lit("web.app"))
    text = d.select(records.certificate_summary(scope, F.lit("web.app"), row, F.col("last")).alias("t")).first().t
    assert text == (
        "cert_scope=platform_wildcard (only the hosting platform's own wildcard certificate covers this host); platform_hosted=true (host is on the shared hosting platform web.app); host=shop.web.app; "
        "certs_covering_host_valid_on_or_before_observation=2 (exact_name=0, wildcard=2); first_covering_cert_valid_from=2024-01-02 (8 days before observation); latest_cert_covers=wildcard; latest_cert_issuer=CA; "
        "latest_not_before=2024-01-08; latest_not_after=2024-04-07; latest_names=*.web.app"
    )


def test_hosts_on_many_days_with_more_certificates_than_are_listed(spark):
    rng = random.Random(7)
    hosts, names = ["a.example.com", "b.example.com", "example.com"], ["a.example.com", "b.example.com", "example.com", "*.example.com", "other.net"]
    certs = [cert(rng.choice([None, f"s{rng.randint(0, 90)}"]), " ".join(rng.sample(names, rng.randint(0, 3))), rng.randint(1, 14), rng.randint(0, 23), rng.choice([None, *names])) for _ in range(500)]
    rows = [(h, dt.date(2024, 1, d)) for h in hosts for d in range(1, 15)]
    h = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "case_id long, host string, day date")
    c = spark.createDataFrame([(*c, "clash", 1) for c in certs], SCHEMA)
    got = {r.case_id: r for r in certificates.summary(h, c, "case_id", listed=7).collect()}
    for i, (host, day) in enumerate(rows):
        want = brute(host, day, certs)
        kinds = [v[0] for v in want.values()]
        assert (got[i].n_before, got[i].n_exact, got[i].n_wildcard) == (len(want), kinds.count("exact"), kinds.count("wildcard")), (host, day)
        assert got[i].first_not_before == min((v[1] for v in want.values()), default=None)
        assert [x.not_before for x in got[i].certificates or []] == sorted(v[1] for v in want.values())[-7:]


def test_pages_of_one_host_do_not_multiply_its_certificates(spark):
    c = spark.createDataFrame([(*cert(f"s{i}", "a.b.com *.b.com", 1 + i % 9), "clash", 1) for i in range(40)], SCHEMA)
    hosts = spark.createDataFrame([(i, "a.b.com", DAY) for i in range(300)], "case_id long, host string, day date")
    n, rows, _ = certificates.counts(hosts, c)
    assert (n.count(), rows.count()) == (1, 40)
    s = certificates.summary(hosts, c, "case_id", columns=("serial", "covers"))
    assert {(r.n_before, len(r.certificates), r.last.covers) for r in s.collect()} == {(40, 40, "exact")} and s.count() == 300


def test_listing_few_columns_looks_nothing_up(spark):
    c = spark.createDataFrame([(*cert("s1", "a.b.com", 2), "clash", 1), (*cert("s2", "*.b.com", 3), "clash", 1)], SCHEMA)
    hosts = spark.createDataFrame([(1, "a.b.com", DAY), (2, "a.b.com", dt.date(2024, 1, 2)), (3, "c.b.com", DAY)], "case_id long, host string, day date")
    s = certificates.summary(hosts, c, "case_id", columns=("serial", "covers"))
    assert {r.case_id: [tuple(x) for x in r.certificates] for r in s.where("n_before > 0").collect()} == {1: [("s1", "exact"), ("s2", "wildcard")], 2: [("s1", "exact")], 3: [("s2", "wildcard")]}
    assert "min_by" not in s._jdf.queryExecution().optimizedPlan().toString()
