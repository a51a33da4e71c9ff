"""JOIN14, URL11: the certificates that cover a host and were valid by a day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gleanery.functions.urls import covering_names
from gleanery.sources.shared import materialize

#: As many of a host's certificates are listed, the latest.
LISTED = 50
CERTIFICATE = ("serial", "issuer", "common_name", "names", "not_before", "not_after", "covers")


def _named(certificates: DataFrame) -> DataFrame:
    """A row per certificate and distinct name, its common name among them, with what tells its serial number from others."""
    names = F.array_append(F.split(F.coalesce("names", F.lit("")), r"\s+"), F.coalesce("common_name", F.lit("")))
    clean = F.filter(F.array_distinct(F.transform(names, lambda n: F.trim(F.lower(n)))), lambda n: n != "")
    same = F.coalesce(F.col("serial").cast("string"), F.concat(F.lit("?"), F.sha2(F.to_json(F.struct(*CERTIFICATE[1:-1])), 256)))
    return certificates.where("not_before is not null").select(*CERTIFICATE[:-1], same.alias("_serial"), F.explode(clean).alias("_name"))


def _days(hosts: DataFrame) -> DataFrame:
    return hosts.where("host is not null and day is not null").select("host", "day").distinct()


def spans(asked: DataFrame, certificates: DataFrame) -> DataFrame:
    """``host``, ``covers``, ``_name``, ``_serial``, ``serial``, ``not_before``, and the days ``since`` and ``until`` (that day not included; null: for good) between
    which the host's certificate of this serial number is the one that began then.

    ``asked``: ``host``, ``_name`` and ``covers`` (``exact`` or ``wildcard``), the names that a host asks for. Of one serial number a host gets
    one certificate: one that names it exactly before a wildcard, else the earliest; so the earliest of either kind is all that any day can get.
    Certificates without a serial number are told apart by all they hold."""
    met = _named(certificates).select("_name", "_serial", "serial", "not_before").join(asked, "_name")
    kinds = [F.min(F.when(F.col("covers") == c, F.col("not_before"))).alias(c) for c in ("exact", "wildcard")]
    first = met.groupBy("host", "_serial", "serial").agg(*kinds)
    until = {"exact": F.lit(None).cast("int"), "wildcard": F.unix_date(F.to_date("exact"))}
    each = [F.struct(F.lit(c).alias("covers"), F.col(c).alias("not_before"), F.unix_date(F.to_date(c)).alias("since"), until[c].alias("until")) for c in until]
    rows = first.select("host", "_serial", "serial", F.inline(F.array(*each))).where("not_before is not null and (until is null or since < until)")
    return rows.join(asked, ["host", "covers"])


GROUP = ("host", "covers", "since", "until")


def _latest_first(*by: str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(F.desc("not_before"), F.desc_nulls_last("serial"))


def _active(days: DataFrame, groups: DataFrame) -> DataFrame:
    """The groups of spans that hold on a host's day."""
    return days.join(groups, "host").where("since <= unix_date(day) and (until is null or unix_date(day) < until)")


def counts(hosts: DataFrame, certificates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per distinct ``host`` and ``day`` that any certificate covers: ``n_before``, ``n_exact``, ``n_wildcard`` and ``first_not_before``; then the spans, and
    the groups of them that hold on each day, with how many began on a later day.

    ``hosts``: ``host``, ``day``. ``certificates``: ``serial``, ``issuer``, ``common_name``, ``names`` (split by white space), ``not_before``,
    ``not_after``; more columns are ignored. A host asks for its own name and, from three labels up, for the wildcard of its parent, so the
    join is on equal names. Hosts are asked once each, whatever the number of rows and days with them, and what began and ends
    on the same days is counted before it meets a day. Null hosts and days meet none."""
    days = _days(hosts)
    ask = days.select("host").distinct().select("host", F.explode(covering_names(F.col("host"))).alias("_ask"))
    rows = spans(materialize(ask.select("host", F.col("_ask.name").alias("_name"), F.col("_ask.covers").alias("covers")), "asked"), certificates)
    groups = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.min("not_before").alias("first"))
    held = _active(materialize(days, "days"), groups)
    kinds = [F.sum(F.when(F.col("covers") == c, F.col("n")).otherwise(0)).alias(f"n_{c}") for c in ("exact", "wildcard")]
    out = held.groupBy("host", "day").agg(F.sum("n").alias("n_before"), *kinds, F.min("first").alias("first_not_before"))
    later = Window.partitionBy("host", "day").orderBy(F.desc("since")).rangeBetween(Window.unboundedPreceding, -1)
    return out, rows, held.withColumn("later", F.coalesce(F.sum("n").over(later), F.lit(0)))


def _latest(rows: DataFrame, held: DataFrame, listed: int) -> DataFrame:
    """The ``listed`` latest spans of each host and day, with their ``_place``; of a group no more than these are taken, and no group
    that began before as many."""
    top = rows.withColumn("_top", F.row_number().over(_latest_first(*GROUP))).where(F.col("_top") <= listed)
    needed = held.where(F.col("later") < listed).select("day", *GROUP)
    alike = (F.col("t.host") == F.col("n.host")) & (F.col("t.covers") == F.col("n.covers")) & (F.col("t.since") == F.col("n.since")) & F.col("t.until").eqNullSafe(F.col("n.until"))
    met = top.alias("t").join(needed.alias("n"), alike).select("t.host", "n.day", "t.covers", "t._name", "t._serial", "t.serial", "t.not_before")
    place = F.row_number().over(_latest_first("host", "day"))
    return met.withColumn("_place", place).where(F.col("_place") <= listed)


def summary(hosts: DataFrame, certificates: DataFrame, key: str, listed: int = LISTED, columns: Sequence[str] = CERTIFICATE) -> DataFrame:
    """The rows of ``hosts`` ``(key, host, day)`` with ``n_before``, ``n_exact``, ``n_wildcard``, ``first_not_before``, ``last`` (the latest certificate) and
    ``certificates`` (the ``listed`` latest, in the order of their beginning, then serial number, each with ``columns``); ``status`` and the reason why
    there is none."""
    n, rows, held = counts(hosts, certificates)
    latest, known = _latest(rows, held, listed), ("serial", "not_before", "covers")
    if set(columns) - set(known):  # the rest of a certificate is looked up for those that are listed
        found = ("_name", "_serial", "not_before")
        rest = [c for c in CERTIFICATE if c not in known]
        picked = latest.select(*found).distinct()
        whole = _named(certificates).join(picked, list(found)).groupBy(*found).agg(F.min_by(F.struct(*rest), F.coalesce("names", F.lit(""))).alias("c"))
        latest = latest.join(whole, list(found)).select("host", "day", "_place", *known, "c.*")
    listing = F.array_sort(F.collect_list(F.struct((-F.col("_place")).alias("_place"), *columns)))
    lists = latest.groupBy("host", "day").agg(F.transform(listing, lambda c: F.struct(*(c[x].alias(x) for x in columns))).alias("certificates"))
    out = hosts.join(n.join(lists, ["host", "day"]), ["host", "day"], "left").select(key, "host", "day", *n.columns[2:], "certificates")
    out = out.fillna(0, ["n_before", "n_exact", "n_wildcard"])
    none = F.col("n_before") == 0
    return out.withColumns(
        {
            "last": F.try_element_at("certificates", F.lit(-1)), "status": F.when(none, "unavailable").otherwise("obtained"),
            "reason": F.when(none, "no_covering_cert_valid_before_observation"),
        }
    )


def scope(n_exact: Column, n_before: Column, host: Column, platform: Column) -> Column:
    """URL12: what of a host its certificates name: the host, its platform's wildcard, or a parent of its own; null without any."""
    parent = F.when(host.contains("."), F.regexp_replace(host, r"^[^.]*\.", "")).otherwise("")
    return F.when(n_exact > 0, "host").when((n_before > 0) & F.coalesce(parent == platform, F.lit(False)), "platform_wildcard").when(n_before > 0, "own_wildcard")
