"""Records of agents on cases: status, validity, lineage, issues, revisions. A record has arrays of the fields its agent may read
(``fields``), needs (``required``) and looked at (``examined``), of what the case ``obtained``, and of its items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONJUNCTS = ("schema_valid", "scope_valid", "basis_valid", "tool_valid", "locators_resolve")


def _within(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def analysis_status(required: Column, obtained: Column, unreadable: Column) -> Column:
    """FIL15: ran if some required field was obtained and can be read, else no data."""
    return F.when(F.size(F.array_intersect(required, F.array_except(obtained, unreadable))) > 0, "ran").otherwise("no_data")


def validity(status: Column, verdict: Column) -> dict[str, Column]:
    """EVD12: the five conjuncts of a record. ``verdict`` is the one it reports; ``declared`` and ``tools`` are its items'."""
    c = F.col
    return {
        "schema_valid": (status == "ran") | verdict.isNull(),
        "scope_valid": _within(c("declared"), c("fields")),
        "basis_valid": _within(c("examined"), F.array_intersect("fields", "obtained")),
        "tool_valid": _within(c("used"), c("tools")),
        "locators_resolve": _within(c("declared"), c("obtained")),
    }


def validated(records: DataFrame) -> DataFrame:
    """EVD12: ``failed`` names the false conjuncts in order; a record with any is an error and keeps no verdict."""
    said = validity(F.col("status"), F.col("verdict"))
    names = F.array_compact(F.array(*(F.when(~said[n], n) for n in CONJUNCTS)))
    ok = F.size("failed") == 0
    out = records.withColumn("failed", names)
    return out.withColumns({"status": F.when(ok, F.col("status")).otherwise("error"), "verdict": F.when(ok, F.col("verdict"))})


def other_refs(records: DataFrame) -> DataFrame:
    """EVD22: ``(case_id, agent, others)``: sorted references of the other agents' valid items. Agents of a case are a handful."""
    valid = records.where("status = 'ran'").select("case_id", F.col("agent").alias("who"), "refs")
    met = records.select("case_id", "agent").join(valid, "case_id").where("who <> agent")
    return met.groupBy("case_id", "agent").agg(F.array_sort(F.flatten(F.collect_list("refs"))).alias("others"))


def record_issues(records: DataFrame) -> DataFrame:
    """EVD21, EVD22: coverage issues (no data; rejected; skipped but arrived) and selection issues (never dispatched)."""
    arrived = F.array_sort(F.array_intersect("fields", "obtained"))
    kind = F.when(F.col("status") == "not_dispatched", "selection").otherwise("coverage")
    affected = F.when(F.col("status") == "no_data", F.array_sort("fields")).when(F.col("status").isin("error", "skipped"), arrived)
    raised = F.col("status").isin("no_data", "error", "not_dispatched") | ((F.col("status") == "skipped") & (F.size(arrived) > 0))
    out = records.where(raised).select("case_id", "agent", "status", kind.alias("kind"), F.coalesce(affected, F.array().cast("array<string>")).alias("affected"))
    refs = F.when(F.col("status") != "skipped", F.col("others"))
    out = out.join(other_refs(records), ["case_id", "agent"], "left")
    return out.select("case_id", "agent", "kind", "status", "affected", F.coalesce(refs, F.array().cast("array<bigint>")).alias("refs"))


def stopping_error(records: DataFrame, issues: DataFrame) -> DataFrame:
    """EVD25: the share of considered agents without a directional verdict, a quarter more for each issue, at most 1; 1 where no
    agent is considered. ``issues`` has one row an issue."""
    considered = F.count_if(F.col("status") != "skipped")
    decided = F.count_if((F.col("status") == "ran") & F.col("verdict").isNotNull())
    n = issues.groupBy("case_id").agg(F.count(F.lit(1)).alias("issues"))
    r = records.groupBy("case_id").agg(considered.alias("considered"), decided.alias("decided")).join(n, "case_id", "left").fillna(0, ["issues"])
    error = F.least(F.lit(1.0), 1 - F.col("decided") / F.col("considered") + 0.25 * F.col("issues"))
    return r.select("case_id", "considered", "decided", "issues", F.when(F.col("considered") == 0, 1.0).otherwise(error).alias("stopping_error"))


def revised(records: DataFrame, proposed: DataFrame) -> DataFrame:
    """EVD26: records with proposed revisions (``declared``, ``used``, ``refs``, ``cited``). A revision is accepted if it has items
    and cites some, its fields are authorised and obtained, and the new record is valid; else the old items stay."""
    new = proposed.select("case_id", "agent", *(F.col(c).alias(f"new_{c}") for c in ("declared", "used", "refs")), "cited")
    j = records.join(new, ["case_id", "agent"])
    both = F.array_intersect("fields", "obtained")
    ok = (F.size("new_refs") > 0) & (F.size("cited") > 0) & _within(F.col("new_declared"), both) & _within(F.col("new_used"), F.col("tools"))
    ok = ok & _within(F.col("examined"), both)
    return j.withColumn("accepted", ok).withColumn("final", F.when(ok, F.col("new_refs")).otherwise(F.col("refs")))


def borrowed_groups(lineage: DataFrame, current: DataFrame) -> DataFrame:
    """JOIN18, EVD16: ``(case_id, original, borrowed)`` where both observations are still current. ``lineage`` has, for each
    borrowed reference, those it was shown; ``current`` the references that stand."""
    shown = lineage.select("case_id", "borrowed", F.explode("shown").alias("original")).where("original <> borrowed")
    stands = current.select("case_id", "ref")
    kept = shown.join(stands.withColumnRenamed("ref", "borrowed"), ["case_id", "borrowed"], "left_semi")
    return kept.join(stands.withColumnRenamed("ref", "original"), ["case_id", "original"], "left_semi").distinct().select("case_id", "original", "borrowed")
