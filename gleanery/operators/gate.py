"""AGG21, EVD23, EVD24, MLD15: whether a case is worth another round, and whom it asks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators import evidence, learning

FEATURES = ("Cov", "Agr", "Suf", "Conf", "Band", "Sol")
#: Fields from which support is sufficient, and the policies.
SUFFICIENT = 5
POLICIES = ("never", "fixed", "always", "calibrated")


def record_bands(records: DataFrame, items: DataFrame) -> DataFrame:
    """``(case_id, agent, band)``: the rung, 0 to 4, of each record that ran: of the side of its own verdict, by its own items."""
    own = F.struct("case_id", "agent")
    s = evidence.support(items.withColumn("case_id", own)).select("case_id.*", F.col("side").alias("verdict"), "breadth", "top", "opposition")
    rung = F.array_position(F.array(*map(F.lit, evidence.RUNGS)), evidence.band(F.col("top"), F.col("breadth"), F.col("opposition"))) - 1
    ran = records.where("status = 'ran'").select("case_id", "agent", "verdict")
    return ran.join(s, ["case_id", "agent", "verdict"], "left").select("case_id", "agent", rung.alias("band"))


def gate_features(records: DataFrame, items: DataFrame, dropped: DataFrame, conflicts: DataFrame, solicited: DataFrame) -> DataFrame:
    """AGG21: one row per case of ``records`` with the six features.

    Cov: records that ran among those not skipped. Agr: \\|P - B\\| / (P + B) over the directional items that are not
    ``dropped`` ``(case_id, ref)``. Suf: their distinct fields, at most five, over five. Conf: conflict issues (``conflicts``
    ``(case_id, n)``) over one more than those fields. Band: the mean rung of the records that ran, over four. Sol: accepted revisions
    (``solicited`` ``(case_id, n)``) over one more than all items. Items are those of records that ran; what has no base is 0."""
    status = records.groupBy("case_id").agg(F.count_if(F.col("status") != "skipped").alias("applicable"), F.count_if(F.col("status") == "ran").alias("ran"))
    mine = items.join(records.where("status = 'ran'").select("case_id", "agent"), ["case_id", "agent"], "left_semi")
    held = mine.groupBy("case_id").agg(F.count(F.lit(1)).alias("items"))
    sides = [F.count_if(F.col("direction") == s).alias(n) for n, s in (("p", "phishing"), ("b", "benign"))]
    kept = mine.join(dropped.select("case_id", "ref"), ["case_id", "ref"], "left_anti").where(F.col("direction").isin(*evidence.SIDES))
    kept = kept.groupBy("case_id").agg(*sides, F.count_distinct("field").alias("fields"))
    bands = record_bands(records, mine).groupBy("case_id").agg(F.avg("band").alias("band"))
    out = status.join(held, "case_id", "left").join(kept, "case_id", "left").join(bands, "case_id", "left")
    out = out.join(conflicts.select("case_id", F.col("n").alias("conflicts")), "case_id", "left").join(solicited.select("case_id", F.col("n").alias("solicited")), "case_id", "left")
    out = out.fillna(0)
    part = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    c = F.col
    return out.select(
        "case_id", part(c("ran"), c("applicable")).alias("Cov"), part(F.abs(c("p") - c("b")), c("p") + c("b")).alias("Agr"), (F.least(c("fields"), F.lit(SUFFICIENT)) / SUFFICIENT).alias("Suf"),
        part(c("conflicts"), c("fields") + 1).alias("Conf"), (c("band") / 4).alias("Band"), part(c("solicited"), c("items") + 1).alias("Sol"),
    )


def stopping_probability(intercept: float, weights: dict[str, float]) -> Column:
    """The modelled probability that the verdict is wrong if the case stops now; the exponent stays within 60."""
    z = F.lit(intercept)
    for f in FEATURES:
        z = z + F.lit(weights[f]) * F.col(f)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z))))


def actionable(issues: DataFrame, attempted: DataFrame) -> DataFrame:
    """EVD23: issues ``(case_id, no, agents)`` that name an agent whose route was not tried, of ``attempted`` ``(case_id, tried)``."""
    tried = F.coalesce("tried", F.array().cast("array<string>"))
    return issues.join(attempted, "case_id", "left").where(F.size(F.array_except("agents", tried)) > 0).drop("tried")


def gate(cases: DataFrame, tau: float, most_rounds: int) -> DataFrame:
    """EVD24: adds ``admits`` to rows of ``p``, ``actionable`` (whether any issue is), ``round`` (from 0), ``left`` (of the budget for
    collaboration) and ``policy``. ``never`` opens no round; ``fixed`` and ``always`` one whenever something is actionable; ``calibrated``
    also needs a probability above ``tau``, a round left and budget left. Another policy is an error."""
    calibrated = (F.col("p") > tau) & F.col("actionable") & (F.col("round") < most_rounds) & (F.col("left") > 0)
    policy = F.col("policy")
    unknown = F.raise_error(F.concat(F.lit("unknown gate mode: "), F.coalesce(policy, F.lit("null")))).cast("boolean")
    rule = F.when(policy == "never", False).when(policy.isin("fixed", "always"), F.col("actionable")).when(policy == "calibrated", calibrated).otherwise(unknown)
    return cases.withColumn("admits", rule)


def round_targets(issues: DataFrame, applicable: DataFrame, attempted: DataFrame, k: int, rounds: int) -> DataFrame:
    """EVD23: ``(case_id, round, place, agent, no)``: whom each round asks, and the issue that each answers.

    Issues ``(case_id, no, agents)`` are taken in order until they name ``k`` or more new agents; an issue's agents, in the order of their
    names, all count once it is taken. Only agents of ``applicable`` ``(case_id, agent)`` that were not tried (``attempted``
    ``(case_id, agent)``) are asked, and those asked are tried for the rounds after. ``rounds`` is a small number."""
    named = issues.select("case_id", "no", F.explode("agents").alias("agent")).join(applicable.select("case_id", "agent").distinct(), ["case_id", "agent"], "left_semi")
    tried, out = attempted.select("case_id", "agent"), None
    for r in range(rounds):
        new = named.join(tried.distinct(), ["case_id", "agent"], "left_anti").groupBy("case_id", "agent").agg(F.min("no").alias("no"))
        by_issue = Window.partitionBy("case_id").orderBy("no")
        before = F.count(F.lit(1)).over(by_issue.rangeBetween(Window.unboundedPreceding, -1))
        asked = new.withColumn("_before", before).where(F.col("_before") < k)
        asked = asked.select("case_id", F.lit(r).alias("round"), F.row_number().over(Window.partitionBy("case_id").orderBy("no", "agent")).alias("place"), "agent", "no")
        out = asked if out is None else out.unionByName(asked)
        tried = tried.unionByName(asked.select("case_id", "agent"))
    return out


def held_out(case: Column, percent: int = 25) -> Column:
    """MLD15: whole cases, by a hash of their id."""
    return F.conv(F.substring(F.md5(case.cast("string")), 1, 8), 16, 10).cast("long") % 100 < percent


def fit_gate(states: DataFrame, reg: float = 0.01) -> tuple[float, dict[str, float]]:
    """MLD15: intercept and weights of a logistic model of ``wrong`` on the six features, from the states that are not held out; without
    both outcomes it refuses."""
    df = states.select(*FEATURES, F.col("wrong").cast("double").alias("y"))
    if df.select("y").distinct().count() < 2:
        raise ValueError("need both correct and incorrect states to fit")
    model = learning.logistic(learning.assemble(df, FEATURES), reg)
    return float(model.intercept), dict(zip(FEATURES, map(float, model.coefficients), strict=True))
