"""FIL10, WIN20, AGG23, EVD32: what a case's evidence allows when parts of it are withheld or fail at first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The order of acquisition, the agents' fields and those they need, what text models cannot read, the fields that a
# directional verdict needs, and the conditions: withheld and transiently failing fields, attempts at most, captures, kind.
STAGES = {
    "message_body": 0, "url": 0, "redirect_chain": 1, "html": 2, "dom": 2, "page_content": 2, "screenshot": 2, "page_resources": 2, "brand_reference": 3, "dns": 4, "tls": 4,
    "ct": 4, "registration": 4, "hosting": 4,
}
AGENT_FIELDS = {
    "url": ("url", "redirect_chain"), "web_structure": ("html", "dom", "page_resources"), "content": ("page_content", "screenshot", "brand_reference"), "message": ("message_body",),
    "metadata": ("dns", "registration", "tls", "ct", "hosting"),
}
AGENT_REQUIRED = {"url": ("url",), "web_structure": ("html", "dom"), "content": ("page_content", "screenshot"), "message": ("message_body",), "metadata": ("dns", "registration", "tls", "ct", "hosting")}
UNREADABLE = ("screenshot",)
SUPPORTING_FIELDS = 2
NETWORK, RENDER, BROWSER = ("dns", "registration", "tls", "ct", "hosting"), ("dom", "page_content"), ("html", "dom", "page_content", "screenshot")
CONDITIONS = (
    ("base", (), (), 2, "split", "reference"),
    ("no_html", ("html",), (), 2, "split", "single"),
    ("no_dom", RENDER, (), 2, "split", "single"),
    ("no_screenshot", ("screenshot",), (), 2, "split", "single"),
    ("no_network_metadata", NETWORK, (), 2, "split", "single"),
    ("cum1_screenshot", ("screenshot",), (), 2, "split", "cumulative"),
    ("cum2_+render", ("screenshot", *RENDER), (), 2, "split", "cumulative"),
    ("cum3_+html_no_browser", BROWSER, (), 2, "split", "cumulative"),
    ("cum4_+network_url_only", (*BROWSER, *NETWORK), (), 2, "split", "cumulative"),
    ("transient_browser_recoverable", (), BROWSER, 2, "split", "recovery"),
    ("transient_browser_no_retry", (), BROWSER, 1, "split", "recovery"),
    ("conflict_swaps", (), (), 2, "conflict", "conflict"),
)


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def condition_table(spark: SparkSession, conditions: tuple = CONDITIONS) -> DataFrame:
    """FIL10: ``(condition, withheld, transient, r_max, captures, kind)``, a row each."""
    rows = [F.struct(F.lit(n).alias("condition"), _strings(w).alias("withheld"), _strings(t).alias("transient"), F.lit(r).alias("r_max"), F.lit(c).alias("captures"), F.lit(k).alias("kind")) for n, w, t, r, c, k in conditions]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def attempts(captured: DataFrame, conditions: DataFrame, budget: int) -> DataFrame:
    """WIN20: ``(condition, case_id, field, stage, attempt, outcome)``: the attempts that a case makes under each condition of its captures.

    ``captured``: ``(case_id, captures, field, state)``, ``state`` one of ok, failed, absent, inapplicable. Fields are fetched by stage, then
    by name, each attempt costs one of the budget, and the first that it does not cover ends the case. Only a transient failure
    is tried again, up to the condition's attempts; it strikes the first attempt at a field that is neither withheld nor inapplicable."""
    stage = F.create_map(*(F.lit(x) for pair in STAGES.items() for x in pair))
    m = captured.join(F.broadcast(conditions), "captures")  # a dozen rows
    withheld, transient = F.array_contains("withheld", F.col("field")), F.array_contains("transient", F.col("field"))
    strikes = transient & ~withheld & (F.col("state") != "inapplicable")
    last = F.when(F.col("state") == "inapplicable", "inapplicable").when(withheld, "withheld").when(F.col("state") == "failed", "failed").when(F.col("state") == "absent", "not_captured").otherwise("obtained")
    tries = F.when(strikes & (F.col("r_max") > 1), F.array(F.lit("transient"), last)).when(strikes, F.array(F.lit("transient"))).otherwise(F.array(last))
    # a field that does not apply to the submission is never asked for
    m = m.where("state <> 'inapplicable'").select("condition", "case_id", "field", F.coalesce(stage[F.col("field")], F.lit(5)).alias("stage"), F.posexplode(tries).alias("n", "outcome"))
    order = Window.partitionBy("condition", "case_id").orderBy("stage", "field", "n")
    m = m.withColumn("spent", F.row_number().over(order)).where(F.col("spent") <= budget)
    return m.select("condition", "case_id", "field", "stage", (F.col("n") + 1).alias("attempt"), "outcome")


def audit(captured: DataFrame, conditions: DataFrame, budget: int) -> DataFrame:
    """EVD32: per condition and case: applicable, ready and analysable agents and their ceiling (a share), obtained and readable fields,
    whether a directional verdict is possible, the fields to disclose as gaps, attempts, transient failures and recovered fields.

    An agent is applicable if a field of its applies, ready if one was obtained, analysable if one that it needs was and can be read;
    readable fields are those of analysable agents."""
    made = attempts(captured, conditions, budget)
    field = made.groupBy("condition", "case_id", "field").agg(F.max_by("outcome", "attempt").alias("final"), F.count(F.lit(1)).alias("tries"), F.count_if(F.col("outcome") == "transient").alias("failed"))
    when = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("field"))))  # noqa: E731  a dozen fields
    got = F.col("final") == "obtained"
    c = field.groupBy("condition", "case_id").agg(when(got).alias("obtained"), when(~got).alias("gaps"), when(got & (F.col("failed") > 0)).alias("recovered"), F.sum("tries").alias("attempts"), F.sum("failed").alias("transient_failures"))
    applies = captured.where("state <> 'inapplicable'").groupBy("captures", "case_id").agg(F.collect_set("field").alias("applies"))
    every = applies.join(F.broadcast(conditions.select("condition", "captures")), "captures")
    c = every.join(c, ["condition", "case_id"], "left")
    none = F.array().cast("array<string>")
    c = c.withColumns({n: F.coalesce(n, none) for n in ("obtained", "gaps", "recovered")} | {n: F.coalesce(n, F.lit(0)).cast("long") for n in ("attempts", "transient_failures")})
    read = F.array_except("obtained", _strings(UNREADABLE))
    met = lambda fields, have: F.arrays_overlap(_strings(fields), have)
    named = lambda test: F.array_compact(F.array(*(F.when(test(a), a) for a in AGENT_FIELDS)))
    applicable = named(lambda a: met(AGENT_FIELDS[a], F.col("applies")))
    ready = named(lambda a: met(AGENT_FIELDS[a], F.col("applies")) & met(AGENT_FIELDS[a], F.col("obtained")))
    analysable = named(lambda a: met(AGENT_FIELDS[a], F.col("applies")) & met(AGENT_REQUIRED[a], read))
    c = c.withColumns({"applicable": F.size(applicable), "ready": F.size(ready), "_agents": analysable})
    theirs = F.flatten(F.array(*(F.when(F.array_contains("_agents", a), _strings(f)).otherwise(none) for a, f in AGENT_FIELDS.items())))
    readable = F.array_sort(F.array_intersect(read, theirs))
    n = F.size("_agents")
    return c.select(
        "condition", "case_id", "applicable", "ready", n.alias("analysable"), F.try_divide(n.cast("double"), F.col("applicable").cast("double")).alias("ceiling"), "obtained",
        readable.alias("readable"), (F.size(readable) >= SUPPORTING_FIELDS).alias("verdict_possible"), "gaps", "attempts", "transient_failures", "recovered",
    )


def by_condition(audited: DataFrame, base: str = "base") -> DataFrame:
    """AGG23: per condition: means over its cases, the share of cases in which a verdict is possible, those that lost it against ``base``,
    and how many transient failures were made good."""
    before = audited.where(F.col("condition") == base).select("case_id", F.col("verdict_possible").alias("_could"))
    a = audited.join(before, "case_id", "left")
    mean = lambda c: F.avg(c.cast("double"))
    failed, recovered = F.sum("transient_failures"), F.sum(F.size("recovered"))
    return a.groupBy("condition").agg(
        F.count(F.lit(1)).alias("cases"), mean(F.col("ready")).alias("mean_ready"), mean(F.col("analysable")).alias("mean_analysable"), F.avg("ceiling").alias("mean_ceiling"),
        F.count_if(F.col("ceiling") < 0.5).alias("ceiling_below_half"), mean(F.size("readable")).alias("mean_readable"), mean(F.col("verdict_possible").cast("int")).alias("verdict_possible"),
        (1 - mean(F.col("verdict_possible").cast("int"))).alias("forced_abstention"), F.count_if(F.coalesce("_could", F.lit(False)) & ~F.col("verdict_possible")).alias("lost_vs_base"),
        mean(F.size("gaps")).alias("mean_gaps"), mean(F.col("attempts")).alias("mean_attempts"), failed.alias("transient_failures"), recovered.cast("long").alias("recovered"),
        F.try_divide(recovered.cast("double"), failed.cast("double")).alias("recovery_rate"),
    )
