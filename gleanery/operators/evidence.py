"""Findings tables: strength bands, dependency groups, issues, gates and coverage. All keyed by case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.texts import grounded
from gleanery.functions.urls import extract_urls
from gleanery.operators.graph import connected_components

SIDES = ("phishing", "benign")


def support(findings: DataFrame) -> DataFrame:
    """AGG19: per case and side: breadth (distinct fields), top strength, and the contrary fields at least as strong."""
    rows = findings.where(F.col("direction").isin(*SIDES))
    own = rows.groupBy("case_id", F.col("direction").alias("side")).agg(F.countDistinct("field").alias("breadth"), F.max("strength").alias("top"))
    other = rows.withColumn("side", F.when(F.col("direction") == "phishing", "benign").otherwise("phishing"))
    strongest = other.groupBy("case_id", "side", "field").agg(F.max("strength").alias("most"))
    against = own.join(strongest, ["case_id", "side"]).where("most >= top").groupBy("case_id", "side").agg(F.count(F.lit(1)).alias("opposition"))
    return own.join(against, ["case_id", "side"], "left").fillna(0, ["opposition"])


def band(top: Column, breadth: Column, opposition: Column) -> Column:
    """EVD13: the five-rung ladder; none without support."""
    return (
        F.when(top.isNull(), "none")
        .when((top == 3) & (breadth >= 2) & (opposition == 0), "decisive")
        .when((opposition == 0) & ((top == 3) | ((top == 2) & (breadth >= 2))), "strong")
        .when((top == 2) & (opposition == 0), "suggestive")
        .otherwise("thin")
    )


def preliminary(findings: DataFrame) -> DataFrame:
    """EVD11: the direction with strictly more distinct fields."""
    n = [F.count_distinct(F.when(F.col("direction") == s, F.col("field"))).alias(s) for s in SIDES]
    c = findings.groupBy("case_id").agg(*n)
    return c.withColumn("verdict", F.when(F.col("phishing") > F.col("benign"), "phishing").when(F.col("benign") > F.col("phishing"), "benign").otherwise("neutral"))


def shared_groups(findings: DataFrame, source: str) -> DataFrame:
    """EVD14, EVD30: observations of one case and capture with the same artifact, instrument or text, two or more, in order."""
    g = findings.groupBy("case_id", "capture_id", source).agg(F.array_sort(F.collect_list("ref")).alias("refs"))
    return g.where(F.size("refs") >= 2)


def discounted(groups: DataFrame) -> DataFrame:
    """EVD18: all but the first member of each group."""
    return groups.select("case_id", F.posexplode("refs").alias("pos", "ref")).where("pos > 0").select("case_id", "ref").distinct()


def common_cause_links(findings: DataFrame, controlled: list[str]) -> DataFrame:
    """EVD15, JOIN8: pairs of one case and capture on attacker-controlled fields, of different artifacts, that name the
    same entity: an equi-join on the entity, within the case."""
    f = findings.where(F.col("field").isin(controlled)).select("case_id", "capture_id", "entity", "artifact", "ref")
    a, b = f.alias("a"), f.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("case_id", "capture_id", "entity")]
    on += [F.col("a.ref") < F.col("b.ref"), F.col("a.artifact") != F.col("b.artifact")]
    return a.join(b, on).select("a.case_id", F.col("a.ref").alias("a"), F.col("b.ref").alias("b"))


def conflict_issues(findings: DataFrame) -> DataFrame:
    """EVD19: cases with substantive findings of both directions, the fields and agents concerned."""
    rows = findings.where(F.col("direction").isin(*SIDES))
    g = rows.groupBy("case_id").agg(
        F.countDistinct("direction").alias("k"), F.array_sort(F.collect_set("field")).alias("fields"), F.array_sort(F.collect_set("agent")).alias("agents")
    )
    return g.where("k = 2").select("case_id", F.array_join("fields", ",").alias("fields"), F.array_join("agents", ",").alias("agents"))


def unexamined(findings: DataFrame, obtained: DataFrame) -> DataFrame:
    """EVD20: obtained fields of a case that no finding examines."""
    seen = findings.groupBy("case_id").agg(F.collect_set("field").alias("seen"))
    have = obtained.groupBy("case_id").agg(F.collect_set("field").alias("have"))
    left = F.array_sort(F.array_except("have", F.coalesce("seen", F.array().cast("array<string>"))))
    return have.join(seen, "case_id", "left").select("case_id", F.array_join(left, ",").alias("fields")).where("fields <> ''")


def feature_histogram(findings: DataFrame) -> DataFrame:
    """AGG18: ``field:direction:strength`` counts per case, as a map."""
    key = F.concat_ws(":", "field", "direction", F.col("strength").cast("string"))
    c = findings.groupBy("case_id", key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("case_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias("histogram"))


RUNGS = ("none", "thin", "suggestive", "strong", "decisive")


def reply_errors(replies: DataFrame) -> DataFrame:
    """FIL18: what is wrong with a stored reply: it cites what is not eligible, decides without citing, or leaves gaps or issues
    undisclosed. Rows have the arrays ``cited``, ``eligible``, ``gaps``, ``said_gaps``, ``issues`` and ``said_issues``, and ``verdict``."""
    left = lambda a, b: F.size(F.array_except(a, b)) > 0
    rules = {
        "cites outside": left("cited", "eligible"), "cites nothing": F.col("verdict").isin(*SIDES) & (F.size("cited") == 0), "gap not disclosed": left("gaps", "said_gaps"),
        "issue not disclosed": left("issues", "said_issues"),
    }
    return replies.withColumn("errors", F.array_compact(F.array(*(F.when(w, n) for n, w in rules.items()))))


def acquire(plan: DataFrame, pool: float) -> DataFrame:
    """WIN20: attempts by stage, field and number, retries charged like first ones, until the case's pool does not cover the next one;
    whatever comes after that is not attempted."""
    w = Window.partitionBy("case_id").orderBy("stage", "field", "attempt").rowsBetween(Window.unboundedPreceding, 0)
    spent = plan.withColumn("spent", F.sum("cost").over(w))
    return spent.withColumn("status", F.when(F.col("spent") <= pool, F.when(F.col("attempt") > 1, "retried").otherwise("attempted")).otherwise("refused"))


def shown_again(findings: DataFrame, cited: DataFrame, fresh: DataFrame) -> DataFrame:
    """EVD31: what an agent that is asked again is shown: the items that others' arguments cite, and its own, unless it is new to
    the case or was rejected (``fresh``, by case and agent)."""
    agents = findings.select("case_id", "agent").distinct()
    own = findings.select("case_id", "agent", "ref").join(fresh, ["case_id", "agent"], "left_anti")
    others = agents.join(cited.select("case_id", F.col("agent").alias("who"), "ref"), "case_id").where("who <> agent")
    return own.unionByName(others.select("case_id", "agent", "ref"))


def bounded_conclusion(findings: DataFrame, dropped: DataFrame, fields: int, coverage: float) -> DataFrame:
    """EVD28, EVD29: two or more distinct fields that are not discounted on one side alone, and enough coverage."""
    left = findings.join(dropped, ["case_id", "ref"], "left_anti")
    n = [F.countDistinct(F.when(F.col("direction") == s, F.col("field"))).alias(s) for s in SIDES]
    g = findings.groupBy("case_id").agg((F.countDistinct("field") / fields).alias("coverage")).join(left.groupBy("case_id").agg(*n), "case_id", "left").fillna(0, list(SIDES))
    p, b = F.col("phishing") >= 2, F.col("benign") >= 2
    out = F.when(F.col("coverage") < coverage, "insufficient").when(p & b, "contested").when(p | b, "decided").otherwise("insufficient")
    cause = F.when(p & b, "contested").when((F.col("phishing") + F.col("benign")) == 0, "undirected").otherwise("insufficient support")
    return g.withColumn("outcome", out).withColumn("cause", F.when(out != "decided", cause))


def dispatch_in_order(plan: DataFrame, budget: float) -> DataFrame:
    """EVD10: agents in order, each dispatched if the case's budget still covers its cost; one that is refused costs nothing, so a
    cheaper one after it may still go. A case has a handful of agents."""
    rows = plan.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("pos", "cost"))).alias("plan"))
    done = "array<struct<pos:bigint,spent:double,status:string>>"
    start = F.struct(F.lit(0.0).alias("spent"), F.array().cast(done).alias("done"))

    def step(s: Column, x: Column) -> Column:
        fits = s["spent"] + x["cost"] <= budget
        spent = F.when(fits, s["spent"] + x["cost"]).otherwise(s["spent"])
        one = F.struct(x["pos"].alias("pos"), spent.alias("spent"), F.when(fits, "dispatched").otherwise("not_dispatched").alias("status"))
        return F.struct(spent.alias("spent"), F.array_append(s["done"], one).alias("done"))

    out = rows.select("case_id", F.inline(F.aggregate("plan", start, step)["done"]))
    return out.withColumn("spent", F.col("spent").cast("long" if dict(plan.dtypes)["cost"] in ("int", "bigint") else "double"))


def support_units(nodes: DataFrame, said: DataFrame, truth: DataFrame) -> DataFrame:
    """GRA3: per case how many components its nodes form under the predicted edges and under the true ones, and the difference."""
    out = nodes
    for name, edges in (("unit", said), ("true_unit", truth)):
        for end in ("a", "b"):  # edges between nodes only
            edges = edges.join(nodes.select(F.col("ref").alias(end)), end, "left_semi")
        parts = connected_components(edges, "a", "b").select(F.col("node").alias("ref"), F.col("component").alias(name))
        out = out.join(parts, "ref", "left").withColumn(name, F.coalesce(name, "ref"))
    g = out.groupBy("case_id").agg(F.count_distinct("unit").alias("units"), F.count_distinct("true_unit").alias("true_units"))
    more = F.col("units") - F.col("true_units")
    return g.withColumns({"excess": F.greatest(F.lit(0), more).cast("long"), "lost": F.greatest(F.lit(0), -more).cast("long")})


def submission_objects(messages: DataFrame, keys: list[str], applicable: dict, metadata: tuple) -> DataFrame:
    """EVD1: each message as object ``o1`` and its links, in order, as ``o1:page:n`` under it, with the sources that apply to either
    kind and the instruments these need (a metadata client for ``metadata``, else a browser)."""
    fields = {k: F.array(*map(F.lit, sorted(v))) for k, v in applicable.items()}
    links = messages.select(*keys, F.posexplode(extract_urls(F.coalesce("text", F.lit("")))).alias("n", "link"))
    child = links.select(*keys, F.concat(F.lit("o1:page:"), F.col("n") + 1).alias("object_id"), F.lit("o1").alias("parent_object_id"), "link", fields["link"].alias("s"))
    parent = messages.select(*keys, F.lit("o1").alias("object_id"), F.lit(None).cast("string").alias("parent_object_id"), F.lit(None).cast("string").alias("link"), fields["message"].alias("s"))
    tool = F.array_sort(F.array_distinct(F.transform("s", lambda x: F.when(x.isin(*metadata), "metadata_client").otherwise("headless_browser"))))
    out = parent.unionByName(child)
    return out.select(*keys, "object_id", "parent_object_id", "link", F.array_join("s", ",").alias("sources"), F.array_join(tool, ",").alias("instruments"))


def best_subset(cover: DataFrame, subsets: DataFrame, budget: float, mu: float) -> DataFrame:
    """EVD9: per case, the subset of agents with the best weighted coverage less ``mu`` times its cost, within the budget; ties
    by lower cost, then by subset. ``subsets`` is a fixed small table (a row for each subset and agent)."""
    sizes = subsets.groupBy("subset").agg(F.sum("cost").alias("cost")).where(F.col("cost") <= budget)
    members = F.broadcast(subsets.join(sizes.select("subset"), "subset", "left_semi").select("subset", "agent"))
    got = cover.join(members, "agent").select("case_id", "subset", "trigger", "weight").distinct()
    value = got.groupBy("case_id", "subset").agg(F.sum("weight").alias("covered")).join(F.broadcast(sizes), "subset")
    value = value.withColumn("value", F.col("covered") - mu * F.col("cost"))
    best = F.min_by("subset", F.struct(-F.col("value"), "cost", "subset"))
    return value.groupBy("case_id").agg(best.alias("subset"), F.max("value").alias("value"))


def serve(attempts: DataFrame) -> DataFrame:
    """FIL9: one ordered rule gives the availability; only obtained evidence carries content."""
    status = (
        F.when(F.col("transient") & (F.col("attempt") == 1), "transient failure")
        .when(F.col("inapplicable"), "inapplicable")
        .when(F.col("withheld"), "withheld")
        .when(F.col("failure").isNotNull(), "failed")
        .when(F.col("content").isNull(), "not captured")
        .otherwise("obtained")
    )
    return attempts.withColumn("status", status).withColumn("content", F.when(status == "obtained", F.col("content")))


def withholding_violations(served: DataFrame) -> DataFrame:
    """FIL11: per status, rows that carry content though their evidence was not obtained, and withheld ones that became inapplicable."""
    leaked = F.count_if((F.col("status") != "obtained") & F.col("content").isNotNull())
    turned = F.count_if(F.col("withheld") & (F.col("status") == "inapplicable"))
    return served.groupBy("status").agg(F.count(F.lit(1)).alias("n"), leaked.alias("leaked"), turned.alias("turned"))


def latest_attempt(attempts: DataFrame) -> DataFrame:
    """EVD2: the last attempt of each field decides."""
    return attempts.groupBy("case_id", "field").agg(F.max_by(F.struct("status", "content"), "attempt").alias("x")).select("case_id", "field", "x.*")


def merge_rates(pairs: DataFrame) -> DataFrame:
    """AGG28: per policy and kind of pair, how many there are, the share that was merged, and the errors: merged though independent
    (over), apart though dependent (under)."""
    over, under = F.col("said") & ~F.col("truth"), F.col("truth") & ~F.col("said")
    return pairs.groupBy("policy", "kind").agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.col("said").cast("int")).alias("merged"), F.count_if(over).alias("over"), F.count_if(under).alias("under"))


def availability_gaps(rows: DataFrame, least: float) -> DataFrame:
    """AGG11: per field the share of each label's cases in which it is available, and whether these differ by ``least`` or more.
    ``rows`` has one row a case and field with ``label`` and ``available``."""
    rate = [F.avg(F.when(F.col("label") == s, F.col("available").cast("int"))).alias(s) for s in SIDES]
    return rows.groupBy("field").agg(*rate).withColumn("flagged", F.abs(F.col("phishing") - F.col("benign")) >= least)


def pair_metrics(pairs: DataFrame) -> DataFrame:
    """AGG28, JOIN9: precision, recall and F1 of predicted dependency pairs, from rows with ``truth`` and ``said``."""
    tp, fp = F.count_if(F.col("truth") & F.col("said")), F.count_if(~F.col("truth") & F.col("said"))
    fn = F.count_if(F.col("truth") & ~F.col("said"))
    return pairs.groupBy("policy").agg(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
        F.try_divide(tp.cast("double"), (tp + fp).cast("double")).alias("precision"), F.try_divide(tp.cast("double"), (tp + fn).cast("double")).alias("recall"),
    )


def grounding(quotes: DataFrame, lines: DataFrame) -> DataFrame:
    """TXT9: ``(case_id, ref, outcome)``: a quote that stands in the line it cites is kept; one that cites none is repaired if it
    stands in one line of the case alone, else dropped as a bad line; one that is not in its line is a bad quote."""
    met = quotes.join(lines, "case_id", "left")
    here = F.when(grounded(F.col("quote"), F.col("line")), F.col("i"))
    g = met.groupBy("case_id", "ref", "cited").agg(F.collect_set(here).alias("at"))
    outcome = (
        F.when(F.col("cited").isNotNull() & F.array_contains("at", F.col("cited")), "kept")
        .when(F.col("cited").isNotNull(), "bad quote")
        .when(F.size("at") == 1, "repaired")
        .otherwise("bad line")
    )
    return g.select("case_id", "ref", outcome.alias("outcome"))


def coverage_ceiling(cases: DataFrame, needs: dict[str, list[str]], least: int) -> DataFrame:
    """EVD32: from the ``readable`` fields of a case: agents that can analyse anything, those with all they need, the number of
    fields, whether ``least`` agents make a verdict possible, and the agents to disclose as gaps."""
    some = {a: F.arrays_overlap("readable", F.array(*map(F.lit, n))) for a, n in sorted(needs.items())}
    whole = [F.size(F.array_except(F.array(*map(F.lit, n)), "readable")) == 0 for n in needs.values()]
    count = lambda flags: sum((x.cast("long") for x in flags), F.lit(0).cast("long"))
    gaps = F.array_join(F.array_compact(F.array(*(F.when(~x, a) for a, x in some.items()))), ",")
    n = count(some.values())
    return cases.select("case_id", n.alias("analysable"), count(whole).alias("complete"), F.size("readable").cast("long").alias("fields"), (n >= least).alias("verdict_possible"), gaps.alias("gaps"))


def escalation_yield(states: DataFrame, case: str, round_: str) -> DataFrame:
    """AGG34: one row: the rounds after a case's first state, those that resolved an issue, those that added a finding, and the share that did
    either. States have the arrays ``found`` and ``opened`` (open issues)."""
    w = Window.partitionBy(case).orderBy(round_)
    n = states.select("found", "opened", F.lead("found").over(w).alias("found_next"), F.lead("opened").over(w).alias("open_next")).where("found_next is not null")
    d = n.select(F.size(F.array_except("found_next", "found")).alias("added"), F.size(F.array_except("opened", "open_next")).alias("resolved"))
    good = ((F.col("resolved") > 0) | (F.col("added") > 0)).cast("int")
    return d.agg(F.count(F.lit(1)).alias("rounds"), F.count_if(F.col("resolved") > 0).alias("resolving"), F.count_if(F.col("added") > 0).alias("adding"), F.avg(good).alias("yield"))
