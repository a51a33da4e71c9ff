"""Abstention-aware detection metrics. Every function takes decision rows and grouping columns, and aggregates partially
before any shuffle; an undefined rate is null unless the function says otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PHISHING, BENIGN = "phishing", "benign"


def _count(when: Column) -> Column:
    return F.count_if(when).cast("long")


def rate(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def f1(precision: Column, recall: Column) -> Column:
    return F.try_divide(2 * precision * recall, precision + recall)


def confusion(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """AGG1: tp, fp, tn, fn over substantive verdicts, abstentions by class, and the number of rows."""
    bad, hit, miss = F.col("label") == PHISHING, F.col("verdict") == PHISHING, F.col("verdict") == BENIGN
    none = ~(hit | miss) | F.col("verdict").isNull()
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        _count(bad & hit).alias("tp"),
        _count(~bad & hit).alias("fp"),
        _count(~bad & miss).alias("tn"),
        _count(bad & miss).alias("fn"),
        _count(bad & none).alias("abstained_bad"),
        _count(~bad & none).alias("abstained_good"),
    )


def rates(counts: DataFrame) -> DataFrame:
    """AGG2: null-safe precision, recall, F1, FPR, accuracy, coverage and selective risk from :func:`confusion`."""
    c = F.col
    done = c("tp") + c("fp") + c("tn") + c("fn")
    p, r = rate(c("tp"), c("tp") + c("fp")), rate(c("tp"), c("tp") + c("fn"))
    return counts.withColumns(
        {
            "precision": p,
            "recall": r,
            "f1": f1(p, r),
            "fpr": rate(c("fp"), c("fp") + c("tn")),
            "coverage": rate(done, c("n")),
            "risk": rate(c("fp") + c("fn"), done),
        }
    )


def forced(counts: DataFrame) -> DataFrame:
    """AGG3: each abstention counts as the wrong verdict of its class."""
    c = F.col
    fn, fp = c("fn") + c("abstained_bad"), c("fp") + c("abstained_good")
    p, r = rate(c("tp"), c("tp") + fp), rate(c("tp"), c("tp") + fn)
    return counts.withColumns(
        {
            "forced_fn": fn,
            "forced_fp": fp,
            "forced_recall": r,
            "forced_precision": p,
            "forced_f1": f1(p, r),
            "forced_fpr": rate(fp, fp + c("tn")),
            "forced_accuracy": rate(c("tp") + c("tn"), c("n")),
        }
    )


def zero_default(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """AGG4: the older convention, where an undefined rate is 0."""
    return df.withColumns({x: F.coalesce(F.col(x), F.lit(0.0)) for x in columns})


def full_table(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """AGG5: confusion with TNR and FNR, where anything but a correct verdict is an error."""
    bad, hit = F.col("label") == PHISHING, F.col("verdict") == PHISHING
    right = F.coalesce(F.col("verdict") == F.col("label"), F.lit(False))
    out = df.groupBy(*by).agg(
        _count(bad & right).alias("tp"), _count(bad & ~right).alias("fn"), _count(~bad & right).alias("tn"), _count(~bad & ~right).alias("fp")
    )
    return out.withColumns({"tnr": rate(F.col("tn"), F.col("tn") + F.col("fp")), "fnr": rate(F.col("fn"), F.col("fn") + F.col("tp"))})


def with_subsets(df: DataFrame, cutoff: str) -> DataFrame:
    """FIL13: one row per evaluation subset a case is in: all, its stratum, after the cutoff day, weak score."""
    names = F.array(
        F.lit("all"),
        F.concat(F.lit("stratum:"), F.col("stratum")),
        F.when(F.to_date("ts") > F.lit(cutoff).cast("date"), F.lit("after-cutoff")),
        F.when(F.col("score").isNull(), F.lit("unscored")),
    )
    return df.withColumn("subset", F.explode(F.array_compact(names)))


def fourth_outcome(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """AGG36: verdicts that could not be finalised have a rate of their own and are errors in the forced view."""
    failed = F.col("verdict") == "inconclusive"
    wrong = failed | (F.col("verdict") != F.col("label"))
    return df.groupBy(*by).agg(
        rate(_count(failed), F.count(F.lit(1))).alias("finalization_error_rate"),
        rate(_count(wrong), F.count(F.lit(1))).alias("forced_error"),
        F.count("score").alias("n_scored"),
    )


def prevalence(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """AGG38: per class, how many cases have a score, its mean, and the unscored count."""
    return df.groupBy(*by).agg(
        F.count("score").alias("scored"), F.avg("score").alias("mean_score"), _count(F.col("score").isNull()).alias("unscored")
    )


def index_quantiles(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """AGG14: median and p95 by index (n // 2 and int(.95 n) - 1 of the sorted values), not interpolated.

    Values are counted first, so what is ordered per group is its distinct values."""
    from pyspark.sql import Window

    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("k").over(w)).withColumn("n", F.sum("k").over(Window.partitionBy(*by)))

    def at(index: Column) -> Column:
        return F.min(F.when(F.col("upto") > index, F.col(value)))

    return counts.groupBy(*by).agg(
        at(F.floor(F.col("n") / 2)).alias("median"), at(F.greatest(F.lit(0), F.floor(F.col("n") * 95 / 100) - 1)).alias("p95")
    )


def reliability(df: DataFrame, p: str = "score", bins: int = 10) -> DataFrame:
    """AGG29: bins of the predicted probability (the last is closed), with mean, observed rate and the Brier parts."""
    y = F.when(F.col("label") == PHISHING, 1.0).otherwise(0.0)
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(p).isNotNull()).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("observed"), F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier")
    )


def citation_support(df: DataFrame, full: str) -> DataFrame:
    """AGG25: per arm the share of returned findings that were dropped for a citation that does not hold, and the verdicts that
    differ from the ``full`` arm's on the same case, by who is right."""
    ref = df.where(F.col("arm") == full).select("case_id", F.col("verdict").alias("ref"))
    changed = F.col("verdict") != F.col("ref")
    right = F.col("verdict") == F.col("label")
    flips = df.join(ref, "case_id").groupBy("arm").agg(_count(changed).alias("changed"), _count(changed & right).alias("changed_right"), _count(changed & ~right).alias("changed_wrong"))
    own = df.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.sum("returned").alias("returned"), F.sum("dropped").alias("dropped"))
    own = own.select("arm", "n", "returned", (F.col("dropped") / F.greatest(F.lit(1), "returned")).alias("unsupported"))
    return own.join(flips, "arm")


def recovery_share(log: DataFrame) -> DataFrame:
    """AGG26: of the agents that were ready and not chosen at first (``spare`` of selection events), the share dispatched later,
    with the first choice a page and the shortfalls."""
    first = log.where("kind = 'selection'").select("arm", "case_id", "chosen", "spare")
    later = log.where("kind = 'later_dispatch' and outcome = 'dispatched'").groupBy("arm", "case_id").agg(F.count(F.lit(1)).alias("later"))
    short = log.where("kind = 'dispatch_shortfall'").groupBy("arm").agg(F.count(F.lit(1)).alias("shortfalls"))
    g = first.join(later, ["arm", "case_id"], "left").fillna(0, ["later"]).groupBy("arm")
    g = g.agg(F.count(F.lit(1)).alias("pages"), F.avg("chosen").alias("initial"), F.sum("spare").alias("unselected_ready"), F.sum("later").alias("later_dispatched"))
    return g.withColumn("recovery_share", rate(F.col("later_dispatched"), F.col("unselected_ready"))).join(short, "arm", "left").fillna(0, ["shortfalls"])


def case_roll_up(objects: DataFrame) -> DataFrame:
    """AGG39: objects of a case as one unit: work summed, insufficient if any object is."""
    sums = [F.sum(c).alias(c) for c in ("cost", "tokens", "dispatched", "eligible")]
    return objects.groupBy("case_id").agg(F.count(F.lit(1)).alias("objects"), *sums, F.bool_or("insufficient").alias("insufficient"))


def cost_by_file(spark: SparkSession, paths: str, prices: Sequence[tuple[str, float, float]]) -> DataFrame:
    """AGG15: cases, tokens and cost per priced model and ledger, with totals of each model and of all. ``paths`` is a glob of ledgers, each
    a file or folder of JSON lines; a row's ledger is what the scan says that it came from. Ledgers of failures, broken lines, parts of
    a case and models without a price do not count. Prices are ``(model, in, out)`` a million tokens."""
    kind = "kind string, parent_object_id string, model_id string, input_tokens long, output_tokens long"
    file = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]*\.jsonl)(?:/[^/]*)?$", 1)
    rows = spark.read.text(paths).select(F.from_json("value", kind).alias("e"), file.alias("file")).where("file <> '' and not contains(file, 'failures')")
    rows = rows.where("e.kind = 'decision' and e.parent_object_id is null")
    price = F.broadcast(spark.createDataFrame([*prices], "model string, price_in double, price_out double"))  # a fixed table
    d = rows.select(F.col("e.model_id").alias("model"), "file", *(F.coalesce(F.col(f"e.{c}_tokens"), F.lit(0)).alias(c) for c in ("input", "output"))).join(price, "model")
    usd = F.sum(F.col("input") * F.col("price_in") + F.col("output") * F.col("price_out")) / 1e6
    return d.rollup("model", "file").agg(F.count(F.lit(1)).alias("n"), F.sum("input").alias("tokens_in"), F.sum("output").alias("tokens_out"), usd.alias("usd"))
