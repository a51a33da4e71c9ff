"""Corpus building: filters with reasons, greedy de-duplication, campaign groups, splits, samples and validators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.graph import connected_components
from gleanery.sources.shared import materialize, release


def first_reason(*rules: tuple[str, Column]) -> Column:
    """FIL1: the name of the first rule that holds; null where none does."""
    out = None
    for name, when in rules:
        out = F.when(when, name) if out is None else out.when(when, name)
    return out


def funnel(df: DataFrame, reason: str, by: Sequence[str] = ()) -> DataFrame:
    """AGG16: rows per reason, ``kept`` for those without one."""
    return df.groupBy(*by, F.coalesce(F.col(reason), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """WIN2, WIN3, JOIN21: the first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def greedy_dedup(df: DataFrame, keys: tuple[str, str], order: Sequence[str], max_rounds: int = 100) -> DataFrame:
    """WIN1: in ``order`` (unique), keep a row unless a kept row has its first or its second key. A dropped row blocks none.

    Rounds: undecided rows that come first under both keys are kept, rows that share a key with a kept one are dropped.
    A null key never matches. Each round is written to the shared folder.
    """
    one, two = keys
    rows = df.select(F.struct(*order).alias("o"), one, two)
    open_, kept = materialize(rows, "open"), None
    for _ in range(max_rounds):
        firsts = [F.min("o").over(Window.partitionBy(k)) for k in (one, two)]
        firsts = [F.when(F.col(k).isNull(), F.col("o")).otherwise(f) for k, f in zip((one, two), firsts)]
        now = materialize(open_.withColumns({"f1": firsts[0], "f2": firsts[1]}).where("o = f1 and o = f2").drop("f1", "f2"), "kept")
        kept = now if kept is None else kept.unionByName(now)
        left = open_.join(now.select("o"), "o", "left_anti")
        left = left.join(now.select(one).where(F.col(one).isNotNull()), one, "left_anti")
        left = materialize(left.join(now.select(two).where(F.col(two).isNotNull()), two, "left_anti"), "open")
        release(open_)
        open_ = left
        if left.isEmpty():
            break
    else:
        raise RuntimeError(f"de-duplication did not end in {max_rounds} rounds")
    return df.join(kept.select("o.*"), list(order), "left_semi")


def campaign_groups(df: DataFrame, row: str, keys: Sequence[str]) -> DataFrame:
    """GRA1: ``(row, grp)``: components over rows and their keys, joined row to key, never row to row. Null keys link
    nothing; the group is named by its smallest row."""
    edges = None
    for k in keys:
        e = df.where(F.col(k).isNotNull()).select(F.concat(F.lit("row:"), row).alias("a"), F.concat(F.lit(f"{k}:"), k).alias("b"))
        edges = e if edges is None else edges.unionByName(e)
    parts = connected_components(edges, "a", "b").where("startswith(node, 'row:')")
    parts = parts.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    # the smallest row of each component, whatever the keys' names sort like
    least = parts.groupBy("_c").agg(F.min("_n").alias("_g"))
    named = parts.join(least, "_c").select("_n", "_g")
    name = F.concat(F.lit("row:"), F.col(row))
    return df.join(named, name == F.col("_n"), "left").select(row, F.coalesce("_g", name).alias("grp"))


def hash_order(*parts: Column | str, seed: str = "") -> Column:
    """The order of seeded samples: the hash of the seed and the parts."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]), 256)


def balanced_sample(df: DataFrame, by: Sequence[str], key: str, n: int, seed: str, skip: int = 0) -> DataFrame:
    """WIN4, WIN5, WIN24: ``n`` rows per stratum in hash order, after the first ``skip``. Spark prunes each group to its
    first rows before the shuffle."""
    w = Window.partitionBy(*by).orderBy(hash_order(*by, key, seed=seed))
    out = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= skip + n)
    return out.where(F.col("rank") > skip) if skip else out


def refill_sample(df: DataFrame, kept: DataFrame, by: Sequence[str], key: str, n: int, seed: str) -> DataFrame:
    """JOIN19: earlier picks stay, only the shortfall is drawn."""
    flagged = df.join(kept.select(key).distinct().withColumn("kept", F.lit(True)), key, "left")
    w = Window.partitionBy(*by).orderBy(F.col("kept").isNull(), hash_order(*by, key, seed=seed))
    return flagged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).withColumn("kept", F.col("kept").isNotNull())


def block_groups(df: DataFrame, used: DataFrame, group: str) -> DataFrame:
    """JOIN5, JOIN6: drop every group with a member among the used ones."""
    return df.join(used.select(group).distinct(), group, "left_anti")


def exclude_any(df: DataFrame, used: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JOIN20: drop rows that share any of the keys with used rows."""
    for k in keys:
        df = df.join(used.where(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti")
    return df


def leaks(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """AGG8: keys found in more than one split."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    return g.where(F.size("splits") > 1).select(key, F.array_join("splits", ",").alias("splits"))


def summary(df: DataFrame) -> DataFrame:
    """AGG7: rows, groups and day range per source and split, with totals by rollup."""
    return df.rollup("stratum", "split").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("grp").alias("groups"), F.min("observed").alias("first"), F.max("observed").alias("last")
    )


def manifest_problems(df: DataFrame, splits: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """AGG9: rows outside the vocabularies, repeated case ids, and splits with a single class."""
    bad = df.where(~F.col("split").isin(*splits) | ~F.col("label").isin(*labels)).groupBy().count().select(F.lit("vocabulary").alias("problem"), F.col("count").alias("n"))
    twice = df.groupBy("case_id").count().where("count > 1").groupBy().count().select(F.lit("repeated id").alias("problem"), F.col("count").alias("n"))
    single = df.groupBy("split").agg(F.countDistinct("label").alias("k")).where("k < 2").groupBy().count().select(F.lit("single class").alias("problem"), F.col("count").alias("n"))
    return bad.unionByName(twice).unionByName(single)


def chronology(df: DataFrame, chain: Sequence[tuple[str, str]]) -> DataFrame:
    """AGG10: for each pair of splits, how many rows of the later one are not after the earlier one's last day."""
    last = df.groupBy("split").agg(F.max("observed").alias("last"))
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("earlier"), F.lit(b).alias("later")) for a, b in chain]))
    table = df.sparkSession.range(1).select(pairs.alias("p")).select("p.*")
    ends = table.join(last, F.col("earlier") == F.col("split")).select("earlier", "later", "last")
    hit = df.join(F.broadcast(ends), F.col("split") == F.col("later"))
    return hit.groupBy("earlier", "later").agg(F.count_if(F.col("observed") <= F.col("last")).alias("offending"))


def cutoff_search(df: DataFrame, need_before: int, need_after: int) -> DataFrame:
    """WIN6: the day that maximises the smaller relative slack of rows up to it and after it, per label's worst; one row.

    Days are counted first; only the table of days is ordered."""
    days = df.groupBy("observed", "label").agg(F.count(F.lit(1)).alias("k"))
    grid = days.select("observed").distinct().crossJoin(days.select("label").distinct())
    days = grid.join(days, ["observed", "label"], "left").fillna(0, ["k"])
    w = Window.partitionBy("label").orderBy("observed").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("k").over(w)
    slack = days.select("observed", (upto / need_before).alias("a"), ((F.sum("k").over(Window.partitionBy("label")) - upto) / need_after).alias("b"))
    worst = slack.groupBy("observed").agg(F.min(F.least("a", "b")).alias("slack"))
    return worst.agg(F.min_by("observed", F.struct(-F.col("slack"), F.col("observed"))).alias("cutoff"), F.max("slack").alias("slack"))


def folds(df: DataFrame, group: str, k: int, seed: str) -> DataFrame:
    """WIN14: whole groups dealt to ``k`` folds in hash order. Groups are numbered inside stretches of the hash, whose sizes are counted
    first, so no task orders all groups. A null group is in no fold."""
    g = df.select(group).where(F.col(group).isNotNull()).distinct().withColumn("_h", hash_order(group, seed=seed)).withColumn("_stretch", F.substring("_h", 1, 2))
    sizes = g.groupBy("_stretch").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(sizes.select("_stretch", F.coalesce(before, F.lit(0)).alias("_start")))  # 256 rows at most
    no = F.col("_start") + F.row_number().over(Window.partitionBy("_stretch").orderBy("_h", group)) - 1
    dealt = g.join(starts, "_stretch").select(group, (no % k).cast("int").alias("fold"))
    return df.join(dealt, group)


def after_cutoff(day: Column, models: Sequence[tuple[str, str]]) -> Column:
    """DAT2: per model, whether the day's month lies after its cutoff month; null for an unknown day."""
    month = F.date_format(day, "yyyy-MM")
    return F.map_from_arrays(F.array(*[F.lit(m) for m, _ in models]), F.array(*[month > F.lit(c) for _, c in models]))


def swap_fields(cases: DataFrame, group: Sequence[str], inside: Sequence[str], seed: str) -> DataFrame:
    """JOIN7: each case with the fields of ``group`` from a donor of the other label, everything else its own; a column ``donor``.

    Cases and donors hold every field of the group. Donors are numbered in a seeded order inside each block of ``inside`` and
    label, and a case takes the one whose number its own hash gives, so no pairs are formed but those taken.
    """
    full = cases.where(" and ".join(f"{c} is not null" for c in group))
    block = Window.partitionBy(*inside, "label")
    no = F.row_number().over(block.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "case_id")), "case_id")) - 1
    donors = full.select(*inside, F.col("label").alias("_label"), F.col("case_id").alias("donor"), *(F.col(c).alias(f"_{c}") for c in group), no.alias("_no"))
    sizes = full.groupBy(*inside, F.col("label").alias("_label")).agg(F.count(F.lit(1)).alias("_k"))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("b"), F.lit(seed), "case_id")), 1, 8), 16, 10).cast("long")
    asked = full.join(sizes, list(inside)).where("label <> _label").withColumn("_no", draw % F.col("_k"))
    met = asked.join(donors, [*inside, "_label", "_no"])
    return met.select(*(F.col(f"_{c}").alias(c) if c in group else F.col(c) for c in cases.columns), "donor")


def append_new(rows: DataFrame, path: str, keys: Sequence[str], by: str, failed: Column) -> None:
    """SNK3: append the rows whose keys a sink does not hold yet, by partition, failures to a sink of their own. A run that is
    repeated after a loss writes only what is missing."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    kind = rows.withColumn("_failed", F.coalesce(failed, F.lit(False)))
    for name, when in (("done", ~F.col("_failed")), ("failed", F.col("_failed"))):
        seen = None
        for other in ("done", "failed"):
            if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{other}")):
                held = spark.read.schema(rows.schema).parquet(f"{path}/{other}").select(*keys)
                seen = held if seen is None else seen.unionByName(held)
        new = kind.where(when).drop("_failed")
        new = new if seen is None else new.join(seen.distinct(), list(keys), "left_anti")
        new.write.mode("append").partitionBy(by).parquet(f"{path}/{name}")


def extend_manifest(manifest: DataFrame, new: DataFrame) -> DataFrame:
    """SET2: the manifest and new rows; raises if it has one of their splits already."""
    both = new.select("split").distinct().join(manifest.select("split").distinct(), "split", "left_semi").limit(1).collect()
    if both:
        raise ValueError(f"the manifest already has split {both[0][0]}")
    return manifest.unionByName(new)
